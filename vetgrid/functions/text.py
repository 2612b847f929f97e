"""Column functions over source text, paths and severities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vetgrid.functions.constants import constant
from vetgrid.functions.regex import to_java
from vetgrid.rules.catalog import CATEGORIES, SEVERITIES

# Private-use characters that mark the start and end of a match inside a text.
MATCH_START = "\ue000"
MATCH_END = "\ue001"


def lines_of(content: Column) -> Column:
    """Lines of a text; only the line feed ends a line."""
    return F.split(content, "\n", -1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    """File name without its last suffix; a leading dot starts no suffix."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def file_suffix(path: Column) -> Column:
    return F.regexp_extract(file_name(path), r"(?<=.)(\.[^.]+)$", 1)


def strip(column: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(column, r"(?U)^\s+|\s+$", "")


def utf8(content: Column) -> Column:
    """Bytes as text, invalid sequences replaced."""
    return F.make_valid_utf8(content.cast("string"))


def mark_matches(content: Column, java_pattern: Column | str) -> Column:
    """The text with every non-overlapping match put between the two marks.

    The text keeps its line feeds, so line ``n`` of the result holds a start mark exactly if a
    match starts on line ``n`` of the input.
    """
    clean = F.replace(content, F.lit(MATCH_START), F.lit("?"))
    clean = F.replace(clean, F.lit(MATCH_END), F.lit("?"))
    pattern = F.lit(java_pattern) if isinstance(java_pattern, str) else java_pattern
    return F.regexp_replace(clean, pattern, F.lit(MATCH_START + "$0" + MATCH_END))


def match_lines(content: Column, pattern: str, flags: str = "im") -> Column:
    """Numbers of the lines on which matches of a Python pattern start."""
    marked = lines_of(mark_matches(content, to_java(pattern, flags)))
    numbered = F.transform(
        marked, lambda text, i: F.when(F.contains(text, F.lit(MATCH_START)), i + 1)
    )
    return F.array_compact(numbered)


def snippet(lines: Column, line_number: Column, before: int = 1, after: int = 2) -> Column:
    """Numbered lines around a line, ``"%4d | text"`` each."""
    first = F.greatest(line_number - before, F.lit(1))
    last = F.least(line_number + after, F.size(lines))
    window = F.slice(lines, first, F.greatest(last - first + 1, F.lit(0)))
    return F.array_join(
        F.transform(window, lambda text, i: F.format_string("%4d | %s", first + i, text)), "\n"
    )


def suppression_codes(line: Column) -> Column:
    """Rule ids and categories named in an inline suppression comment."""
    # Fixed value: the comment form that switches rules off.
    names = F.regexp_extract(line, r"(?dU)#\s*owasp-ignore:\s*([\w\-,\s]+)", 1)
    return F.transform(F.split(names, ","), strip)


def _scale() -> Column:
    return constant(SEVERITIES, "array<string>")


def severity_rank(severity: Column) -> Column:
    """1 (low) to 4 (critical); 0 for unknown words."""
    return F.array_position(_scale(), severity).cast("int")


def shift_severity(severity: Column, delta: Column | int) -> Column:
    """Severity moved by ``delta`` levels within the scale; unknown words pass through."""
    rank = severity_rank(severity)
    moved = F.greatest(F.lit(1), F.least(F.lit(len(SEVERITIES)), rank + delta))
    return F.when(rank > 0, F.element_at(_scale(), moved)).otherwise(severity)


# Paths of lower risk.
_MIGRATION_PATHS = r"(?i)(?:^|/)migrations?/|(?:^|/)alembic/"
_TEST_PATHS = (
    r"(?i)(?:^|/)tests?/|(?:^|/)test_[^/]+\.py$|_test\.py$|(?:^|/)conftest\.py$|(?:^|/)fixtures?/"
)


def adjust_severity(severity: Column, path: Column, surface: Column | None = None) -> Column:
    """Severity for a path: migrations are low, tests one level down, local projects one more."""
    by_path = (
        F.when(severity_rank(severity) == 0, severity)
        .when(path.rlike(_MIGRATION_PATHS), F.lit("low"))
        .when(path.rlike(_TEST_PATHS), shift_severity(severity, -1))
        .otherwise(severity)
    )
    if surface is None:
        return by_path
    return F.when(surface == "local", shift_severity(by_path, -1)).otherwise(by_path)


def fingerprint(path: Column, line_number: Column, rule_id: Column) -> Column:
    """Identity of a finding; NULL without a rule. A missing line prints as ``None``."""
    line = F.coalesce(line_number.cast("string"), F.lit("None"))
    return F.when(
        rule_id.isNotNull() & (rule_id != ""), F.sha2(F.concat_ws(":", path, line, rule_id), 256)
    )


def category_label(category: Column, default: Column | None = None) -> Column:
    known = F.array_position(constant(list(CATEGORIES), "array<string>"), category)
    label = F.element_at(constant(list(CATEGORIES.values()), "array<string>"), known.cast("int"))
    return F.coalesce(F.when(known > 0, label), default if default is not None else category)


def slug(title: Column) -> Column:
    dashed = F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, 40)


def display_time(text: Column) -> Column:
    """ISO time text as ``YYYY-MM-DD HH:MM UTC``; other text passes through."""
    shown = F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd HH:mm 'UTC'")
    return F.coalesce(shown, text, F.lit(""))


def sarif_level(severity: Column) -> Column:
    return (
        F.when(severity.isin("critical", "high"), "error")
        .when(severity == "low", "note")
        .otherwise("warning")
    )


def setting_value(content: Column, name: str) -> Column:
    """First value assigned to ``name`` at the start of a line, stripped; NULL if there is none."""
    raw = F.regexp_extract(content, rf"(?dmU)^\s*{name}\s*=\s*(.+?)$", 1)
    return strip(F.nullif(raw, F.lit("")))


def setting_is(value: Column, word: str) -> Column:
    """True if a setting value is ``word``, trailing commas aside; never NULL."""
    return F.coalesce(F.regexp_replace(value, ",+$", "") == word, F.lit(False))


def has_any(column: Column, words: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for word in words:
        test = test | F.contains(column, F.lit(word))
    return test


def count_present(column: Column, words: tuple[str, ...]) -> Column:
    total = F.lit(0)
    for word in words:
        total = total + F.contains(column, F.lit(word)).cast("int")
    return total


def percent(ratio: Column) -> Column:
    """Ratio as whole percent, ties to even, like ``85%``."""
    return F.concat(F.bround(ratio * 100, 0).cast("int").cast("string"), F.lit("%"))
