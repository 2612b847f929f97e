"""Rules against source text.

A file meets the rules in three narrow steps, without a shuffle:

1. substring tests over the folded text pick the rules that can match at all;
2. each picked rule runs as a regex, by line and over the whole text;
3. the hits leave as small rows with their context, and the text stays behind.

The rule set is one constant array, so the plan has the same size for ten rules or a thousand.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vetgrid.functions.constants import constant
from vetgrid.functions.regex import (
    can_cross_lines,
    fold,
    glob_match,
    required_literals,
    to_java,
)
from vetgrid.functions.text import (
    MATCH_END,
    MATCH_START,
    adjust_severity,
    file_name,
    fingerprint,
    lines_of,
    mark_matches,
    snippet,
    suppression_codes,
)
from vetgrid.rules.catalog import Rule

_FORMS = "struct<plain: string, full: string>"
_RULE_TYPE = (
    "array<struct<id: string, position: int, globs: array<int>, literals: array<array<string>>, "
    f"pattern: {_FORMS}, exclude: {_FORMS}, crosses: boolean>>"
)
_DIMENSION_TYPE = (
    "array<struct<rule_id: string, owasp_category: string, severity: string, title: string, "
    "description: string, suggested_fix: string>>"
)


def _rule_array(rules: Sequence[Rule], globs: Sequence[str]) -> Column:
    """What the search needs of each rule, as a constant."""
    def forms(pattern: str | None, flags: str) -> dict | None:
        """One form for ASCII text, one for any text."""
        if pattern is None:
            return None
        return {"plain": to_java(pattern, flags, ascii_text=True), "full": to_java(pattern, flags)}

    return constant([
        {
            "id": r.id,
            "position": i,
            "globs": [globs.index(g) for g in r.globs],
            "literals": required_literals(r.pattern, r.flags),
            "pattern": forms(r.pattern, r.flags),
            "exclude": forms(r.exclude_pattern, r.flags),
            "crosses": can_cross_lines(r.pattern),
        }
        for i, r in enumerate(rules)
    ], _RULE_TYPE)


def _rule_dimension(rules: Sequence[Rule]) -> Column:
    return constant([
        {
            "rule_id": r.id, "owasp_category": r.owasp_category, "severity": r.severity,
            "title": r.title, "description": r.description, "suggested_fix": r.suggested_fix,
        }
        for r in rules
    ], _DIMENSION_TYPE)


def _candidates(base: DataFrame, rules: Sequence[Rule], keep: Sequence[str], wanted: str | None) -> DataFrame:
    """One row for each file and rule that can match there: ``(keep, _text, _rule)``.

    ``explode`` drops the files without candidates, evaluates the tests once, and keeps later
    predicates from being pushed below it, where they would evaluate them again.
    """
    globs = sorted({g for r in rules for g in r.globs})
    file_globs = F.array_compact(F.array(*[
        F.when(glob_match(F.col("_name"), g), F.lit(i)) for i, g in enumerate(globs)]))
    named = base.withColumn("_globs", file_globs)

    def may_match(rule: Column) -> Column:
        asked = F.lit(True) if wanted is None else F.array_contains(F.col("_wanted"), rule["id"])
        return asked & F.arrays_overlap(rule["globs"], F.col("_globs")) & F.forall(
            rule["literals"],
            lambda group: F.exists(group, lambda text: F.contains(F.col("_folded"), text)),
        )

    picked = F.filter(_rule_array(rules, globs), may_match)
    return named.select(*keep, "_text", F.explode(picked).alias("_rule"))


def _found(pattern: Column, text: Column) -> Column:
    # Unlike ``rlike``, this keeps the compiled form of a pattern that is no literal.
    return F.regexp_instr(text, pattern) > 0


def scan_text(
    files: DataFrame,
    rules: Sequence[Rule],
    *,
    keep: Sequence[str] = ("path",),
    path: str = "path",
    content: str = "content",
    context_lines: tuple[int, int] | None = None,
    suppressed: bool = False,
    wanted: str | None = None,
) -> DataFrame:
    """Matches of ``rules`` in the text of each row, one row for each rule and line.

    Result: the ``keep`` columns, the rule's columns, ``line_number``, ``line_content``,
    ``code_snippet`` and, on request, ``context`` with a wider window. Lines switched off by a
    comment are left out, or are all that is returned if ``suppressed`` is set. ``wanted`` names a column
    with the ids of the rules that are run on the row.
    """
    if not rules:
        raise ValueError("no rules to scan with")
    base = files.select(
        *keep,
        file_name(F.col(path)).alias("_name"),
        F.col(content).alias("_text"),
        fold(F.col(content)).alias("_folded"),
        *([] if wanted is None else [F.col(wanted).alias("_wanted")]),
    )
    is_ascii = F.octet_length("_text") == F.length("_text")

    def form(name: str) -> Column:
        return F.when(is_ascii, F.col(f"_rule.{name}.plain")).otherwise(F.col(f"_rule.{name}.full"))

    candidates = _candidates(base, rules, keep, wanted).select(
        *keep, "_text", F.col("_rule.position").alias("_position"),
        F.col("_rule.crosses").alias("_crosses"),
        form("pattern").alias("_pattern"), form("exclude").alias("_exclude"))
    pattern, exclude = F.col("_pattern"), F.col("_exclude")
    # A start mark in a line means that a match of the whole-text search begins there.
    marks = F.when(
        F.col("_crosses"), lines_of(mark_matches(F.col("_text"), pattern))
    ).otherwise(F.array().cast("array<string>"))
    split = candidates.select(
        *keep, "_position", "_pattern", "_exclude", lines_of(F.col("_text")).alias("_lines"),
        marks.alias("_marks"))
    lines = F.col("_lines")

    tested = F.transform(
        F.arrays_zip(lines.alias("line"), F.col("_marks").alias("mark")),
        lambda z, i: F.struct(
            (i + 1).alias("line_number"), z["line"].alias("line"), z["mark"].alias("mark"),
            _found(pattern, z["line"]).alias("in_line")),
    )
    hit = F.filter(tested, lambda t: (
        t["in_line"] | F.coalesce(F.contains(t["mark"], F.lit(MATCH_START)), F.lit(False))
    ) & (exclude.isNull() | ~_found(exclude, t["line"])))

    def in_context(t: Column) -> Column:
        n = t["line_number"]
        begun = F.regexp_extract(t["mark"], f"{MATCH_START}([^{MATCH_END}]*)", 1)
        fields = [
            n.alias("line_number"),
            F.when(t["in_line"], t["line"]).otherwise(begun).alias("line_content"),
            t["line"].alias("line"),
            F.when(n > 1, F.element_at(lines, F.greatest(n - 1, F.lit(1)))).alias("above"),
            snippet(lines, n).alias("code_snippet"),
        ]
        if context_lines is not None:
            fields.append(snippet(lines, n, *context_lines).alias("context"))
        return F.struct(*fields)

    hits = split.select(
        *keep, "_position",
        F.explode(F.transform(hit, in_context)).alias("h"))
    codes = F.array_union(
        suppression_codes(F.col("h.line")),
        F.coalesce(suppression_codes(F.col("h.above")), F.array().cast("array<string>")),
    )
    rows = hits.select(
        *keep,
        F.element_at(_rule_dimension(rules), F.col("_position") + 1).alias("r"),
        "h.*",
        codes.alias("_codes"),
    )
    off = F.arrays_overlap("_codes", F.array("r.rule_id", "r.owasp_category"))
    columns = [*keep, "r.*", "line_number", "line_content", "code_snippet"]
    if context_lines is not None:
        columns.append("context")
    return rows.filter(off if suppressed else ~off).select(*columns)


def to_findings(
    matches: DataFrame,
    *,
    scan_id: str,
    surfaces: DataFrame | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Finding candidates from matches: fingerprint and severity for path and project.

    ``surfaces`` is ``(project, surface)``; the join happens on the matches, never on the files.
    """
    if surfaces is not None:
        matches = matches.join(surfaces.select("project", "surface"), "project", "left")
    path = F.col("path")
    return matches.select(
        F.lit(scan_id).alias("scan_id"),
        path.alias("file_path"),
        "line_number",
        "rule_id",
        fingerprint(path, F.col("line_number"), F.col("rule_id")).alias("fingerprint"),
        "owasp_category",
        adjust_severity(
            F.col("severity"), path, F.col("surface") if surfaces is not None else None
        ).alias("severity"),
        "title",
        "description",
        "code_snippet",
        "suggested_fix",
        F.lit(None).cast("double").alias("confidence"),
        *extra,
    )
