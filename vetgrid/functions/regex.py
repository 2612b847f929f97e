"""Regex text: Python patterns to Java ones, globs to predicates, literals a match must hold."""

from __future__ import annotations

import re
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUANTIFIER = re.compile(r"\{\d+(?:,\d*)?\}")


def to_java(pattern: str, flags: str = "", *, ascii_text: bool = False) -> str:
    """Java form of a Python pattern.

    ``d`` makes the line feed the only line end and ``U`` gives the shorthand classes their
    Unicode meaning, as in Python; it costs time and is left out for text known to be ASCII,
    where it makes no difference. Braces that are no quantifier are escaped, as are opening
    brackets and ``&&`` inside a class, and named groups are respelled.
    """
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append("\\z" if pattern[i + 1] == "Z" and not in_class else pattern[i:i + 2])
            i += 2
            continue
        if in_class:
            if c == "]":
                in_class = False
            elif c in "[&":
                c = "\\" + c
            out.append(c)
        elif c == "[":
            in_class = True
            out.append(c)
            for prefix in ("^", "]"):
                if pattern.startswith(prefix, i + 1):
                    out.append("\\]" if prefix == "]" else prefix)
                    i += 1
        elif c == "{":
            m = _QUANTIFIER.match(pattern, i)
            if pattern.startswith("{,", i) and re.match(r"\{,\d+\}", pattern[i:]):
                out.append("{0")
            else:
                out.append(c if m else "\\{")
        elif pattern.startswith("(?P<", i):
            out.append("(?<")
            i += 3
        elif pattern.startswith("(?P=", i):
            end = pattern.index(")", i)
            out.append("\\k<" + pattern[i + 4:end] + ">")
            i = end
        else:
            out.append(c)
        i += 1
    letters = "d" + ("m" if "m" in flags else "") + ("s" if "s" in flags else "")
    letters += "i" if "i" in flags else ""
    if not ascii_text:
        letters += "uU" if "i" in flags else "U"
    return f"(?{letters})" + "".join(out)


def is_valid(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


# Tokens that match at least one character which may be a line feed, or that look across one.
_LINE_CROSSING_TEXT = re.compile(r"\\[sA-Znrtfvxu0-9]|\[\^|\(\?[a-z]*s|[\x00-\x1f]")


def can_cross_lines(pattern: str) -> bool:
    """False only if no part of the pattern, lookarounds included, can consume a line feed.

    For such a pattern a search in each line finds exactly the lines on which a match in the
    whole text starts, so the whole-text pass adds nothing.
    """
    return bool(_LINE_CROSSING_TEXT.search(pattern))


def glob_regex(glob: str) -> str:
    """Shell glob (``*``, ``?``, ``[..]``, ``[!..]``) as a Java regex over the whole string."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            first = i + 2 if glob[i + 1:i + 2] == "!" else i + 1
            end = glob.find("]", first + 1)
            if end < 0:
                out.append("\\[")
            else:
                body = re.sub(r"([\\\[\]&^])", r"\\\1", glob[first:end])
                out.append("[" + ("^" if first == i + 2 else "") + body + "]")
                i = end
        else:
            out.append(re.sub(r"([^\w/ -])", r"\\\1", c))
        i += 1
    return "^(?s:" + "".join(out) + ")$(?!\\n)"


# A run of characters that stand for themselves, a closed set, or one character.
_GLOB_TOKENS = r"(?s)[\w/ -]+|\[(?:!.|[^!])[^\]]*\]|."


def glob_regex_of(glob: Column) -> Column:
    """A shell glob that is held in a column, as a Java regex over the whole string.

    The glob is cut into tokens once, so a long line costs time in proportion to its length. Every text
    is a glob: an unclosed bracket stands for itself, a range that runs backwards holds nothing.
    """
    def regex(token: Column) -> Column:
        return (F.when(token == "*", ".*").when(token == "?", ".")
                .when(F.startswith(token, F.lit("[")) & (F.length(token) > 1),
                      _set_regex(F.substring(token, F.lit(2), F.length(token) - 2)))
                .otherwise(F.regexp_replace(token, r"([^\w/ -])", r"\\$1")))

    tokens = F.regexp_extract_all(glob, F.lit(_GLOB_TOKENS), F.lit(0))
    return F.concat(F.lit("^(?s:"), F.array_join(F.transform(tokens, regex), ""), F.lit(")$(?!\\n)"))


def glob_head(glob: Column) -> Column:
    """The text before the first wildcard or bracket: whatever matches the glob starts with it."""
    return F.regexp_extract(glob, r"^[^*?\[]*", 0)


def _set_regex(members: Column) -> Column:
    """What stands between brackets, ``!`` first for the complement, as a Java character class."""
    negated = F.startswith(members, F.lit("!"))
    listed = F.when(negated, F.substring(members, 2, 1 << 30)).otherwise(members)

    def escaped(c: Column) -> Column:
        return F.regexp_replace(c, r"([\\\[\]&^-])", r"\\$1")

    def member(m: Column) -> Column:
        first, last = F.substring(m, 1, 1), F.substring(m, 3, 1)
        span = F.concat(escaped(first), F.lit("-"), escaped(last))
        return F.when(F.length(m) == 1, escaped(m)).when(first <= last, span).otherwise("")

    parts = F.regexp_extract_all(listed, F.lit("(?s).-.|."), F.lit(0))
    body = F.array_join(F.transform(parts, member), "")
    return (F.when(body != "", F.concat(F.lit("["), F.when(negated, "^").otherwise(""), body, F.lit("]")))
            .when(negated, ".").otherwise("(?!)"))


def glob_match(column: Column, glob: str) -> Column:
    """Glob test, as a plain string predicate where the glob has a fixed head or tail."""
    if glob == "*":
        return column.isNotNull()
    plain = not set(glob[1:-1]) & set("*?[")
    if plain and glob[0] == "*" and glob[-1] not in "*?]":
        return column.endswith(glob[1:])
    if plain and glob[-1] == "*" and glob[0] not in "*?[":
        return column.startswith(glob[:-1])
    if not set(glob) & set("*?["):
        return column == glob
    return column.rlike(glob_regex(glob))


def fold(column: Column) -> Column:
    """Lower case, with the four characters that regex engines treat as ASCII letters."""
    for odd, plain in (("\u017f", "s"), ("\u212a", "k"), ("\u0131", "i"), ("\u0130", "i")):
        column = F.replace(column, F.lit(odd), F.lit(plain))
    return F.lower(column)


def required_literals(pattern: str, flags: str = "", keep: int = 3) -> list[tuple[str, ...]]:
    """Literals of which every match holds at least one from each returned group.

    The texts are lower case and are to be looked up in ``fold``-ed text. The groups are a
    necessary condition only; an empty list means nothing is known. The longest ``keep``
    groups are returned, the most selective first.
    """
    parsed = sre_parser.parse(pattern, re.MULTILINE if "m" in flags else 0)
    groups = [g for g in _literal_groups(parsed) if all(g)]
    # Short texts are common in code, and many alternatives take many searches.
    groups = sorted(set(groups), key=lambda g: (
        min(map(len, g)) < 3, len(g), -min(map(len, g)), g))
    return groups[:keep]


def _literal_groups(sequence) -> list[tuple[str, ...]]:
    groups: list[tuple[str, ...]] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            groups.append(("".join(run).lower(),))
            run.clear()

    for op, arg in sequence:
        if op is sre.LITERAL and arg < 128:
            run.append(chr(arg))
            continue
        flush()
        if op is sre.SUBPATTERN:
            groups += _literal_groups(arg[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
            groups += _literal_groups(arg[2])
        elif op is sre.BRANCH:
            best = []
            for branch in arg[1]:
                found = _literal_groups(branch)
                if not found:
                    break
                best.append(max(found, key=lambda g: min(map(len, g))))
            else:
                groups.append(_without_longer_forms({text for g in best for text in g}))
    flush()
    return groups


def _without_longer_forms(texts: set[str]) -> tuple[str, ...]:
    return tuple(sorted(t for t in texts if not any(o != t and o in t for o in texts)))
