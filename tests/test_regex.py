from __future__ import annotations

import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.test_rules import CASES
from vetgrid.functions.regex import (
    can_cross_lines,
    fold,
    glob_match,
    glob_regex_of,
    is_valid,
    required_literals,
    to_java,
)
from vetgrid.functions.text import match_lines
from vetgrid.rules import ALL_RULES


def test_literals_are_necessary():
    for rule in ALL_RULES:
        text = CASES[rule.id][1].lower()
        for group in required_literals(rule.pattern, rule.flags, keep=99):
            assert any(word in text for word in group), (rule.id, group)


@pytest.mark.parametrize("pattern, expected", [
    (r"abc\d+def", [("abc",), ("def",)]),
    (r"(?:foo|bar)x?", [("bar", "foo")]),
    (r"(?:foo|b?)", []),
    (r"x{0,3}yy*", [("y",)]),
    (r"(ab)+(cd)*", [("ab",)]),
    (r"post(?:gres|gresql)://", [("postgres",), ("://",)]),
    (r"(?!not)[abc]", []),
    (r"(?<=pre)post", [("post",)]),
    (r"Straße", [("stra",), ("e",)]),
])
def test_required_literals(pattern, expected):
    assert sorted(required_literals(pattern, "i", keep=99)) == sorted(expected)


def test_fold_covers_case_insensitive_letters(one):
    for odd in "\u017f\u212a\u0131\u0130SKI":
        plain = one(fold(F.col("t")), t=odd)
        assert re.fullmatch(plain, odd, re.I), odd


def test_line_crossing():
    assert not can_cross_lines(r"hashlib\.md5\(")
    assert not can_cross_lines(r"AKIA[0-9A-Z]{16}")
    for pattern in (r"a\s*b", r"[^x]", r"(?s).", "a\nb", r"\W", r"a\nb", r"[\x00-\x20]"):
        assert can_cross_lines(pattern), pattern


@pytest.mark.parametrize("pattern, text, hit", [
    (r"{a}", "{a}", True),
    (r"a{2}", "aa", True),
    (r"a{,2}b", "aab", True),
    (r"[[]x", "[x", True),
    (r"[]x]", "]", True),
    (r"[^]]", "]", False),
    (r"(?P<q>['\"])x(?P=q)", "'x'", True),
    (r"(?P<q>['\"])x(?P=q)", "'x\"", False),
    (r"x\Z", "x\n", False),
    (r"[a&&b]", "&", True),
    (r"^b$", "a\nb\nc", True),
    (r"a.b", "a\rb", True),
    (r"a\sb", "a\u00a0b", True),
    (r"\bé\b", "é", True),
])
def test_java_form(one, pattern, text, hit):
    assert bool(re.search(pattern, text, re.I | re.M)) is hit
    assert one(F.col("t").rlike(to_java(pattern, "im")), t=text) is hit


def test_validity():
    assert is_valid("a") and not is_valid("(")


NAMES = ["a.ts", "a.tsx", "a.json", "route.ts", "x/route.ts", "a.b", "é.py", "a+b.py", "[x].py",
         "docker-compose.yml", "a\nb.py", "ab", "!.py", "-.py", "^a"]
GLOBS = ["*", "*.py", "*.[jt]s", "*.[jt]sx", "route.*", "docker-compose*", "?.ts", "[!a]*", "[x",
         "a.b", "*a*", "x/*", "[a-c]?.py", "[!^]*", "a+b.py"]


def test_globs(spark):
    rows = spark.createDataFrame([(n,) for n in NAMES], "n STRING")
    for glob in GLOBS:
        got = {r.n for r in rows.filter(glob_match(F.col("n"), glob)).collect()}
        assert got == {n for n in NAMES if fnmatch.fnmatchcase(n, glob)}, glob


def test_globs_held_in_a_column(spark):
    """Any text is a glob; also those that no regex engine would take as they are."""
    draw = random.Random(6)
    odd = ["foo[bar", "[z-a].py", "[]", "[!]", "[]]", "[!]]", "[]-a]", "a[b-", "[[]", "[a-b-c]", "[--/]", "\\[a]", "[\\]", "(", "a{2}", "[^a]", "[&&]", ""]
    globs = GLOBS + odd + ["".join(draw.choice("ab-]![*?\\^&.") for _ in range(draw.randrange(1, 9))) for _ in range(300)]
    names = NAMES + ["foo[bar", "foobar", "a", "b", "-", "]", "!", "ab-", "\\", "^", "&", "aa", "", "\U0001f600.py"]
    pairs = [(n, g) for n in names for g in dict.fromkeys(globs)]
    rows = spark.createDataFrame(pairs, "n STRING, g STRING")
    got = rows.filter(F.rlike("n", glob_regex_of(F.col("g")))).collect()
    assert {tuple(r) for r in got} == {p for p in pairs if fnmatch.fnmatchcase(*p)}


@pytest.mark.parametrize("text", ["", "a", "x\n\n\n  DEBUG = True\nDEBUG=True", "\ue000DEBUG=True\n\ue001"])
def test_match_lines(one, text):
    pattern = r"^\s*DEBUG\s*=\s*True"
    expected = sorted({text[:m.start()].count("\n") + 1 for m in re.finditer(pattern, text, re.I | re.M)})
    assert one(match_lines(F.col("t"), pattern), t=text) == expected
