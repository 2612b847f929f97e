from __future__ import annotations

import random
import re
from collections import Counter
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tests.test_rules import CASES
from vetgrid.functions.folding import spellings
from vetgrid.operators.rule_index import (
    FEW_WORDS,
    Entry,
    Index,
    _index,
    _passes,
    _sieve,
    checked_rules,
    matches,
    rejected_rules,
    scan_with_rules,
)
from vetgrid.operators.scan import scan_text
from vetgrid.rules import ALL_RULES, rules_dataframe
from vetgrid.schemas import RULES

COLUMNS = ("path", "rule_id", "line_number", "line_content", "code_snippet", "severity", "title")
NAMES = ("id", "owasp_category", "severity", "title", "description", "pattern", "file_glob", "exclude_pattern")


@pytest.fixture
def rules(spark):
    def make(*patterns, glob="*"):
        rows = [(f"R{i}", "A05", "low", f"t{i}", "d", p, glob, None) if isinstance(p, str) else p for i, p in enumerate(patterns)]
        return spark.createDataFrame(rows, ", ".join(f"{n} STRING" for n in NAMES))
    return make


def found(df, *columns):
    return sorted({tuple(r) for r in df.select(*columns).collect()})


def test_same_as_the_built_in_scan(spark, make_files):
    """Every built-in rule from a table, on texts that hit and miss, with switched-off and odd lines."""
    texts = {}
    for n, (rule, (path, hit, miss)) in enumerate(CASES.items()):
        folder = path.rsplit("/", 1)
        name = f"p{n}/{path}" if len(folder) == 1 else f"p{n}/{folder[0]}/{folder[1]}"
        texts[name] = f"{hit}\nx é\n{miss}\n{hit}  # owasp-ignore: {rule}\n{hit}"
    files = make_files({**texts, "q/empty.py": "", "q/a.py": "# owasp-ignore: A05\neval(x)\neval(y)"})
    # The table has no column for flags: rules are searched without regard to case, by line.
    same = [r for r in ALL_RULES if r.flags == "im"]
    expected = found(scan_text(files, same), *COLUMNS)
    assert len(expected) > 60
    assert found(scan_with_rules(files, rules_dataframe(spark, same)), *COLUMNS) == expected
    assert found(scan_with_rules(files, rules_dataframe(spark, same), shard_bytes=2000), *COLUMNS) == expected


def test_rejected_records(spark, rules):
    table = rules("ok", "(", "[z-a]", "*a", r"(?P<n>x)(?P<n>y)", ("N", None, "low", None, "d", "x", "*", None),
                  ("E", "A05", "low", "t", "d", "x", "*", "("), (None, "A05", "low", "t", "d", "x", "*", None))
    reasons = {r.id: r.reason for r in rejected_rules(table).collect()}
    assert set(reasons) == {"R1", "R2", "R3", "R4", "N", "E", None}
    assert reasons["N"] == "missing: owasp_category, title" and reasons["E"].startswith("exclude_pattern: ")
    assert reasons[None] == "missing: id" and reasons["R1"].startswith("pattern: ")
    assert checked_rules(table).filter("problem is null").count() == 1


@pytest.mark.parametrize("pattern, text, lines", [
    (r"(a)?b(?(1)c|d)", "abc\nabd\nbd", [1, 2, 3]),  # conditional group, unknown to the JVM
    (r"(?P<q>['\"])x(?P=q)", "'x'\n'x\"", [1]),
    (r"(?<=ab)c", "abc\nc", [1]),
    (r"x(?:\"|\w|-)*;", "x" + "a-" * 60_000 + ";\nx", [1]),  # a line far deeper than a thread's stack
    (r"x(?:ab|c)*;", "x" + "abc" * 300_000 + ";", [1]),
    (r"start\s+end", "start\n\nend\nstart end", [1, 4]),
    (r"\Z", "a\nb", [1, 2]),
    (r"", "a\n", [1, 2]),
    (r"İ|ſ", "İ\ns\nx", [1, 2]),
    (r"é+", "É\ne", [1]),
])
def test_python_patterns(make_files, rules, pattern, text, lines):
    got = scan_with_rules(make_files({"p/a.txt": text}), rules(pattern))
    assert [n for n, in found(got, "line_number")] == lines


def test_patterns_are_searched_in_the_lines_that_hold_their_literal():
    """A word's rule is not run on other lines; a pattern that can cross lines still sees the whole text."""
    index = Index([Entry(("W",) * 6, r"\bword\b", "skip", "*"), Entry(("X",) * 6, r"word\s+next", None, "*")])
    assert index.in_line == [("word",), ()]
    text = "a Word\nno\nword skip\nWORD\nnext"
    lines, folded = text.split("\n"), ["a word", "", "word skip", "word", "next"]
    assert list(matches(text, lines, index.entries[0], folded, index.in_line[0])) == [(1, "a Word"), (4, "WORD")]
    assert list(matches(text, lines, index.entries[1], folded, index.in_line[1])) == [(4, "WORD")]


def test_an_index_is_built_once_in_a_worker():
    shared = SimpleNamespace(value=[Entry(("W",) * 6, "word", None, "*")])
    first = _index("shard", shared)
    assert _index("shard", shared) is first and _index("other", shared) is not first


def test_a_whole_word_is_no_candidate_inside_another():
    index = Index([Entry(("W",) * 6, r"\bword\b", None, "*", [("word",)], True), Entry(("X",) * 6, "word", None, "*")])
    assert [index.candidates(t) for t in ("a wordy", "a Word.", "x_word", "word")] == [[1], [0, 1], [1], [0, 1]]


def test_many_rules_few_candidates():
    from vetgrid.operators.rule_index import Entry
    entries = [Entry((f"R{i}",) * 6, rf"\bword{i:05d}\b", None, "*") for i in range(20_000)]
    index = Index([*entries, Entry(("L",) * 6, r"\d+", None, "*")])
    assert index.candidates("x WORD00007 word19999, word1") == [7, 19_999, 20_000]
    assert index.candidates("") == [20_000]


def test_globs_excludes_repeats_and_empty_tables(spark, make_files, rules):
    files = make_files({"p/a.py": "hit\nhit safe", "p/b.js": "hit", "p/[x].py": "hit"})
    row = ("G", "A05", "low", "t", "d", "hit", "*.py", "safe")
    assert found(scan_with_rules(files, rules(row)), "path", "line_number") == [("p/[x].py", 1), ("p/a.py", 1)]
    assert scan_with_rules(files, rules(row, row)).count() == 4
    assert scan_with_rules(files, rules(("U", "A05", "low", "t", "d", "hit", "[x", None))).count() == 0
    empty = spark.createDataFrame([], RULES)
    assert scan_with_rules(files, empty).count() == 0
    assert scan_with_rules(make_files({}), rules(row)).count() == 0
    nulls = files.withColumn("content", F.lit(None).cast("string"))
    assert scan_with_rules(nulls, rules(row)).count() == 0
    assert scan_with_rules(files, rules(row), keep=("project", "path")).columns[:2] == ["project", "path"]


LETTERS = "sSkKiIıİſ\u212aéÉσςΣµμßẞιͅǅǆa1_ſt"


def test_a_folded_word_is_what_the_pattern_finds():
    rng, spell, hits = random.Random(5), spellings(), 0
    for _ in range(20_000):
        word = "".join(rng.choices(LETTERS, k=rng.randint(1, 3)))
        text = "".join(rng.choices(LETTERS + " .-\u0301", k=10))
        folded = spell.word_of(rf"\b{word}\b")
        if folded is not None:
            hit = re.search(rf"\b{word}\b", text, re.I | re.M) is not None
            assert hit == (folded in re.findall(r"\w+", spell.fold(text))), (word, text)
            hits += hit
    assert hits > 100
    assert [spell.word_of(p) for p in (r"\bιδέα\b", r"\bStraẞe_1\b", r"\ba b\b", r"\bab", r"\ba+\b", "\\bab\\b\n")] == [
        None, "straße_1", None, None, None, None]


def test_the_sieve_lets_every_word_of_a_rule_pass(spark):
    words = [f"wort{i}é" for i in range(5000)]
    marked = spark.createDataFrame([(w,) for w in words], "word STRING").selectExpr(
        "word", "crc32(encode(word, 'UTF-8')) AS mark")
    sieve = _sieve(marked, len(words))
    assert all(_passes(w, sieve) for w in words)
    assert sum(_passes(f"other{i}", sieve) for i in range(5000)) < 250


def test_many_words_are_joined_in_one_pass(spark, make_files, rules):
    """The number of passes over the files does not grow with the rules; each rule still finds its lines."""
    count = FEW_WORDS + 1
    files = make_files({"p/a.txt": "x\nWORD00007, word01999\nword1", "p/b.txt": f"word{FEW_WORDS:05d}"})
    got = scan_with_rules(files, rules(*[rf"\bword{i:05d}\b" for i in range(count)]), shard_bytes=5000)
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert found(got, "path", "rule_id", "line_number", "line_content") == [
        ("p/a.txt", "R1999", 2, "WORD00007, word01999"), ("p/a.txt", "R7", 2, "WORD00007, word01999"),
        ("p/b.txt", f"R{FEW_WORDS}", 1, f"word{FEW_WORDS:05d}")]


def test_joined_words_find_what_the_index_finds(spark, make_files, rules):
    """Repeated rules and rows, odd letters, globs, excludes, switched-off lines, other patterns, null texts."""
    rng = random.Random(6)
    words = ["kind", "Kİnd", "task", "éTude", "straße", "ſos", "a_1", "été", "word", "ΣΑΣ", "ιδ", "中文", "x"]
    texts = {}
    for n in range(120):
        parts = [rng.choice([*words, *map(str.upper, words), "\u212aind", "wordy", "- ", "\n", "\n", "\r\n", "\u2028", ".",
                             "# owasp-ignore: A05\n", "# owasp-ignore: R3, x"]) + rng.choice([" ", " ", "", "\n"])
                 for _ in range(rng.randint(0, 30))]
        texts[f"p/{n}{rng.choice(['.py', '.txt'])}"] = "".join(parts)
    files = make_files(texts)
    files = files.unionByName(files.limit(10)).unionByName(files.limit(5).withColumn("content", F.lit(None).cast("string")))
    table = rules(*[rf"\b{w}\b" for w in words], r"\bword\b", "wor", r"\d+", "(",
                  ("G", "A06", "low", "t", "d", r"\bword\b", "*.py", None), ("E", "A06", "low", "t", "d", r"\btask\b", "*", "kind"))
    table = table.unionByName(table.limit(3))
    columns = (*COLUMNS, "owasp_category", "description", "suggested_fix")
    rows = [Counter(map(tuple, scan_with_rules(files, table, few_words=n).select(*columns).collect())) for n in (0, 1000)]
    assert rows[0] == rows[1] and sum(rows[0].values()) > 1000
    assert {r[1] for r in rows[0]} >= {*(f"R{i}" for i in range(len(words) + 3)), "G", "E"}
    assert scan_with_rules(files, table, few_words=0).schema == scan_with_rules(files, table).schema
