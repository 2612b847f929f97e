from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from vetgrid.functions.text import percent, slug
from vetgrid.operators import triage
from vetgrid.operators.aggregates import token_usage


def test_slug_and_percent(one):
    assert one(slug(F.col("t")), t="  Missing Auth -- on POST /api! ") == "missing-auth-on-post-api"
    assert len(one(slug(F.col("t")), t="x" * 90)) == 40
    assert [one(percent(F.col("c")), c=c) for c in (0.85, 1.0, 0.125, 0.8)] == ["85%", "100%", "12%", "80%"]


def answer(*items):
    return json.dumps({"assessments": list(items)})


def test_verdicts(spark):
    rows = [("a", answer({"finding_id": "b", "verdict": "true_positive"}, {"finding_id": "a", "verdict": "false_positive", "confidence": 0.9, "reasoning": "r"})),
            ("b", answer({"finding_id": "x", "verdict": "true_positive", "confidence": 0.3})),
            ("c", answer()), ("d", "broken"), ("e", answer({"finding_id": "e"}))]
    verdicts = triage.parse_verdicts(spark.createDataFrame(rows, "finding_id STRING, json STRING"))
    got = {r.finding_id: (r.verdict, r.confidence) for r in verdicts.collect()}
    assert got == {"a": ("false_positive", 0.9), "b": ("true_positive", 0.3), "c": ("needs_investigation", 0.0),
                   "d": ("needs_investigation", 0.0), "e": ("needs_investigation", 0.5)}
    requests = spark.createDataFrame([("a",), ("z",)], "finding_id STRING")
    full = {r.finding_id: r.verdict for r in triage.complete_verdicts(requests, verdicts).collect()}
    assert full == {"a": "false_positive", "z": "needs_investigation"}
    updates = triage.verdicts_as_updates(verdicts).collect()
    assert [(u.finding_id, u.status, u.notes) for u in updates] == [("a", "false_positive", "LLM triage (90%): r")]


def test_reviews(spark):
    item = {"owasp_category": "A06", "severity": "high", "title": "No Rate Limit", "line_number": 4, "confidence": 0.7}
    rows = [("p/tests/a.py", json.dumps({"findings": [item, {}]})), ("p/b.py", "{}"), ("p/c.py", "oops")]
    found = triage.review_findings(triage.parse_reviews(spark.createDataFrame(rows, "path STRING, json STRING")), scan_id="s")
    assert {(r.rule_id, r.severity, r.line_number, r.confidence) for r in found.collect()} == {
        ("llm-A06-no-rate-limit", "medium", 4, 0.7), ("llm-A10-unknown", "low", None, 0.5)}


def test_context(make_files, spark):
    files = make_files({"p/.owasp-context.md": "root", "p/a/b/.owasp-context.md": "inner", "p/a/b/c/x.py": "", "p/a/y.py": "",
                        "q/z.py": "", "r/.owasp-context.md": "  \n", "r/x.py": "", "s/.owasp-context.md": "y" * 20001})
    contexts = triage.project_contexts(files)
    got = {r.path: r.context for r in triage.with_context(files.select("path"), contexts).collect()}
    assert got["p/a/b/c/x.py"] == "inner" and got["p/a/y.py"] == "root"
    assert got["q/z.py"] is None and got["r/x.py"] is None
    assert got["s/.owasp-context.md"] == "y" * 20001
    cut = triage.project_contexts(files, max_chars=20_000).filter("folder = 's'").first().context
    assert cut.startswith("y" * 20000 + "\n\n[")


def test_requests(make_files, spark):
    files = make_files({"p/a.py": "\n".join(f"l{n}" for n in range(1, 31)), "p/app/page.tsx": "x", "p/big.py": "z" * 150001})
    findings = spark.createDataFrame(
        [("1", "t", "d", "p/a.py", 15, "old"), ("2", "t", "d", "p/gone.py", 3, "kept"), ("3", "t", "d", "p/a.py", None, None)],
        "id STRING, title STRING, description STRING, file_path STRING, line_number INT, code_snippet STRING")
    rows = {r.id: r.context for r in triage.findings_in_context(findings, files).collect()}
    assert rows["1"].split("\n")[0] == "   6 | l6" and rows["1"].split("\n")[-1] == "  25 | l25"
    assert rows["2"] == "kept" and rows["3"].startswith("   1 | l1\n")
    withctx = triage.findings_in_context(findings, files).withColumn("notes_text", F.lit(" our notes "))
    prompts = {r.finding_id: r.prompt for r in triage.triage_requests(withctx, "notes_text").collect()}
    assert "Finding ID: 1\n" in prompts["1"] and "our notes\n\nTriage" in prompts["1"] and "File: p/a.py:15" in prompts["1"]
    types = spark.createDataFrame([("p", "nextjs")], "project STRING, project_type STRING")
    rows = triage.review_requests(files, types).collect()
    reviews = {r.path: r for r in rows}
    assert set(reviews) == {"p/a.py", "p/app/page.tsx", "p/big.py"}
    assert reviews["p/app/page.tsx"].role == "page" and "Type: Page\n" in reviews["p/app/page.tsx"].prompt
    big = [r.prompt for r in rows if r.path == "p/big.py"]
    assert len(big) == 3 and "Part: 1 of 3, lines 1 to 1\n" in big[0]
    assert sum(p.count("z") for p in big) == 150001
    assert "Part" not in reviews["p/a.py"].prompt


@pytest.mark.parametrize("size", [2, 7, 40, 10_000])
def test_windows_cover_the_text(spark, make_files, size):
    draw = random.Random(size)
    texts = {"e/x": "", "f/x": "\n", "g/x": "\n" * 50, "h/x": "z" * 100, "i/x": "é\n\U0001f600\n" * 30}
    texts |= {f"r{i}/x": "".join(draw.choice("ab\n") for _ in range(draw.randrange(200))) for i in range(20)}
    texts |= {f"l{i}/x": "\n".join("w" * draw.randrange(30) for _ in range(20)) for i in range(20)}
    rows = triage.review_windows(make_files(texts), window=size).orderBy("path", "part").collect()
    for path, text in texts.items():
        own = [r for r in rows if r.path == path]
        assert [r.part for r in own] == list(range(len(own))) and {r.parts for r in own} == {len(own)}
        assert "".join(r.window_text for r in own) == text
        at = 0
        for r in own:
            assert len(r.window_text) <= size
            assert r.first_line == text[:at].count("\n") + 1
            at += len(r.window_text)
            assert r.last_line == r.first_line + r.window_text.rstrip("\n").count("\n") + max(
                0, len(r.window_text) - len(r.window_text.rstrip("\n")) - 1)
    if size >= 40:  # lines shorter than half a window are never cut
        assert all(r.window_text.endswith("\n") or r.part == r.parts - 1 for r in rows if r.path[0] == "r")


def test_reviews_of_windows(spark, make_files):
    files = make_files({"p/a.py": "\n".join(f"line {n}" for n in range(1, 101))})
    windows = triage.review_windows(files, window=200)
    third = windows.filter("part = 2").first()
    item = lambda n: json.dumps({"findings": [{"title": "t", "line_number": n}]})
    rows = [("p/a.py", 2, item(3)), ("p/a.py", 2, item(999)), ("p/a.py", 2, item(0)), ("p/a.py", 0, item(1)), ("p/a.py", 77, item(1))]
    reviews = triage.parse_reviews(spark.createDataFrame(rows, "path STRING, part INT, json STRING"))
    lines = [r.line_number for r in triage.place_reviews(reviews, windows).collect()]
    assert sorted(lines, key=str) == [1, third.first_line + 2, None, None]


def test_usage(spark):
    calls = spark.createDataFrame([("m", 1000000, 500000), ("m", 0, 500000)], "model STRING, input_tokens BIGINT, output_tokens BIGINT")
    assert tuple(token_usage(calls).first()) == ("m", 1000000, 1000000, 0.5)


def test_windows_are_cut_once(spark):
    """No step of the cut is repeated in a filter that Spark infers and pushes down to the source."""
    rows = spark.createDataFrame([("a", "ab\ncd\xe9f\n\ng" * 40), ("b", "x" * 25), ("c", ""), ("d", None)], "path STRING, content STRING")
    windows = triage.review_windows(rows, window=10)
    got = {}
    for r in windows.orderBy("path", "part").collect():
        got[r.path] = got.get(r.path, "") + r.window_text
        assert len(r.window_text) <= 10 and r.first_line == got[r.path][: len(got[r.path]) - len(r.window_text)].count("\n") + 1
    assert got == {"a": "ab\ncd\xe9f\n\ng" * 40, "b": "x" * 25, "c": ""}
    plan = windows.select("path", "part")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
