"""The scan against a plain Python twin, and its particular rules of behaviour."""

from __future__ import annotations

import fnmatch
import random
import re

import pandas as pd
from pyspark.sql import functions as F

from vetgrid.operators.scan import scan_text, to_findings
from vetgrid.rules import ALL_RULES, Rule, select_rules
from workload import corpus
from workload.profiles import PROFILES

SF = "/root/testdata/sf0.001"
SUPPRESSION = re.compile(r"#\s*owasp-ignore:\s*([\w\-,\s]+)")


def twin(path: str, text: str) -> set:
    """What a search with Python's own regexes finds: lines first, then the whole text."""
    lines = text.split("\n")
    found = set()
    for rule in ALL_RULES:
        name = path.rsplit("/", 1)[-1]
        if not any(fnmatch.fnmatchcase(name, g) for g in rule.globs):
            continue
        flags = sum(getattr(re, f.upper()) for f in rule.flags)
        numbers = {i for i, line in enumerate(lines) if re.search(rule.pattern, line, flags)}
        numbers |= {text.count("\n", 0, m.start()) for m in re.finditer(rule.pattern, text, flags)}
        for i in numbers:
            if rule.exclude_pattern and re.search(rule.exclude_pattern, lines[i], flags):
                continue
            codes = [c.strip() for k in (i, i - 1) if k >= 0
                     for m in [SUPPRESSION.search(lines[k])] if m for c in m.group(1).split(",")]
            if rule.id not in codes and rule.owasp_category not in codes:
                found.add((path, rule.id, i + 1))
    return found


def twin_batches(batches):
    for batch in batches:
        rows = [r for p, t in zip(batch["path"], batch["content"]) for r in twin(p, t)]
        yield pd.DataFrame(rows, columns=["path", "rule_id", "line_number"])


def test_twin_on_the_corpus(spark):
    files = corpus.files(spark, SF)
    expected = {tuple(r) for r in files.select("path", "content").mapInPandas(
        twin_batches, "path STRING, rule_id STRING, line_number INT").collect()}
    got = {tuple(r) for r in scan_text(files, ALL_RULES).select(
        "path", "rule_id", "line_number").collect()}
    assert got == expected and len(got) > 300


def test_twin_on_mixed_fragments(scan):
    """Fragments in random order with odd white space, line ends and letters between them."""
    rng = random.Random(7)
    pieces = [t for _, h, t in PROFILES] + [h for _, h, _ in PROFILES]
    glue = ["\n", "\n\n", "\r\n", " ", "\t\n ", "\u2028", "\u00a0", "\u017f", "é\n", "\ue000", "# owasp-ignore: A05\n"]
    texts = {}
    for n in range(400):
        name = rng.choice(["a.py", "b.ts", "route.tsx", "c.html", "next.config.js", "docker-compose.yml", "middleware.js"])
        parts = []
        for _ in range(rng.randint(1, 12)):
            piece = rng.choice(pieces)
            cut = rng.randint(0, len(piece))
            parts += [piece[cut:] if rng.random() < 0.3 else piece, rng.choice(glue)]
        texts[f"p/{n}/{name}"] = "".join(parts)
    expected = set().union(*(twin(p, t) for p, t in texts.items()))
    assert scan(texts) == expected and len(expected) > 400


def test_blank_line_above_is_reported_too(scan):
    assert scan({"p/a.py": "x=1\n\nDEBUG = True"}) == {("p/a.py", "A02-001", 2), ("p/a.py", "A02-001", 3)}


def test_empty_and_comment_only(scan):
    assert scan({"p/a.py": "", "p/b.py": "# nothing\n# here\n"}) == set()


def test_suppression(scan):
    hit = "eval(x)"
    texts = {
        "p/id.py": f"{hit}  # owasp-ignore: A05-004",
        "p/category.py": f"{hit}  # owasp-ignore: A05",
        "p/above.py": f"# owasp-ignore: A05-004\n{hit}",
        "p/list.py": f"{hit}  # owasp-ignore: A04-001, A05-004",
        "p/wrong.py": f"{hit}  # owasp-ignore: A04-001",
        "p/two_above.py": f"# owasp-ignore: A05-004\n\n{hit}",
    }
    assert {p for p, _, _ in scan(texts)} == {"p/wrong.py", "p/two_above.py"}
    assert len(scan(texts, suppressed=True)) == 4


def test_line_content_and_snippet(make_files):
    rows = {r.line_number: r for r in scan_text(
        make_files({"p/a.py": "a\nb\nsubprocess.run(c,\n  shell=True)\ne\nf"}),
        select_rules(ids=["A05-007"]), context_lines=(9, 10)).collect()}
    row = rows[3]
    assert row.line_content == "subprocess.run(c,"
    assert row.code_snippet == "   2 | b\n   3 | subprocess.run(c,\n   4 |   shell=True)\n   5 | e"
    assert row.context.startswith("   1 | a\n") and row.context.endswith("   6 | f")


def test_rule_without_literals_and_many_rules(scan):
    rules = [Rule(f"X-{n}", "A01", "low", "t", "d", r"[0-9]{3}|[a-c]{3}", ("*",)) for n in range(300)]
    found = scan({"p/a.txt": "123\nxyz\nabc"}, rules)
    assert len(found) == 600


def test_findings_have_fingerprint_and_severity(make_files, spark):
    files = make_files({"p/a.py": "eval(x)", "p/tests/a.py": "eval(x)", "p/migrations/a.py": "eval(x)",
                        "q/a.py": "eval(x)"})
    surfaces = spark.createDataFrame([("p", "network"), ("q", "local")], "project STRING, surface STRING")
    rows = to_findings(scan_text(files, ALL_RULES, keep=("project", "path")), scan_id="s",
                       surfaces=surfaces).collect()
    severity = {r.file_path: r.severity for r in rows}
    assert severity == {"p/a.py": "critical", "p/tests/a.py": "high", "p/migrations/a.py": "low",
                        "q/a.py": "high"}
    assert len({r.fingerprint for r in rows}) == 4


def test_plan_has_no_shuffle_and_no_python(spark):
    files = spark.read.schema("path STRING, content STRING").parquet(SF + "/documents.parquet")
    plan = scan_text(files, ALL_RULES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange (hash|range|Single|Round)|MapInPandas|PythonUDF|BatchEval", plan)


def test_severity_shift(one):
    from vetgrid.functions.text import adjust_severity
    cases = [("critical", "src/a.py", None, "critical"), ("critical", "a/tests/x.py", None, "high"),
             ("low", "tests/x.py", None, "low"), ("high", "x/test_a.py", "local", "low"),
             ("high", "alembic/v.py", "network", "low"), ("weird", "tests/a.py", "local", "weird"),
             ("medium", "src/contest/x.py", None, "medium"), ("high", "a/conftest.py", None, "medium"),
             ("high", "a_test.py", None, "medium"), ("critical", "Fixtures/a.json", "local", "medium")]
    for base, path, surface, expected in cases:
        got = one(adjust_severity(F.col("s"), F.col("p"), F.lit(surface).cast("string")), s=base, p=path)
        assert got == expected, (base, path, surface)
