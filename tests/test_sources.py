from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from vetgrid.operators.findings import files_to_verify, verify_findings
from vetgrid.operators.scan import scan_text
from vetgrid.operators.triage import findings_in_context
from vetgrid.plans.scans import scan_changes
from vetgrid.rules import ALL_RULES
from vetgrid.sources import records
from vetgrid.sources.files import (
    MAX_FILE_KB,
    changed_paths,
    drop_ignored,
    eligible_files,
    ignore_patterns,
    in_skipped_folder,
    is_excluded,
    only_changed,
    write_source_snapshot,
)
from vetgrid.sources.trees import list_tree, read_tree


def test_read_tree(spark, tmp_path):
    (tmp_path / "src" / "node_modules").mkdir(parents=True)
    (tmp_path / "src" / "a.py").write_bytes(b"eval(x)\xff\xfe\n")
    (tmp_path / "src" / "b.bin").write_bytes(b"x\x00y")
    (tmp_path / "src" / "big.py").write_bytes(b"x" * (MAX_FILE_KB * 1024 + 1))
    (tmp_path / "src" / "edge.py").write_bytes(b"x" * (MAX_FILE_KB * 1024))
    (tmp_path / "src" / "late.py").write_bytes(b"y" * 1024 + b"\x00")
    (tmp_path / "src" / ".env").write_text("KEY=1")
    (tmp_path / "src" / "__init__.py").write_text("")
    (tmp_path / "src" / "node_modules" / "x.js").write_text("eval(x)")
    (tmp_path / "_private" / ".ci" / "deep").mkdir(parents=True)
    (tmp_path / "_private" / ".ci" / "deep" / "job.yml").write_text("é")
    assert read_tree(spark, str(tmp_path)).filter("rel_path = 'src/big.py'").count() == 1
    rows = {r.rel_path: r for r in read_tree(spark, str(tmp_path), max_file_kb=MAX_FILE_KB).collect()}
    assert set(rows) == {"src/a.py", "src/b.bin", "src/edge.py", "src/late.py", "src/.env",
                         "src/__init__.py", "_private/.ci/deep/job.yml"}
    assert rows["src/__init__.py"].content == "" and rows["src/__init__.py"].size == 0
    assert rows["_private/.ci/deep/job.yml"].content == "é"
    assert list_tree(spark, str(tmp_path)).count() == 8
    assert rows["src/a.py"].content == "eval(x)��\n"
    assert rows["src/b.bin"].is_binary and not rows["src/late.py"].is_binary
    assert rows["src/a.py"].path == f"{tmp_path}/src/a.py"


def test_read_tree_by_url(spark, tmp_path):
    """The same rows by path and by URL, odd names, hidden and empty files included."""
    for name, text in {"a b/ü%41#x.py": "1", "a b/_hidden/.env": "K=1", "__init__.py": "", "node_modules/x.js": "no",
                       "deep/" * 12 + "end.txt": "end"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    columns = ("rel_path", "content", "size", "is_binary")
    by_path = sorted(map(tuple, read_tree(spark, str(tmp_path)).select(*columns).collect()))
    by_url = read_tree(spark, f"file://{tmp_path}")
    assert sorted(map(tuple, by_url.select(*columns).collect())) == by_path and len(by_path) == 4
    assert all(r.path.startswith("file:///") for r in by_url.collect())
    capped = read_tree(spark, f"file://{tmp_path}/", max_file_kb=0)
    assert [r.rel_path for r in capped.collect()] == ["__init__.py"]


@pytest.mark.parametrize("path, skipped", [
    ("a/node_modules/b.py", True), ("x.egg-info/a.py", True), ("build", False), ("a/build.py", False),
    ("build/a/b.py", True), ("a/.env", False), (".env/a.py", True), ("rebuild/a.py", False)])
def test_skipped_folders(one, path, skipped):
    assert one(in_skipped_folder(F.col("p")), p=path) is skipped


@pytest.mark.parametrize("path, patterns, excluded", [
    ("tests/a.py", ["tests/"], True), ("src/tests/a.py", ["tests/"], True), ("mytests/a.py", ["tests/"], False),
    ("a/b.test.ts", ["*.test.ts"], True), ("docs/a/b.md", ["docs/*"], True), ("a.py", ["a.p?"], True),
    ("a.py", [], False), ("A.py", ["a.py"], False)])
def test_excludes(one, path, patterns, excluded):
    assert one(is_excluded(F.col("p"), patterns), p=path) is excluded


def test_eligibility(make_files):
    files = make_files({"p/a.py": "x", "p/notes.txt": "x", "p/bin.py": "x\x00", "p/dist/a.py": "x"})
    names = lambda df: {r.rel_path for r in df.collect()}
    assert names(eligible_files(files)) == {"a.py", "notes.txt"}
    assert names(eligible_files(files, all_text=False)) == {"a.py", "bin.py"}
    assert names(eligible_files(files, exclude=["*.txt"])) == {"a.py"}


def test_ignore_file_is_per_project(make_files):
    files = make_files({"p/.owaspignore": "# c\n\n docs/ \n*.gen.py", "p/docs/a.py": "", "p/x.gen.py": "",
                        "p/a.py": "", "q/docs/a.py": ""})
    left = {r.path for r in drop_ignored(files, ignore_patterns(files)).collect()}
    assert left == {"p/.owaspignore", "p/a.py", "q/docs/a.py"}


def test_ignore_lines_are_made_regexes_once(make_files):
    """Once for a project and before the join, not once more for each file; odd lines keep their meaning."""
    files = make_files({"p/.owaspignore": "a long line of prose?\n[!]x]\n[ab].py\nz[", "p/a.py": "", "p/c.py": "", "p/d/b.py": "",
                        "p/z[": "", "p/y": ""})
    left = drop_ignored(files, ignore_patterns(files))
    assert {r.path for r in left.collect()} == {"p/.owaspignore", "p/c.py"}
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "_tests" in above and "regexp_extract_all" not in above


def test_changes(make_files):
    old = make_files({"p/same": "1", "p/edit": "1", "p/gone": "1"})
    new = make_files({"p/same": "1", "p/edit": "2", "p/new": "1"})
    changes = changed_paths(old, new)
    assert {tuple(r) for r in changes.collect()} == {
        ("p/edit", "modified"), ("p/gone", "deleted"), ("p/new", "added")}
    assert {r.path for r in only_changed(new, changes).collect()} == {"p/edit", "p/new"}


def test_custom_rules(spark, tmp_path):
    good = {"id": "C-1", "owasp_category": "A07", "severity": "high", "title": "t", "description": "d",
            "pattern": "KEY_[A-Z]{4}"}
    entries = [good, {**good, "id": "C-2", "file_glob": "*", "exclude_pattern": "demo"},
               {k: v for k, v in good.items() if k != "title"}, {**good, "id": "C-3", "pattern": "("}]
    path = tmp_path / "rules.json"
    path.write_text("\n".join(map(json.dumps, entries)))
    rules = records.read_rules(spark, str(path))
    assert {(r.id, r.globs, r.exclude_pattern) for r in rules} == {
        ("C-1", ("*.py",), None), ("C-2", ("*",), "demo")}


def test_errors(spark, tmp_path):
    lines = [json.dumps({"error_id": str(n), "timestamp": f"2025-01-0{n}", "tool_name": f"t{n % 2}",
                         "error_type": "E", "message": "m", "context": {"a": "b"}}) for n in range(1, 6)]
    path = tmp_path / "errors.jsonl"
    path.write_text("\n".join([lines[0], "{broken", "", *lines[1:], lines[0][:30]]))
    errors = records.read_errors(spark, str(path))
    assert errors.count() == 5
    assert [r.error_id for r in records.recent_errors(errors, tool_name="t1", limit=2).collect()] == ["5", "3"]
    assert records.recent_errors(errors, error_id="2").first()["context"] == {"a": "b"}


def test_categories(spark, tmp_path):
    path = tmp_path / "categories.json"
    path.write_text(json.dumps({"version": "2025", "categories": [
        {"id": "A01", "name": "n", "rank": 1, "stats": {"cwes_mapped": 2, "avg_weighted_exploit": None},
         "key_cwes": [{"id": "CWE-1", "name": "x"}, {"id": "CWE-2", "name": "y", "cves": 7}],
         "prevention": ["p1", "p2"], "common_vulnerabilities": ["c"]}]}, indent=1))
    categories = records.read_categories(spark, str(path))
    assert categories.select("stats.cwes_mapped").first()[0] == 2
    assert {(r.cwe_id, r.cves) for r in records.category_weaknesses(categories).collect()} == {
        ("CWE-1", None), ("CWE-2", 7)}
    assert {(r.kind, r.position, r.text) for r in records.category_notes(categories).collect()} == {
        ("prevention", 0, "p1"), ("prevention", 1, "p2"), ("common_vulnerabilities", 0, "c")}


def test_dependency_sources(make_files):
    files = make_files({"p/uv.lock": "", "p/pyproject.toml": "", "q/requirements/base.txt": "",
                        "q/requirements.txt": "", "r/poetry.lock": "", "s/a.py": "", "t/sub/requirements.txt": ""})
    assert {tuple(r) for r in records.dependency_sources(files).collect()} == {
        ("p", "p/pyproject.toml", "pyproject"), ("q", "q/requirements.txt", "requirements"),
        ("r", "r/poetry.lock", "lockfile")}


def test_audit_report(spark):
    from vetgrid.operators.dependencies import dependency_findings, vulnerability_counts
    report = json.dumps({"dependencies": [
        {"name": "a", "version": "1", "vulns": [
            {"id": "V-1", "description": "d" * 600, "fix_versions": ["2", "3"]}, {"id": "V-2", "fix_versions": []}]},
        {"name": "b", "version": "1", "vulns": []}]})
    reports = spark.createDataFrame([("p/requirements.txt", report), ("q", "not json")],
                                    "source_path STRING, json STRING")
    rows = records.audit_report_rows(reports)
    found = {r.rule_id: r for r in dependency_findings(rows, scan_id="s").collect()}
    assert set(found) == {"pip-audit-V-1", "pip-audit-V-2"}
    assert found["pip-audit-V-1"].suggested_fix == "Upgrade a to 2, 3"
    assert len(found["pip-audit-V-1"].description) == 600
    cut = dependency_findings(rows, scan_id="s", description_chars=500).filter("rule_id = 'pip-audit-V-1'").first()
    assert len(cut.description) == 500
    assert found["pip-audit-V-2"].description == "V-2"
    assert found["pip-audit-V-2"].suggested_fix == "Upgrade a to No fix available"
    assert tuple(vulnerability_counts(rows).first()) == ("p/requirements.txt", 2, 1)


def moved_columns(df):
    """Columns that go through each exchange of a plan."""
    text = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return re.findall(r"\(\d+\) (?:Exchange|BroadcastExchange)[^\n]*\nInput \[\d+\]: \[(.*?)\]\n", text)


@pytest.fixture
def snapshots(spark, make_files):
    """Two bucketed snapshots, without broadcast joins."""
    for name, setting in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.shuffle.partitions", "4")):
        spark.conf.set(name, setting)
    texts = {f"p{n % 3}/f{n}.py": f"eval(x{n})\n" for n in range(40)}
    write_source_snapshot(make_files(texts), "snap_old", 8)
    later = {p: t for p, t in texts.items() if "f7" not in p} | {"p0/f3.py": "y = 1\nexec(y)", "p1/new.py": "eval(n)"}
    write_source_snapshot(make_files(later), "snap_new", 8)
    yield spark.table("snap_old"), spark.table("snap_new")
    for name in ("snap_old", "snap_new"):
        spark.sql(f"DROP TABLE {name}")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_incremental_scan_moves_no_text(snapshots):
    old, new = snapshots
    changes = changed_paths(old, new)
    assert moved_columns(changes) == []
    assert sorted(map(tuple, changes.collect())) == [("p0/f3.py", "modified"), ("p1/f7.py", "deleted"), ("p1/new.py", "added")]
    found = scan_changes(old, new, scan_id="s")
    moved = moved_columns(found)
    assert moved and not any("content#" in columns or "_text" in columns for columns in moved)
    assert sorted((r.file_path, r.line_number) for r in found.collect()) == [("p0/f3.py", 2), ("p1/new.py", 1)]


def test_verification_and_triage_move_no_text(spark, snapshots):
    _, new = snapshots
    rows = [("a", "p0/f3.py", 1, "A05-004", "open"), ("b", "p0/f6.py", 1, "A05-004", "open"), ("c", "p0/f6.py", 1, "A04-001", "open"),
            ("d", "p9/gone.py", 1, "A05-004", "open"), ("e", "p2/f2.py", 1, "A05-004", "fixed")]
    stored = spark.createDataFrame(rows, "id STRING, file_path STRING, line_number INT, rule_id STRING, status STRING").withColumn(
        "code_snippet", F.lit("kept"))
    chosen = files_to_verify(new, stored)
    assert {r.path: sorted(r.wanted) for r in chosen.collect()} == {"p0/f3.py": ["A05-004"], "p0/f6.py": ["A04-001", "A05-004"]}
    fresh = scan_text(chosen, ALL_RULES, wanted="wanted")
    for plan in (fresh, findings_in_context(stored, new)):
        assert not any("content#" in columns for columns in moved_columns(plan))
    outcome = verify_findings(stored, new, fresh, [r.id for r in ALL_RULES])
    assert {r.id: r.outcome for r in outcome.collect()} == {
        "a": "still_present", "b": "still_present", "c": "verified_fixed", "d": "file_missing", "e": "already_resolved"}
    shown = {r.id: r.context for r in findings_in_context(stored, new).collect()}
    assert shown["b"].startswith("   1 | eval(x6)") and shown["d"] == "kept"
