from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from vetgrid.operators import aggregates as agg
from vetgrid.operators import findings as fnd
from vetgrid.operators.replay import chunk_number, replayed
from vetgrid.operators.scan import scan_text
from vetgrid.plans.scans import complete_scans, open_scan, scan_changes, scan_files, scan_path
from vetgrid.plans.snapshots import (
    delete_from,
    empty_snapshot,
    merge_into,
    read_baseline_file,
    update_into,
    write_baseline,
)
from vetgrid.rules import ALL_RULES
from vetgrid.schemas import AUDIT_LOG, FINDINGS, UPDATES

CANDIDATE = (
    "scan_id STRING, file_path STRING, line_number INT, rule_id STRING, fingerprint STRING, "
    "owasp_category STRING, severity STRING, title STRING, description STRING, "
    "code_snippet STRING, suggested_fix STRING, confidence DOUBLE, ord INT"
)


def at(day: int):
    return F.to_timestamp(F.lit(f"2025-01-{day:02d} 10:00:00"))


@pytest.fixture
def batch(spark):
    def make(*rows, scan_id="s1"):
        made = []
        for n, (path, line, rule, *rest) in enumerate(rows):
            title = rest[0] if rest else "t"
            fp = hashlib.sha256(f"{path}:{line}:{rule}".encode()).hexdigest() if rule else None
            made.append((scan_id, path, line, rule, fp, "A05", "high", title, "d", f"code {n}", "fix", None, n))
        return spark.createDataFrame(made, CANDIDATE)
    return make


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], FINDINGS)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_insert_and_audit(empty, batch):
    change = fnd.merge_findings(empty, batch(("a.py", 1, "R"), ("a.py", 2, "R"), ("a.py", 1, "S")), at(1))
    assert change.findings.count() == 3
    assert rows_of(change.findings.select("status").distinct(), "status") == [("open",)]
    assert rows_of(change.audit, "action", "new_value") == [("created", "high: t")] * 3


def test_rescan_adds_nothing(empty, batch):
    rows = [("a.py", 1, "R"), ("b.py", 2, "S")]
    first = fnd.merge_findings(empty, batch(*rows), at(1)).findings
    again = fnd.merge_findings(first, batch(*rows, scan_id="s2"), at(2))
    assert again.findings.count() == 2 and again.audit.count() == 0
    assert rows_of(again.findings, "scan_id", F.date_format("found_at", "d"), F.date_format("updated_at", "d")) \
        == [("s2", "1", "2")] * 2
    assert tuple(fnd.scan_counts(fnd.flag_candidates(first, batch(*rows))).first()) == (2, 0, 2)


def test_closed_findings_stay(empty, batch):
    first = fnd.merge_findings(empty, batch(("a.py", 1, "R", "old"), ("a.py", 2, "R", "old")), at(1)).findings
    first = first.withColumn("status", F.when(F.col("line_number") == 1, "fixed").otherwise("in_progress"))
    new = batch(("a.py", 1, "R", "new"), ("a.py", 2, "R", "new"), scan_id="s2")
    merged = fnd.merge_findings(first, new, at(2)).findings
    assert rows_of(merged, "line_number", "status", "scan_id", "title", "code_snippet") == [
        (1, "fixed", "s1", "old", "code 0"), (2, "in_progress", "s2", "old", "code 1")]
    flags = fnd.flag_candidates(first, new)
    assert rows_of(flags, "line_number", "is_new", "reappeared") == [(1, False, True), (2, False, False)]


def test_copies_in_one_batch(empty, batch):
    new = batch(("a.py", None, "R", "one"), ("a.py", None, "R", "two"), ("a.py", None, "R", "three"))
    merged = fnd.merge_findings(empty, new, at(1))
    assert rows_of(merged.findings, "title", "code_snippet") == [("one", "code 2")]
    assert merged.audit.count() == 1
    assert tuple(fnd.scan_counts(fnd.flag_candidates(empty, new)).first()) == (3, 1, 2)


def test_findings_without_rule_always_insert(empty, batch):
    new = batch(("a.py", 1, None), ("a.py", 1, None))
    first = fnd.merge_findings(empty, new, at(1))
    assert first.findings.count() == 2 and first.audit.count() == 2
    second = fnd.merge_findings(first.findings, batch(("a.py", 1, None)), at(2))
    assert second.findings.count() == 3


def test_fingerprint(one):
    from vetgrid.functions.text import fingerprint
    expr = fingerprint(F.col("p"), F.lit(None).cast("int"), F.col("r"))
    assert one(expr, p="a.py", r="R") == hashlib.sha256(b"a.py:None:R").hexdigest()
    assert one(expr, p="a.py", r="") is None


def test_updates(spark, empty, batch):
    stored = fnd.merge_findings(empty, batch(("a.py", 1, "R"), ("a.py", 2, "R"), ("a.py", 3, "R")), at(1)).findings
    ids = {r.line_number: r.id for r in stored.collect()}
    updates = spark.createDataFrame([
        (ids[1], "in_progress", None, None, None, 1), (ids[1], "fixed", "n" * 300, "abc", None, 2),
        (ids[1], None, None, None, "new fix", 3), (ids[2], "open", "", None, "", 1),
        (ids[3], "closed", "x", None, None, 1), ("unknown", "fixed", None, None, None, 1)], UPDATES)
    change = fnd.update_findings(stored, updates, at(5))
    got = {r.line_number: r for r in change.findings.collect()}
    assert (got[1].status, got[1].fix_commit_sha, got[1].suggested_fix, got[1].fixed_at.day) == ("fixed", "abc", "new fix", 5)
    assert (got[2].status, got[2].notes, got[2].suggested_fix, got[2].updated_at.day) == ("open", "", "fix", 5)
    assert (got[3].status, got[3].updated_at.day) == ("open", 1)
    audit = rows_of(change.audit.filter(F.col("finding_id") == ids[1]), "action", "old_value", "new_value")
    assert audit == [("fix_suggested", None, "new fix"), ("note_added", None, "n" * 300),
                     ("status_changed", "in_progress", "fixed"), ("status_changed", "open", "in_progress")]
    cut = fnd.update_findings(stored, updates, at(5), audit_text=200).audit
    assert rows_of(cut.filter("action = 'note_added'"), "new_value") == [("",), ("n" * 200,)]
    assert fnd.rejected_updates(updates).count() == 1
    assert change.audit.select("id").distinct().count() == change.audit.count()


def test_fixed_and_reopened_in_one_batch(spark, empty, batch):
    stored = fnd.merge_findings(empty, batch(("a.py", 1, "R")), at(1)).findings
    key = stored.first().id
    updates = spark.createDataFrame([
        (key, "open", None, None, None, 9), (key, "fixed", None, None, None, 3), (key, "fixed", None, None, None, 5)], UPDATES)
    change = fnd.update_findings(stored, updates, at(5))
    assert rows_of(change.audit, "old_value", "new_value") == [("fixed", "open"), ("open", "fixed")]
    assert rows_of(change.findings, "status", F.dayofmonth("fixed_at")) == [("open", 5)]


def test_chunk_number_is_a_count_by_halving(spark):
    """The number of a chunk costs a step for each bit of the number of bounds, not one for each bound."""
    for size in (0, 1, 2, 3, 7, 8, 20):
        bounds = [10 * i for i in range(size)]
        rows = spark.range(-15, 220).select("id").unionByName(spark.createDataFrame([(None,)], "id LONG"))
        got = rows.select("id", chunk_number(F.col("id"), bounds).alias("n")).collect()
        assert all(r.n == sum(r.id is not None and b < r.id for b in bounds) for r in got)


def test_findings_with_few_updates_are_not_cut(spark):
    """Only the updates of findings with more than a chunk of them are cut."""
    stored = spark.createDataFrame([(str(i), "open") for i in range(50)], "id STRING, status STRING")
    updates = spark.createDataFrame([(str(i % 50), "fixed", None, None, None, i) for i in range(200)], UPDATES)
    plan = replayed(stored, updates, chunk=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "chunk" not in plan


def test_copies_of_a_stored_finding_in_a_replay(spark):
    """A finding that is stored twice: the second copy starts from what the batch leaves, with one window as with chunks."""
    stored = spark.createDataFrame([("a", "open"), ("a", "open"), ("b", "open")], "id STRING, status STRING")
    updates = spark.createDataFrame([
        ("a", None, "n", None, None, 1), ("a", "fixed", None, None, None, 2), ("a", None, "m", None, None, 3),
        ("b", None, "n", None, None, 1)], UPDATES)
    got = sorted((r.finding_id, r.ord, r.old_status, r.moved) for r in replayed(stored, updates).collect())
    assert got == [("a", 1, "fixed", False), ("a", 1, "open", False), ("a", 2, "fixed", False), ("a", 2, "open", True),
                   ("a", 3, "fixed", False), ("a", 3, "fixed", False), ("b", 1, "open", False)]


@pytest.mark.parametrize("chunk", [1, 7, 60, 100_000])
def test_replay_against_one_update_at_a_time(spark, empty, batch, chunk):
    """A hot finding, ties, empty and null fields, unknown findings; chunks change nothing."""
    draw = random.Random(8)
    stored = fnd.merge_findings(empty, batch(*[(f"f{i}.py", i, "R") for i in range(6)]), at(1)).findings
    ids = [r.id for r in stored.orderBy("line_number").collect()]
    rows = [(draw.choice([ids[0]] * 4 + ids + ["unknown"]), draw.choice([None, "", *fnd.STATUSES]),
             draw.choice([None, "", "note"]), draw.choice([None, "", "sha"]), draw.choice([None, "", "fix"]), n)
            for n in draw.sample(range(10_000), 400)]
    updates = spark.createDataFrame(rows, UPDATES).repartition(3)
    state = {r.id: {"status": r.status, "notes": r.notes, "fix_commit_sha": None, "suggested_fix": r.suggested_fix}
             for r in stored.collect()}
    log = []
    for key, status, notes, sha, fix, _ in sorted(rows, key=lambda r: r[5]):
        if key not in state:
            continue
        if status and status != state[key]["status"]:
            log.append((key, "status_changed", state[key]["status"], status))
            state[key]["status"] = status
        if notes is not None:
            log.append((key, "note_added", None, notes))
            state[key]["notes"] = notes
        if sha:
            state[key]["fix_commit_sha"] = sha
        if fix:
            log.append((key, "fix_suggested", None, fix))
            state[key]["suggested_fix"] = fix
    replay = replayed(stored, updates, chunk=chunk)
    moves = [(r.finding_id, "status_changed", r.old_status, r.status) for r in replay.filter("moved").orderBy("ord").collect()]
    assert moves == [x for x in log if x[1] == "status_changed"]
    change = fnd.update_findings(stored, updates, at(5))
    audit = change.audit.select("finding_id", "action", "old_value", "new_value").collect()
    assert sorted(map(tuple, audit), key=repr) == sorted(log, key=repr)
    assert {r.id: {k: r[k] for k in state[r.id]} for r in change.findings.collect()} == state


def test_no_updates(spark, empty, batch):
    stored = fnd.merge_findings(empty, batch(("a.py", 1, "R")), at(1)).findings
    change = fnd.update_findings(stored, spark.createDataFrame([], UPDATES), at(5))
    assert change.audit.count() == 0 and rows_of(change.findings, "status") == [("open",)]
    assert fnd.update_findings(empty, spark.createDataFrame([("x", "fixed", None, None, None, 1)], UPDATES), at(5)).audit.count() == 0


def test_delete(spark, empty, batch):
    change = fnd.merge_findings(empty, batch(("a.py", 1, "R"), ("a.py", 2, "R")), at(1))
    gone = change.findings.filter("line_number = 1").select("id")
    left = fnd.delete_findings(change.findings, change.audit, gone)
    assert left.findings.count() == 1 and left.audit.count() == 1


def test_manual(spark, empty):
    rows = spark.createDataFrame([("a.py", 1, "High", "a05"), ("a.py", 1, "awful", "A05"), ("a.py", 1, "low", "B1"),
                                  ("a.py", 1, None, "A01")],
                                 "file_path STRING, line_number INT, severity STRING, owasp_category STRING")
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in ("scan_id", "title", "description", "code_snippet", "suggested_fix")})
    assert rows_of(fnd.validated_manual(rows).filter("reject_reason IS NOT NULL"), "reject_reason") == [
        ("category",), ("severity",), ("severity",)]
    merged = fnd.merge_findings(empty, fnd.manual_candidates(rows), at(1)).findings
    assert rows_of(merged, "severity", "owasp_category", "fingerprint") == [("high", "A05", None)]


def test_verify(spark, make_files, empty):
    files = make_files({"p/a.py": "\n" * 9 + "eval(x)\neval(y)"})
    matches = scan_text(files, ALL_RULES)
    rows = [("near", "p/a.py", 5, "A05-004", "open"), ("far", "p/a.py", 4, "A05-004", "accepted"),
            ("below", "p/a.py", 16, "A05-004", "open"), ("none", "p/a.py", None, "A05-004", "open"),
            ("norule", "p/a.py", 5, None, "open"), ("blank", "p/a.py", 5, "", "open"),
            ("done", "p/a.py", 5, "A05-004", "false_positive"), ("conf", "p/a.py", 5, "config-X", "open"),
            ("gone", "p/b.py", 5, "A05-004", "open")]
    stored = empty.unionByName(spark.createDataFrame(
        rows, "id STRING, file_path STRING, line_number INT, rule_id STRING, status STRING"), allowMissingColumns=True)
    outcome = fnd.verify_findings(stored, files, matches, [r.id for r in ALL_RULES])
    assert {r.id: (r.outcome, r.near) for r in outcome.collect()} == {
        "near": ("still_present", [10]), "far": ("verified_fixed", None), "below": ("still_present", [11]),
        "none": ("verified_fixed", None), "norule": ("no_rule", None), "blank": ("no_rule", None),
        "done": ("already_resolved", None), "conf": ("unknown_rule", None), "gone": ("file_missing", None)}
    closed = fnd.update_findings(stored, fnd.fixes_as_updates(outcome), at(3)).findings
    assert rows_of(closed.filter("fixed_at IS NOT NULL"), "id") == [("far",), ("none",)]


def test_near_range_against_brute_force(spark, empty):
    lines = [1, 2, 6, 7, 12, 13, 18, 30, 31, 36]
    stored = empty.unionByName(spark.createDataFrame(
        [(str(n), "f", n, "R", "open") for n in range(0, 45)],
        "id STRING, file_path STRING, line_number INT, rule_id STRING, status STRING"), allowMissingColumns=True)
    matches = spark.createDataFrame([("f", "R", n) for n in lines], "path STRING, rule_id STRING, line_number INT")
    near = {r.id: r.near for r in fnd.nearby_matches(stored, matches).collect()}
    assert near == {str(n): [m for m in lines if abs(m - n) <= 5] for n in range(0, 45)
                    if any(abs(m - n) <= 5 for m in lines)}


def test_baseline_gate_listing(spark, empty, batch):
    stored = fnd.merge_findings(empty, batch(("Src/a_1.py", 1, "R"), ("b.py", 2, "R"), ("c.py", 3, None)), at(1)).findings
    assert fnd.baseline(stored).count() == 2
    assert rows_of(fnd.beyond_baseline(batch(("b.py", 2, "R"), ("b.py", 9, "R")), fnd.baseline(stored)), "line_number") == [(9,)]
    assert rows_of(fnd.filter_findings(stored, path_part="src/A"), "line_number") == [(1,)]
    assert rows_of(fnd.filter_findings(stored, path_part="a_1", severity="high", status="open", category="A05", scan_id="s1"), "line_number") == [(1,)]
    assert fnd.newest(stored, 2).count() == 2
    assert fnd.newest(stored).count() == stored.count()
    assert fnd.filter_findings(stored, path_part="src\\a").count() == 0
    assert "notes" not in fnd.compact(stored).columns
    assert tuple(fnd.gate(stored).first()) == (3, False)
    assert tuple(fnd.gate(stored, "critical").first()) == (0, True)


def test_trends_on_no_data(spark, empty):
    assert tuple(agg.trend_totals(empty, at(1)).first()) == (0, 0, 0, None)
    assert agg.daily_changes(empty).count() == 0


def test_status_history(spark):
    rows = [("1", "f", "created", None, "high: t", "2025-01-01 10:00:00"),
            ("2", "f", "status_changed", "open", "fixed", "2025-01-01 12:00:00"),
            ("3", "f", "note_added", None, "x", "2025-01-02 12:00:00"),
            ("4", "f", "status_changed", "fixed", "open", "2025-01-05 12:00:00"),
            ("5", "g", "created", None, "low: t", "2025-01-03 12:00:00")]
    audit = spark.createDataFrame(rows, "id STRING, finding_id STRING, action STRING, old_value STRING, new_value STRING, t STRING")
    audit = audit.withColumn("timestamp", F.to_timestamp("t")).drop("t")
    history = rows_of(agg.status_history(audit), "finding_id", F.date_format("since", "d H"), "status", F.date_format("until", "d H"))
    assert history == [("f", "1 10", "open", "1 12"), ("f", "1 12", "fixed", "5 12"),
                       ("f", "5 12", "open", None), ("g", "3 12", "open", None)]


def test_snapshots(spark, tmp_path, make_files):
    start = empty_snapshot(spark, str(tmp_path / "v0"))
    files = make_files({"p/a.py": "eval(x)\nos.system(c)", "p/docs/a.py": "eval(x)", "p/.owaspignore": "docs/",
                        "p/build/a.py": "eval(x)", "p/web.py": "import flask"})
    found = scan_files(files, scan_id="s1")
    v1 = merge_into(start, found, str(tmp_path / "v1"), at(1))
    assert rows_of(v1.findings(spark), "file_path", "line_number", "severity") == [
        ("p/a.py", 1, "critical"), ("p/a.py", 2, "critical")]
    v2 = merge_into(v1, scan_files(files, scan_id="s2"), str(tmp_path / "v2"), at(2))
    assert v2.findings(spark).count() == 2 and v2.audit(spark).count() == 2
    ids = v2.findings(spark).filter("line_number = 1")
    updates = ids.select(F.col("id").alias("finding_id"), F.lit("accepted").alias("status"), F.lit("ok").alias("notes"),
                         F.lit(None).cast("string").alias("fix_commit_sha"), F.lit(None).cast("string").alias("suggested_fix"),
                         F.lit(1).cast("long").alias("ord"))
    v3 = update_into(v2, updates, str(tmp_path / "v3"), at(3))
    counts = {r["status"]: r["count"] for r in agg.by_status(v3.findings(spark)).collect()}
    assert counts == {"open": 1, "accepted": 1}
    assert v3.audit(spark).count() == 4
    known = write_baseline(v3, spark, str(tmp_path / "baseline"))
    assert rows_of(fnd.beyond_baseline(scan_files(files, scan_id="s4"), known), "line_number") == [(1,)]
    v4 = delete_from(v3, v3.findings(spark).filter("status = 'accepted'").select("id"), str(tmp_path / "v4"))
    assert v4.findings(spark).count() == 1 and v4.audit(spark).count() == 1
    with pytest.raises(ValueError):
        update_into(v3, updates, v3.folder, at(4))


def test_baseline_file(spark, tmp_path):
    path = tmp_path / "baseline.json"
    path.write_text('{\n "version": 1,\n "fingerprints": ["a", "b"],\n "count": 2\n}')
    assert rows_of(read_baseline_file(spark, str(path)), "fingerprint") == [("a",), ("b",)]


def test_incremental_and_single_path(spark, make_files):
    old = make_files({"p/a.py": "eval(x)", "p/b.py": "x = 1"})
    new = make_files({"p/a.py": "eval(x)", "p/b.py": "exec(y)", "p/c.py": "eval(z)"})
    assert rows_of(scan_changes(old, new, scan_id="s"), "file_path") == [("p/b.py",), ("p/c.py",)]
    assert rows_of(scan_path(new, "p/c.py", scan_id="s"), "file_path") == [("p/c.py",)]


def test_scan_rows(spark, empty, batch):
    scans = open_scan(spark, "s1", "directory", "/src", at(1), ["A05"]).unionByName(
        open_scan(spark, "s0", "file", "/x", at(2)))
    stored = fnd.merge_findings(empty, batch(("a.py", 1, "R"), ("a.py", 2, "R")), at(1)).findings
    closed = complete_scans(scans, stored, at(3))
    assert rows_of(closed, "id", "status", "findings_count") == [("s0", "completed", 0), ("s1", "completed", 2)]
    assert [r.id for r in fnd.newest_scans(closed, 1).collect()] == ["s0"]
    assert tuple(agg.scan_history_range(scans).first()) == (2, "2025-01-01", "2025-01-02")


def test_audit_trail(spark, empty, batch):
    change = fnd.merge_findings(empty, batch(("a.py", 1, "R")), at(1))
    rows = fnd.with_audit_trail(change.findings, change.audit).collect()
    assert [(r.owasp_label, r.action) for r in rows] == [("Injection", "created")]


def test_bucketed_table(spark, empty, batch):
    from vetgrid.plans.snapshots import write_bucketed
    stored = fnd.merge_findings(empty, batch(("a.py", 1, "R")), at(1)).findings
    write_bucketed(stored, "findings_bucketed", 4)
    assert spark.table("findings_bucketed").count() == 1
    spark.sql("DROP TABLE findings_bucketed")


def test_audit_schema(spark):
    assert spark.createDataFrame([], AUDIT_LOG).columns[1] == "finding_id"
