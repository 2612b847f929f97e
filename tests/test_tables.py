from __future__ import annotations

import datetime as dt
import hashlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vetgrid.plans.tables import create_table, open_table
from vetgrid.schemas import UPDATES
from vetgrid.streaming.continuous import merge_into_table, scan_stream

CANDIDATE = ("scan_id STRING, file_path STRING, line_number INT, rule_id STRING, fingerprint STRING, owasp_category STRING, "
             "severity STRING, title STRING, description STRING, code_snippet STRING, suggested_fix STRING, confidence DOUBLE, id STRING")


def at(day: int):
    return F.to_timestamp(F.lit(f"2025-01-{day:02d} 10:00:00"))


@pytest.fixture
def batch(spark):
    def make(*keys, scan="s1", loose=0):
        rows = [(scan, f"{k}.py", 1, "R", hashlib.sha256(str(k).encode()).hexdigest(), "A05", "high", f"t{k}", "d", "c", "f", None, None)
                for k in keys]
        rows += [(scan, "loose.py", n, None, None, "A05", "low", "loose", "d", "c", "f", None, None) for n in range(loose)]
        return spark.createDataFrame(rows, CANDIDATE)
    return make


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_merge_touches_its_buckets_only(spark, tmp_path, batch):
    table = create_table(spark, str(tmp_path / "t"), buckets=16).merge(batch(*range(60)), at(1))
    before = dict(table.manifest.findings)
    assert 12 <= len(before) <= 16 and table.findings().count() == 60 and table.audit().count() == 60
    files = {p: p.stat().st_mtime_ns for p in Path(table.folder, "findings").rglob("*.parquet")}
    second = table.merge(batch(3, 99, scan="s2"), at(2))
    changed = {b for b, p in second.manifest.findings.items() if before.get(b) != p}
    assert 1 <= len(changed) <= 2
    assert {p: p.stat().st_mtime_ns for p in files} == files
    assert second.findings().count() == 61 and second.audit().count() == 61
    assert rows_of(second.findings().filter("scan_id = 's2'"), "file_path", F.dayofmonth("found_at")) == [("3.py", 1), ("99.py", 2)]
    assert table.findings().count() == 60  # the old version stays readable
    assert rows_of(open_table(spark, table.folder).findings(), "id") == rows_of(second.findings(), "id")
    assert open_table(spark, table.folder, 1).findings().count() == 60


def test_rows_without_fingerprint_are_added(spark, tmp_path, batch):
    table = create_table(spark, str(tmp_path / "t"), buckets=4).merge(batch(1, 2, loose=5), at(1))
    table = table.merge(batch(loose=5, scan="s2"), at(2)).merge(batch(2, scan="s3", loose=1), at(3))
    assert table.findings().filter("fingerprint is null").count() == 11
    assert table.findings().count() == 13 and table.audit().count() == 13


def test_update_and_delete(spark, tmp_path, batch):
    table = create_table(spark, str(tmp_path / "t"), buckets=8).merge(batch(*range(20), loose=2), at(1))
    ids = {r.file_path: r.id for r in table.findings().collect()}
    updates = spark.createDataFrame([(ids["3.py"], "fixed", None, None, None, 1), (ids["3.py"], "open", "again", None, None, 2),
                                     ("unknown", "fixed", None, None, None, 1)], UPDATES)
    changed = table.update(updates, at(2))
    assert sum(changed.manifest.findings[b] != p for b, p in table.manifest.findings.items()) == 1
    assert rows_of(changed.findings().filter("status = 'open' AND fixed_at IS NOT NULL"), "file_path", "notes") == [("3.py", "again")]
    assert changed.audit().count() == 22 + 3
    left = changed.delete(changed.findings().filter("file_path IN ('3.py', '5.py')").select("id"))
    assert left.findings().count() == 20 and left.audit().count() == 20
    left = left.update(spark.createDataFrame([], UPDATES), at(3))
    assert left.findings().count() == 20
    gone = left.delete(left.findings().select("id"))
    assert gone.findings().count() == 0 and gone.audit().count() == 0 and gone.manifest.findings == {}
    assert gone.merge(batch(1), at(4)).findings().count() == 1


def test_failed_change_leaves_the_version(spark, tmp_path, batch):
    table = create_table(spark, str(tmp_path / "t"), buckets=4).merge(batch(1, 2), at(1))
    broken = batch(3).withColumn("title", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        table.merge(broken, at(2))
    assert open_table(spark, table.folder).manifest == table.manifest
    assert table.merge(batch(3), at(2)).findings().count() == 3


def test_second_writer_fails(spark, tmp_path, batch):
    table = create_table(spark, str(tmp_path / "t"), buckets=4)
    table.merge(batch(1), at(1))
    with pytest.raises(Exception, match="already exists"):
        table.merge(batch(2), at(1))
    assert open_table(spark, table.folder).findings().count() == 1
    with pytest.raises(Exception, match="already exists"):
        create_table(spark, table.folder)
    with pytest.raises(ValueError, match="no version 9"):
        open_table(spark, table.folder, 9)


def test_sweep(spark, tmp_path, batch):
    table = create_table(spark, str(tmp_path / "t"), buckets=4).merge(batch(1, 2, 3), at(1))
    for day in range(2, 6):
        table = table.merge(batch(1, 2, 3, scan=f"s{day}"), at(day))
    gone = table.sweep(keep=2)
    assert any(p.startswith("findings/v1") for p in gone) and not any(p.startswith("audit/") for p in gone)
    last = open_table(spark, table.folder)
    assert last.findings().count() == 3 and last.audit().count() == 3
    assert open_table(spark, table.folder, last.manifest.version - 1).findings().count() == 3
    with pytest.raises(ValueError):
        open_table(spark, table.folder, 1)
    assert last.sweep(keep=2) == []


def test_a_batch_is_merged_once(spark, tmp_path, batch):
    table = create_table(spark, str(tmp_path / "t"), buckets=4)
    table = table.merge(batch(1), at(1), stream="s", batch_id=0).merge(batch(2), at(1), stream="other", batch_id=0)
    again = table.merge(batch(1, 7), at(2), stream="s", batch_id=0)
    assert again is table and open_table(spark, table.folder).manifest.batches == {"s": 0, "other": 0}
    assert table.merge(batch(7), at(2), stream="s", batch_id=1).findings().count() == 3


def test_stream_into_table(spark, tmp_path):
    schema, folder = "path STRING, content STRING, arrived TIMESTAMP", str(tmp_path / "in")
    for hour, rows in enumerate([[("p/a.py", "eval(x)")], [("p/a.py", "eval(x)"), ("p/b.py", "exec(y)")]]):
        made = [(*r, dt.datetime(2025, 1, 1, hour)) for r in rows]
        spark.createDataFrame(made, schema).coalesce(1).write.mode("append").parquet(folder)
    create_table(spark, str(tmp_path / "t"), buckets=4)
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    merge_into_table(scan_stream(files, scan_id="s"), str(tmp_path / "t"), str(tmp_path / "c"), at(1)).awaitTermination()
    table = open_table(spark, str(tmp_path / "t"))
    assert table.manifest.version == 2 and table.manifest.batches == {"scan": 1}
    assert table.findings().count() == 2 and table.audit().count() == 2
