from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from vetgrid.plans.snapshots import Snapshot, empty_snapshot, merge_into
from vetgrid.streaming.continuous import merge_batches, scan_stream, windowed_counts
from workload.queries import arriving, run_stream

SCHEMA = "path STRING, content STRING, arrived TIMESTAMP"


def arrive(spark, folder, *rows):
    made = [(p, t, dt.datetime(2025, 1, 1, hour)) for p, t, hour in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def finish(query):
    query.awaitTermination()
    assert query.exception() is None


def test_scan_stream_drops_repeats(spark, tmp_path):
    folder = str(tmp_path / "in")
    arrive(spark, folder, ("p/a.py", "eval(x)", 1))
    arrive(spark, folder, ("p/a.py", "eval(x)\nos.system(c)", 2))
    found = scan_stream(stream(spark, folder), scan_id="s", event_time="arrived")
    finish(found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
           .trigger(availableNow=True).start(str(tmp_path / "out")))
    rows = spark.read.parquet(str(tmp_path / "out")).select("rule_id", "line_number").collect()
    assert sorted(map(tuple, rows)) == [("A05-004", 1), ("A05-006", 2)]


def test_merge_batches(spark, tmp_path):
    folder = str(tmp_path / "in")
    arrive(spark, folder, ("p/a.py", "eval(x)", 1))
    arrive(spark, folder, ("p/a.py", "eval(x)", 2), ("p/b.py", "exec(y)", 2))
    versions = [empty_snapshot(spark, str(tmp_path / "v"))]

    def merge(batch, batch_id):
        now = F.to_timestamp(F.lit("2025-01-01 00:00:00"))
        versions.append(merge_into(versions[-1], batch, str(tmp_path / f"v{batch_id}"), now))

    finish(merge_batches(scan_stream(stream(spark, folder), scan_id="s"), merge, str(tmp_path / "c")))
    last: Snapshot = versions[-1]
    assert last.findings(spark).count() == 2 and last.audit(spark).count() == 2


def test_windowed_counts(spark, tmp_path):
    folder = str(tmp_path / "in")
    arrive(spark, folder, ("high", "", 1), ("high", "", 2), ("low", "", 3))
    arrive(spark, folder, ("high", "", 23))
    rows = stream(spark, folder).select(F.col("path").alias("severity"), F.col("arrived").alias("found_at"))
    counts = windowed_counts(rows, window="4 hours")
    finish(counts.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c"))
           .trigger(availableNow=True).start(str(tmp_path / "out")))
    got = spark.read.parquet(str(tmp_path / "out")).select("severity", "count").collect()
    assert sorted(map(tuple, got)) == [("high", 2), ("low", 1)]


def test_a_table_arrives_as_a_folder_or_as_a_file(spark, tmp_path):
    rows = spark.range(5).coalesce(1)
    rows.write.parquet(f"{tmp_path}/folder/documents.parquet")
    part = next((tmp_path / "folder/documents.parquet").glob("part-*"))
    (tmp_path / "file").mkdir()
    (tmp_path / "file/documents.parquet").write_bytes(part.read_bytes())
    for kind in ("folder", "file"):
        read = run_stream(arriving(spark, f"{tmp_path}/{kind}", "documents"), "arriving")
        assert {r.id for r in read.collect()} == set(range(5))
