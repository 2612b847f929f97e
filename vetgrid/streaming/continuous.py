"""Scans and counts over arriving rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vetgrid.operators.scan import scan_text, to_findings
from vetgrid.plans.tables import open_table
from vetgrid.rules.catalog import ALL_RULES, Rule


def scan_stream(
    files: DataFrame,
    *,
    scan_id: str,
    rules: Sequence[Rule] = tuple(ALL_RULES),
    event_time: str | None = None,
    watermark: str = "1 day",
) -> DataFrame:
    """Candidates from a stream of files; the scan itself keeps no state.

    With an event time, a fingerprint seen again within the watermark is dropped; the state
    then holds one key for each fingerprint of that period. Without one, merge the batches with
    ``merge_batches``, which is exact over all time.
    """
    keep = ("path",) if event_time is None else ("path", event_time)
    matches = scan_text(files, rules, keep=keep)
    extra = () if event_time is None else (event_time,)
    found = to_findings(matches, scan_id=scan_id, extra=extra)
    if event_time is None:
        return found
    return found.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark(["fingerprint"])


def merge_batches(
    candidates: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Hand every micro-batch of candidates to ``merge(batch, batch_id)`` once.

    ``merge`` has to be idempotent for a batch id, for instance by writing the version folder of
    that id; a batch is repeated after a failure.
    """
    return (
        candidates.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def merge_into_table(candidates: DataFrame, folder: str, checkpoint: str, now: Column, *,
                     stream: str = "scan") -> StreamingQuery:
    """Merge every micro-batch of candidates into the table at ``folder``, each exactly once.

    A batch that is repeated after a failure finds its number in the table's manifest and changes nothing.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        open_table(batch.sparkSession, folder).merge(batch, now, stream=stream, batch_id=batch_id)

    return merge_batches(candidates, merge, checkpoint)


def windowed_counts(findings: DataFrame, *, time: str = "found_at", key: str = "severity",
                    window: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Findings for each window of time and key."""
    return (
        findings.withWatermark(time, watermark)
        .groupBy(F.window(time, window).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("count"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                key, "count")
    )
