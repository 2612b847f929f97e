"""Ordered replay of updates: every update sees the state that the ones before it left.

An update is a change of state: a field that it names takes the new value, the others stay. Changes
compose. A finding with up to ``CHUNK`` updates is one window, which gives each update the last status
before it. The updates of all others are cut into chunks by quantiles of their ``ord`` and folded in two
steps: a window inside a finding's chunk, and another one over its chunks, one small row each, that
carries the last status on. A finding that a third of all updates belong to is spread over all chunks,
and none of its windows holds more rows than a chunk has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetgrid.functions.constants import constant
from vetgrid.session import stage_table

CHUNK = 100_000  # updates of a chunk, about
MOST_CHUNKS = 1024  # bounds that a plan carries; beyond them chunks grow
FIELDS = ("status", "notes", "fix_commit_sha", "suggested_fix")


def _given(name: str) -> Column:
    """The value of a field that an update sets. An empty note empties the notes, other empty texts set nothing."""
    return F.col(name) if name == "notes" else F.when(F.col(name) != "", F.col(name))


def chunk_bounds(updates: DataFrame, chunk: int = CHUNK) -> list[int]:
    """Values of ``ord`` that cut a batch into parts of about ``chunk`` updates."""
    count = updates.count()
    parts = min(-(-count // chunk), MOST_CHUNKS)
    if parts < 2:
        return []
    shares = [i / parts for i in range(1, parts)]
    cuts = updates.agg(F.percentile_approx("ord", shares, 10 * parts)).first()[0]
    return sorted(set(cuts or []))


def chunk_number(order: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` lie below ``order`` (null: none), by halving: a step for each bit of their number."""
    steps = [1 << bit for bit in reversed(range(len(bounds).bit_length()))]
    if not steps:
        return F.lit(0)
    cuts = constant(bounds, "array<bigint>")

    def halve(below: Column, step: Column) -> Column:
        return F.when(F.get(cuts, below + step - 1) < order, below + step).otherwise(below)

    return F.aggregate(constant(steps, "array<int>"), F.lit(0), halve)


def replayed(stored: DataFrame, updates: DataFrame, *, chunk: int = CHUNK) -> DataFrame:
    """``(finding_id, ord, old_status, moved, status, notes, fix_commit_sha, suggested_fix, place)``.

    One row for each of ``updates (finding_id, status, notes, fix_commit_sha, suggested_fix, ord)`` of a
    stored finding, fields as the update gives them. ``old_status`` is the status before this update,
    ``moved`` tells whether it changed it; ``place`` orders the updates of a finding: by ``ord`` (null
    first), ties by a hash of the fields. An update that stands twice is two updates.
    """
    known = stored.select(F.col("id").alias("finding_id"), F.col("status").alias("stored_status"))
    rows = updates.select(
        "finding_id", "ord", *[_given(c).alias(c) for c in FIELDS],
        F.struct(F.col("ord"), F.xxhash64(*FIELDS).alias("tie")).alias("place"))
    # At most one row for ``chunk`` updates.
    hot = stage_table(rows.groupBy("finding_id").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("finding_id").isNotNull() & (F.col("n") > chunk)).select("finding_id"), "updates-hot")
    if hot.isEmpty():
        old = _in_one_window(rows, known)
    else:
        old = _in_one_window(rows.join(hot, "finding_id", "left_anti"), known).unionByName(
            _in_chunks(rows.join(hot, "finding_id", "left_semi"), known, chunk))
    moved = F.col("status").isNotNull() & ~F.col("status").eqNullSafe(F.col("old_status"))
    return old.select("finding_id", "ord", "old_status", moved.alias("moved"), *FIELDS, "place")


def _last_before(*keys: str, order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def _in_one_window(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Updates with ``old_status``, a window for each finding.

    A finding that is stored more than once gets its updates once for each copy; those of the second copy
    on start from the status that the batch leaves.
    """
    whole = Window.partitionBy("finding_id").orderBy("place").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = known.withColumn("copy", F.row_number().over(Window.partitionBy("finding_id").orderBy("stored_status")))
    return rows.withColumns({
        "before": F.last("status", ignorenulls=True).over(_last_before("finding_id", order="place")),
        "left": F.last("status", ignorenulls=True).over(whole),
    }).join(numbered, "finding_id").withColumn("old_status", F.coalesce(
        "before", F.when(F.col("copy") > 1, F.col("left")), "stored_status")).drop("before", "left", "copy", "stored_status")


def _in_chunks(rows: DataFrame, known: DataFrame, chunk: int) -> DataFrame:
    """Updates with ``old_status``, windows inside a finding's chunks and over its chunks."""
    rows = rows.withColumn("chunk", chunk_number(F.col("ord"), chunk_bounds(rows, chunk)))
    inside = F.last("status", ignorenulls=True).over(_last_before("finding_id", "chunk", order="place"))
    ends = rows.groupBy("finding_id", "chunk").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col("place"))).alias("last_status"))
    over = F.last("last_status", ignorenulls=True).over(_last_before("finding_id", order="chunk"))
    carried = ends.join(known, "finding_id").select(
        "finding_id", "chunk", F.coalesce(over, F.col("stored_status")).alias("carried"))
    return rows.withColumn("before", inside).join(carried, ["finding_id", "chunk"]).withColumn(
        "old_status", F.coalesce("before", "carried")).drop("before", "carried", "chunk")


def final_values(replay: DataFrame, now: Column) -> DataFrame:
    """What the updates leave of each finding: last given value of each field, and when it was last fixed."""
    def last(name: str) -> Column:
        return F.max_by(name, F.when(F.col(name).isNotNull(), F.col("place"))).alias(name)

    return replay.groupBy("finding_id").agg(
        *map(last, FIELDS), F.max(F.when(F.col("moved") & (F.col("status") == "fixed"), now)).alias("fixed_at"))
