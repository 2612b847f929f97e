"""Sharding by a Feistel permutation of global row numbers, in DataFrame functions only.

Rows get a number from 0 to N - 1 in the order of a hash of what identifies them, which depends on
the rows alone and never on files or partitions. The number is permuted by a keyed Feistel network
over a grid a x b that is only just larger than N; a number that leaves [0, N) walks on along its
cycle until it is back. Shard and slot follow from the permuted number p by arithmetic: shard
``p % shards``, slot ``p div shards``. Row counts of shards differ by one at most (the law ``rows``).
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vetgrid.session import stage_table

ROUNDS = 6
PREFIX_BITS = 12  # row numbers are counted inside 4096 ranges of the hash
CHUNK = 1 << 16  # equal rows are expanded in steps of so many


def permuted(number: Column, rows: int, seed: int) -> Column:
    """One pass of the Feistel network over the grid of ``rows`` cells or a few more.

    In each round one half takes a keyed hash of the other, modulo its own side of the grid, so
    every round, and so the whole, is one to one.
    """
    a, b = grid(rows)
    left, right = F.floor(number / F.lit(b)).cast("long"), number % F.lit(b)
    for step in range(ROUNDS):
        if step % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(F.lit(seed), F.lit(step), right), F.lit(a)), F.lit(a))
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(F.lit(seed), F.lit(step), left), F.lit(b)), F.lit(b))
    return left * F.lit(b) + right


def grid(rows: int) -> tuple[int, int]:
    a = isqrt(max(rows - 1, 0)) + 1
    return a, -(-max(rows, 1) // a)


def longest_walk(spark: SparkSession, rows: int, seed: int) -> int:
    """Steps after which every number is back in range: only the cells beyond ``rows``, fewer than the
    square root of it, can lengthen a walk, so these are followed until none is left outside."""
    if not rows:
        return 1
    a, b = grid(rows)
    outside, steps = spark.range(rows, a * b).select(F.col("id").alias("p")), 1
    while not outside.isEmpty():
        outside = stage_table(outside.select(permuted(F.col("p"), rows, seed).alias("p")).filter(
            F.col("p") >= rows), "walk")
        steps += 1
    return steps


def shards(docs: DataFrame, *, count: int = 16, seed: int = 20240607) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for each row of ``docs (doc_id, text, ...)``.

    ``size`` is the UTF-8 length plus 1 (null text: 1), ``text_crc32`` the unsigned checksum (null text:
    0, as for the empty one). Rows alike in id, size and checksum are counted once and numbered in a
    row, so a group of copies of any size is spread evenly and no key is gathered. Ties of the hash
    go by id, size and checksum; a null id is a value like others. Further columns are ignored. No rows
    give no rows. ``grown_shard`` is null, as for any law but ``key``.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary"))
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"))
    key = F.xxhash64(F.lit(seed), "doc_id", "size", "text_crc32")
    groups = stage_table(narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies")).select(
        "*", key.alias("key"), F.shiftright(key, 64 - PREFIX_BITS).alias("range")), "shard-rows")
    ranges = groups.groupBy("range").agg(F.sum("copies").alias("total"))
    # 4096 rows at most, whatever the input.
    starts = ranges.select("range", (F.sum("total").over(Window.orderBy("range")) - F.col("total")).alias("start"))
    rows = groups.agg(F.sum("copies")).first()[0] or 0
    inside = F.sum("copies").over(
        Window.partitionBy("range").orderBy("key", "doc_id", "size", "text_crc32")) - F.col("copies")
    numbered = groups.withColumn("inside", inside).join(F.broadcast(starts), "range")
    chunks = numbered.select(
        "doc_id", "size", "text_crc32", "copies", (F.col("start") + F.col("inside")).alias("first"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / CHUNK).cast("long"))).alias("chunk"))
    each = chunks.select(
        "doc_id", "size", "text_crc32", "first",
        F.explode(F.sequence(F.col("chunk") * CHUNK, F.least(F.col("copies"), (F.col("chunk") + 1) * CHUNK) - 1)).alias("nth"))
    place = permuted(F.col("first") + F.col("nth"), rows, seed)
    placed = each.select("doc_id", "size", "text_crc32", place.alias("p"))
    for _ in range(longest_walk(spark, rows, seed) - 1):
        placed = placed.withColumn("p", F.when(F.col("p") < rows, F.col("p")).otherwise(permuted(F.col("p"), rows, seed)))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("p") % count).cast("int").alias("shard"),
        F.floor(F.col("p") / count).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 16 shards."""
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
