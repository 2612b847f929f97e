"""Connected components of a link table, in rounds of Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vetgrid.session import stage_table


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``links (a, b)``; the root is the least node reached.

    Large-star and small-star steps in turn: each node hooks its neighbours to its least
    neighbour, which halves distances, so that rounds grow with the logarithm of a chain. Minima
    are partial aggregates and the joins carry two keys a row, so a node with very many links
    needs no task of its own. Every round is written to the shared folder, which also cuts the
    lineage. Loops (a = b) and repeated or reversed links are allowed; nodes without a link to
    another node are not returned, and an empty table gives an empty result.
    """
    links = stage_table(_down(links), "links")
    state = _fingerprint(links)
    while state[0]:
        links = stage_table(_small(_large(links)), "links")
        last, state = state, _fingerprint(links)
        if state == last:
            break
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _down(links: DataFrame) -> DataFrame:
    return links.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    links = links.filter("a > b")
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    hooked = links.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hooked.unionByName(least.withColumnRenamed("m", "b")).distinct()


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40)),
                    F.max(F.xxhash64("b", "a"))).first()
    return tuple(row)
