"""Approximate nearest neighbours by a forest of hash prefixes.

A tree gives every vector a hash string of ``BITS`` bits, the signs of random projections, and keeps
the strings of a block as a sorted array. A query descends to the longest prefix that it shares with
any string; the strings with a common prefix are one range of the array. All trees then ascend
together, one bit at a time, and their ranges grow, until the trees hold enough candidates. The
scores of the candidates are computed exactly from the original vectors.

Inner products are not angles. Vectors are lifted to a common length by one more component before
they are hashed (the query's is zero), after which the nearest angle is the largest inner product.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetgrid.llm import blocks

TREES = 24
BITS = 62
CANDIDATES = 1.0  # entries to gather over all trees, in rows of the block; ``LEAST`` entries at least
LEAST = 1000
SEED = 11


def codes(vectors: np.ndarray, tree: int) -> np.ndarray:
    """Hash strings as integers, first bit highest."""
    planes = np.random.Generator(np.random.PCG64((SEED, tree))).standard_normal((vectors.shape[1], BITS))
    return (vectors @ planes > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def forest_search(query_ids, queries, ids, rows, k: int, longest: float):
    """The best ``k`` gathered rows of a block for each query."""
    lifted = np.hstack([rows, np.sqrt(np.maximum(longest**2 - (rows**2).sum(1), 0))[:, None]])
    asked = np.hstack([queries, np.zeros((len(queries), 1))])
    trees = []
    for tree in range(TREES):
        code = codes(lifted, tree)
        order = np.argsort(code, kind="stable")
        trees.append((code[order], order, codes(asked, tree)))
    wanted = min(TREES * len(ids), max(LEAST, int(CANDIDATES * len(ids))))
    starts, ends = _ascended(trees, len(queries), wanted)
    who, found, scores = [], [], []
    for q, query in enumerate(queries):
        able = np.zeros(len(ids), bool)
        for t, (_, order, _) in enumerate(trees):
            able[order[starts[t, q] : ends[t, q]]] = True
        at = np.flatnonzero(able)
        at = at[ids[at] != query_ids[q]]
        exact = (rows[at] * query).sum(1)
        if len(at) > k:
            kth = np.partition(exact, len(at) - k)[len(at) - k]
            at, exact = at[exact >= kth], exact[exact >= kth]
        take = blocks.best(exact, ids[at], k)
        who.append(np.full(len(take), query_ids[q]))
        found.append(ids[at][take])
        scores.append(exact[take])
    return np.concatenate(who), np.concatenate(found), np.concatenate(scores)


def _ascended(trees: list, queries: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of all trees at the longest common prefix length that gathers ``wanted`` entries, what
    trees share counted in each. The root (length 0) holds every row, so the ascent always ends."""
    starts = np.zeros((len(trees), queries), np.int64)
    ends = np.zeros_like(starts)
    open_ = np.arange(queries)
    for length in range(BITS, -1, -1):
        for t, (code, _, asked) in enumerate(trees):
            low = asked[open_] >> (BITS - length) << (BITS - length)
            starts[t, open_] = np.searchsorted(code, low, "left")
            ends[t, open_] = np.searchsorted(code, low + ((1 << (BITS - length)) - 1), "right")
        held = (ends - starts)[:, open_].sum(0)
        open_ = open_[held < wanted]
        if not len(open_):
            break
    return starts, ends


def nearest(vectors: DataFrame, *, k: int = 20, every: int = 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` nearest rows found, by inner product.

    Queries are the rows whose ``vec_id`` is divisible by ``every``, candidates all rows with another
    id. Every row is indexed. Scores are inner products of the original vectors in double precision.
    Rows with null ids, null or zero vectors or null or non-finite components take no part; repeated
    rows count once; of vectors of several lengths the most common length takes part. Fewer
    candidates give fewer ranks; ties go to the smaller ``vec_id``. No rows give no rows.
    """
    rows = blocks.usable(vectors).filter(F.exists("embedding", lambda x: x != 0))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    longest = rows.agg(F.max(length)).first()[0] or 0.0

    def search(query_ids, queries, ids, rows):
        return forest_search(query_ids, queries, ids, rows, k, longest)

    return blocks.against_all(rows, F.col("vec_id") % every == 0, search, "double", k)


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of ``embeddings`` found for each 20th of them."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
