"""Exact top-k by the aggregation that needs no random access.

In every block each dimension is a list of the block's rows sorted by its component. A query reads
each list from the end that its own component favours, all lists to the same depth. A row's lower
bound adds what was read of it to the least that its unread components can still bring, its upper
bound adds the most they can, which is the last value read of each list. Reading stops for a query
as soon as no row outside its current best k, read or unread, has an upper bound above the k-th
lower bound; the scores of the rows that can still qualify are then resolved exactly.

The bounds of all rows for all queries of a block are matrix products: what lies within a depth of
a sorted list is a mask over the block, so a product of masked components gives all partial sums.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetgrid.llm import blocks

DEPTHS = (0.5, 0.75, 0.9, 1.0)  # shares of the lists read when bounds are compared
PART = 256  # queries whose bounds are held at a time
SCALE = 64


def no_random_access(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int):
    """The best ``k`` rows of a block for each query, by exact integer inner product."""
    order = np.sort(rows, axis=0)  # the sorted lists
    n = len(ids)
    masks = []
    for depth in DEPTHS:
        last = min(n, max(k + 1, int(np.ceil(depth * n))))
        high, low = order[n - last], order[last - 1]  # last values read from either end
        top, bottom = rows >= high, rows <= low
        masks.append((high, low, top, bottom))
    who, found, scores = [], [], []
    for part in range(0, len(queries), PART):
        chosen = queries[part : part + PART]
        up, down = np.maximum(chosen, 0), np.minimum(chosen, 0)
        open_ = np.arange(len(chosen))
        for high, low, top, bottom in masks:
            lower, upper, outside = _bounds(rows, order, up[open_], down[open_], high, low, top, bottom)
            own = query_ids[part + open_][:, None] == ids[None, :]
            lower[own] = upper[own] = -np.inf
            kth = np.partition(lower, max(0, n - k), axis=1)[:, max(0, n - k)]
            left = []
            for i, q in enumerate(open_):
                able = np.flatnonzero(upper[i] >= kth[i])
                full = bool(top.all() and bottom.all())
                if not full and (len(able) > 4 * k or outside[i] >= kth[i]):
                    left.append(q)
                    continue
                able = able[ids[able] != query_ids[part + q]]
                exact = (rows[able] @ chosen[q]).astype(np.int64)
                take = blocks.best(exact, ids[able], k)
                who.append(np.full(len(take), query_ids[part + q]))
                found.append(ids[able][take])
                scores.append(exact[take])
            open_ = np.array(left, np.int64)
            if not len(open_):
                break
    if not who:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(who), np.concatenate(found), np.concatenate(scores)


def _bounds(rows, order, up, down, high, low, top, bottom):
    """Lower and upper bounds of every row for every query, and the bound of rows not read at all."""
    read = up @ np.where(top, rows, 0).T + down @ np.where(bottom, rows, 0).T
    unread_top, unread_bottom = (~top).astype(np.float64), (~bottom).astype(np.float64)
    upper = read + (up * high) @ unread_top.T + (down * low) @ unread_bottom.T
    lower = read + (up * order[0]) @ unread_top.T + (down * order[-1]) @ unread_bottom.T
    return lower, upper, up @ high + down @ low


def top_k(vectors: DataFrame, *, k: int = 20, every: int = 20, scale: int = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows of the highest integer inner product.

    A component x counts as ``floor(scale * x)`` in double precision. Queries are the rows whose
    ``vec_id`` is divisible by ``every``, candidates all rows with another id. Fewer candidates give
    fewer ranks; ties go to the smaller ``vec_id``. Rows with null ids, null vectors or null or
    non-finite components take no part; repeated rows count once; of vectors of several lengths the
    most common length takes part. Further columns are ignored. No rows give no rows.
    """
    whole = blocks.usable(vectors).withColumn(
        "embedding", F.transform("embedding", lambda x: F.floor(x * F.lit(float(scale))).cast("double")))

    def search(query_ids, queries, ids, rows):
        return no_random_access(query_ids, queries, ids, rows, k)

    return blocks.against_all(whole, F.col("vec_id") % every == 0, search, "long", k)


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows of ``embeddings`` for each 20th of them."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
