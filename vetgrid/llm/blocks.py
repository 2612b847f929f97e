"""A stated query set against all vectors, in blocks of bounded size.

Rows are dealt to blocks by a hash, so no block depends on a key that could be hot; a block is one
row that holds its ids and its matrix. Every query block meets every row block once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vetgrid.llm import words as W
from vetgrid.session import stage_table

ROWS = 8192  # rows of a block on average: 4 MB of 64 doubles
QUERIES = 1024


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, embedding)`` as doubles: rows without a null id, a null vector, or null or non-finite
    components; rows that repeat id and vector count once."""
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                           F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return plain.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite
                        & (F.size("embedding") > 0)).dropDuplicates(["vec_id", "embedding"])


def _blocks(rows: DataFrame, count: int, names: tuple[str, str]) -> DataFrame:
    """``(block, ids, matrix)``: one row a block."""
    number, ids = names
    dealt = rows.withColumn(number, F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(count)).cast("int"))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("vec_id", kind="stable")
        return pd.DataFrame({
            number: [frame[number].iloc[0]], ids: [frame["vec_id"].to_numpy(np.int64).tobytes()],
            f"{ids}_matrix": [np.array(frame["embedding"].tolist(), np.float64).tobytes()]})

    return dealt.groupBy(number).applyInPandas(pack, f"{number} int, {ids} binary, {ids}_matrix binary")


Search = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple]


def against_all(rows: DataFrame, is_query: Column, search: Search, score: str, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best of what ``search(query ids, queries, row ids,
    rows)`` finds in each block; ties go to the smaller ``vec_id``. Vectors of different lengths do
    not meet: the most common length counts.
    """
    rows = stage_table(rows, "search-rows")
    sizes = rows.groupBy(F.size("embedding").alias("width")).agg(
        F.count("*").alias("n"), F.sum(is_query.cast("long")).alias("q")).orderBy(F.desc("n"), "width").first()
    width, n, q = (sizes["width"], sizes["n"], sizes["q"]) if sizes else (0, 0, 0)
    rows = rows.filter(F.size("embedding") == width)
    query_blocks = -(-q // QUERIES)
    candidates = _blocks(rows, max(1, -(-n // ROWS)), ("block", "ids"))
    queries = _blocks(rows.filter(is_query), max(1, query_blocks), ("query_block", "query"))
    pairs = candidates.withColumn(
        "query_block", F.explode(F.sequence(F.lit(0), F.lit(max(0, query_blocks - 1))))).join(queries, "query_block")
    # One task for a few pairs: the work is in the pairs, not in their bytes.
    pairs = pairs.repartition(max(1, min(4096, query_blocks * -(-n // ROWS))), "query_block", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for query, queries_, ids, matrix in W.rows(batches, "query", "query_matrix", "ids", "ids_matrix"):
            query, ids = np.frombuffer(query, np.int64), np.frombuffer(ids, np.int64)
            who, found, scores = search(query, np.frombuffer(queries_).reshape(len(query), -1),
                                        ids, np.frombuffer(matrix).reshape(len(ids), -1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(who, pa.int64()), pa.array(found, pa.int64()), pa.array(scores)],
                ["query_id", "vec_id", "score"])

    found = pairs.mapInArrow(run, f"query_id long, vec_id long, score {score}")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, ties to the smaller id, best first."""
    return np.lexsort((ids, -scores))[:k]
