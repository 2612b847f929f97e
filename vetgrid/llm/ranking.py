r"""Ranked lexical search: a frequency-ordered trie of document vectors, searched by branch and bound.

A document vector is restricted to the terms of the items and written once, as term numbers and
occurrences, so texts are read one time and everything after works on these small rows. A task
gathers vectors into blocks. For an item the vectors of a block, restricted to the item's own terms
in ascending document frequency, form a trie: documents sorted by which of those terms they hold,
so that a node (a decided prefix of terms) is a range of rows and equal vectors share one path. A
node is bounded by the largest tf of each term and the least length norm ``m`` below it; the score
grows with tf and falls with m, division by rounding down included, so no document below a node
scores more. The search goes depth first, the branch that holds the term first, and leaves a node
whose bound is below the ``k``-th score found so far in the task. Rare terms come first because their
absence lowers the bound most: the path on which all of them are absent, which is nearly the whole
block, ends after a few steps, and its documents are not even placed in the trie.

Score of a document: the sum over the item's terms, once each, of
``w * ((10**9 * tf) div (1000 * tf + 20 * m))`` with ``w = floor(1000 * ln((2N + 2) / (2 df + 1)))``
and ``m = 50 + (50 * n * N) div L``; N counts the documents with a term, L their terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vetgrid.session import stage_table

K = 50
ITEM_BYTES = 8 << 20  # distinct terms of the items that one pass broadcasts; more items take more passes
BLOCK_ROWS, BLOCK_ENTRIES = 1 << 15, 1 << 22
LEAF = 128  # rows of a node that are scored at once instead of split further

# Bytes between terms become spaces, A-Z become a-z; bytes of other characters belong to terms.
_TERM_BYTES = [b for b in range(256) if b >= 128 or chr(b).isalnum()]
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b in _TERM_BYTES else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_TABLE).split()


def ranked(docs: DataFrame, items: DataFrame, *, k: int = K, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best rows of ``docs (doc_id, text)`` for each item.

    ``items (item_id, text)``; several rows of one item id are one item with the terms of all. Only
    scores above 0 count, equal scores go by ascending ``doc_id`` (null last), and repeated rows are
    documents of their own. Null, empty and blank texts have no term: as a document they count
    nowhere, as an item they return nothing, and so does an empty table on either side. Texts of any
    length are read whole; further columns are ignored whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    parts = [_ranked(docs, chunk, k) for chunk in _chunks(items, item_bytes)]
    if not parts:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _chunks(items: DataFrame, limit: int) -> Iterator[dict]:
    """Items as ``{item_id: distinct terms}``, in parts whose terms stay within ``limit`` bytes (or one item)."""
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(set(terms_of(t or b""))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id"), pa.array(own, pa.list_(pa.binary()))], ["item_id", "terms"])

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    rows = rows.mapInArrow(listed, "item_id long, terms array<binary>").filter("size(terms) > 0").orderBy("item_id")
    chunk: dict = {}
    size = 0
    for item_id, terms in rows.toLocalIterator():
        own = sum(map(len, terms))
        if chunk and size + own > limit and item_id not in chunk:
            yield chunk
            chunk, size = {}, 0
        chunk.setdefault(item_id, set()).update(bytes(t) for t in terms)
        size += own
    if chunk:
        yield chunk


def _ranked(docs: DataFrame, chunk: dict, k: int) -> DataFrame:
    spark = docs.sparkSession
    ids = {t: i for i, t in enumerate(sorted(set().union(*chunk.values())))}
    vectors = stage_table(restricted(docs, ids), "ranking-vectors")
    total = vectors.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)).alias("docs"),
                        F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(ids), np.int64)
    for term, count in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[term] = count
    weight = np.floor(1000 * np.log((2 * total["docs"] + 2) / (2 * df + 1))).astype(np.int64)
    plans = {}
    for item, terms in chunk.items():
        own = np.array(sorted(ids[t] for t in terms), np.int64)
        own = own[(df[own] > 0) & (weight[own] > 0)]
        plans[item] = own[np.argsort(df[own], kind="stable")]
    plans = {item: own for item, own in plans.items() if len(own)}
    shared = spark.sparkContext.broadcast((plans, weight))
    count, length = total["docs"], total["terms"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans_, weights = shared.value
        best = {item: Best(k) for item in plans_}
        for block in _blocks(batches, count, length):
            for item, own in plans_.items():
                block.search(own, weights[own], best[item])
        for item, found in best.items():
            if len(found.score):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(found.score), pa.int64()),
                     pa.array(found.doc, mask=found.null), pa.array(found.score)], ["item_id", "doc_id", "score"])

    found = vectors.filter("size(terms) > 0").mapInArrow(search, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "item_id", "rank", "doc_id", "score")


def restricted(docs: DataFrame, ids: dict[bytes, int]) -> DataFrame:
    """``(doc_id, n, terms, tfs)`` for each row of ``docs``: the number of all terms, and those in ``ids`` with their tf."""
    shared = docs.sparkSession.sparkContext.broadcast(ids)

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            sizes, offsets, terms, tfs = [], [0], [], []
            for text in batch.column("text"):
                own = terms_of(text.as_py() or b"")
                sizes.append(len(own))
                counts = Counter(own)
                for t in counts.keys() & known.keys():
                    terms.append(known[t])
                    tfs.append(counts[t])
                offsets.append(len(terms))
            offsets = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32()))], ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(restrict, "doc_id long, n long, terms array<int>, tfs array<int>")


class Best:
    """The ``k`` best documents of an item so far; ``least`` is the score that another one must reach."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.score, self.doc, self.null = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    def add(self, score: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        keep = score >= self.least
        if not keep.any():
            return
        score, doc, null = (np.concatenate((a, b[keep])) for a, b in
                            ((self.score, score), (self.doc, doc), (self.null, null)))
        order = np.lexsort((doc, null, -score))[: self.k]
        self.score, self.doc, self.null = score[order], doc[order], null[order]
        if len(order) == self.k:
            self.least = int(self.score[-1])


def part(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


class Block:
    """Document vectors of a block by term: the rows that hold it, ascending, with their tf."""

    def __init__(self, doc: np.ndarray, null: np.ndarray, m: np.ndarray, row: np.ndarray, term: np.ndarray, tf: np.ndarray):
        self.doc, self.null, self.m = doc, null, m
        order = np.argsort(term, kind="stable")
        self.row, self.tf = row[order], tf[order].astype(np.int64)
        self.terms, self.start = np.unique(term[order], return_index=True)
        self.end = np.append(self.start[1:], len(order))
        self.top = np.maximum.reduceat(self.tf, self.start) if len(order) else self.tf
        self.low = np.int64(m.min()) if len(m) else np.int64(0)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        here = self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)
        if not here.any():
            return
        at, weights = at[here], weights[here]
        # The path without the first terms: what the later ones can still give, from the back.
        ahead = np.cumsum((weights * part(self.top[at], self.low))[::-1])[::-1]
        deep = int(np.count_nonzero(ahead >= best.least))
        if not deep:
            return
        rows = np.unique(np.concatenate([self.row[self.start[t]:self.end[t]] for t in at[:deep]]))
        tf = np.zeros((len(rows), len(at)), np.int64)
        for j, t in enumerate(at):
            listed, values = self.row[self.start[t]:self.end[t]], self.tf[self.start[t]:self.end[t]]
            if len(listed) > 8 * len(rows):
                place = np.minimum(np.searchsorted(listed, rows), len(listed) - 1)
                tf[:, j] = np.where(listed[place] == rows, values[place], 0)
            else:
                place = np.minimum(np.searchsorted(rows, listed), len(rows) - 1)
                held = rows[place] == listed
                tf[place[held], j] = values[held]
        order = trie_order(tf > 0)
        self._descend(rows[order], tf[order], weights, best)

    def _descend(self, rows: np.ndarray, tf: np.ndarray, weights: np.ndarray, best: Best) -> None:
        m, width = self.m[rows], tf.shape[1]
        nodes = [(0, len(rows), 0)]
        while nodes:
            low, high, depth = nodes.pop()
            bound = int((weights * part(tf[low:high].max(axis=0), m[low:high].min())).sum())
            if bound < best.least:
                continue
            split = low
            while high - low > LEAF and depth < width:
                split = low + int(np.count_nonzero(tf[low:high, depth]))
                depth += 1
                if low < split < high:  # otherwise all or none hold the term, and the node has one child
                    break
            if low < split < high:
                nodes += [(split, high, depth), (low, split, depth)]
                continue
            for a in range(low, high, 4096):  # equal vectors beyond LEAF rows share one leaf
                b = min(a + 4096, high)
                score = (weights * part(tf[a:b], m[a:b, None])).sum(axis=1)
                best.add(score, self.doc[rows[a:b]], self.null[rows[a:b]])


def trie_order(holds: np.ndarray) -> np.ndarray:
    """Rows in the order of a trie over their columns, at each step those that hold the column first."""
    width = -(-holds.shape[1] // 64) * 64
    bits = np.zeros((len(holds), width), bool)
    bits[:, : holds.shape[1]] = ~holds
    words = np.packbits(bits, axis=1).view(">u8")
    return np.lexsort(words.T[::-1])


def _blocks(batches: Iterator[pa.RecordBatch], count: int, length: int) -> Iterator[Block]:
    held: list[pa.RecordBatch] = []
    rows = entries = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        entries += len(batch.column("terms").flatten())
        if rows >= BLOCK_ROWS or entries >= BLOCK_ENTRIES:
            yield _block(held, count, length)
            held, rows, entries = [], 0, 0
    if rows:
        yield _block(held, count, length)


def _block(batches: list[pa.RecordBatch], count: int, length: int) -> Block:
    table = pa.Table.from_batches(batches).combine_chunks()
    doc, n, terms, tfs = (table.column(c).combine_chunks() for c in ("doc_id", "n", "terms", "tfs"))
    null = np.asarray(doc.is_null())
    m = 50 + 50 * n.to_numpy() * np.int64(count) // np.int64(length)
    row = np.repeat(np.arange(len(n)), np.asarray(terms.value_lengths()))
    return Block(np.asarray(doc.fill_null(0)), null, m, row, np.asarray(terms.flatten()), np.asarray(tfs.flatten()))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best ``documents`` of each ``benchmark`` item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return ranked(docs, items)
