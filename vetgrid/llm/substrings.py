"""Substring dedup: difference-cover anchors find long repeats, whole windows confirm them.

A window is ``width`` consecutive words of one document. Positions are taken modulo a period v with
a difference cover D: for any two positions i and j there is a step l < v with both i + l and j + l
on the cover. An anchor is the run of ``width - v + 1`` words at a cover position, so any two equal
windows share an aligned anchor inside both. Only cover positions (4 of 13 by default) are hashed
into the first shuffle, which finds the anchors that occur more than once. Then each document
extends its repeated anchors to the windows around them, and only these windows, by 128-bit hashes,
meet in a second shuffle that tells which of them started earlier. They travel in runs: neighbouring
windows that share their minimiser, the least hash of the short shingles inside, are one row under
it, and equal windows have equal minimisers. So the rows of this shuffle, and those that come back from
it, grow with the repeated text alone and not with the number of partitions.

Repeats inside one slice of a batch are settled there, so a passage that a third of all documents
share sends its runs once a slice to their partitions, not once an occurrence. Later whole copies of a
text are known by their text alone and send no windows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vetgrid.llm import words as W
from vetgrid.session import stage_table

# Perfect difference covers by period (fixed values).
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
DOCUMENT = "doc_id long, text_key long"
KEY = ["doc_id", "text_key"]
SLICE = 4 << 20  # bytes of text (a quarter of it packed) that a task works on at once
RUNS = 1 << 15  # runs of windows that are compared at once, and all runs of the last key
SALTS = 16  # parts of the copies of one text where they meet its first document


def period_of(width: int) -> int:
    """The period for a window; two thirds of it leave an anchor long enough to be selective."""
    fitting = [v for v in COVERS if v * 3 <= (width + 1) * 2]
    if not fitting:
        raise ValueError("a window needs 4 words at least")
    return max(fitting)


def text_key(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = W.spans(text)
    return starts, ends, W.hashes(text, starts, ends)


def repeated_words(docs: DataFrame, *, width: int = 20) -> DataFrame:
    """``(doc_id, text_key, removed)`` for the documents that lose words.

    ``removed`` holds pairs of little-endian 32-bit word numbers, first and end, of the maximal
    runs to remove: a word goes if a window covers it whose words also start earlier, that is in a
    smaller ``doc_id`` or further ahead in the same document. Windows are judged on the input.

    Null and empty texts have no window. Rows that repeat id and text are one document, each of them
    gets its result. Different texts under one id are ordered by ``text_key``, a hash of the text.
    A null id comes before all others. Further columns are ignored. No rows give no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    hot = stage_table(repeated_anchors(source, width), "substring-anchors")
    texts = stage_table(_texts_with(source, hot, width), "substring-texts")
    windows = texts.filter("original").mapInArrow(_candidates(width), _CANDIDATES)
    repeats = windows.repartition("key").sortWithinPartitions("key").mapInArrow(_later, f"{DOCUMENT}, at binary")
    found = repeats.groupBy(*KEY).agg(F.collect_list("at").alias("at"))
    lists = found.mapInArrow(_runs(width), f"{DOCUMENT}, removed binary")
    copies = texts.filter("not original").select(*KEY, "whole").filter("whole is not null").withColumnRenamed(
        "whole", "removed")
    return lists.unionByName(copies)


def _anchors(text: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Cover positions of a text and the hashes of their anchors, cut to 48 bits to save shuffle."""
    period = period_of(width)
    length = width - period + 1
    _, _, words = hashed(text)
    if len(words) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    grid = np.arange(0, len(words), period)[:, None] + np.array(COVERS[period])
    at = grid.ravel()
    at = at[at <= len(words) - length]
    return at, W.windows(words, at, length) & np.uint64((1 << 48) - 1)


def repeated_anchors(source: DataFrame, width: int) -> DataFrame:
    """``(doc_id, at)``: positions of anchors that occur more than once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.sliced(batches, "text", 4 * SLICE):
            ids = batch.column("doc_id").to_pylist()
            found = [(i, *_anchors(t, width)) for i, t in zip(ids, batch.column("text").to_pylist()) if t]
            found = [x for x in found if len(x[1])]
            if not found:
                continue
            doc = np.concatenate([np.full(len(at), i if i is not None else _NULL) for i, at, _ in found])
            at = np.concatenate([at for _, at, _ in found]).astype(np.int32)
            anchor = np.concatenate([a for _, _, a in found])
            order = np.argsort(anchor, kind="stable")
            opens = np.concatenate(([True], anchor[order][1:] != anchor[order][:-1]))
            count = np.diff(np.flatnonzero(np.concatenate((opens, [True]))))
            again = np.empty(len(anchor), bool)
            again[order] = np.repeat(count > 1, count)
            head = np.zeros(len(anchor), bool)
            head[order[opens]] = True
            for known in (False, True):  # one row of each anchor asks the others; repeats are known
                pick = again if known else head
                # Known rows only pass through, so they go by their document.
                key = W.mix(doc.astype(np.uint64)) if known else anchor
                yield pa.RecordBatch.from_arrays(
                    [pa.array(W.signed(key)[pick]), pa.array(doc[pick]), pa.array(at[pick]),
                     pa.array(np.full(int(pick.sum()), known))], ["anchor", "doc_id", "at", "known"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted, so an anchor occurs again if a neighbour has it; the last row waits for the next batch.
        held, again = tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int32)), np.empty(0, bool)
        for batch in batches:
            known = batch.filter(batch.column("known"))
            yield known.select(["doc_id", "at"])
            asking = batch.filter(pc.invert(batch.column("known")))
            anchor, doc, at = (np.concatenate((h, asking.column(c).to_numpy()))
                               for h, c in zip(held, ("anchor", "doc_id", "at")))
            same = anchor[1:] == anchor[:-1]
            found = np.concatenate((again, np.zeros(asking.num_rows, bool)))
            found[1:] |= same
            found[:-1] |= same
            held, again = (anchor[-1:], doc[-1:], at[-1:]), found[-1:]
            yield _places(doc[:-1][found[:-1]], at[:-1][found[:-1]])
        yield _places(held[1][again], held[2][again])

    asked = source.mapInArrow(emit, "anchor long, doc_id long, at int, known boolean")
    return asked.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(meet, "doc_id long, at int")


def _places(doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(at, pa.int32())], ["doc_id", "at"])


_NULL = -(1 << 63)  # stands for a null id inside tasks


def _texts_with(source: DataFrame, hot: DataFrame, width: int) -> DataFrame:
    """Compressed texts of the documents with repeated anchors, the anchors, and whether the text
    is the first of its copies; a later copy gets ``whole``, the run of all its words."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3)
        for batch in W.sliced(batches, "text", SLICE):
            ids = [_NULL if i is None else i for i in batch.column("doc_id").to_pylist()]
            texts = batch.column("text").to_pylist()
            runs = [len(W.spans(t)[0]) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([text_key(t) for t in texts], pa.int64()),
                 pa.array([len(t) for t in texts], pa.int64()),
                 W.binaries([np.array([0, n], np.int32).tobytes() if n >= width else None for n in runs]),
                 W.binaries([press.compress(t) for t in texts])],
                ["doc_id", "text_key", "size", "whole", "packed"])

    packed = source.filter("text is not null").mapInArrow(
        pack, f"{DOCUMENT}, size long, whole binary, packed binary")
    places = hot.groupBy("doc_id").agg(F.collect_list("at").alias("at"))
    joined = stage_table(packed.join(places, "doc_id").dropDuplicates(KEY), "substring-packed")
    # Only texts with copies meet their first document, each in parts.
    firsts = joined.groupBy("text_key", "size").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("copies")).filter("copies > 1").select(
        "text_key", "size", "first_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = joined.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(firsts, ["text_key", "size", "salt"], "left").select(
        *KEY, "packed", "at", "whole", (F.col("doc_id") == F.coalesce("first_id", "doc_id")).alias("original"))


_CANDIDATES = f"key long, {DOCUMENT}, at int, windows binary, later binary"


def _candidates(width: int):
    """Windows that hold a repeated anchor at an aligned position, by two 64-bit hashes, in runs.

    A run is a row ``(key, doc_id, text_key, at, windows)``: hashes of neighbouring windows from ``at`` on
    that share the minimiser ``key``. What a slice settles by itself is a row with ``later``, positions
    that only pass through, under a key of their document."""
    period = period_of(width)
    short = max(1, width // 5)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in W.sliced(batches, "packed", SLICE // 4):
            parts = []
            places = batch.column("at")
            for row, (doc, key, packed) in enumerate(W.rows([batch], *KEY, "packed")):
                _, _, words = hashed(open_.decompress(packed))
                count = len(words) - width + 1
                if count < 1:
                    continue
                anchors = places[row].values.to_numpy()
                cover = np.zeros(count + 1, np.int32)  # window i holds anchor p for i <= p < i + period
                np.add.at(cover, np.clip(anchors - period + 1, 0, count), 1)
                np.add.at(cover, np.minimum(anchors + 1, count), -1)
                at = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                small = W.windows(words, np.arange(len(words) - short + 1), short)
                least = _sliding_least(small, width - short + 1)[at]
                parts.append((W.windows(words, at, width), W.windows(words, at, width, 1),
                              np.full(len(at), doc), np.full(len(at), key), at.astype(np.int32), least))
            if not parts:
                continue
            one, two, doc, key, at, least = (np.concatenate(c) for c in zip(*parts))
            again = _after_first(one, two, doc, key, at)
            yield _window_runs(*(c[~again] for c in (one, two, doc, key, at, least)))
            yield _settled(doc[again], key[again], at[again])
    return emit


def _sliding_least(values: np.ndarray, count: int) -> np.ndarray:
    """The least of every ``count`` neighbours, by doubling."""
    span = 1
    while span * 2 <= count:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = count - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _window_runs(one, two, doc, key, at, least) -> pa.RecordBatch:
    """Neighbouring windows of a document with one minimiser as one row."""
    cuts = np.flatnonzero(np.concatenate((
        [len(at) > 0], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1) | (least[1:] != least[:-1]),
        [len(at) > 0])))
    pairs = np.stack((one, two), 1)
    first = cuts[:-1]
    return pa.RecordBatch.from_arrays(
        [pa.array(W.signed(least[first])), pa.array(doc[first], pa.int64()), pa.array(key[first], pa.int64()),
         pa.array(at[first], pa.int32()), W.binaries([pairs[a:b].tobytes() for a, b in zip(first, cuts[1:])]),
         pa.nulls(len(first), pa.binary())], ["key", *KEY, "at", "windows", "later"])


def _settled(doc, key, at) -> pa.RecordBatch:
    docs, keys, places = _by_document(doc, key, at)
    spread = W.mix(docs.astype(np.uint64) + keys.astype(np.uint64))
    return pa.RecordBatch.from_arrays(
        [pa.array(W.signed(spread)), pa.array(docs), pa.array(keys), pa.nulls(len(docs), pa.int32()),
         pa.nulls(len(docs), pa.binary()), W.binaries(places)], ["key", *KEY, "at", "windows", "later"])


def _by_document(doc, key, at) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    order = np.lexsort((at, key, doc))
    doc, key, at = doc[order], key[order], at[order]
    cuts = np.flatnonzero(np.concatenate(
        ([len(doc) > 0], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]), [len(doc) > 0])))
    return (doc[cuts[:-1]].astype(np.int64), key[cuts[:-1]].astype(np.int64),
            [at[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, cuts[1:])])


def _after_first(one, two, doc, key, at) -> np.ndarray:
    """Which windows equal one that starts earlier."""
    order = np.lexsort((at, key, doc, two, one))
    same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    result = np.zeros(len(one), bool)
    result[order[1:][same]] = True
    return result


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed positions of windows that start later than an equal one; rows come sorted by key.

    Only the runs of a few whole keys are held at a time."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        known = batch.filter(pc.is_valid(batch.column("later")))
        yield known.select([*KEY, "later"]).rename_columns([*KEY, "at"])
        asking = batch.filter(pc.is_null(batch.column("later")))
        held.append(asking)
        rows += asking.num_rows
        if rows < RUNS:
            continue
        part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        keys = part.column("key").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        yield from _later_runs(part.slice(0, cut))
        held, rows = [part.slice(cut)], part.num_rows - cut
    for part in pa.Table.from_batches(held).combine_chunks().to_batches() if rows else ():
        yield from _later_runs(part)


def _later_runs(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if not part.num_rows:
        return
    packed = part.column("windows").to_pylist()
    count = np.array([len(p) // 16 for p in packed])
    pairs = np.frombuffer(b"".join(packed), np.uint64).reshape(-1, 2)
    doc, key, first = (np.repeat(part.column(c).to_numpy(), count) for c in (*KEY, "at"))
    at = first + np.arange(len(first)) - np.repeat(np.cumsum(count) - count, count)
    later = _after_first(pairs[:, 0], pairs[:, 1], doc, key, at)
    docs, keys, places = _by_document(doc[later], key[later], at[later])
    yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(keys), W.binaries(places)], [*KEY, "at"])


def _runs(width: int):
    """Maximal runs of words from the windows of a document."""
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = []
            for places in batch.column("at").to_pylist():
                at = np.sort(np.concatenate([np.frombuffer(p, np.int32) for p in places]))
                gap = np.flatnonzero(at[1:] > at[:-1] + width)
                first = at[np.concatenate(([0], gap + 1))]
                end = at[np.concatenate((gap, [len(at) - 1]))] + width
                merged.append(np.stack([first, end], 1).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), W.binaries(merged)], [*KEY, "removed"])
    return runs


def _with_removed(docs: DataFrame, width: int, digest: bool) -> DataFrame:
    """Each row of ``docs (doc_id, text)`` with what is left of it; compressed texts meet their runs."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    removed = stage_table(repeated_words(docs, width=width), "substring-removed")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3)
        for batch in W.sliced(batches, "text", SLICE):
            ids = [_NULL if i is None else i for i in batch.column("doc_id").to_pylist()]
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([text_key(t or b"") for t in texts], pa.int64()),
                 W.binaries([t if t is None else press.compress(t) for t in texts])], [*KEY, "packed"])

    packed = source.mapInArrow(pack, f"{DOCUMENT}, packed binary")
    joined = packed.join(removed, KEY, "left")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in W.sliced(batches, "packed", SLICE // 4):
            ids, kept, counts, lost, sums = [], [], [], [], []
            for doc, packed, runs in W.rows([batch], "doc_id", "packed", "removed"):
                text = None if packed is None else open_.decompress(packed)
                pairs = np.frombuffer(runs or b"", np.int32).reshape(-1, 2)
                starts, ends = W.spans(text or b"")
                ids.append(None if doc == _NULL else doc)
                counts.append(len(starts))
                lost.append(int((pairs[:, 1] - pairs[:, 0]).sum()))
                if digest:
                    sums.append(hashlib.sha256(_kept_words(text or b"", starts, ends, pairs)).hexdigest())
                else:
                    kept.append(text if not len(pairs) else _kept_text(text, starts, ends, pairs))
            columns = [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(lost, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sums, pa.string()) if digest else W.binaries(kept)],
                ["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept"])

    return joined.mapInArrow(
        finish, "doc_id long, n_words long, n_removed long, " + ("kept_sha256 string" if digest else "kept binary"))


def _kept_words(text: bytes, starts: np.ndarray, ends: np.ndarray, pairs: np.ndarray) -> bytes:
    words, at, kept = text.split(), 0, []
    for first, end in pairs:
        kept += words[at:first]
        at = end
    return b" ".join(kept + words[at:])


def _kept_text(text: bytes, starts: np.ndarray, ends: np.ndarray, pairs: np.ndarray) -> bytes:
    """The text without the runs; white space around what stays is kept as it is."""
    at, kept = 0, []
    for first, end in pairs:
        kept.append(text[at : starts[first]])
        at = starts[end] if end < len(starts) else len(text)
    return b"".join(kept) + text[at:]


def without_repeats(docs: DataFrame, *, width: int = 20) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept)`` for each row; ``kept`` is the text without the removed
    words (null for a null text). See ``repeated_words`` for what is removed."""
    return _with_removed(docs, width, digest=False).withColumn("kept", F.col("kept").cast("string"))


def kept_texts(docs: DataFrame, *, width: int = 20) -> DataFrame:
    """``docs`` with what ``without_repeats`` keeps as ``text``; rows and other columns stay.

    Texts that lose nothing are taken from ``docs`` as they are; only the others are rewritten."""
    removed = stage_table(repeated_words(docs, width=width), "substring-removed")
    names = docs.columns
    keyed = docs.select(
        F.struct(*names).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"),
        F.col("text").cast("binary").alias("text"))

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.sliced(batches, "text", SLICE):
            keys = [text_key(t or b"") for t in batch.column("text").to_pylist()]
            yield batch.select(["row", "doc_id"]).append_column("text_key", pa.array(keys, pa.int64()))

    rows = keyed.mapInArrow(key, T.StructType([
        keyed.schema["row"], T.StructField("doc_id", T.LongType()), T.StructField("text_key", T.LongType())]))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, runs: pd.Series) -> pd.Series:
        kept = []
        for text, run in zip(texts, runs):
            data = text.encode()
            kept.append(_kept_text(data, *W.spans(data), np.frombuffer(run, np.int32).reshape(-1, 2)).decode())
        return pd.Series(kept, dtype=object)

    joined = rows.join(removed, KEY, "left").select("row", "removed")
    same = joined.filter("removed is null").select("row.*")
    changed = joined.filter("removed is not null")
    return same.unionByName(changed.select(*[
        cut("row.text", "removed").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names]))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of ``documents`` without the later copies of 20-word windows, as a digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _with_removed(docs, 20, digest=True)
