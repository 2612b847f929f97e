"""Packing along a space-filling curve.

Each document is a vector of hashed token counts, projected to a few dimensions by a fixed random
matrix; its place on the Hilbert curve through that space is its sort key, so documents of similar
words are neighbours. Documents are range-sorted by the key and laid end to end; the line is cut
every ``capacity`` tokens, so every sequence but the last one is full.

The tokens are made once and written to the shared folder. Only a narrow table (key, length, row) is
sorted; a first pass writes its partitions with running lengths, the partition totals give each
partition its offset, and the pieces are then cut where the tokens are.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vetgrid.llm import words as W
from vetgrid.session import small_batches, stage_table

REMEMBERED = 300_000  # words that a worker remembers before it starts anew
SHORT = 48  # bytes of a word that is worth remembering, and of its ids
SLICE = 2 << 20  # bytes of text that a task encodes at once
CALL = 1 << 16  # bytes of words in one call of the tokenizer; a longer word makes a call of its own
BINS = 256  # hashed token counts of a document, a power of two
DIMENSIONS = 4
BITS = 12  # a key has DIMENSIONS * BITS bits
END = 1  # id behind each document
CLOSING = [".", ",", ";", ":", "!", "?"]
# Letters of ASCII and small ones of Latin-1: the tokenizer folds only their case, and cuts only before the closing mark.
PLAIN = r"\A[A-Za-z\x{DF}-\x{F6}\x{F8}-\x{FF}]+[.,;:!?]?\z"
# Byte-level letters of the bytes of plain words that stand for no printable Latin-1 character.
BYTES = {"\x9f": "\u0141", "\xa0": "\u0142", "\xad": "\u0143"}
WORD_END = "</w>"  # how the tokenizer names an id that ends a word
MARK = "\x01"  # a word between words that are encoded together; a word that holds it goes by itself


class _Words(dict):
    """Ids of words, as 16 or 32 bits each. Words are independent: the tokenizer drops white space.

    A plain word is remembered in small letters and without its closing mark, so it is merged once.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.merges = Tokenizer(self.tokenizer.model)  # for plain words: merges only, nothing to fold or cut
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = [i for word, i in self.tokenizer.get_vocab().items() if word.endswith(WORD_END)]
        self.closing = pa.array([self._alone(mark) for mark in [*CLOSING, ""]], pa.large_binary())

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null has none. The distinct words of all texts are looked up once."""
        texts = pc.fill_null(texts, "")
        whole = np.zeros(len(texts), bool)
        for special in self.special:  # it is one id wherever it stands, so words are not independent
            whole |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        split = pc.ascii_split_whitespace(pc.if_else(pa.array(whole), "", texts))
        words = split.flatten().dictionary_encode()
        ids = self._distinct(words.dictionary).take(words.indices)
        data, ends = _numbers(ids, self.kind)
        bounds = ends[split.offsets.to_numpy()]
        return [np.frombuffer(self._alone(texts[row].as_py()), self.kind) if alone else data[a:b]
                for row, (alone, a, b) in enumerate(zip(whole, bounds, bounds[1:]))]

    def _distinct(self, words: pa.Array) -> pa.Array:
        """Ids of each of ``words``, which are distinct."""
        plain = pc.match_substring_regex(words, PLAIN)
        stems = pc.ascii_rtrim(pc.ascii_lower(words), characters="".join(CLOSING))
        mark = pc.index_in(pc.utf8_slice_codeunits(words, -1), value_set=pa.array(CLOSING))
        mark = pc.fill_null(pc.if_else(plain, mark, None), len(CLOSING))
        stems = pc.if_else(plain, stems, words).dictionary_encode()
        keys = _values(stems.dictionary.cast(pa.binary()))
        found = list(map(self.get, keys))
        missing = [row for row, ids in enumerate(found) if ids is None]
        if missing:
            new = self._learn(stems.dictionary.take(pa.array(missing, pa.int32())))
            for row, ids in zip(missing, new):
                found[row] = ids
            self._remember([keys[row] for row in missing], new)
        ids = pa.array(found, pa.large_binary()).take(stems.indices)
        return pc.binary_join_element_wise(ids, self.closing.take(mark), pa.scalar(b"", pa.large_binary()))

    def _remember(self, words: list[bytes], ids: list[bytes]) -> None:
        new = {w: i for w, i in zip(words, ids) if len(w) <= SHORT and len(i) <= SHORT}
        if len(self) + len(new) > REMEMBERED:
            self.clear()
        if len(new) <= REMEMBERED:
            self.update(new)

    def _learn(self, new: pa.Array) -> list[bytes]:
        """Ids of words that are not remembered; plain ones are in small letters and without a closing mark."""
        plain = pc.match_substring_regex(new, PLAIN).to_numpy(zero_copy_only=False)
        odd = pc.match_substring(new, MARK).to_numpy(zero_copy_only=False)
        words, result = _values(new), [b""] * len(new)
        for rows in _calls(np.flatnonzero(plain), words):
            joined = " ".join([words[r] for r in rows]).encode().decode("latin-1")
            for byte, letter in BYTES.items():
                joined = joined.replace(byte, letter)
            self._together(self.merges, joined, self.ends, 1, words, rows, result)
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        for rows in _calls(np.flatnonzero(~plain & ~odd), words):
            joined = "".join([f"{words[r]} {MARK} " for r in rows])
            self._together(self.tokenizer, joined, mark if len(mark) == 1 else [], 0, words, rows, result)
        for row in np.flatnonzero(odd):
            result[row] = self._alone(words[row])
        return result

    def _together(self, tokenizer, joined: str, last: list[int], own: int, words, rows, result) -> None:
        """One call for all words of ``joined``. Each ends in one of ``last``, of which it holds no other.

        ``own`` is 1 if that id is the word's own, 0 if it only stands between words."""
        ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(np.isin(ids, np.array(last, self.kind)))
        if len(ends) != len(rows):
            for row in rows:
                result[row] = self._alone(words[row])
            return
        data, size = ids.tobytes(), ids.itemsize
        starts = (np.concatenate(([0], ends[:-1] + 1)) * size).tolist()
        for row, a, b in zip(rows, starts, ((ends + own) * size).tolist()):
            result[row] = data[a:b]

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()


def _values(words: pa.Array) -> list:
    """What ``to_pylist`` gives, for strings much faster."""
    return words.to_numpy(zero_copy_only=False).tolist()


def _numbers(ids: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids behind each other, and where the words of ``ids`` begin and end among them."""
    _, offsets, data = ids.buffers()
    ends = np.frombuffer(offsets, np.int64)[ids.offset : ids.offset + len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    numbers = np.frombuffer(data, kind, ends[-1] // np.dtype(kind).itemsize) if ends[-1] else np.zeros(0, kind)
    return numbers, ends // np.dtype(kind).itemsize


def _calls(rows: np.ndarray, words: list[str]) -> list[list[int]]:
    """``rows`` in groups whose words have about ``CALL`` characters."""
    group = np.cumsum([len(words[r]) + 1 for r in rows]) // CALL if len(rows) else rows
    return [part.tolist() for part in np.split(rows, np.flatnonzero(np.diff(group)) + 1) if len(part)]


@lru_cache(2)
def _words(path: str) -> _Words:
    return _Words(path)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, curve, n, ids)``: tokens of each document with the end id, and its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, press = _words(path), zstandard.ZstdCompressor(1)
        matrix = np.random.Generator(np.random.PCG64(7)).standard_normal((BINS, DIMENSIONS))
        for batch in W.sliced(batches, "text", SLICE):
            packed, counts, vectors = [], [], []
            for own in words.encode(batch.column("text").cast(pa.string())):
                ids = np.append(own, np.array([END], words.kind))
                bins = np.bincount(ids & (BINS - 1), minlength=BINS)
                packed.append(press.compress(ids.tobytes()))
                counts.append(len(ids))
                vectors.append(np.sqrt(bins / len(ids)))
            if counts:
                places = hilbert(_cells(np.array(vectors) @ matrix))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(places, pa.int64()), pa.array(counts, pa.int64()),
                     W.binaries(packed)], ["doc_id", "curve", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, curve long, n long, ids binary")


def _cells(points: np.ndarray) -> np.ndarray:
    """Grid cells of points whose coordinates are about as spread as a standard normal variable."""
    return np.minimum((1 << BITS) / (1 + np.exp(-1.7 * points)), (1 << BITS) - 1).astype(np.int64)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each row of ``cells`` on the Hilbert curve (Skilling's transform of the axes)."""
    x = [c.copy() for c in cells.T]
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(len(x)):
            inside = (x[i] & bit) == 0
            swap = np.where(inside, (x[0] ^ x[i]) & low, 0)
            x[0] ^= np.where(inside, swap, low)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip, bit = np.zeros_like(x[0]), 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where((x[-1] & bit) > 0, bit - 1, 0)
        bit >>= 1
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in x:
            place = place << 1 | ((axis ^ flip) >> level & 1)
    return place


def packed(docs: DataFrame, path: str, *, capacity: int = 2048) -> DataFrame:
    """Pieces of all documents: ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)``.

    ``ids`` are the piece's tokens as little-endian unsigned 32-bit integers; ``start`` counts the ids
    of the document before the piece, ``offset`` those of the sequence. Null and empty texts consist
    of the end id. Equal places go by id, then by length, then by row; equal rows are interchangeable.
    Repeated rows are packed each. Further columns are ignored. No rows give no pieces.
    """
    return _pieces(docs, path, capacity, _cut_ids, "ids binary")


def _pieces(docs: DataFrame, path: str, capacity: int, cut, column: str) -> DataFrame:
    tokens = stage_table(
        tokenized(docs, path).withColumn("row", F.monotonically_increasing_id()), "packing-tokens")
    line = tokens.select("row", "curve", "doc_id", "n").repartitionByRange("curve", "doc_id", "n", "row")
    part = F.spark_partition_id()
    sorted_ = stage_table(line.sortWithinPartitions("curve", "doc_id", "n", "row").select(
        part.alias("part"), "row", "n", F.monotonically_increasing_id().alias("nth")), "packing-line")
    totals = sorted_.groupBy("part").agg(F.sum("n").alias("total"))
    # One row a partition: the offsets of the partitions are a running sum over few rows.
    offsets = totals.select("part", (F.sum("total").over(
        Window.orderBy("part")) - F.col("total")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("nth")) - F.col("n")
    placed = sorted_.select("part", "row", inside.alias("inside")).join(F.broadcast(offsets), "part").select(
        "row", (F.col("before") + F.col("inside")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, open_ = _words(path).kind, zstandard.ZstdDecompressor()
        for batch in batches:
            out: tuple = ([], [], [], [], [], [], [])
            for doc, n, ids, first in W.rows([batch], "doc_id", "n", "ids", "first"):
                whole = np.frombuffer(open_.decompress(ids), kind).astype("<u4")
                start = 0
                while start < n:
                    offset = (first + start) % capacity
                    length = min(n - start, capacity - offset)
                    for c, v in zip(out, (doc, start, length, cut(whole[start : start + length].tobytes()), n,
                                          (first + start) // capacity, offset)):
                        c.append(v)
                    start += length
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.binary() if cut is _cut_ids and i == 3 else pa.int64()) for i, c in enumerate(out)],
                ["doc_id", "start", "length", column.split()[0], "doc_tokens", "sequence_id", "offset"])
        W.release()

    return tokens.select("row", "doc_id", "n", "ids").join(placed, "row").mapInArrow(
        run, f"doc_id long, start long, length long, {column}, doc_tokens long, sequence_id long, offset long")


def _cut_ids(piece: bytes) -> bytes:
    return piece


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of 2048 tokens, with the checksum of each piece."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, zlib.crc32, "ids_crc32 long")
