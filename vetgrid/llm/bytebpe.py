"""Byte-level BPE by backtracking from longest matches.

The bytes of a piece are read as Latin-1 characters, so that pyahocorasick, which works on
characters, finds every vocabulary token inside it in one pass. Encoding then goes from left to
right with the longest token at each position. A token may follow another one only if the merges of
their joined bytes give exactly these two tokens; that is decided once for each pair and remembered.
A token that does not fit is replaced by the longest token that is a proper prefix of it; with none
left the last token is taken back and its end is marked as a dead position, so every position is
given up at most once and the time is linear in the piece. A sequence whose neighbours all fit is
the one that the merges would have made.

Words repeat a lot, so each worker remembers the ids of up to ``REMEMBERED`` short ones.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetgrid.llm import words as W

REMEMBERED = 1_000_000  # words, and pairs of tokens, that a worker remembers before it starts anew
_MEETING = re.compile(r"[^\S \n]|\s\s| \Z").search  # also white space other than spaces and line feeds
SHORT = 64  # characters of a word that is worth remembering


class ByteBPE:
    """A vocabulary of byte strings by rank; the rank is the id and the order of merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("every single byte must be a token")
        # The pattern's white space is Unicode's, without the four separators U+001C to U+001F.
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(
            r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.matches = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.matches.add_word(token.decode("latin-1"), (len(token), rank))
        self.matches.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.made: dict[int, tuple[int, int] | None] = {}
        self.fit: dict[int, bool] = {}
        self.size = {i: len(t) for i, t in self.token.items()}
        self.reach = max(self.size.values())
        self.pieces = _Remembered(lambda p: np.array(self.piece(p.encode()), "<u4").tobytes())
        self.words = _Remembered(self._word)

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens of the last merge that makes a token; None for a byte."""
        if token not in self.made:
            text = self.token[token]
            left = [text[i : i + 1] for i in range(len(text))]
            while len(left) > 2:
                rank, at = min((self.ranks.get(a + b, token), i) for i, (a, b) in enumerate(zip(left, left[1:])))
                if rank >= token:
                    break  # no merges lead here; only a piece that equals it gets this token
                left[at : at + 2] = [left[at] + left[at + 1]]
            self.made[token] = (self.ranks[left[0]], self.ranks[left[-1]]) if len(left) > 1 else None
        return self.made[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges of both tokens' bytes end in exactly these two, remembered."""
        pair = a << 32 | b
        if pair not in self.fit:
            if len(self.fit) >= REMEMBERED:
                self.fit.clear()
            self.fit[pair] = self._fits(a, b)
        return self.fit[pair]

    def _fits(self, a: int, b: int) -> bool:
        """Undo the merges of both from the last one on, and look at the two tokens that meet at the
        border: if they join at a lower rank than what was undone, the merges would have crossed it."""
        before = 1 << 62
        while True:
            if self.ranks.get(self.token[a] + self.token[b], before) < before:
                return False
            of_a, of_b = self.parts(a), self.parts(b)
            if of_a and (a > b or not of_b):
                before, a = a, of_a[1]
            elif of_b:
                before, b = b + 1, of_b[0]  # of equal ranks the left one comes first
            else:
                return True

    def prefix(self, token: int) -> int | None:
        """The longest token that is a proper prefix of a token."""
        if token not in self.shorter:
            text = self.token[token]
            self.shorter[token] = next(
                (self.ranks[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.ranks), None)
        return self.shorter[token]

    def piece(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        text = piece.decode("latin-1")
        fit, taken, at = self.fit, [], 0
        for _, (size, token) in self.matches.iter_long(text):  # the longest token, again and again
            if taken:
                ok = fit.get(taken[-1] << 32 | token)
                if not (self.fits(taken[-1], token) if ok is None else ok):
                    return self._backtracked(text, taken, at, token)
            taken.append(token)
            at += size
        return taken

    def _backtracked(self, text: str, taken: list[int], at: int, token: int) -> list[int]:
        """Go on from the first token that does not fit behind those taken."""
        size, fit, reach, dead = self.size, self.fit, self.reach, set()
        while True:
            end = at + size[token]
            if end not in dead:
                ok = not taken or fit.get(taken[-1] << 32 | token)
                if ok is None:
                    ok = self.fits(taken[-1], token)
                if ok:
                    taken.append(token)
                    at = end
                    if at == len(text):
                        return taken
                    _, (_, token) = next(self.matches.iter_long(text[at : at + reach]))
                    continue
            token = self.prefix(token)
            if token is None:
                dead.add(at)
                token = taken.pop()
                at -= size[token]

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers.

        If no two white-space characters meet, a line feed is a piece and a space belongs to the word
        behind it, so lines and words are independent and words can be remembered whole.
        """
        if _MEETING(text):
            return self.ids(text)
        lines = []
        for line in text.split("\n"):
            first, *others = line.split(" ")
            lines.append(self.ids(first))
            if others:
                lines[-1] += b"".join(map(self.words.__getitem__, others))
        return self.pieces["\n"].join(lines)

    def _word(self, word: str) -> bytes:
        """Ids of a word with a space before it; letters first, then what follows them."""
        if word.isalpha():
            return np.array(self.piece(b" " + word.encode()), "<u4").tobytes()
        first, *others = self.split(" " + word)
        head = self.words[first[1:]] if first[1:].isalpha() else self.pieces[first]
        return head + b"".join(map(self.pieces.__getitem__, others))

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Remembered(dict):
    """Ids of short strings, made by a function when they are first asked for."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, text: str) -> bytes:
        ids = self.make(text)
        if len(text) <= SHORT and (text.isalpha() or len(self) < REMEMBERED // 2):
            if len(self) >= REMEMBERED:
                self.clear()
            self[text] = ids
        return ids


@lru_cache(2)
def load(path: str, pattern: str = public_tokenizers.PATTERN) -> ByteBPE:
    """The vocabulary of a rank file, once for each worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return ByteBPE(ranks, pattern)


def encoded(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(doc_id, ids, decoded)`` for each row of ``docs (doc_id, text, ...)``.

    ``ids`` are little-endian unsigned 32-bit integers in one binary, ``decoded`` the bytes they stand
    for. Null and empty texts have no ids. Special tokens are ordinary text. Rows are independent:
    repeated rows give repeated results, further columns are ignored, no rows give no rows. A text
    of any length is encoded as a whole. ``path`` must be readable on every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            ids = [bpe.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), W.binaries(ids), W.binaries([bpe.decode(i) for i in ids])],
                ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, hashed where the ids are made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column("text").to_pylist():
                ids = bpe.encode(text or "")
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()),
                 pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` encoded and decoded again, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
