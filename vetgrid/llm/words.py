"""Words of whole texts as byte spans and 64-bit hashes, with numpy inside tasks.

A word is a run of bytes that are no ASCII white space (space, tab to carriage return), which for
UTF-8 is the pattern ``[^\\x20\\x09-\\x0D]+``. A text of any length is hashed in blocks, so memory
stays a small multiple of the text itself.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 16  # bytes hashed at once; a longer word makes a block of its own

_draw = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _draw.integers(0, 1 << 64, 256, dtype=np.uint64)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]  # A-Z hash as a-z
MULTIPLIERS = _draw.integers(0, 1 << 64, (2, 4096), dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _powers(base: int, count: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.full(count - 1, base, np.uint64))).cumprod(dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, BLOCK), _powers(_INVERSE, BLOCK)


def mix(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit (the constants of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word."""
    space = np.ones(len(text) + 2, bool)
    space[1:-1] = _SPACE[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def hashes(text: bytes, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A hash of each word: a polynomial over random byte values, by prefix sums."""
    table = _FOLDED if fold else _BYTES
    data = np.frombuffer(text, np.uint8)
    result = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + BLOCK, "right")))
        high = ends[last - 1]
        up, down = (_UP, _DOWN) if high - low <= BLOCK else (
            _powers(_BASE, int(high - low)), _powers(_INVERSE, int(high - low)))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(table[data[low:high]] * up[: high - low], out=sums[1:])
        a, b = starts[first:last] - low, ends[first:last] - low
        result[first:last] = (sums[b] - sums[a]) * down[a]
        first = last
    return mix(result + (ends - starts).astype(np.uint64))


def windows(words: np.ndarray, at: np.ndarray, width: int, family: int = 0) -> np.ndarray:
    """A hash of the ``width`` words that begin at each position of ``at``."""
    total = np.zeros(len(at), np.uint64)
    for step in range(width):
        total += words[at + step] * MULTIPLIERS[family, step]
    return mix(total)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashed shingles in ascending order; a shorter text is one shingle as a whole."""
    if not len(words):
        return words
    if len(words) < width:
        whole = words * MULTIPLIERS[1, : len(words)]
        return mix(whole.sum(dtype=np.uint64, keepdims=True) + np.uint64(len(words)))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for step in range(width):
        total += words[step : len(total) + step] * MULTIPLIERS[0, step]
    return np.unique(mix(total))


def signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def sliced(batches: Iterator[pa.RecordBatch], name: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of one string or binary column, one row at least.

    What a task derives from texts stays a small multiple of ``limit`` whatever the size of a batch."""
    for batch in batches:
        first = 0
        sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
        total = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(total, total[first] + limit, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last
    release()


def release() -> None:
    """Give memory that a task has freed back to the system; a worker waits for its next task without it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named columns of each batch, as Python values, batch by batch in rows."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names))


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())
