r"""Spelling variant grouping with a variable-length gram index.

A word stands between two marks. Its grams begin at every place and are as short as they can be
while being selective: from ``SHORTEST`` characters on, a gram grows while it is frequent (more than
``FREQUENT`` occurrences in the vocabulary) up to ``LONGEST``. So the gram dictionary holds short rare
grams and only the extensions of frequent ones. Occurrences are counted over the whole vocabulary in
a table of fixed size; grams that share a cell count together, which costs time, never a result,
because all tasks read the same table. A gram depends only on its own characters, so an edit can
change only the grams that cover its place: the affected-gram bound of a word is the largest number of
its grams that cover one place.

Two words one edit apart share all other grams, at the same distance from the start (left of the edit)
or from the end (right of it). Of a word's gram lists the longest may therefore be skipped: a near word
stands in one of the ``bound + 1`` shortest lists, of either word, in an order by frequency that is the
same for all words. These lists are merged by one shuffle on (gram, side, distance). Inside a list
words of fitting length are compared whole, and a pair leaves only in the rarest list that it shares,
so each pair comes out once. Lists of more than ``BLOCK`` words are dealt into blocks that meet
pairwise, so no list is bound to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vetgrid.llm import words as W
from vetgrid.session import stage_table

SHORTEST, LONGEST = 2, 5
FREQUENT = 500
CELLS = 1 << 19  # of the table of gram counts: 4 MB
BLOCK = 8192  # words of a list that are compared by one task
ROWS = 1 << 16  # words of lists that are gathered for one comparison
PAIRS = 1 << 19  # pairs compared at once
WIDE = 62  # longer words are compared one pair at a time
MARKS = (1, 2)  # before and after a word

_FACTORS = W.MULTIPLIERS[0, 100 : 100 + LONGEST]
_SIDES = W.MULTIPLIERS[1, 100:102]
_LOWER = "abcdefghijklmnopqrstuvwxyz"


# ---- words as matrices ---------------------------------------------------------------------------

class Words:
    """Words of similar length as one matrix of code points, with a mark at both ends and zeros behind."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        width = int(sizes.max()) + 2 + LONGEST
        column = np.arange(width)
        at = np.minimum(starts[:, None] + column - 1, max(len(codes) - 1, 0))
        self.size = sizes
        inside = (column > 0) & (column <= sizes[:, None])
        self.code = np.where(inside, codes[at], 0).astype(codes.dtype)
        self.code[:, 0] = MARKS[0]
        self.code[np.arange(len(sizes)), sizes + 1] = MARKS[1]


def flat(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All code points, the first one of each word, and the lengths in code points."""
    parts = words.to_pylist()
    codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    if len(codes) and codes.max() < 256:
        codes = codes.astype(np.uint8)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return codes, np.cumsum(sizes) - sizes, sizes


def length_classes(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers by powers of two of the length, in parts whose matrices stay small."""
    classes = np.ceil(np.log2(np.maximum(sizes, 16))).astype(np.int64)
    for c in np.unique(classes):
        rows = np.flatnonzero(classes == c)
        step = max(1, (1 << 22) >> int(c))
        for first in range(0, len(rows), step):
            yield rows[first : first + step]


def gram_hashes(code: np.ndarray) -> list[np.ndarray]:
    """For each gram length from ``SHORTEST`` to ``LONGEST`` the hash of the gram at each place."""
    places = code.shape[1] - LONGEST
    total = np.zeros((len(code), places), np.uint64)
    result = []
    for step in range(LONGEST):
        total = total + (code[:, step : step + places].astype(np.uint64) + np.uint64(1)) * _FACTORS[step]
        if step + 1 >= SHORTEST:
            result.append(W.mix(total + np.uint64(step)))
    return result


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) & (CELLS - 1)


class Grams:
    """The gram at each place of each word: its end, its hash, and the order of the word's lists."""

    def __init__(self, words: Words, table: np.ndarray):
        hashes = gram_hashes(words.code)
        place = np.arange(hashes[0].shape[1])
        last = words.size[:, None] + 2  # one behind the closing mark
        self.valid = place + SHORTEST <= last
        self.hash, count = hashes[0], table[cells(hashes[0])]
        length = np.full(self.hash.shape, SHORTEST)
        grows = self.valid
        for longer in hashes[1:]:
            grows = grows & (count > FREQUENT) & (place + length < last)
            length = length + grows
            self.hash = np.where(grows, longer, self.hash)
            count = np.where(grows, table[cells(longer)], count)
        self.end = place + length
        self.last = last
        rank = (np.minimum(count, (1 << 24) - 1).astype(np.uint64) << np.uint64(40)) | (self.hash >> np.uint64(24))
        rank[~self.valid] = np.iinfo(np.uint64).max
        self.order = np.argsort(rank, axis=1, kind="stable")  # equal grams go by place

    def bound(self) -> np.ndarray:
        """The most grams that an edit of one character can change, for each word."""
        places = self.valid.shape[1]
        cover = np.zeros(self.valid.shape, np.int64)
        for back in range(LONGEST):
            cover[:, back:] += (self.valid & (self.end > np.arange(places) + back))[:, : places - back]
        letters = (np.arange(places) > 0) & (np.arange(places) < self.last - 1)
        return np.where(letters, cover, 0).max(axis=1)

    def keys(self, rows: np.ndarray, places: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The list of a gram on a side, by its distance from that end of the word."""
        distance = np.where(right, self.last[rows, 0] - places, places).astype(np.uint64)
        mixed = W.mix(self.hash[rows, places] + distance * _SIDES[0] + right * _SIDES[1])
        return (mixed & ~np.uint64(1)) | right.astype(np.uint64)


def shortest_lists(words: Words, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and list keys: for each word the ``bound + 1`` shortest lists, on either side."""
    grams = Grams(words, table)
    rows, ranks = np.nonzero(np.arange(grams.order.shape[1]) <= grams.bound()[:, None])
    places = grams.order[rows, ranks]
    sides = [grams.keys(rows, places, np.full(len(rows), right)) for right in (False, True)]
    return np.concatenate((rows, rows)), np.concatenate(sides)


def rarest_shared(words: Words, edit: np.ndarray, shift: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The key of the rarest list that a word shares with the one that lacks or changes character ``edit``.

    ``shift`` tells that the other word is shorter; only then is a place right of the edit counted
    from the end."""
    grams = Grams(words, table)
    ends = np.take_along_axis(grams.end, grams.order, axis=1)
    hit = (grams.order <= edit[:, None]) & (edit[:, None] < ends)
    rows = np.arange(len(edit))
    place = grams.order[rows, np.argmin(hit, axis=1)]
    return grams.keys(rows, place, shift & (place > edit))


# ---- the index -----------------------------------------------------------------------------------

def gram_table(vocabulary: DataFrame) -> np.ndarray:
    """Occurrences of grams of all lengths in the words, by cell."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(CELLS, np.int64)
        for batch in batches:
            codes, starts, sizes = flat(batch.column("word"))
            for rows in length_classes(sizes):
                words = Words(codes, starts[rows], sizes[rows])
                for length, hashes in enumerate(gram_hashes(words.code), SHORTEST):
                    inside = np.arange(hashes.shape[1]) + length <= words.size[:, None] + 2
                    table += np.bincount(cells(hashes[inside]), minlength=CELLS)
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(table[used])], ["cell", "n"])

    counted = vocabulary.select("word").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = counted.toPandas()
    table = np.zeros(CELLS, np.int64)
    table[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    return table


def list_members(vocabulary: DataFrame, table) -> DataFrame:
    """``(key, word, n, size)``: every word in its shortest lists."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, starts, sizes = flat(batch.column("word"))
            for part in length_classes(sizes):
                rows, keys = shortest_lists(Words(codes, starts[part], sizes[part]), table.value)
                rows = part[rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), batch.column("word").take(pa.array(rows)),
                     batch.column("n").take(pa.array(rows)), pa.array(sizes[rows].astype(np.int32))],
                    ["key", "word", "n", "size"])

    return vocabulary.select("word", "n").mapInArrow(emit, "key long, word string, n long, size int")


def near_words(vocabulary: DataFrame, least: int = LONGEST) -> DataFrame:
    """``(word, other, n)`` for both directions of each pair of ``vocabulary (word, n)`` that is one
    insertion, deletion or replacement apart; n belongs to ``other``.

    Words are distinct and have ``least`` code points or more, which must be ``LONGEST`` at least:
    only then does every word keep a gram whatever the edit. Words of any length and characters.
    """
    if least < LONGEST:
        raise ValueError(f"words of fewer than {LONGEST} code points can lose all their grams")
    table = vocabulary.sparkSession.sparkContext.broadcast(gram_table(vocabulary))
    members = stage_table(list_members(vocabulary, table), "spelling-lists")
    # Lists beyond a block are few; every other one is a single block that meets itself.
    large = members.groupBy("key").count().filter(F.col("count") > BLOCK).select(
        "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    dealt = members.join(large, "key", "left").withColumn(
        "own", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("word"), "blocks")).otherwise(0).cast("int"))
    others = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
    met = dealt.withColumn("with", F.explode(others)).select(
        "key", F.least("own", "with").alias("one"), F.greatest("own", "with").alias("two"), "own", "size", "word", "n")
    met = met.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "size")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lists in _whole_lists(batches):
            yield from _near_in_lists(lists, table.value)

    return met.mapInArrow(compare, "word string, other string, n long")


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in larger parts that end where a list (or a pair of its blocks) ends."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows < ROWS:
            continue
        part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        edges = _edges(part)
        cut = int(edges[-1]) if len(edges) else 0
        if cut:
            yield part.slice(0, cut)
        held, rows = [part.slice(cut)], part.num_rows - cut
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _edges(part: pa.RecordBatch) -> np.ndarray:
    """The first row of each list but the first one."""
    change = np.zeros(max(part.num_rows - 1, 0), bool)
    for name in ("key", "one", "two"):
        values = part.column(name).to_numpy()
        change |= values[1:] != values[:-1]
    return np.flatnonzero(change) + 1


def _near_in_lists(part: pa.RecordBatch, table: np.ndarray) -> Iterator[pa.RecordBatch]:
    key, size, own = (part.column(c).to_numpy() for c in ("key", "size", "own"))
    size = size.astype(np.int64)
    names, n = part.column("word"), part.column("n")
    codes, starts, sizes = flat(names)
    ends = np.append(_edges(part), part.num_rows)
    group = np.searchsorted(ends, np.arange(part.num_rows), "right")
    # Partners of a row stand behind it in its list: the same length (left side only) or one more.
    level = group * (int(size.max()) + 3) + size
    right = (key & 1).astype(bool)
    first = np.where(right, np.searchsorted(level, level + 1), np.arange(part.num_rows) + 1)
    count = np.maximum(np.searchsorted(level, level + 1, "right") - first, 0)
    letters = np.zeros(part.num_rows, np.uint64)
    if len(codes):
        np.bitwise_or.at(letters, np.repeat(np.arange(part.num_rows), sizes),
                         np.uint64(1) << (codes.astype(np.uint64) & np.uint64(63)))
    left_codes, right_codes = _aligned(codes, starts, size)
    total = np.concatenate(([0], np.cumsum(count)))
    begin = 0
    while begin < part.num_rows:
        stop = max(begin + 1, int(np.searchsorted(total, total[begin] + PAIRS, "right")) - 1)
        a = np.repeat(np.arange(begin, stop), count[begin:stop])
        b = np.arange(total[stop] - total[begin]) - np.repeat(total[begin:stop] - total[begin], count[begin:stop]) + first[a]
        begin = stop
        keep = np.bitwise_count(letters[a] ^ letters[b]) <= 2
        meeting = (part.column("one").to_numpy() != part.column("two").to_numpy())[a]
        keep &= ~meeting | (own[a] != own[b])
        a, b = a[keep], b[keep]
        same = _same_before(a, b, size, left_codes, names)
        keep = same + _same_behind(a, b, size, right_codes, names) >= size[b] - 1
        a, b, same = a[keep], b[keep], same[keep]
        if not len(a):
            continue
        mine = np.zeros(len(a), bool)
        for rows in length_classes(size[b]):
            longer = Words(codes, starts[b[rows]], size[b[rows]])
            shared = rarest_shared(longer, same[rows] + 1, size[a[rows]] < size[b[rows]], table)
            mine[rows] = shared.view(np.int64) == key[a[rows]]
        word, other = np.concatenate((a[mine], b[mine])), np.concatenate((b[mine], a[mine]))
        yield pa.RecordBatch.from_arrays(
            [names.take(pa.array(word)), names.take(pa.array(other)), n.take(pa.array(other))], ["word", "other", "n"])


def _aligned(codes: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of up to ``WIDE`` characters as rows, from the first character on and from the last one back."""
    short = np.minimum(size, WIDE)
    column = np.arange(int(short.max(initial=0)) + 1)
    inside = column < short[:, None]
    top = max(len(codes) - 1, 0)
    ahead = np.where(inside, codes[np.minimum(starts[:, None] + column, top)], 0)
    back = np.where(inside, codes[np.maximum((starts + size)[:, None] - 1 - column, 0)], 0)
    return ahead.astype(codes.dtype), back.astype(codes.dtype)


def _same_before(a, b, size, codes, names) -> np.ndarray:
    """Equal characters at the start of each pair; b is the longer word."""
    same = np.argmin(codes[a] == codes[b], axis=1)
    for i in np.flatnonzero(size[b] > WIDE):
        same[i] = _common(names[int(a[i])].as_py(), names[int(b[i])].as_py())
    return same


def _same_behind(a, b, size, codes, names) -> np.ndarray:
    same = np.argmin(codes[a] == codes[b], axis=1)
    for i in np.flatnonzero(size[b] > WIDE):
        same[i] = _common(names[int(a[i])].as_py()[::-1], names[int(b[i])].as_py()[::-1])
    return same


def _common(a: str, b: str) -> int:
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


# ---- groups --------------------------------------------------------------------------------------

def variants(vocabulary: DataFrame, *, factor: int = 10, least: int = LONGEST) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for each row of ``vocabulary (word, n)``.

    ``form`` is the near word of largest n (ties: least in code-point order) if that n is ``factor``
    times the own one or more, else null; ``root`` is the last word that forms lead to. Words are
    distinct; an empty vocabulary gives no rows.
    """
    vocabulary = vocabulary.select("word", "n")
    own = vocabulary.select("word", F.lit(None).cast("string").alias("other"), "n")
    best = F.min(F.when(F.col("other").isNotNull(), F.struct((-F.col("n")).alias("less"), F.col("other").alias("form"))))
    facts = near_words(vocabulary, least).unionByName(own).groupBy("word").agg(
        F.max(F.when(F.col("other").isNull(), F.col("n"))).alias("n"), F.count("other").alias("n_near"), best.alias("best"))
    good = -F.col("best.less") >= factor * F.col("n")
    facts = stage_table(facts.select(
        "word", "n", "n_near", F.when(good, F.col("best.form")).alias("form"),
        F.when(good, -F.col("best.less")).alias("form_n")), "spelling-forms")
    return facts.join(_roots(facts), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(facts: DataFrame) -> DataFrame:
    """``(word, root)`` for the words that have a form. Each round doubles the steps followed; n grows
    with each step by the factor, so a chain has a few steps and the rounds are fewer."""
    roots = stage_table(facts.filter("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stage_table(roots.join(further, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        roots = step.select("word", "root")
        if step.filter("moved").isEmpty():
            return roots


def damaged_words(docs: DataFrame, least: int = 7, times: int = 2) -> DataFrame:
    """``(word, n)``: runs of Latin letters of ``docs (doc_id, text)``, A-Z folded, one in 31 without a letter.

    The crc32 of ``<doc_id>:<run>`` decides which run loses which letter. Words of ``least`` code
    points and ``times`` occurrences or more remain. Null and empty texts have no run, a null
    ``doc_id`` counts as no characters, repeated rows count again.
    """
    folded = F.translate(F.col("text"), _LOWER.upper(), _LOWER)
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(
        folded, F.lit(f"([a-z\u00C0-\u00FF]{{{least},}})"), 0)).alias("run"))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    hashed = runs.select("run", F.crc32(F.encode(named, "UTF-8")).alias("hash"))
    at = F.pmod("hash", F.length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    word = F.when(F.col("hash") % 31 == 0, shorter).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).filter(F.length("word") >= least).groupBy("word").agg(
        F.count("*").alias("n")).filter(F.col("n") >= times)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(stage_table(damaged_words(docs), "spelling-words"), least=7)
