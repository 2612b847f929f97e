from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np
import pytest

from vetgrid.llm import spelling
from vetgrid.llm.spelling import damaged_words, near_words, variants


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(counts: dict[str, int], factor: int = 10):
    close = {w: [o for o in counts if near(w, o)] for w in counts}
    form = {}
    for w, others in close.items():
        if others:
            best = min(others, key=lambda o: (-counts[o], o))
            if counts[best] >= factor * counts[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), counts[w], len(close[w]), counts.get(form.get(w))) for w in counts)


def run(spark, counts, **options):
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = variants(frame, **options).select("word", "form", "root", "n", "n_near", "form_n").collect()
    return sorted(map(tuple, found), key=lambda r: r[0])


def vocabulary(seed: int, size: int, alphabet: str, low: int, high: int) -> dict[str, int]:
    draw, counts = random.Random(seed), {}
    while len(counts) < size:
        word = "".join(draw.choice(alphabet) for _ in range(draw.randrange(low, high)))
        counts[word] = draw.choice([1, 2, 5, 30, 300, 4000])
        for _ in range(draw.randrange(4)):
            i = draw.randrange(len(word))
            other = draw.choice([word[:i] + word[i + 1:], word[:i] + draw.choice(alphabet) + word[i + 1:],
                                 word[:i] + draw.choice(alphabet) + word[i:]])
            if len(other) >= low:
                counts[other] = draw.choice([1, 2, 3, 20])
                word = other
    return counts


@pytest.mark.parametrize("alphabet,low,high", [("ab", 5, 9), ("abcé", 7, 10), ("abcdefghij", 5, 12)])
@pytest.mark.parametrize("frequent", [0, 20, 10**9])
def test_against_all_pairs(spark, monkeypatch, alphabet, low, high, frequent):
    monkeypatch.setattr(spelling, "FREQUENT", frequent)  # from only longest to only shortest grams
    counts = vocabulary(len(alphabet) + low, 300, alphabet, low, high)
    members = spark.createDataFrame(list(counts.items()), "word string, n long")
    table = spelling.gram_table(members)
    # Tasks see the module's own bound, so the lists are built here with the changed one as well.
    lists = []
    codes, starts, sizes = spelling.flat(members.toArrow().column("word").combine_chunks())
    words = members.toArrow().column("word").to_pylist()
    for part in spelling.length_classes(sizes):
        rows, keys = spelling.shortest_lists(spelling.Words(codes, starts[part], sizes[part]), table)
        lists += zip(keys.tolist(), (words[i] for i in part[rows]))
    together = {}
    for key, word in lists:
        together.setdefault(key, set()).add(word)
    for a in words:
        for b in words:
            if a < b and near(a, b):
                assert any(a in g and b in g for g in together.values()), (a, b)


@pytest.mark.parametrize("alphabet,low,high", [("ab", 5, 9), ("abcdé", 7, 11), ("aé\U0001f600\x01\x02", 5, 8)])
def test_variants(spark, alphabet, low, high):
    counts = vocabulary(11 + low, 400, alphabet, low, high)
    assert run(spark, counts) == brute(counts)


def test_hot_lists_in_blocks(spark, monkeypatch):
    stem = "interchangeable"
    counts = {stem: 100_000}
    for i in range(len(stem)):
        for c in "abcdefghijklmnopqrstuvwxyz":
            counts[stem[:i] + c + stem[i + 1:]] = counts.get(stem[:i] + c + stem[i + 1:], 3)
            counts[stem[:i] + c + stem[i:]] = 2
    counts[stem] = 100_000
    expected = brute(counts)
    for block in (50, 8192):
        monkeypatch.setattr(spelling, "BLOCK", block)
        assert run(spark, counts) == expected


def test_chains_long_words_and_small_tables(spark):
    chain = {"abcdefgh": 3, "abcdefg": 40, "abcdefgx": 500, "bcdefgx": 6000, "bcdefgxyz": 9}
    assert run(spark, chain) == brute(chain)
    long = "".join(random.Random(1).choice("abc") for _ in range(5000))
    words = {long: 50, long[:70] + "z" + long[71:]: 2, long[:4000] + long[4001:]: 1, "q" * 64: 30, "q" * 63: 2, "q" * 62: 1}
    assert run(spark, words) == brute(words)
    assert run(spark, {}) == []
    assert run(spark, {"lonelyword": 2}) == [("lonelyword", None, "lonelyword", 2, 0, None)]


def test_too_short_words_are_refused(spark):
    with pytest.raises(ValueError):
        near_words(spark.createDataFrame([("abc", 1)], "word string, n long"), least=3)


def test_bound_covers_every_edit(spark):
    """No edit of one character changes more grams than the bound says."""
    draw = random.Random(2)
    table = np.zeros(spelling.CELLS, np.int64)
    table[draw.sample(range(spelling.CELLS), spelling.CELLS // 2)] = spelling.FREQUENT + 1

    def grams(word):
        import pyarrow as pa
        codes, starts, sizes = spelling.flat(pa.array([word]))
        made = spelling.Grams(spelling.Words(codes, starts, sizes), table)
        places = np.flatnonzero(made.valid[0])
        size = len(word) + 2
        return made, Counter((int(made.hash[0, p]), side, (int(p) if side == "L" else size - int(p)))
                             for p in places for side in "LR")

    for _ in range(100):
        word = "".join(draw.choice("abcd") for _ in range(draw.randrange(5, 12)))
        made, own = grams(word)
        i = draw.randrange(len(word))
        for other in (word[:i] + word[i + 1:], word[:i] + "e" + word[i + 1:], word[:i] + "e" + word[i:]):
            _, theirs = grams(other)
            shared = {(g, d) for g, s, d in own.keys() & theirs.keys() if s == "L"} | {
                (g, len(word) + 2 - d) for g, s, d in own.keys() & theirs.keys() if s == "R"}
            assert len(shared) >= len(word) + 1 - made.bound()[0]


def test_damaged_words(spark, table):
    texts = [(1, "Wonderful wonderful WONDERFUL été Élémentaire"), (None, "wonderful élémentaire"), (2, None), (3, ""),
             (4, "under7score_letters " * 40), (4, "under7score_letters " * 40), (5, "lettersandmore " * 2000)]
    counts = Counter()
    import re
    for doc, text in texts:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = word.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1:]
            counts[word] += 1
    expected = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    assert {r["word"]: r["n"] for r in damaged_words(table(texts)).collect()} == expected
    many = [(i, "harborlights tangerine") for i in range(400)]
    found = {r["word"]: r["n"] for r in damaged_words(table(many), times=1).collect()}
    assert sum(found.values()) == 800 and len(found) > 2  # some runs lost a letter
