from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from vetgrid.llm import ranking
from vetgrid.llm.ranking import ranked, trie_order

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=50):
    vectors = [(d, Counter(TERM.findall((t or "").translate(FOLD)))) for d, t in docs]
    n_docs, terms = sum(1 for _, c in vectors if c), sum(sum(c.values()) for _, c in vectors)
    df = Counter(t for _, c in vectors for t in c)
    wanted: dict = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(TERM.findall((text or "").translate(FOLD)))
    rows = []
    for item, own in wanted.items():
        scores = []
        for doc, counts in vectors:
            if not counts:
                continue
            m = 50 + (50 * sum(counts.values()) * n_docs) // terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * ((1_000_000_000 * counts[t]) // (1000 * counts[t] + 20 * m)) for t in own if t in counts)
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        scores.sort()
        rows += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(scores[:k], 1)]
    return sorted(rows, key=repr)


def run(spark, table, docs, items, **options):
    frame = spark.createDataFrame([(i, t, 1, 2, "m") for i, t in items], "item_id long, text string, rank int, doc_id long, term string")
    found = ranked(table(docs).repartition(3), frame, **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, found.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(9)
    vocabulary = [f"w{i}" for i in range(150)] + ["É", "straße", "x", "Y"]
    word = lambda: vocabulary[min(int(draw.expovariate(0.03)), 153)]
    docs = [(i, " ".join(word() for _ in range(draw.randrange(1, 60)))) for i in range(700)]
    docs += [(700 + i, docs[5][1]) for i in range(120)]  # ties beyond k
    docs += [docs[3], docs[3], (None, docs[5][1]), (None, docs[6][1]), (900, None), (901, ""), (902, " .,;\n")]
    docs += [(903, "rare " * 5000), (904, "w1-w2_w3/w4×w5")]
    items = [(i, " ".join(word() for _ in range(draw.randrange(1, 40)))) for i in range(25)]
    items += [(30, docs[5][1]), (31, None), (32, ""), (33, "absent words only"), (34, "rare"), (None, "w1 x"), (35, "w1"),
              (35, "w2 W1"), (36, " ".join(vocabulary)), (37, "É é STRASSE straße")]
    return docs, items


def test_against_brute_force(spark, table, corpus):
    docs, items = corpus
    expected = brute(docs, items)
    assert run(spark, table, docs, items) == expected
    assert run(spark, table, docs, items, item_bytes=60) == expected  # several passes over the items
    assert run(spark, table, docs, items, k=3) == brute(docs, items, 3)


def test_small_blocks_and_deep_tries(monkeypatch):
    """The search itself: tiny blocks and leaves, so that bounds carry over and many nodes are split."""
    draw = np.random.default_rng(4)
    for leaf in (1, 7):
        monkeypatch.setattr(ranking, "LEAF", leaf)
        for width in (3, 20, 90):
            weights, m = draw.integers(1, 9000, width), draw.integers(50, 400, 600)
            tf = np.where(draw.random((600, width)) < 0.15, draw.integers(1, 9, (600, width)), 0)
            tf[100:200] = tf[0]
            best = ranking.Best(20)
            for first in range(0, 600, 150):
                row, term = np.nonzero(tf[first:first + 150])
                block = ranking.Block(np.arange(first, first + 150), np.zeros(150, bool), m[first:first + 150], row, term,
                                      tf[first:first + 150][row, term])
                block.search(np.arange(width), weights, best)
            score = (weights * ranking.part(tf, m[:, None])).sum(axis=1)
            order = np.lexsort((np.arange(600), -score))[:20]
            assert best.doc.tolist() == order[score[order] > 0].tolist()
            assert best.score.tolist() == score[order][score[order] > 0].tolist()


def test_trie_order_keeps_equal_prefixes_together():
    draw = np.random.default_rng(1)
    holds = draw.random((200, 70)) < 0.5
    holds[:50, :65] = holds[60, :65]
    rows = [tuple(r) for r in ~holds[trie_order(holds)]]
    assert rows == sorted(rows)


def test_empty_tables(spark, table):
    assert run(spark, table, [], [(1, "a")]) == []
    assert run(spark, table, [(1, "a")], []) == []
    assert run(spark, table, [(1, None), (2, "")], [(1, "a")]) == []
    assert run(spark, table, [(1, "a b")], [(1, "a")]) == brute([(1, "a b")], [(1, "a")])
