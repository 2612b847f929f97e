"""Sharding, searches, encoding, packing and the pipeline."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from vetgrid.llm import bytebpe, forest, packing, sharding, topk

SF = "/root/testdata/sf0.01"
WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_registry():
    names = queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14)) and "pipeline" in names
    assert set(oracle_sql()) <= set(names)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation(spark, n):
    steps = sharding.longest_walk(spark, n, 5)
    p = F.col("id")
    for k in range(steps):
        p = sharding.permuted(p, n, 5) if k == 0 else F.when(p < n, p).otherwise(sharding.permuted(p, n, 5))
    assert sorted(r[0] for r in spark.range(n).select(p).collect()) == list(range(n))


def test_shards(table):
    rows = [(i % 50, f"text {i % 70}é") for i in range(500)] + [(None, None), (7, ""), (7, None)] + [(99, "hot")] * 400
    got = sharding.shards(table(rows), count=16).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    counts = Counter(r["shard"] for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    again = sharding.shards(table(rows[::-1]).repartition(3), count=16).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert sharding.shards(table([])).count() == 0


def vectors(spark):
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=8).tolist(), "x") for i in range(300)]
    rows += [(i, rows[5][1], "x") for i in range(300, 330)] + [rows[0], rows[20]]
    rows += [(400, None, "x"), (420, [1.0] * 7 + [None], "x"), (440, [1.0] * 7 + [float("nan")], "x"), (None, rows[0][1], "x"),
             (460, [0.0] * 8, "x"), (480, [float("inf")] + [0.0] * 7, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")


def brute(spark, scale, zero):
    kept = {}
    for i, e, _ in vectors(spark).collect():
        if i is not None and e is not None and None not in e and np.isfinite(e).all() and (zero or any(e)):
            kept[i] = np.floor(scale * np.array(e)) if scale else np.array(e)
    result = {}
    for q in (i for i in kept if i % 20 == 0):
        found = sorted((-float((kept[q] * kept[c]).sum()), c) for c in kept if c != q)[:20]
        result[q] = [(c, -s) for s, c in found]
    return result


def test_top_k(spark):
    got = defaultdict(list)
    for r in topk.top_k(vectors(spark)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], float(r["score"])))
    assert got == brute(spark, 64, True)
    assert topk.top_k(vectors(spark).limit(0)).count() == 0
    assert topk.top_k(vectors(spark).filter("vec_id in (0, 3)")).count() == 1


def test_forest(spark):
    want, got = brute(spark, 0, False), defaultdict(dict)
    for r in forest.nearest(vectors(spark)).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    hits = sum(len(set(got[q]) & {c for c, _ in found}) for q, found in want.items())
    assert set(got) == set(want) and hits >= 0.9 * 20 * len(want)
    for q, found in want.items():
        for c, s in found:
            assert c not in got[q] or abs(got[q][c] - s) < 1e-12
    assert forest.nearest(vectors(spark).limit(0)).count() == 0


def test_forest_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    got = defaultdict(set)
    for r in forest.op8_nearest_neighbours(spark, SF).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[i]
        scores[i] = -np.inf
        hits += len(got[ids[i]] & set(ids[np.lexsort((ids, -scores))[:20]].tolist()))
        total += 20
    assert hits >= 0.9 * total


def test_byte_bpe(table):
    bpe = bytebpe.load(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    reference = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    draw = random.Random(2)
    parts = ["'s", " ", "  ", "\n", "\x1c", "\x85", "　", "é", "漢字", "😀", "a", "the", "12", "...", "\t", "é", "x" * 50]
    texts = ["", " ", "\n\n\n", "a" * 3000, " " * 3000] + ["".join(draw.choices(parts, k=draw.randrange(1, 30))) for _ in range(400)]
    for text in texts:
        assert np.frombuffer(bpe.encode(text), "<u4").tolist() == reference.encode_ordinary(text)
    rows = bytebpe.encoded(table([(1, None), (2, ""), (3, texts[9]), (3, texts[9])]), public_tokenizers.path(
        "byte_bpe_multi_50k.tiktoken")).collect()
    assert [bytes(r["decoded"]).decode() for r in rows] == ["", "", texts[9], texts[9]]
    row = bytebpe.digests(table([(3, "some text")]), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).first()
    ids = np.array(reference.encode_ordinary("some text"), "<u4").tobytes()
    assert tuple(row)[1:] == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(b"some text").hexdigest())


def test_hilbert_curve():
    grid = np.array(np.meshgrid(*[np.arange(4)] * 4, indexing="ij")).reshape(4, -1).T
    place = packing.hilbert(grid, 2)
    assert sorted(place.tolist()) == list(range(256))
    assert np.abs(np.diff(grid[np.argsort(place)], axis=0)).sum(1).max() == 1


def test_packing(table, prose):
    tokenizer = Tokenizer.from_file(WORDS)
    rows = prose + [(300, "x <|endoftext|> ΣΑΣ"), (301, "a\x01b \x01 c"), (302, "\x01"), (303, "a<|startoftext|><|ENDOFTEXT|>b"),
                    (304, "<|endoftext|>" * 3000)]
    pieces = packing.packed(table(rows), WORDS).collect()
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for number, parts in sequences.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == 2048 or number == max(sequences)
    want = Counter()
    for i, text in rows:
        want[i, np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()] += 1
    total = Counter()
    for p in pieces:
        total[p["doc_id"]] += p["length"]
    assert total == Counter({i: sum(len(ids) // 4 * n for (d, ids), n in want.items() if d == i) for i, _ in want})
    for i, ids in want:
        if want[i, ids] == 1 and sum(1 for d, _ in want if d == i) == 1:
            own = sorted((p for p in pieces if p["doc_id"] == i), key=lambda p: p["start"])
            assert b"".join(bytes(p["ids"]) for p in own) == ids
    assert packing.packed(table([]), WORDS).count() == 0


def test_packing_merges_a_word_once():
    words, reference, draw = packing._Words(WORDS), Tokenizer.from_file(WORDS), random.Random(4)
    merges, sent = words.merges, []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            sent.extend(w for text in texts for w in text.split())
            return merges.encode_batch_fast(texts, **options)

    words.merges = Counting()
    vocabulary = ["".join(draw.choices("abcdeßàíñ", k=n)) for n in range(1, 20) for _ in range(20)]
    cases = [str, lambda w: w[0].upper() + w[1:] if w.isascii() else w, lambda w: w.upper() if w.isascii() else w]
    texts = [" ".join(draw.choice(cases)(draw.choice(vocabulary)) + draw.choice(["", *".,;:!?"]) for _ in range(300))
             for _ in range(40)]
    for part in texts[:25], texts[25:]:
        got = [ids.tolist() for ids in words.encode(pa.array(part))]
        assert got == [reference.encode(text, add_special_tokens=False).ids for text in part]
    assert len(sent) == len(set(sent)) <= len(set(vocabulary))


@pytest.mark.parametrize("count", [1, 7, 2000])
def test_packing_encodes_texts_together(count):
    words, reference, draw = packing._Words(WORDS), Tokenizer.from_file(WORDS), random.Random(6)
    parts = ["'s", " ", "  ", "\n", "\x0b", "\x1c", "\x85", "\u3000", "e\u0301", "É", "漢字", "😀", "a", "The", "12", "...", ".", ",",
             "\t", "ß", "à", "\xad", "í", "÷", "ÿ", "x" * 50, "\x01", "\x00", "\u212a", "Σ", "<|endoftext|>", "</w>", "H\u0331", "\u0308"]
    texts = [None, "", " ", "."] + ["".join(draw.choices(parts, k=draw.randrange(1, 30))) for _ in range(1000)]
    got = [ids.tolist() for i in range(0, len(texts), count) for ids in words.encode(pa.array(texts[i : i + count], pa.string()))]
    assert got == [reference.encode(text or "", add_special_tokens=False).ids for text in texts]


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first = corpus_pipeline.reject_toxic(spark, docs, sf)
    near = corpus_pipeline.drop_near_copies(spark, first, sf)
    cut = corpus_pipeline.cut_repeats(spark, near, sf)
    clean = corpus_pipeline.redact_secrets(spark, cut, sf)
    assert docs.columns == first.columns == near.columns == cut.columns == clean.columns
    assert docs.count() > first.count() > near.count() == cut.count() == clean.count()
    assert clean.filter("n_chars <> length(text)").count() == 0
    assert corpus_pipeline.run(spark, sf).select("doc_id").distinct().count() == clean.count()
