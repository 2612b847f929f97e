"""N-gram Jaccard join and substring dedup against brute force."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from vetgrid.llm import jaccard, substrings
from vetgrid.llm import words as W
from vetgrid.llm.components import components


def shingle_set(text, width):
    words = text.encode().lower().split() if text else []
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}


def brute_classes(rows, width, percent):
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    label = [i for i, _ in rows]
    changed = True
    while changed:
        changed = False
        for x, (_, a) in enumerate(sets):
            for y, (_, b) in enumerate(sets):
                if a and b and label[y] < label[x] and 100 * len(a & b) >= percent * len(a | b):
                    label[x], changed = label[y], True
    return sorted((i, len(s), c) for (i, s), c in zip(sets, label))


@pytest.mark.parametrize("width,percent,heavy", [(4, 85, 100_000), (5, 80, 0), (3, 70, 40)])
def test_jaccard_matches_brute_force(table, prose, width, percent, heavy, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    got = jaccard.jaccard_classes(table(prose), width=width, percent=percent, heavy=heavy)
    assert sorted(map(tuple, got.collect())) == brute_classes(prose, width, percent)


def test_similar_sets_share_a_signature():
    draw = np.random.default_rng(3)
    for n in (6, 10, 40, 63, 70, 300, 511, 600):
        for heavy in (0, n // 2, 3 * n):
            a = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
            lost = n - -(-85 * n // 100)
            b = np.unique(np.concatenate([a[lost // 2 :], draw.integers(0, 1 << 63, lost // 2, dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            if 100 * common < 85 * (len(a) + len(b) - common):
                continue
            frequent = np.unique(np.concatenate([a, b]))[:heavy]
            table = frequent, draw.integers(1, 9, len(frequent))
            one, two = (jaccard.signatures(s, table, 85)[0] for s in (a, b))
            assert len(np.intersect1d(one, two))


def test_keep_one_and_empty(table, prose):
    kept = {r["doc_id"] for r in jaccard.keep_one(table(prose), width=4, percent=85).collect()}
    assert kept == {c for _, _, c in brute_classes(prose, 4, 85)}
    assert jaccard.jaccard_classes(table([])).count() == 0


def test_keep_one_with_repeated_ids_and_columns(spark):
    words = [f"w{i}" for i in range(60)]
    text, near, other = " ".join(words), " ".join([*words[:-1], "x"]), " ".join(words[::-1])
    rows = [(3, text, "a"), (3, text, "a"), (3, text, "b"), (5, near, "c"), (5, other, "d"), (None, near, "e"), (None, "alone here now yes no", "f"),
            (7, None, "g"), (7, None, "g"), (8, "", "h"), (9, " ", "i")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, copies string"))
    assert kept.columns == ["doc_id", "text", "copies"]
    got = sorted(map(tuple, kept.collect()), key=repr)
    first = [r for r in got if r[0] == 3]
    assert len(first) == 1 and first[0][1] == text
    assert [r for r in got if r[0] != 3] == sorted(
        [rows[4], rows[6], *rows[7:]], key=repr)


@pytest.mark.parametrize("sizes", [(5, 9, 200), (64, 65, 63), (1, 3, 2000)])
def test_bitmaps_bound_the_overlap(sizes):
    draw = np.random.default_rng(2)
    pool = draw.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sets = [np.unique(draw.choice(pool, n)) for n in sizes for _ in range(6)]
    bound = jaccard.overlap_bound([jaccard.bitmap(s).tobytes() for s in sets], np.array([len(s) for s in sets]))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert bound[i, j] >= len(np.intersect1d(a, b))
    assert (np.diag(bound) == [len(s) for s in sets]).all()


def test_only_texts_near_by_bitmap_move(table, monkeypatch):
    draw = np.random.default_rng(5)
    head = [f"h{i}" for i in range(100)]  # a passage that puts all sets into the same groups
    texts = [head + [f"w{i}" for i in draw.integers(0, 10**6, 100)] for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(100 + i, " ".join([*t[:-1], "x"])) for i, t in enumerate(texts[:3])]
    staged, stage = {}, jaccard.stage_table

    def kept(df, name):
        staged.setdefault(name, []).append(stage(df, name))
        return staged[name][-1]

    monkeypatch.setattr(jaccard, "stage_table", kept)
    monkeypatch.setattr(jaccard, "STAR", 4)
    got = jaccard.jaccard_classes(table(rows), heavy=0)
    assert sorted(map(tuple, got.collect())) == brute_classes(rows, 4, 85)
    assert all("packed" not in df.columns for tables in staged.values() for df in tables)
    assert staged["jaccard-bitmaps"][0].count() == 63
    assert sum(df.count() for df in staged["jaccard-wanted"]) <= 12
    members = staged["jaccard-buckets"][0]  # all are of one band and meet in that one only
    assert members.select("band").distinct().count() == 1


def test_the_sieve_holds_no_wanted_row_back(spark, monkeypatch):
    keys = np.random.default_rng(6).integers(-(1 << 63), 1 << 63, 5000)
    wanted = spark.createDataFrame([(int(k),) for k in keys[:300]], "row_key long")
    for most, others in ((1 << 25, 200), (64, 4700)):
        monkeypatch.setattr(jaccard, "SIEVE", most)
        words = jaccard.sieve(wanted, 300)
        assert jaccard.passes(words, keys[:300]).all() and 64 * len(words) <= most
        assert jaccard.passes(words, keys[300:]).sum() <= others
    assert not jaccard.passes(jaccard.sieve(wanted.limit(0), 0), keys).any()


def test_chains_and_long_chains(spark, table, monkeypatch):
    near = np.eye(7, dtype=bool)
    for i, j in ((0, 6), (6, 3), (3, 5), (1, 4)):
        near[i, j] = near[j, i] = True
    assert jaccard.chained(near).tolist() == [0, 1, 2, 0, 1, 0, 0]
    words = [f"w{i}" for i in range(140)]  # each text is near to the few before and after it only
    rows = [(i, " ".join(words[i : i + 60])) for i in range(60)] + [(500, " ".join(words[70:]))]
    for block in (8, 256):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        monkeypatch.setattr(jaccard, "STAR", 1000)
        got = jaccard.jaccard_classes(table(rows))
        assert sorted(map(tuple, got.collect())) == brute_classes(rows, 4, 85)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(7, 7), (3, 2), (90, 80)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert roots == {**{i: 0 for i in range(41)}, 90: 80, 80: 80}


def brute_kept(rows, width):
    rows = sorted({(i, t or "") for i, t in rows})
    seen, result = set(), {}
    for i, text in rows:
        words, gone = text.encode().split(), set()
        for at in range(len(words) - width + 1):
            window = tuple(words[at : at + width])
            if window in seen:
                gone.update(range(at, at + width))
            seen.add(window)
        result[i] = len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone)
    return result


@pytest.mark.parametrize("width", [20, 8])
def test_substrings_match_brute_force(table, prose, width):
    want = brute_kept(prose, width)
    got = substrings._with_removed(table(prose), width, digest=True).collect()
    assert len(got) == len(prose)
    for row in got:
        n, gone, kept = want[row["doc_id"]]
        assert (row["n_words"], row["n_removed"], row["kept_sha256"]) == (n, gone, hashlib.sha256(kept).hexdigest())


def test_kept_texts(table, prose):
    want, source = brute_kept(prose, 20), table(prose)
    got = substrings.kept_texts(source)
    assert got.columns == source.columns
    texts = dict(prose)
    for row in got.collect():
        n, gone, kept = want[row["doc_id"]]
        assert (row["text"] or "").encode().split() == kept.split()
        assert gone or row["text"] == texts[row["doc_id"]]
        assert (row["removed"], row["row"]) == (7, "r")
    assert substrings.kept_texts(table([])).count() == 0


def test_word_hashes():
    text = ("Wörter  WÖRTER x\ta " + "x" * 70_000 + " a end").encode()
    starts, ends = W.spans(text)
    assert [text[a:b] for a, b in zip(starts, ends)] == text.split()
    hashes = W.hashes(text, starts, ends)
    assert hashes[2] == hashes[4] and len(set(hashes.tolist())) == len(set(text.split()))
    folded = W.hashes(b"ABC abc", *W.spans(b"ABC abc"), fold=True)
    assert folded[0] == folded[1]
