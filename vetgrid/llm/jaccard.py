r"""N-gram Jaccard join: token-combination prefixes, then exact verification.

The tokens of a document are its distinct hashed word shingles. If two sets have a Jaccard
similarity of ``percent`` or more, each keeps at least ``ceil(percent * size / 100)`` of its tokens
in the other, so at most ``size - that`` of its tokens are missing there. Tokens have one global
order: rare ones first, by hash, then frequent ones by ascending count. A prefix is extended until
the missing tokens cannot destroy all of its signatures: a rare token is a signature by itself; the
frequent tokens are dealt into classes by hash, and every pair of one class is a signature, so a
class with c prefix tokens survives c - 1 losses. Whichever of two similar sets has the prefix that
ends first in the global order shares a whole signature with the other one. Pairs of frequent
tokens are far more selective than the tokens, which is what keeps common passages from filling
buckets. Larger sets use more classes, so that long documents emit few pairs; near a boundary a
set emits the signatures of both sides of it.

Which tokens are frequent decides cost only, never results: any order and any classes are right as
long as all tasks use the same. They are counted over all documents, batch by batch, and only the
``heavy`` most frequent ones are broadcast (12 bytes each), whatever the size of the input.

Equal sets are one node. Nodes of a bucket (a signature) whose sizes are near enough meet in groups,
one for each size band, under a hub: the node with the smallest share of rare tokens, which is the
original among its near copies. Large groups are first compared with their hub only, which is linear
and connects nearly all nodes of a hot group. Pairs that are connected by then need no comparison.
In every group the nodes outside the hub's component still meet each other and the rest, in blocks of
bounded size: first as bitmaps of their hashed tokens, about a bit a token. Every bit that only one of
two sets has is a token the other one lacks, which bounds their similarity from above, so a node whose
bitmap is near to none of another component is done with that group. The few that are left are parted
into chains of near bitmaps. A chain that several groups hold is one, so that near copies which share many
groups meet once, and is verified exactly by whole compressed texts; only links that join components come
out. No link between different texts that could change a component is lost.

Texts move only for these last steps: a bitmap of the wanted rows, of bounded size, holds all others
back where they are read. In buckets a set is 64 bits of its 128, which two linked sets share by chance only.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vetgrid.llm import words as W
from vetgrid.llm.components import components
from vetgrid.session import stage_table

HEAVY = 100_000  # broadcast bound: 1.2 MB
BATCH_REPEATS = 4  # documents of four slices that make a token worth counting
STAR = 32  # nodes of a group that meet without being compared with the hub first
BLOCK = 256  # nodes of a group that meet at once, with as many others
BLOCK_TOKENS = 1_000_000  # tokens of a block, about; one longer text is a block of its own
SLICE = 4 << 20  # bytes of text that a task works on at once
SALTS = 16  # parts of the nodes of one component where they learn its id
SIEVE = 1 << 25  # bits that tell wanted rows from others: 4 MB; a fuller sieve lets more texts through
SIG_SHIFT = 24  # signatures of 40 bits; two that coincide cost comparisons
COLUMNS = 4096  # tokens of one membership matrix: 8 MB for 512 nodes
CLASSES = ((64, 1), (512, 8), (4096, 32), (1 << 62, 128))  # sets below a size: classes of frequent tokens

Tokens = tuple[np.ndarray, np.ndarray]


def token_set(text: bytes, width: int) -> np.ndarray:
    starts, ends = W.spans(text)
    return W.shingles(W.hashes(text, starts, ends, fold=True), width)


def node_of(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def key_of(node: bytes) -> int:
    return int.from_bytes(node[:8], "little", signed=True)


def jaccard_classes(docs: DataFrame, *, width: int = 4, percent: int = 85, heavy: int = HEAVY) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for each row of ``docs (doc_id, text, ...)``.

    A-Z are folded; ``component_id`` is the least ``doc_id`` that links reach, the own one included.
    A null, empty or blank text has no shingle and links with nothing. A text of fewer than
    ``width`` words is one shingle. Repeated rows give repeated results; further columns are ignored
    whatever their names. A null ``doc_id`` keeps its row; it is never the least id of a component
    that holds another one. An empty table gives no rows.
    """
    facts, roots = _linked(docs, width, percent, heavy)
    return _with_components(facts, roots)


def _linked(docs: DataFrame, width: int, percent: int, heavy: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, text_key, n_shingles, node)`` for each row, and ``(node, root)`` for the linked nodes."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"),
                         F.xxhash64("text").alias("text_key"))
    common = frequent_tokens(source, width, heavy)
    facts = stage_table(source.mapInArrow(
        _facts(width, percent), "doc_id long, text_key long, n_shingles long, node binary, key long, bits binary"),
        "jaccard-facts")
    members = stage_table(bucket_members(source, facts, common, width, percent), "jaccard-buckets")
    bitmaps = stage_table(facts.filter("bits is not null").select(
        "node", F.col("n_shingles").cast("int").alias("n"), "bits").join(
        members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "jaccard-bitmaps")

    links = stage_table(hub_links(members, bitmaps, source, facts, width, percent), "jaccard-stars")
    apart = stage_table(_placed(members, components(links)), "jaccard-placed")
    near = stage_table(near_by_bitmap(apart, bitmaps.select("node", "bits"), percent), "jaccard-near")
    rest = stage_table(between_components(near, source, facts, width, percent), "jaccard-links")
    return facts, components(links.unionByName(rest))


def frequent_tokens(source: DataFrame, width: int, heavy: int) -> Tokens:
    """The most frequent tokens and their counts, in ascending order of the token."""

    def often(sets: list[np.ndarray]) -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
        keep = counts >= BATCH_REPEATS
        return pa.RecordBatch.from_arrays([pa.array(W.signed(tokens[keep])), pa.array(counts[keep])], ["token", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, size = [], 0
        for batch in W.sliced(batches, "text", SLICE):
            sets += [token_set(t, width) for t in batch.column("text").to_pylist() if t]
            size += batch.column("text").nbytes
            if size >= 4 * SLICE and sets:
                yield often(sets)
                sets, size = [], 0
        if sets:
            yield often(sets)

    counted = source.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(
        F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "token").limit(heavy).toPandas()
    tokens = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], top["n"].to_numpy(np.int64)[order]


def signatures(tokens: np.ndarray, common: Tokens, percent: int) -> tuple[np.ndarray, int]:
    """Signatures of a set, and how many of its tokens are rare; similar sets share a signature."""
    n = len(tokens)
    need = n - -(-percent * n // 100) + 1
    keys, counts = common
    rank = np.zeros(n, np.int64)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, tokens), len(keys) - 1)
        rank = np.where(keys[at] == tokens, counts[at], 0)
    rares = int((rank == 0).sum())
    rare = tokens[rank == 0][:need]
    if len(rare) == need or not n:
        return W.mix(rare), rares
    need -= len(rare)
    often = tokens[rank > 0]
    often = often[np.lexsort((often, rank[rank > 0]))]
    parts = [W.mix(rare)]
    for classes in _schemes(n, percent):
        mine = (W.mix(often) % np.uint64(classes)).astype(np.int64)
        order = np.argsort(mine, kind="stable")
        opens = np.ones(len(often), bool)  # the first of a class adds no surviving pair
        opens[order] = np.concatenate(([True], mine[order][1:] != mine[order][:-1]))
        end = int(np.searchsorted(np.cumsum(~opens), need)) + 1
        for c in np.unique(mine[:end]):
            group = often[:end][mine[:end] == c]
            i, j = np.triu_indices(len(group), 1)
            parts.append(W.mix(group[i] * W.MULTIPLIERS[0, 0] + group[j] * W.MULTIPLIERS[0, 1]
                               + np.uint64(classes)))
    return np.concatenate(parts), rares


def _schemes(n: int, percent: int) -> set[int]:
    """Class counts that a set of this size shares with sets of any size it can link with."""
    low, high = percent * n // 100, -(-100 * n // percent)
    return {c for (below, c), above in zip(CLASSES, (0, *(b for b, _ in CLASSES)))
            if low < below and high >= above}


def bucket_members(source: DataFrame, facts: DataFrame, common: Tokens, width: int, percent: int) -> DataFrame:
    """``(node, n, hub, band)`` for each group of more than one node, hubs included; n is the set size.

    A node of a size band is in the group of that band and of the next one, so that any two nodes of
    a bucket with sizes near enough to link are in one group. A group without a node of its own band
    is left out: all its nodes are in the group of the band before."""
    spark = source.sparkSession
    shared = spark.sparkContext.broadcast(common)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # 16 bytes for each set that this task has emitted
        for batch in W.sliced(batches, "text", SLICE):
            sigs, keys, shares, sizes = [], [], [], []
            for text in batch.column("text").to_pylist():
                tokens = token_set(text, width) if text else ()
                # One more token is too many for a small set: only equal sets link, and they are one node.
                if _alone(len(tokens), percent):
                    continue
                node = node_of(tokens)
                if node in seen:
                    continue
                seen.add(node)
                own, rares = signatures(tokens, shared.value, percent)
                sigs.append(own >> np.uint64(SIG_SHIFT))
                keys.append(np.full(len(own), key_of(node), np.int64))
                shares.append(np.full(len(own), 1000 * rares // len(tokens), np.int32))
                sizes.append(np.full(len(own), len(tokens), np.int32))
            if sigs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(W.signed(np.concatenate(sigs))), pa.array(np.concatenate(keys)), pa.array(np.concatenate(shares)),
                     pa.array(np.concatenate(sizes))], ["sig", "key", "rare", "n"])

    def over(window):
        return window.orderBy("rare", "key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def ends(window):
        return F.first("key").over(over(window)).alias("hub_key"), F.last("key").over(over(window)).alias("top")

    rows = source.select("text").mapInArrow(emit, "sig long, key long, rare int, n int")
    # Both windows need one exchange. Bands are a trace wider than the size ratio, for rounding.
    shared_sigs = rows.select("*", *ends(Window.partitionBy("sig"))).filter("hub_key <> top").drop("hub_key", "top")
    own = F.floor(F.log("n") / F.lit(math.log(100 / percent) * 1.000001 or 1.0)).cast("int")
    banded = shared_sigs.withColumn("own", own).withColumn("band", F.explode(F.array("own", F.col("own") + 1)))
    group = Window.partitionBy("sig", "band")
    grouped = banded.select("key", "n", "band", *ends(group), F.max("own").over(over(group)).alias("highest")).filter(
        "hub_key <> top and highest = band").select("key", "n", "hub_key", "band").distinct()
    nodes = facts.filter("bits is not null").select(
        "key", F.col("n_shingles").cast("int").alias("n"), "node").distinct()
    hubs = nodes.select(F.col("key").alias("hub_key"), F.col("node").alias("hub"))
    return grouped.join(nodes, ["key", "n"]).join(hubs, "hub_key").select("node", "n", "hub", "band")


def _alone(n: int, percent: int) -> bool:
    """Whether a set of this size links with equal sets only."""
    return n * (100 - percent) < percent


def _facts(width: int, percent: int):
    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.sliced(batches, "text", SLICE):
            sizes, nodes, bits = [], [], []
            for text in batch.column("text").to_pylist():
                tokens = token_set(text, width) if text else ()
                sizes.append(len(tokens))
                nodes.append(node_of(tokens) if len(tokens) else None)
                bits.append(None if _alone(len(tokens), percent) else bitmap(tokens).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), W.binaries(nodes),
                 pa.array([None if n is None else key_of(n) for n in nodes], pa.int64()), W.binaries(bits)],
                ["doc_id", "text_key", "n_shingles", "node", "key", "bits"])
    return facts


def _with_texts(met: DataFrame, source: DataFrame, facts: DataFrame) -> DataFrame:
    """``met`` with ``packed``, the compressed text of its ``node``.

    One row of ``source`` is wanted for each node. Rows that are not wanted stop at the sieve, before
    they are compressed and shuffled, but for the share of the sieve's bits that is set."""
    row_key = F.xxhash64("doc_id", "text_key").alias("row_key")
    one = facts.join(met.select("node").distinct(), "node", "left_semi").groupBy("node").agg(
        F.min(F.struct("text_key", "doc_id")).alias("one")).select("node", "one.*")
    wanted = stage_table(one.select("node", row_key, "text_key"), "jaccard-wanted")
    count = wanted.count()
    shared = source.sparkSession.sparkContext.broadcast(sieve(wanted.select("row_key"), count))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(3)
        passed = (b.filter(pa.array(passes(shared.value, b.column("row_key").to_numpy()))) for b in batches)
        for batch in W.sliced(passed, "text", SLICE):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), batch.column("text_key"), W.binaries([press.compress(t) for t in texts])],
                ["row_key", "text_key", "packed"])

    # Without a wanted row nothing is read. Equal keys of a text mean equal texts, so the id needs no comparison.
    rows = source.filter(F.col("text").isNotNull() & F.lit(count > 0)).select(row_key, "text_key", "text")
    packed = rows.mapInArrow(pack, "row_key long, text_key long, packed binary").dropDuplicates(["row_key", "text_key"])
    return met.join(wanted, "node").join(packed, ["row_key", "text_key"]).drop("row_key", "text_key")


def sieve(keys: DataFrame, count: int) -> np.ndarray:
    """A bitmap in words of 64 bits, with a bit set for each of ``keys (row_key)``: 64 bits a key, ``SIEVE`` at most."""
    bits = min(SIEVE, 1 << max(10, (64 * count).bit_length()))
    at = F.col("row_key").bitwiseAND(F.lit(bits - 1)).cast("int")
    words = keys.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(row_key & 63 as int))").alias(
        "bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    result = np.zeros(bits >> 6, np.uint64)
    result[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return result


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.view(np.uint64) & np.uint64(64 * len(words) - 1)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def hub_links(members: DataFrame, bitmaps: DataFrame, source: DataFrame, facts: DataFrame, width: int,
              percent: int) -> DataFrame:
    """Links ``(a, b)`` of the nodes of large groups with their hubs, each block next to a copy of the hub."""
    large = members.groupBy("hub", "band").count().filter(F.col("count") > STAR).groupBy("hub").agg(
        F.ceil(F.sum("count") / BLOCK).cast("int").alias("blocks"))
    nodes = members.filter("node <> hub").select("node", "hub").distinct().join(large, "hub").select(
        "hub", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node")
    hubs = large.select("hub", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
                        F.col("hub").alias("node"))

    def by_block(rows: DataFrame) -> DataFrame:  # the hub comes first
        return rows.repartition("hub", "block").sortWithinPartitions("hub", "block", F.col("node") != F.col("hub"))

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_n, hub_bits = 0, b""
        for batch in batches:
            keep = []
            for hub, node, n, bits in W.rows([batch], "hub", "node", "n", "bits"):
                if node == hub:
                    hub_n, hub_bits = n, bits
                    keep.append(True)
                    continue
                both = overlap_bound([hub_bits, bits], np.array([hub_n, n]))[0, 1]
                keep.append(bool(100 * both >= percent * (n + hub_n - both)))
            yield batch.filter(pa.array(keep, pa.bool_())).select(["hub", "block", "node"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        hub_set = np.empty(0, np.uint64)
        for batch in W.sliced(batches, "packed", SLICE // 4):
            a, b = [], []
            for hub, node, packed in W.rows([batch], "hub", "node", "packed"):
                own = token_set(open_.decompress(packed), width)
                if node == hub:  # the first row of its block
                    hub_set = own
                    continue
                both = len(np.intersect1d(own, hub_set, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(hub_set) - both):
                    a.append(node)
                    b.append(hub)
            yield pa.RecordBatch.from_arrays([W.binaries(a), W.binaries(b)], ["a", "b"])

    met = by_block(nodes.unionByName(hubs).join(bitmaps, "node").select("hub", "block", "node", "n", "bits"))
    near = stage_table(met.mapInArrow(bound, "hub binary, block int, node binary"), "jaccard-hubs")
    return by_block(_with_texts(near, source, facts)).select("hub", "node", "packed").mapInArrow(
        compare, "a binary, b binary")


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """Low bits of the tokens as places in a bitmap of about one bit a token (a power of two)."""
    size = 1 << max(6, (len(tokens) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(tokens & np.uint64(size - 1)).astype(np.int64)] = True
    return np.packbits(bits)


def overlap_bound(bitmaps: list[bytes], n: np.ndarray) -> np.ndarray:
    """At least the sizes of the intersections of all pairs, from bitmaps folded to the smallest of them."""
    size = min(map(len, bitmaps)) * 8
    bits = np.empty((len(bitmaps), size), np.float32)
    for row, packed in zip(bits, bitmaps):
        row[:] = np.unpackbits(np.frombuffer(packed, np.uint8)).reshape(-1, size).any(axis=0)
    both = (bits @ bits.T).astype(np.int64)
    most = n - np.diag(both)  # tokens that share a bit with another token of their set
    return np.minimum(most[:, None], most[None, :]) + both


def _placed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``(hub, band, node, n, root, apart)``: members with their component and whether it is not the hub's."""
    return members.join(roots, "node", "left").join(
        roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root")), "hub", "left").select(
        "hub", "band", "node", "n", F.coalesce("root", "node").alias("root"),
        (F.coalesce("root", "node") != F.coalesce("hub_root", "hub")).alias("apart"))


def _meetings(placed: DataFrame, block: int, block_tokens: int) -> DataFrame:
    """``placed`` by meetings ``(hub, band, one, two)`` in which all pairs with a node apart meet once.

    Nodes apart are dealt into ``blocks`` blocks, the others of the group into ``rest`` further ones.
    A block of nodes apart meets itself and every other block."""
    def blocks(of):
        count, tokens = F.count(F.when(of, 1)), F.coalesce(F.sum(F.when(of, F.col("n").cast("long"))), F.lit(0))
        return F.greatest(F.ceil(count / block), F.ceil(tokens / block_tokens)).cast("int")

    whole = F.when((F.count("*") <= block) & (F.sum(F.col("n").cast("long")) <= block_tokens), 0)
    groups = placed.groupBy("hub", "band").agg(
        blocks(F.col("apart")).alias("blocks"), whole.otherwise(blocks(~F.col("apart"))).alias("rest")).filter("blocks > 0")
    own = F.when(F.col("apart") | (F.col("rest") == 0), F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(
        F.col("blocks") + F.pmod(F.xxhash64("node"), F.col("rest"))).cast("int")
    last = F.when(F.col("apart"), F.col("blocks") + F.col("rest")).otherwise(F.col("blocks")) - 1
    return placed.join(groups, ["hub", "band"]).withColumn("own", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), last))).select(
        F.xxhash64("hub", "band", F.least("own", "other"), F.greatest("own", "other")).alias("meeting"),
        "hub", "band", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"),
        "node", "n", "root", "apart")


_MEETING = ("meeting", "hub", "band", "one", "two")


def near_by_bitmap(placed: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """``(hub, band, node, n, root, apart)``: nodes of ``placed`` whose bitmap may link with one of another component.

    They are grouped anew, by chains of such bitmaps inside a meeting; ``hub`` is a digest of the whole
    chain, so that equal chains of several groups are one group."""
    met = _meetings(placed, 2 * BLOCK, BLOCK_TOKENS).join(bitmaps, "node").repartition(
        "meeting").sortWithinPartitions(*_MEETING)

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = W.rows(batches, "hub", "band", "one", "two", "node", "n", "root", "apart", "bits")
        for _, group in groupby(rows, lambda r: r[:4]):
            _, _, _, _, nodes, sizes, roots, apart, bits = zip(*group)
            if len(set(roots)) == 1:
                continue
            n = np.array(sizes, np.int64)
            both = overlap_bound(bits, n)
            _, root = np.unique(np.array(roots, object), return_inverse=True)
            near = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (root[:, None] != root[None, :])
            keep = np.flatnonzero(near.any(axis=1))
            if len(keep):
                chain, first = np.empty(len(nodes), object), chained(near)
                for c in np.unique(first[keep]):
                    of = np.flatnonzero(first == c)
                    parts = sorted(nodes[i] + bytes([apart[i]]) for i in of)
                    chain[of] = hashlib.blake2b(b"".join(parts), digest_size=16).digest()
                yield pa.RecordBatch.from_arrays(
                    [W.binaries([chain[i] for i in keep]), pa.array(np.zeros(len(keep), np.int32)),
                     W.binaries([nodes[i] for i in keep]), pa.array(n[keep].astype(np.int32)),
                     W.binaries([roots[i] for i in keep]), pa.array([apart[i] for i in keep], pa.bool_())],
                    ["hub", "band", "node", "n", "root", "apart"])

    return met.mapInArrow(bound, "hub binary, band int, node binary, n int, root binary, apart boolean").distinct()


def chained(near: np.ndarray) -> np.ndarray:
    """The first row that the links of a symmetric matrix lead to from each row."""
    label = np.arange(len(near))
    while True:
        least = np.minimum(label, np.where(near, label, len(near)).min(axis=1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def between_components(near: DataFrame, source: DataFrame, facts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between nodes of one chain that are in different components so far."""
    near = stage_table(_meetings(near, BLOCK, BLOCK_TOKENS), "jaccard-met")
    met = _with_texts(near, source, facts).repartition("meeting").sortWithinPartitions(*_MEETING)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        rows = W.rows(W.sliced(batches, "packed", SLICE // 4), "hub", "band", "one", "two", "node", "root", "packed")
        for _, group in groupby(rows, lambda r: r[:4]):
            nodes, roots_, sets = zip(*((r[4], r[5], token_set(open_.decompress(r[6]), width)) for r in group))
            if len(set(roots_)) == 1:
                continue
            a, b = _joining(nodes, roots_, sets, percent)
            if a:
                yield pa.RecordBatch.from_arrays([W.binaries(a), W.binaries(b)], ["a", "b"])

    return met.mapInArrow(verify, "a binary, b binary")


def _joining(nodes, roots, sets, percent: int) -> tuple[list, list]:
    """Similar pairs that join components, one for each step of joining."""
    n = np.array([len(s) for s in sets])
    both = _shared(sets)
    _, root = np.unique(np.array(roots, object), return_inverse=True)
    near = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (root[:, None] != root[None, :])
    joined, a, b = list(range(int(root.max()) + 1)), [], []
    for i, j in np.argwhere(np.triu(near)):
        x, y = _find(joined, root[i]), _find(joined, root[j])
        if x != y:
            joined[x] = y
            a.append(nodes[i])
            b.append(nodes[j])
    return a, b


def _find(joined: list[int], x: int) -> int:
    while joined[x] != x:
        joined[x] = x = joined[joined[x]]
    return x


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, by products of membership matrices in column parts."""
    tokens, places, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    column = np.cumsum(counts > 1) - 1
    keep = counts[places] > 1
    owners, columns = owners[keep], column[places[keep]]
    result = np.zeros((len(sets), len(sets)))
    order = np.argsort(columns, kind="stable")
    owners, columns = owners[order], columns[order]
    for start in range(0, int(columns[-1]) + 1 if len(columns) else 0, COLUMNS):
        a, b = np.searchsorted(columns, (start, start + COLUMNS))
        member = np.zeros((len(sets), COLUMNS), np.float32)
        member[owners[a:b], columns[a:b] - start] = 1
        result += member @ member.T
    return result.astype(np.int64)


def _with_components(facts: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``facts`` with the least id of their component.

    Ids are reduced to one for each node, then for each component. Only linked nodes go back to their
    component, in ``SALTS`` parts, so that a component of very many nodes is no single task."""
    linked = facts.groupBy("node").agg(F.min("doc_id").alias("own")).join(roots, "node")
    least = linked.groupBy("root").agg(F.min("own").alias("least")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = linked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    linked_least = salted.join(least, ["root", "salt"]).select("node", "least")
    own = facts.groupBy("node").agg(F.min("doc_id").alias("own"), F.count("*").alias("rows")).filter("rows > 1")
    # Written, so that the join back is a plain one whose hot nodes (copies of one text) can be split.
    by_node = stage_table(own.join(linked_least, "node", "full").select(
        "node", F.coalesce("least", "own").alias("least")), "jaccard-components")
    return facts.join(by_node, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the near copies: of each class of similar texts one row stays, with all its columns.

    It is the one of the least ``doc_id`` (null last), of several texts under that id the one of the
    least hash. Rows that repeat the kept row with the same id and text are dropped too, one of them
    stays. Null, empty and blank texts are no copies of each other and all stay. Columns of any names
    stay as they are; an empty table stays empty. Only rows that repeat are grouped with their texts.
    """
    facts, roots = _linked(docs, width, percent, HEAVY)
    texts = facts.groupBy("doc_id", "text_key", "node").agg(F.count("*").alias("copies"))
    placed = texts.filter("node is not null").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min_by(
        F.struct("doc_id", "text_key", "copies"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("kept"))
    blank = texts.filter("node is null").select("doc_id", "text_key", F.lit(1).cast("long").alias("copies"))
    kept = stage_table(least.select("kept.*").unionByName(blank), "jaccard-kept").select(
        F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key"), "copies")
    row = docs.select(F.struct(*docs.columns).alias("row"))
    joined = row.join(kept, F.col("row.doc_id").cast("long").eqNullSafe(F.col("kept_id"))
                      & (F.xxhash64(F.col("row.text").cast("binary")) == F.col("kept_key")))
    once = joined.filter("copies = 1").select("row.*")
    more = joined.filter("copies > 1").dropDuplicates(["kept_id", "kept_key"]).select("row.*")
    return once.unionByName(more)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies of ``documents``: distinct 4-word shingles, similarity 0.85."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_classes(docs)
