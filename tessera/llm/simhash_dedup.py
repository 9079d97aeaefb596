"""Near-duplicate groups by SimHash fingerprints and BK-trees.

1.  A text's fingerprint has a bit set where more than half of the XXH64 hashes of its word shingles, repeats included, have it set.
    Texts with equal fingerprints are one node from here on.
2.  Shards: codes that differ in at most ``radius`` bits agree in one of ``radius + 1`` segments of the bits, so every node stands in the shard
    of each of its segments, and partners share one. A shard with more than ``max_shard`` nodes is cut by segments of the bits that are
    still free, as often as needed; a shard whose free bits can't tell more than ``max_shard`` codes apart needs no cut, so every shard is bounded.
3.  Each task grows the BK-trees of its shards, many shards side by side in NumPy: a node's children are keyed by their integer Hamming distance to
    it, and a search at distance d from a node follows the edges d - radius to d + radius only.
4.  A search leaves out subtrees that lie wholly in its own component, as they can't join anything: a dense group costs little more than its
    members, and a task returns each node with its shard's smallest node that it is joined to, never the pairs.
5.  Union-find by minimum labels over these links; ids come back at the end.

Trees are dealt out by shard and not broadcast, as together they grow with the corpus.

Cases: null and empty texts, and texts of white space, have the fingerprint zero, which links like any other; a row with a null id takes part, its component is the
smallest id of its group or null; rows with equal ids each have their own text and row; a very long text is read in slices of its shingles and
takes the memory of one text; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tessera.llm.common import materialize, spread, table
from tessera.llm.components import connected_components

_U = np.uint64
BITS = 64
#: Shingles of one text whose bits are counted at a time.
SLICE = 1 << 14
#: Nodes that a task reads before it grows their trees; a shard is never cut.
BATCH = 1 << 16
#: Pairs of a search and a tree node that are looked at side by side.
FRONTIER = 1 << 21


def fingerprint(text: str | bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit fingerprint of a text as an unsigned number; 0 without words."""
    raw = (text.encode() if isinstance(text, str) else text or b"").lower().split()  # both of ASCII only
    if not raw:
        return 0
    if len(raw) <= shingle:
        return xxh64_intdigest(b" ".join(raw), seed)
    n = len(raw) - shingle + 1
    set_in = np.zeros(BITS, np.int64)
    for lo in range(0, n, SLICE):
        hi = min(n, lo + SLICE)
        parts = map(b" ".join, zip(*(raw[lo + i : hi + i] for i in range(shingle)), strict=True))
        h = np.fromiter(map(xxh64_intdigest, parts, repeat(seed)), _U, hi - lo)
        set_in += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > n, bitorder="little").view(_U)[0])


def _fingerprints(shingle: int, seed: int):
    """Batches of (doc_id, text) to doc_id, code (the fingerprint as a signed number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            codes = np.array([fingerprint(t.as_py(), shingle, seed) for t in texts], _U)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes.view(np.int64))], names=["doc_id", "code"])

    return run


def segments(mask: int, parts: int) -> list[int]:
    """The masks ``mask`` plus one of ``parts`` segments of the bits that are free in it."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    cuts = [len(free) * i // parts for i in range(parts + 1)]
    return [mask | sum(1 << b for b in free[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shards(codes: DataFrame, radius: int, max_shard: int) -> list[DataFrame]:
    """Tables mask, value, code: the codes whose bits under ``mask`` are ``value``; no shard is unbounded."""
    spark, parts = codes.sparkSession, radius + 1
    masks, done = [0], []
    open_codes = codes.select(F.lit(0).cast("long").alias("mask"), "code")
    while True:
        finer = {m: segments(m, parts) for m in masks}
        # masks of one level: the number of segments to the power of the level
        cuts = spark.createDataFrame([(_signed(m), [_signed(x) for x in f]) for m, f in finer.items()], "mask long, finer array<long>")
        dealt = open_codes.join(F.broadcast(cuts), "mask").select(F.explode("finer").alias("mask"), "code")
        dealt = dealt.select("mask", F.col("code").bitwiseAND(F.col("mask")).alias("value"), "code")  # in the order that _joined() reads
        if len(masks) > 1:
            dealt = dealt.distinct()  # two ways of cutting may lead to one shard
        sizes = dealt.groupBy("mask", "value").agg(F.count("*").alias("n")).where(F.col("n") > max_shard)
        large = materialize(sizes.select("mask", "value"), "large")  # fewer than codes x segments / max_shard
        masks = sorted({m for f in finer.values() for m in f})
        if not large.head(1) or all(1 << (BITS - m.bit_count()) <= max_shard for m in masks):
            return [*done, dealt]
        done.append(dealt.join(large, ["mask", "value"], "left_anti"))
        open_codes = materialize(dealt.join(large, ["mask", "value"], "left_semi").select("mask", "code"), "open")


class Forest:
    """BK-trees of several groups of different codes, grown level by level."""

    def __init__(self, codes: np.ndarray, group: np.ndarray):
        """``codes`` sorted by ``group``, whose numbers are 0, 1, ..."""
        n = len(codes)
        self.codes, self.group = codes, group
        self.parent, self.edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        self.roots = np.flatnonzero(np.diff(group, prepend=-1))
        self.levels = [self.roots]
        inside = np.ones(n, bool)
        inside[self.roots] = False
        rest = np.flatnonzero(inside)
        above = self.roots[group[rest]]
        while len(rest):
            edge = np.bitwise_count(codes[rest] ^ codes[above]).astype(np.int64)
            key = above * (BITS + 1) + edge
            # the first of those that hang at one edge is the child there, the others hang below it
            order = np.argsort(key, kind="stable")
            first = np.diff(key[order], prepend=-1) != 0
            child = rest[order[first]]
            self.parent[child], self.edge[child] = above[order[first]], edge[order[first]]
            self.levels.append(child)
            below = child[np.cumsum(first) - 1]
            rest, above = rest[order[~first]], below[~first]
        inner = np.flatnonzero(self.parent >= 0)
        key = self.parent[inner] * (BITS + 1) + self.edge[inner]
        by = np.argsort(key)
        self._child, self._key = inner[by], key[by]

    def _spans(self, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The smallest and the largest label in each node's subtree."""
        low, high = label.copy(), label.copy()
        for level in reversed(self.levels[1:]):
            np.minimum.at(low, self.parent[level], low[level])
            np.maximum.at(high, self.parent[level], high[level])
        return low, high

    def components(self, radius: int) -> np.ndarray:
        """For each code the first code, in the given order, that it is joined to by steps of at most ``radius`` bits."""
        n = len(self.codes)
        label = np.arange(n)
        size = np.bincount(self.group)[self.group]
        cost = np.cumsum(size)
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(cost, (cost[lo - 1] if lo else 0) + FRONTIER, "right")))
            low, high = self._spans(label)
            ask = np.arange(lo, hi)
            at = self.roots[self.group[ask]]
            a, b = [], []
            while len(ask):
                mixed = (low[at] != high[at]) | (low[at] != label[ask])
                ask, at = ask[mixed], at[mixed]
                d = np.bitwise_count(self.codes[ask] ^ self.codes[at]).astype(np.int64)
                near = d <= radius
                a.append(ask[near])
                b.append(at[near])
                start = np.searchsorted(self._key, at * (BITS + 1) + np.maximum(d - radius, 0), "left")
                stop = np.searchsorted(self._key, at * (BITS + 1) + np.minimum(d + radius, BITS), "right")
                many = stop - start
                ask = np.repeat(ask, many)
                at = self._child[np.repeat(start - np.cumsum(many) + many, many) + np.arange(int(many.sum()))]
            label = _united(label, np.concatenate(a), np.concatenate(b))
            lo = hi
        return label


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels, each the smallest number of its component, after further links."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _joined(radius: int):
    """Batches of (mask, value, code), sorted, to links (a, b) of codes to the first of their component in a shard."""

    def links(rows: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum((rows[:, 0] != np.roll(rows[:, 0], 1)) | (rows[:, 1] != np.roll(rows[:, 1], 1)) | (np.arange(len(rows)) == 0)) - 1
        codes = rows[:, 2]
        label = Forest(codes.view(_U), group).components(radius)
        linked = np.flatnonzero(label != np.arange(len(codes)))
        return pa.RecordBatch.from_arrays([pa.array(codes[label[linked]]), pa.array(codes[linked])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 3), np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)])
            if len(held) < BATCH:
                continue
            last = np.flatnonzero((held[:, 0] != held[-1, 0]) | (held[:, 1] != held[-1, 1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield links(np.ascontiguousarray(held[:cut]))
                held = held[cut:]
        if len(held):
            yield links(np.ascontiguousarray(held))

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, seed: int = 42, max_shard: int = 1 << 16
) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id: documents link whose fingerprints differ in at most ``radius`` bits."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    coded = materialize(plain.mapInArrow(_fingerprints(shingle, seed), f"doc_id {kind}, code long"), "codes")
    nodes = materialize(coded.groupBy("code").agg(F.min("doc_id").alias("rep")), "nodes")
    dealt = shards(nodes.select("code"), radius, max_shard)
    parts = [
        s.repartition("mask", "value").sortWithinPartitions("mask", "value", "code").mapInArrow(_joined(radius), "a long, b long") for s in dealt
    ]
    links = parts[0]
    for p in parts[1:]:
        links = links.unionByName(p)
    labels = connected_components(links)
    groups = nodes.join(labels.withColumnRenamed("node", "code"), "code", "left").select("code", "rep", F.coalesce("label", "code").alias("label"))
    first = groups.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = groups.join(first, "label").select("code", "component_id")
    text = F.lower(F.lpad(F.hex("code"), 16, "0"))
    return coded.join(named, "code").select("doc_id", text.alias("fingerprint"), "component_id")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents")))
