"""Near-duplicate groups by SuperMinHash signatures.

1.  A text's word shingles are hashed; texts with equal sets of shingles form a class, which is one node from here on.
2.  SuperMinHash: each shingle walks through its own random permutation of
    the signature's places, in step with all shingles of the set; at step j it offers
    j plus a random fraction to the place it is at.  Once every place has an offer, later steps
    can't improve any, and the walk stops.
3.  Bands of the signature are bucket keys.  In each bucket every member is paired with the
    bucket's centre (another member in each bucket); in small buckets all
    members are paired.
4.  Pairs are confirmed on the full sets: first each node's best pair, then those of the rest that would still join two
    components.
5.  In large buckets that still hold several components, the members outside the bucket's largest component
    are compared with all members, on the full sets and inside one task for each block of bounded size; only links that
    join two components leave the task.  So the rows are as many as the members, and none that links is lost.
6.  Union-find by minimum labels; ids come back at the end.

Only keys, counts and sets of hashes are grouped; texts are read twice and never shuffled, except for a semi-join by id.

Cases: null and empty texts have no shingles and link with nothing; a row with a null id takes part and
is not kept, its component is the smallest id of its group or null; rows with equal ids each have their own text and row;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize, spread, table
from tessera.llm.components import connected_components
from tessera.llm.hashing import mix, shingles, text_chunks, word_hashes

_U = np.uint64
#: Buckets of at most so many members pair all of them; larger ones pair with a centre, then across components.
SMALL_BUCKET = 6
#: Shingles of the members, and of the askers, that meet in one task.
BLOCK_SHINGLES = 1 << 18
#: Pairs of the inverted index that a task looks at side by side, and shingles of such pairs that it compares.
PAIRS = 1 << 18
COMPARED = 1 << 21


def super_min_hash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """The SuperMinHash signatures (m places of 64 bits) of non-empty sets of 64-bit hashes; m is at most 256."""
    n = len(sets)
    out = np.full((n, m), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets], np.int64)
    seeds, owner = np.concatenate(sets) if n else np.zeros(0, np.uint64), np.repeat(np.arange(n), sizes)
    order = np.tile(np.arange(m, dtype=np.uint8), (len(seeds), 1))
    for j in range(m):
        r = mix(seeds + _U((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        k = (j + (((r >> _U(32)) * _U(m - j)) >> _U(32))).astype(np.int64)
        row = np.arange(len(seeds))
        place = order[row, k]
        order[row, k] = order[:, j]
        offer = (_U(j) << _U(48)) | (mix(r) >> _U(16))
        np.minimum.at(flat, owner * m + place, offer)
        open_sets = (out >= _U(j + 1) << _U(48)).any(axis=1)
        if not open_sets.any():
            break
        live = open_sets[owner]
        if not live.all():
            seeds, owner, order = seeds[live], owner[live], order[live]
    return out


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band, different for equal values in different bands."""
    n, m = signatures.shape
    rows = m // bands
    part = signatures[:, : rows * bands].reshape(n, bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    for i in range(rows):
        key = mix(key * _U(0x9FB21C651E98DF25) + part[:, :, i])
    return key.view(np.int64)


def _sets_of(column: pa.Array, shingle: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets of shingles) of runs of texts."""
    for lo, data, offsets in text_chunks(column):
        h, before = word_hashes(data, offsets, lower=True)
        yield lo, [shingles(h[a:b], shingle) for a, b in zip(before[:-1], before[1:], strict=True)]


def _set_keys(sets: list[np.ndarray]) -> pa.Array:
    return pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())


def _signed(shingle: int, bands: int, rows: int, chunk: int = 100_000):
    """Batches of (doc_id, text) to doc_id, n_shingles, set_key, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, sets in _sets_of(batch.column(1), shingle):
                full = [i for i, s in enumerate(sets) if len(s)]
                keys: list = [None] * len(sets)
                group, held = [], 0
                for i in [*full, None]:
                    if group and (i is None or held + len(sets[i]) > chunk):
                        for g, k in zip(group, band_keys(super_min_hash([sets[g] for g in group], bands * rows), bands), strict=True):
                            keys[g] = k
                        group, held = [], 0
                    if i is not None:
                        group.append(i)
                        held += len(sets[i])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        _set_keys(sets),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set_key", "keys"],
                )

    return run


def _hashed(shingle: int):
    """Batches of (doc_id, text) to set_key, shingles (the hashes, 8 bytes each, ascending)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets_of(batch.column(1), shingle):
                yield pa.RecordBatch.from_arrays(
                    [_set_keys(sets), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_key", "shingles"]
                )

    return run


def _confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets have ``den * intersection >= num * union``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                one, two = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(den * both >= num * (len(one) + len(two) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    joined = pairs.select("a", "b").join(two, "b").join(one, "a").select("a", "b", "set_a", "set_b")
    return joined.mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    num: int = 4,
    den: int = 5,
    bands: int = 40,
    rows: int = 4,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents link where ``den * intersection >= num * union``.

    ``bands`` x ``rows`` is the signature's length. At a similarity s a pair shares no bucket
    with probability ``(1 - s**rows)**bands``, 7e-10 at 0.8 with the defaults.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(
        plain.mapInArrow(_signed(shingle, bands, rows), "doc_id long, n_shingles long, set_key binary, keys array<long>"), "signed"
    )
    classes = signed.where("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys")
    )
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    # a set links with another one only if it can lose a shingle and still reach the similarity
    able = classes.where(F.col("n_shingles") * F.lit(den - num) >= F.lit(num))
    members = able.select("node", "n_shingles", F.explode("keys").alias("key"))
    # the centre: the smallest node in an order of the bucket's own
    buckets = members.groupBy("key").agg(F.count("*").alias("n"), F.min(F.col("node").bitwiseXOR(F.col("key"))).alias("c")).where("n > 1")
    # a table and not an aggregate below the join, so that adaptive execution may split a hot bucket's members
    buckets = materialize(buckets.select("key", "n", F.col("c").bitwiseXOR(F.col("key")).alias("centre")), "buckets")
    shared = materialize(members.join(buckets, "key").select("key", "n", "centre", "node", "n_shingles"), "shared")
    small = shared.where(F.col("n") <= SMALL_BUCKET)
    other = small.select("key", F.col("node").alias("b"), F.col("n_shingles").alias("size_b"))
    inner = small.join(other, "key").where(F.col("node") < F.col("b"))
    inner = inner.where(F.lit(den) * F.least("n_shingles", "size_b") >= F.lit(num) * F.greatest("n_shingles", "size_b"))
    star = shared.where((F.col("n") > SMALL_BUCKET) & (F.col("node") != F.col("centre")))
    pairs = inner.select(F.col("node").alias("a"), "b").unionByName(
        star.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
    )
    pairs = materialize(pairs.groupBy("a", "b").agg(F.count("*").alias("n")), "pairs")

    asked = classes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "set_key", "rep")
    texts = plain.join(asked.select(F.col("rep").alias("doc_id")).where("rep is not null").distinct(), "doc_id", "left_semi")
    texts = texts.unionByName(plain.where("doc_id is null"))
    hashed = texts.mapInArrow(_hashed(shingle), "set_key binary, shingles binary").where("set_key is not null")
    hashed = hashed.join(asked.select("set_key", "node"), "set_key").groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = materialize(hashed, "sets")

    best = materialize(_best(pairs), "best")
    links = materialize(_confirmed(best, sets, num, den), "links")
    labels = connected_components(links)
    rest = materialize(_across(pairs.join(best, ["a", "b"], "left_anti"), labels), "open")
    more = materialize(_confirmed(rest, sets, num, den), "links")
    labels = _joined(labels, more)
    several = materialize(_unsettled(shared, labels), "several")
    last = materialize(_settling(shared, labels, several, sets, num, den), "links")
    labels = _joined(labels, last)
    discard(buckets, shared, pairs, sets, best, links, rest, more, several, last)

    groups = classes.join(labels, "node", "left").select("set_key", "rep", F.coalesce("label", "node").alias("label"))
    first = groups.groupBy("label").agg(F.min("rep").alias("component_id"))
    named = groups.join(first, "label").select("set_key", "component_id")
    return (
        signed.select("doc_id", "n_shingles", "set_key")
        .join(named, "set_key", "left")
        .select("doc_id", "n_shingles", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def _best(pairs: DataFrame) -> DataFrame:
    """Of each node the pair with most shared buckets."""
    both = pairs.select(F.col("a").alias("node"), "a", "b", "n").unionByName(pairs.select(F.col("b").alias("node"), "a", "b", "n"))
    best = both.groupBy("node").agg(F.max(F.struct("n", F.xxhash64("a", "b").alias("h"), "a", "b")).alias("x"))
    return best.select("x.a", "x.b").distinct()


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs of nodes of different components."""
    a = labels.select(F.col("node").alias("a"), F.col("label").alias("label_a"))
    b = labels.select(F.col("node").alias("b"), F.col("label").alias("label_b"))
    return (
        pairs.join(a, "a", "left")
        .join(b, "b", "left")
        .where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b"))
        .select("a", "b", "n")
    )


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels with further links, which are looked at between components only."""
    if not links.head(1):
        return labels
    one, two = (labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")) for c in ("a", "b"))
    ends = links.join(one, "a", "left").join(two, "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    over = connected_components(ends)
    far = over.select(F.col("node").alias("label"), F.col("label").alias("far"))
    known = labels.join(far, "label", "left").select("node", F.coalesce("far", "label").alias("label"))
    out = materialize(known.unionByName(over.join(labels, "node", "left_anti")), "labels")
    discard(labels, over)
    return out


def _large(shared: DataFrame, labels: DataFrame) -> DataFrame:
    large = shared.where(F.col("n") > SMALL_BUCKET).join(labels, "node", "left")
    return large.withColumn("label", F.coalesce("label", "node"))


def _unsettled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Large buckets with several components: the largest of them, and the blocks of members and of the others."""
    tally = _large(shared, labels).groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    several = (
        tally.groupBy("key")
        .agg(F.count("*").alias("parts"), F.sum("size").alias("size"), F.max(F.struct("n", "label", "size")).alias("most"))
        .where("parts > 1")
    )
    units = lambda size: F.greatest(F.lit(1), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    return several.select(
        "key", F.col("most.label").alias("main"), units(F.col("size")).alias("blocks"), units(F.col("size") - F.col("most.size")).alias("asking")
    )


def _settling(shared: DataFrame, labels: DataFrame, several: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between components that meet in the buckets ``several``."""
    spot = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    place = lambda ask, block, asks: F.struct(ask.alias("ask"), block.alias("block"), F.lit(asks).alias("asks"))
    # a member stands in its block before every block of askers, an asker in its own before every block of members
    stands = F.transform(F.sequence(F.lit(0), F.col("asking") - 1), lambda x: place(x, spot("blocks"), False))
    asks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: place(spot("asking"), x, True))
    dealt = (
        _large(shared, labels)
        .join(several, "key")
        .withColumn("at", F.explode(F.when(F.col("label") != F.col("main"), F.concat(stands, asks)).otherwise(stands)))
        .select("key", "at.ask", "at.block", "at.asks", "node", "label")
        .join(sets, "node")
        .select("key", "ask", "block", "asks", "node", "label", "shingles")
    )
    return (
        dealt.repartition("key", "ask", "block")
        .sortWithinPartitions("key", "ask", "block")
        .mapInArrow(_joining(num, den), "a long, b long")
        .distinct()
    )


def _joining(num: int, den: int):
    """Of each task (key, ask, block) the links that join components."""

    def compare(group: list[tuple]) -> tuple[list[int], list[int]]:
        asks = [g for g in group if g[3]]
        members = [g for g in group if not g[3]]
        a, b, root = [], [], {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        if not asks or not members:
            return a, b
        label_a, label_m = (np.array([g[5] for g in x]) for x in (asks, members))
        for i, k in _similar([g[6] for g in asks], [g[6] for g in members], label_a, label_m, find, num, den):
            x, y = find(int(label_a[i])), find(int(label_m[k]))
            if x != y:
                root[x] = y
                a.append(min(asks[i][4], members[k][4]))
                b.append(max(asks[i][4], members[k][4]))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def settle() -> pa.RecordBatch:
            a, b = compare(group)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            plain = zip(*[batch.column(i).to_pylist() for i in range(6)], strict=True)
            for row, value in zip(plain, batch.column(6), strict=True):
                if group and group[0][:3] != row[:3]:
                    yield settle()
                    group = []
                group.append((*row, np.frombuffer(value.as_buffer(), np.uint64)))
        if group:
            yield settle()

    return run


def _similar(
    one: list[np.ndarray], two: list[np.ndarray], label_a: np.ndarray, label_m: np.ndarray, find, num: int, den: int
) -> Iterator[tuple[int, int]]:
    """The pairs (place in ``one``, place in ``two``) of different components with ``den * intersection >= num * union``.

    ``find`` tells the components as they are when a run of pairs is looked at, so pairs that a link before has joined are left out.
    """
    n = len(one)
    sizes = np.array([len(s) for s in [*one, *two]], np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    _, token, often = np.unique(np.concatenate([*one, *two]), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    token = rank[token]
    by = np.lexsort((token, owner))
    owner, token = owner[by], token[by]
    first = np.cumsum(sizes) - sizes
    # sets that link share at least ceil(size * num / den) shingles, so one of the rarest of the others and one more
    prefix = np.arange(len(owner)) - first[owner] < (sizes - -(-sizes * num // den) + 1)[owner]
    asked, met = prefix & (owner < n), np.flatnonzero(prefix & (owner >= n))
    met = met[np.argsort(token[met], kind="stable")]
    probe = np.flatnonzero(asked)
    lo, hi = np.searchsorted(token[met], token[probe], "left"), np.searchsorted(token[met], token[probe], "right")
    cost = np.cumsum(hi - lo)
    width, keys = len(often), owner * np.int64(len(often)) + token  # ascending
    at = 0
    while at < len(probe):
        to = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + PAIRS, "right")))
        many = (hi - lo)[at:to]
        total = int(many.sum())
        x = np.repeat(owner[probe[at:to]], many)
        y = owner[met[np.repeat(lo[at:to] - np.cumsum(many) + many, many) + np.arange(total)]]
        at = to
        small, large = np.minimum(sizes[x], sizes[y]), np.maximum(sizes[x], sizes[y])
        fits = den * small >= num * large
        pairs = np.unique(x[fits] * np.int64(len(sizes)) + y[fits])
        x, y = pairs // len(sizes), pairs % len(sizes)
        step = max(1, COMPARED // max(1, int(sizes[:n].max())))
        for part in range(0, len(x), step):
            u, v = x[part : part + step], y[part : part + step]
            known = {k: find(k) for k in {*label_a[u].tolist(), *label_m[v - n].tolist()}}
            apart = np.array([known[p] != known[q] for p, q in zip(label_a[u].tolist(), label_m[v - n].tolist(), strict=True)], bool)
            u, v = u[apart], v[apart]
            if not len(u):
                continue
            upto = np.cumsum(sizes[u])
            own = token[np.repeat(first[u] - upto + sizes[u], sizes[u]) + np.arange(int(upto[-1]))]
            key = np.repeat(v, sizes[u]) * np.int64(width) + own
            spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            both = np.add.reduceat(keys[spot] == key, upto - sizes[u])
            linked = den * both >= num * (sizes[u] + sizes[v] - both)
            yield from zip(u[linked].tolist(), (v[linked] - n).tolist(), strict=True)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents")), shingle=2, num=80, den=100)


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, words[i] || chr(32) || words[i + 1] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words))) AS i FROM w)
  UNION ALL
  SELECT doc_id, words[1] FROM w WHERE len(words) = 1
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * shared >= 80 * (na.n + nb.n - shared)
), e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, root) AS (
  SELECT doc_id, doc_id FROM w UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.doc_id
), c AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""
