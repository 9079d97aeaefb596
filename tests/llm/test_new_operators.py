"""Fingerprints with BK-trees, phrases by Suffix-sigma and centroids by partial-distance search against brute-force versions."""

from __future__ import annotations

import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_operators import WORD, corpus, empty, frame

from tessera.llm import centroids, ngram_lm, phrases, simhash_dedup, warc_store

DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def rows():
    return corpus()


def components(codes, group, radius=3):
    """The first code of each one's component, by comparing all."""
    codes, group = np.asarray(codes, np.uint64), np.asarray(group)
    near = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= radius) & (group[:, None] == group[None, :])
    label = np.arange(len(codes))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


def fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    hashes = [xxhash.xxh64(" ".join(words[i : i + 3]).encode(), seed=42).intdigest() for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def expected_groups(rows):
    codes = [fingerprint(t) for _, t in rows]
    label = components(codes, [0] * len(codes))
    ids = collections.defaultdict(list)
    for (i, _), g in zip(rows, label, strict=True):
        if i is not None:
            ids[g].append(i)
    return sorted(((i, f"{c:016x}", min(ids[g], default=None)) for (i, _), c, g in zip(rows, codes, label, strict=True)), key=repr)


def test_simhash_equals_brute_force(spark, rows):
    more = rows + [(None, rows[0][1]), (None, None), (70, rows[20][1]), (70, "other words here"), (71, "Émile\x85two  three"), (72, "a" * 400_000 + " b c d")]
    found = simhash_dedup.near_duplicates(frame(spark, more))
    assert sorted(map(tuple, found.collect()), key=repr) == expected_groups(more)
    assert simhash_dedup.near_duplicates(empty(spark)).count() == 0


def test_simhash_links_near_fingerprints(spark):
    rng = random.Random(8)
    words = [rng.choice(["a", "b", "c", "d", "e"]) + str(rng.randrange(60)) for _ in range(400)]
    rows = [(i, " ".join(w if rng.random() > 0.003 else "X" for w in words)) for i in range(60, 0, -1)] + [(99, "Other words")]
    want = expected_groups(rows)
    codes = collections.defaultdict(set)
    for _, code, component in want:
        codes[component].add(code)
    assert max(map(len, codes.values())) > 5  # groups that only links between different fingerprints make
    assert sorted(map(tuple, simhash_dedup.near_duplicates(frame(spark, rows)).collect()), key=repr) == want


def test_long_text_in_slices():
    text = " ".join(random.Random(5).choices(["one", "two", "three", "four", "five"], k=40_000))
    assert simhash_dedup.fingerprint(text) == fingerprint(text)


def drifting_codes(n=60, seed=1):
    rng, out = random.Random(seed), []
    for _ in range(n):
        code = rng.getrandbits(64)
        for _ in range(rng.randint(1, 25)):
            out.append(code)
            for b in rng.sample(range(64), rng.randint(1, 6)):
                code ^= 1 << b
    return sorted(set(out))


@pytest.mark.parametrize("frontier", [1 << 21, 300, 1])
def test_forest(monkeypatch, frontier):
    monkeypatch.setattr(simhash_dedup, "FRONTIER", frontier)
    codes = np.array(drifting_codes(), np.uint64)
    np.random.default_rng(2).shuffle(codes)
    group = np.sort(np.random.default_rng(3).integers(0, 4, len(codes)))
    assert (simhash_dedup.Forest(codes, group).components(3) == components(codes, group)).all()


def test_dense_group_is_not_compared_in_pairs():
    # all codes of 12 bits in one shard: 4,096 nodes, one component, some 1.2 million links
    codes = np.arange(1 << 12, dtype=np.uint64) << np.uint64(20)
    assert (simhash_dedup.Forest(codes, np.zeros(len(codes), np.int64)).components(3) == 0).all()


def test_large_shards_are_cut(spark):
    codes = sorted({*drifting_codes(20), *(x << 20 for x in range(0, 300, 7))})
    signed = [(c - (1 << 64) if c >> 63 else c,) for c in codes]
    nodes = spark.createDataFrame(signed, "code long")
    parts = simhash_dedup.shards(nodes, 3, 8)
    assert len(parts) > 1
    merged = {c: c for (c,) in signed}

    def find(x):
        while merged[x] != x:
            x = merged[x]
        return x

    for part in parts:
        assert part.groupBy("mask", "value").count().agg(F.max("count")).first()[0] <= 8
        links = part.repartition("mask", "value").sortWithinPartitions("mask", "value", "code").mapInArrow(simhash_dedup._joined(3), "a long, b long")
        for r in links.collect():
            merged[find(r.a)] = find(r.b)
    mine, theirs = collections.defaultdict(set), collections.defaultdict(set)
    for c, g in zip(codes, components(codes, [0] * len(codes)), strict=True):
        theirs[g].add(c)
        mine[find(c - (1 << 64) if c >> 63 else c)].add(c)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_segments_share_one():
    for mask in (0, *simhash_dedup.segments(0, 4)):
        parts = simhash_dedup.segments(mask, 4)
        assert all(p & mask == mask for p in parts)
        union = 0
        for p in parts:
            union |= p
        assert union == (1 << 64) - 1


def expected_phrases(rows, top, least):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in [("und" if a is None else a, b) for a, b in rows]:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, min(4, len(w) - i) + 1):
                    f[(lang, *w[i : i + k])] += 1
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    covered = set()
    for p, a in candidates.items():
        for size in range(2, len(p) - 1):
            for i in range(1, len(p) - size + 1):
                sub = (p[0], *p[i : i + size])
                if 100 * a >= 80 * f[sub]:
                    covered.add(sub)
    by = collections.defaultdict(list)
    for p, a in candidates.items():
        if p not in covered:
            cuts = [(2000000 * a // (f[p[: k + 1]] + f[(p[0], *p[k + 1 :])]), k) for k in range(1, len(p) - 1)]
            score, k = min(cuts)
            by[p[0]].append((-score, -a, " ".join(p[1:]).encode(), f[p[: k + 1]], f[(p[0], *p[k + 1 :])]))
    out = []
    for lang, found in by.items():
        for rank, (score, a, text, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, text.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def test_one_order_is_counted_alone():
    words = np.arange(1, 50, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    block = {"words": words, "tokens": np.random.default_rng(1).integers(0, 49, 3000), "lengths": np.array([1, 2, 1997, 1000])}
    every = list(ngram_lm._grams(block, 3))
    for n in (1, 2, 3):
        (alone,) = ngram_lm._grams(block, n, n)
        assert all((x == y).all() for x, y in zip(alone, every[n - 1], strict=True))


def test_rare_words_are_not_shuffled():
    import pyarrow as pa

    texts = ["new york " * 5 + f"rare{i} new averyveryverylongword{i % 2}" for i in range(40)] + ["rare1 alone", None]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(texts)), pa.array(texts)], names=["lang", "text"])
    slices = sorted(phrases._pair_tables(20, 4, 15)(iter([batch])), key=lambda b: b.column(0)[0].as_py())
    known = np.zeros(1 << 17, np.uint8)
    for b in phrases._frequent_places(15)(iter(slices)):
        at, bits = b.column(0)[0].as_py() >> 3, np.frombuffer(b.column(1)[0].as_py(), np.uint8)
        known[at : at + len(bits)] = bits
    broadcast = type("Broadcast", (), {"value": known.tobytes()})
    found = [r for b in phrases._suffixes(broadcast, 20, 4)(iter([batch])) for r in b.to_pylist()]
    single = {r["suffix"]: r["n"] for r in found if r["suffix"].count(b" ") == 1}
    assert single.keys() == {b"york ", b"averyveryverylongword0 ", b"averyveryverylongword1 "}  # before, every rare word came too
    assert sum(r["n"] for r in found if not r["suffix"]) == 40 * 13 + 2  # and all words count


def phrase_rows():
    rng = random.Random(4)
    words = ["of", "the", "and", "New", "York", "city", "hall", "a\x01", "a", "naïve", "x" * 40, "été"]
    weights = [9, 9, 7, 3, 3, 3, 2, 2, 4, 2, 1, 1]
    out = []
    for i in range(160):
        text = "".join(w + rng.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\r\n", "!?"]) for w in rng.choices(words, weights, k=rng.randint(1, 90)))
        out.append((rng.choice(["en", "en", None, "", "de"]), text + " new york city hall" * (i % 3)))
    return out + [("en", None), ("en", ""), (None, " \n.,"), ("fr", "of the " * 20_000), ("en", "the the the the the")]


@pytest.mark.parametrize(("bits", "run"), [(25, 8 << 20), (16, 300)])
def test_phrases_equal_brute_force(spark, monkeypatch, bits, run):
    monkeypatch.setattr(phrases, "RUN_BYTES", run)
    rows = phrase_rows()
    docs = spark.createDataFrame([(a, b, "k", 1, 2, "s") for a, b in rows], "lang string, text string, phrase string, n long, f long, suffix string").repartition(5)
    found = phrases.collocations(docs, top=40, min_count=30, sketch_bits=bits)
    assert sorted(map(tuple, found.collect())) == expected_phrases(rows, 40, 30)
    assert phrases.collocations(docs.where("false")).count() == 0


def test_prefix_counts_over_ranges(spark):
    # every row its own range: all that a range passes on is merged to the right sums
    rows = [("en", f"a b{i} ".encode(), 1) for i in range(40)] + [("en", b"a ", 5), ("en", b"a\x01 b ", 3)]
    table = spark.createDataFrame(rows, "lang string, suffix binary, n long").repartition(7).sortWithinPartitions(F.desc("lang"), F.desc("suffix"))
    parts = table.mapInArrow(phrases._prefix_counts(4, 30), "lang string, phrase binary, n long")
    found = {bytes(r.phrase): r.n for r in parts.groupBy("phrase").agg(F.sum("n").alias("n")).collect()}
    assert found[b"a "] == 45 and found[b"a\x01 "] == 3


def test_equal_suffixes_of_several_runs_are_one_row(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(phrases, "RUN_BYTES", 100)
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "de"] * 100), pa.array(["of the city hall, of the\n"] * 200)], names=["lang", "text"])
    broadcast = type("Broadcast", (), {"value": b"\xff" * (1 << 13)})
    found = collections.Counter()
    for b in phrases._suffixes(broadcast, 16, 4)(iter([batch])):
        for r in b.to_pylist():
            assert not r["suffix"] or (r["lang"], r["suffix"]) not in found  # before, a row for each run
            found[r["lang"], r["suffix"]] += r["n"]
    once = {b"of the city hall ": 100, b"the city hall ": 100, b"city hall ": 100, b"hall ": 100, b"of the ": 100, b"the ": 100, b"": 600}
    assert found == {(lang, k): n for lang in ("en", "de") for k, n in once.items()}


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
@pytest.mark.parametrize("bits", [0, 2, 20])
def test_prefix_counts_in_any_batches(size, bits):
    """Codes of few bits let first words lie between each other: their counts are passed on in parts, and nothing is lost."""
    import pyarrow as pa

    rng = random.Random(size)
    suffixes = collections.Counter()
    for _ in range(3000):
        suffixes[rng.choice(["en", "de", ""]), b"".join(rng.choice([b"a ", b"b ", "é ".encode(), b"a\x01 ", b"abc "]) for _ in range(rng.randint(1, 4)))] += rng.randint(1, 3)
    want = collections.Counter()
    for (lang, suffix), n in suffixes.items():
        words = suffix.split(b" ")[:-1]
        for d in range(len(words)):
            want[lang, b"".join(w + b" " for w in words[: d + 1])] += n

    def code(lang, suffix):
        first, second = (suffix.split(b" ") + [b""])[:2]
        return (zlib.crc32(lang.encode() + first) & ((1 << bits) - 1)) << 16 | zlib.crc32(second) & 1

    rows = sorted(((code(*k), *k, n) for k, n in suffixes.items()), key=lambda r: (r[0], [-x for x in r[1].encode()] + [1], [-x for x in r[2]] + [1]))
    whole = pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows], pa.binary()), *(pa.array([r[i] for r in rows], pa.int64()) for i in (3, 0))], names=["lang", "suffix", "n", "code"])
    found = collections.Counter()
    for b in phrases._prefix_counts(4, 30)(whole.slice(i, size) for i in range(0, len(rows), size)):
        for r in b.to_pylist():
            found[r["lang"], r["phrase"]] += r["n"]
    assert {k: n for k, n in found.items() if n >= 30} == {k: n for k, n in want.items() if n >= 30}


def expected_clusters(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), n) for n, x in enumerate(c))

    for _ in range(rounds):
        of = [nearest(v)[1] for _, v in kept]
        for n in range(len(c)):
            own = [v for (_, v), g in zip(kept, of, strict=True) if g == n]
            if own:
                c[n] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [nearest(v) for _, v in kept]
    inertia = collections.Counter()
    for d, n in last:
        inertia[n] += d
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), digest[n]) for (i, _), (d, n) in zip(kept, last, strict=True)), key=repr)


def vector_rows(n=150, seed=6):
    rng = random.Random(seed)
    f32 = lambda x: float(np.float32(x))
    out = [(i, [f32(rng.gauss(i % 5, 1 + (j % 7))) for j in range(64)]) for i in range(n)]
    out += [(n, None), (n + 1, []), (n + 2, [1.0] * 63), (n + 3, [None] + [1.0] * 63), (n + 4, [float("nan")] * 64), (n + 5, [float("inf")] + [0.0] * 63)]
    return out + [(3, out[3][1]), (3, out[4][1]), (None, out[7][1]), (None, [f32(0.1)] * 64), (n + 6, [0.0] * 64), (n + 7, [0.0] * 64)]


VECTORS = "vec_id long, embedding array<float>, cluster string, distance int, n int, v int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "c", 1, 2, 3) for i, v in rows], VECTORS).repartition(4)


def test_clusters_equal_brute_force(spark):
    rows = vector_rows()
    assert sorted(map(tuple, centroids.clusters(vectors(spark, rows)).collect()), key=repr) == expected_clusters(rows)


@pytest.mark.parametrize("n", [1, 9])
def test_fewer_vectors_than_centroids(spark, n):
    rows = vector_rows()[:n] + [(500, [1e6] * 64)]
    assert sorted(map(tuple, centroids.clusters(vectors(spark, rows)).collect()), key=repr) == expected_clusters(rows)


def test_large_components(spark):
    rows = vector_rows(30) + [(600, [3e6 if j % 2 else -3e6 for j in range(64)]), (601, [2.0**22] * 64)]
    assert sorted(map(tuple, centroids.clusters(vectors(spark, rows), k=4).collect()), key=repr) == expected_clusters(rows, k=4)


def test_no_vectors(spark):
    assert centroids.clusters(vectors(spark, [(1, None)])).count() == 0


def test_partial_distances_keep_ties():
    v = np.array([[0] * 16, [1] * 16], np.int64)
    c = np.array([[1] * 16, [-1] * 16, [1] * 16], np.int64)
    number, distance = centroids.nearest(v, c, np.arange(16), step=4)
    assert number.tolist() == [0, 0] and distance.tolist() == [16, 0]


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize(("query", "sql"), [(warc_store.op2_warc, warc_store.OP2_SQL), (phrases.op12_phrases, phrases.OP12_SQL), (centroids.op13_centroids, centroids.OP13_SQL)])
def test_queries_equal_sql(spark, query, sql):
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    found = query(spark, DIR)
    cursor = con.execute(sql)
    names = [x[0] for x in cursor.description]
    assert sorted(map(tuple, found.select(*names).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)


@pytest.mark.parametrize("longest", [3, 7, 4096])
def test_automaton_in_segments(longest):
    """Bigram states: each text's sum equals a walk of its own, wherever it is cut."""
    rng = np.random.default_rng(longest)
    n_words, lengths = 6, np.array([1, 40, 0, 13, 7, 90])
    pairs = np.array([(s, w) for s in range(1, n_words) for w in range(n_words) if rng.random() < 0.5])
    root_p, weight, log_p = rng.normal(-2, 1, n_words), np.append(0, rng.normal(-1, 1, n_words - 1)), rng.normal(-1, 1, len(pairs))
    root_target = np.arange(n_words)  # the last word is known but no context: 0 stands for the root there
    machine = ngram_lm.Automaton(np.zeros(n_words, np.int64), weight, pairs[:, 0], pairs[:, 1], log_p, root_target[pairs[:, 1]], root_p, root_target)
    arcs = {tuple(p): v for p, v in zip(pairs.tolist(), log_p, strict=True)}
    words, want, at = rng.integers(0, n_words, lengths.sum()), [], 0
    for n in lengths:
        state, total = 0, 0.0
        for w in words[at : at + n].tolist():
            total += arcs[state, w] if (state, w) in arcs else weight[state] + root_p[w]
            state = w
        at += n
        want.append(total)
    assert np.allclose(machine.score(words, lengths, 1, longest), want)


def test_sums_of_contexts_are_small_whole_numbers():
    """Fractions took 16 bytes a context on the way to the buckets and 8 on the way back."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    words = rng.integers(1, 1 << 63, 60, dtype=np.uint64)
    block = {"block": 7, "words": words, "tokens": np.append(rng.zipf(1.5, 20000) % 60, np.arange(60)), "lengths": np.array([12000, 8060])}
    answers = []
    for n, (keys, _, place) in enumerate(ngram_lm._grams(block, 3), 1):
        count = np.bincount(place)
        kept = count * (count >= (2 if n > 1 else 1))
        rows = pa.Table.from_batches([ngram_lm._dealt(7, keys, 6, count)])
        answers.append(ngram_lm._answers(rows, rows.column("size").to_numpy(), n, 2 * kept + (kept > 0), 0, 0))
    made = ngram_lm.Block(block, 3, pa.concat_tables(answers), 20060, 60)
    text, cut = block["tokens"].tolist(), {12000}
    grams = [collections.Counter(tuple(text[i - n + 1 : i + 1]) for i in range(n - 1, len(text)) if not cut & set(range(i - n + 2, i + 1))) for n in (1, 2, 3)]
    c = {g: k for n, counts in enumerate(grams) for g, k in counts.items() if k > 1 or n == 0}
    total = 20060 + 0.1 * 61
    p = lambda g: (c[g] + 0.1) / total if len(g) == 1 else (c[g] - 0.5) / c[g[:-1]]
    for n in (2, 3):
        keys, mass, below = made.sums(n)
        assert mass.dtype == below.dtype == np.int64
        assert len(ngram_lm._packed(mass)) + len(ngram_lm._packed(below)) < 4 * len(keys) + 200
        rows = pa.Table.from_batches([ngram_lm._dealt(7, keys, 6, mass, below)])
        each = [ngram_lm._weighed(rows.filter(pa.compute.equal(rows.column("bucket"), b)), -n) for b in set(rows.column("bucket").to_pylist())]
        weights = made.weights(n, pa.concat_tables(each))
        at = made.last(n - 1)[made.contexts(n)]
        for weight, i in zip(weights.tolist(), at.tolist(), strict=True):
            context = tuple(text[i - n + 2 : i + 1])
            arcs = [g for g in c if len(g) == n and g[:-1] == context]
            want = (1 - sum(map(p, arcs))) / (1 - sum(p(g[1:]) for g in arcs))
            assert weight == pytest.approx(np.log10(want), abs=1e-9)
