"""Each operator against a brute-force version, with the edge cases that its docstring defines."""

from __future__ import annotations

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import (
    bwt_dedup,
    decontaminate,
    near_dedup,
    ngram_lm,
    packing,
    pii,
    quality_rules,
    repeats,
    substring_dedup,
    token_archive,
    tokens,
    warc_store,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, key string, n long, piece long, rid long, label int, part int, words string, keys string"


def vocabulary(n=400, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdeflmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def corpus(seed=1, n=60):
    """Random texts, exact and near copies, shared passages, nulls, empties, odd white space, one long text."""
    rng, words = random.Random(seed), vocabulary()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 160))) for _ in range(n)]
    passage = " ".join(rng.choice(words) for _ in range(90))
    for i in range(0, n, 7):
        texts[i] = texts[i] + "\n" + passage + " " + rng.choice(words)
    for i in range(3, n, 9):
        near = texts[i - 1].split()
        if len(near) > 3:
            near[rng.randrange(len(near))] = "changed"
        texts[i] = " ".join(near)
    texts[5] = texts[4]
    texts[6] = texts[4]
    texts[10], texts[11], texts[12], texts[13] = None, "", " \t\n ", "word"
    texts[14] = "Ha " * 300
    texts[15] = "a" * 2000
    texts[16] = "naïve café　 x  y \x1c z\r\n\x0b\x0c tail  "
    texts[17] = " ".join(rng.choice(words) for _ in range(6000))
    texts[18] = "one  <|endoftext|> two<|endoftext|>"
    return list(enumerate(texts))


def frame(spark, rows):
    """The rows with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "k", 1, 2, 3, 4, 5, "w", "ks") for i, t in rows], SCHEMA).repartition(4)


def empty(spark):
    return frame(spark, [(0, "x")]).where("false")


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).persist()


def lower(raw: bytes) -> bytes:
    return raw.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))


def shingle_set(text, k):
    w = lower((text or "").encode()).split()
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(rows, k, num, den):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingle_set(t, k)) for i, t in rows]
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                r, q = find(sets[a][0]), find(sets[b][0])
                parent[max(r, q)] = min(r, q)
    return {i: find(i) for i, _ in rows}, dict(sets)


@pytest.mark.parametrize(("k", "num", "den"), [(2, 80, 100), (5, 4, 5)])
def test_near_duplicates(docs, rows, k, num, den):
    want, sets = components(rows, k, num, den)
    got = near_dedup.near_duplicates(docs, shingle=k, num=num, den=den).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {
        (i, len(sets[i]), c, c == i) for i, c in want.items()
    }


def test_near_duplicates_large_buckets(spark, monkeypatch):
    """A family of near copies, some linked only through others, with tiny buckets, blocks and runs of pairs."""
    monkeypatch.setattr(near_dedup, "SMALL_BUCKET", 2)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 1000)
    monkeypatch.setattr(near_dedup, "PAIRS", 50)
    monkeypatch.setattr(near_dedup, "COMPARED", 300)
    rng, words = random.Random(5), vocabulary()
    base = [rng.choice(words) for _ in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(3, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    want, _ = components(rows, 2, 80, 100)
    got = near_dedup.near_duplicates(frame(spark, rows), shingle=2, num=80, den=100).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_near_duplicates_nulls_and_empty(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)]
    got = sorted(tuple(r) for r in near_dedup.near_duplicates(frame(spark, rows)).select(F.coalesce("doc_id", F.lit(-1)), "component_id", "kept").collect())
    assert got == [(-1, 1, False), (1, 1, True), (1, 1, True), (2, 2, True)]
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_near_duplicates_equal_ids_of_different_texts(spark):
    rng, words = random.Random(6), vocabulary()
    one, two = ([rng.choice(words) for _ in range(60)] for _ in range(2))
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, " ".join([*one, "x"])), (3, " ".join([*two, "x"])), (None, " ".join([*one, "y"])), (4, "\t")]
    got = near_dedup.near_duplicates(frame(spark, rows), shingle=2, num=80, den=100).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in got) == [
        (0, 1, False), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)
    ]


def test_near_duplicates_long_texts(spark):
    rng = random.Random(7)
    w = [f"w{rng.randrange(10**6)}" for _ in range(100_000)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:-9000], *(f"v{i}" for i in range(9000))])), (3, " ".join(reversed(w))), (4, "a " * 300_000), (5, "a " * 299_999)]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, rows), shingle=2, num=80, den=100).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}


def test_joining_leaves_no_link_out():
    """Links within one task against all pairs: the components are the same, and a link at most for each merge."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**62, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(60) < 0.92], rng.integers(0, 2**62, 5).astype(np.uint64)])) for _ in range(80)]
    asks = [i % 2 == 0 for i in range(80)]
    rows = [(1, 0, 0, False, i, i, s.tobytes()) for i, s in enumerate(sets)] + [(1, 0, 0, True, i, i, s.tobytes()) for i, s in enumerate(sets) if asks[i]]
    names = ["key", "ask", "block", "asks", "node", "label", "shingles"]
    batch = pa.RecordBatch.from_pydict({n: [r[k] for r in rows] for k, n in enumerate(names)})
    links = [x for b in near_dedup._joining(80, 100)(iter([batch])) for x in zip(*b.to_pydict().values(), strict=True)]
    full = [(a, b) for a in range(80) for b in range(80) if a != b and asks[a] and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]

    def groups(pairs):
        root = list(range(80))
        for _ in range(80):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert set(links) <= {(min(x), max(x)) for x in full} and len(links) < 80 and groups(links) == groups(full)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 500).astype(np.uint64)
    b = np.concatenate([a[:400], rng.integers(0, 2**63, 100).astype(np.uint64)])
    s = near_dedup.super_min_hash([np.unique(a), np.unique(b), np.unique(a[:3])], 256)
    assert abs((s[0] == s[1]).mean() - 400 / 600) < 0.12
    assert (s < np.iinfo(np.uint64).max).all()


def test_archive_round_trip(spark, tmp_path):
    rows = [(3, "u3", "<p>ä</p>"), (1, "u\r\n1", "<p>ä</p>"), (2, None, None), (7, "u7", ""), (5, "u5", "a\r\n\r\nb"), (6, "u", "<p>ä</p>")]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, header string, payload long")
    path = f"file://{tmp_path}/archive"
    warc_store.write_archive(pages, path)
    got = {r["record_key"]: r for r in warc_store.read_archive(spark, path).collect()}
    assert len(got) == 6 and spark.read.parquet(f"{path}/payloads").count() == 3
    for i, _, html in rows:
        payload, r = (html or "").encode(), got[str(i)]
        assert bytes(r["payload"]) == payload
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        first = min(k for k, _, h in rows if (h or "") == (html or ""))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == i else ("revisit", str(first)))
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        body = payload if first == i else b""
        assert rest == body + b"\r\n\r\n" and f"Content-Length: {len(body)}".encode() in head.split(b"\r\n")
    warc_store.write_archive(pages.where("false"), f"{path}-empty")
    assert warc_store.read_archive(spark, f"{path}-empty").count() == 0


def test_archive_null_and_equal_keys(spark, tmp_path):
    rows = [(None, "u", "a"), (2, "v", "a"), (1, "w", "b"), (1, "w", "b"), (None, "x", "c"), (3, "y", "z" * 3_000_000), (4, "y", "z" * 3_000_000)]
    path = f"file://{tmp_path}/keys"
    warc_store.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = sorted((r["record_key"] or "", r["record_type"], r["refers_to"] or "", len(r["payload"])) for r in warc_store.read_archive(spark, path).collect())
    assert got == [
        ("", "response", "", 1), ("", "revisit", "2", 1), ("1", "response", "", 1), ("1", "response", "", 1),
        ("2", "response", "", 1), ("3", "response", "", 3_000_000), ("4", "revisit", "3", 3_000_000),
    ]


def test_damaged_archive_is_an_error(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    warc_store.write_archive(spark.createDataFrame([(1, "u", "abc")], "page_id long, url string, html string"), path)
    bad = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.encode(F.lit("xyz"), "UTF-8")).collect()
    spark.createDataFrame(bad, "payload_sha256 string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="differs from its digest"):
        warc_store.read_archive(spark, path).collect()


@pytest.fixture(scope="module")
def library():
    """The library on its own, as the contract names it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path(tokens.DEFAULT_TOKENIZER))


@pytest.fixture(scope="module")
def ids(rows, library):
    return {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}


def test_units_equal_whole_texts(library):
    import pyarrow as pa

    enc, rng = tokens.UnitEncoder(), random.Random(2)
    parts = [" ", "  ", "\n", "\t", "a", "é", "'s", "1", ".", "\xa0", "　", "\x85", "\x1c", "中", "<|endoftext|>", "​", " ", " ab", "«"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [None]
    got = [ids[a:b].tolist() for _, ids, off in enc.encode(pa.array(texts)) for a, b in zip(off[:-1], off[1:], strict=True)]
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    found = list(enc.encode(pa.array(["a", "abc <|endoftext|> def", "b <|endo", "ftext|>"])))
    assert found[0][1].tolist() == [x for t in ("a", "abc <|endoftext|> def", "b <|endo", "ftext|>") for x in library.encode(t, add_special_tokens=False).ids]


def test_packing_holds_little(library):
    """With 4 MB at a time the peak was over 200 MB; workers stay, and an executor has two."""
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(3)
    words = [f"w{rng.randrange(30_000)}" for _ in range(700_000)]
    texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
    enc = tokens.UnitEncoder(max_cached=packing.CACHED)
    tracemalloc.start()
    found = [(lo, np.diff(off)) for lo, _, off in enc.encode(pa.array(texts), packing.ENCODED_BYTES)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 110 << 20
    assert np.concatenate([n for _, n in found])[::100].tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts[::100]]


def test_units_are_forgotten_and_learned_again(library):
    import pyarrow as pa

    enc = tokens.UnitEncoder(max_cached=50)
    texts = [f"one {i} two {i % 7} three{i}" for i in range(300)]
    got = [ids[a:b].tolist() for _, ids, off in enc.encode(pa.array(texts), 200) for a, b in zip(off[:-1], off[1:], strict=True)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_archive(spark, docs, rows, ids, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_archive.write_archive(docs, path, block_tokens=500, lanes=16)
    got = {r["doc_id"]: r for r in token_archive.read_archive(spark, path).collect()}
    start = 0
    for i, _ in rows:
        want = np.array(ids[i], "<u4")
        assert got[i]["start"] == start and got[i]["n_tokens"] == len(want)
        assert bytes(got[i]["ids"]) == want.tobytes() and got[i]["ids_crc32"] == zlib.crc32(want)
        start += len(want)
    token_archive.write_archive(empty(spark), f"{path}-empty")
    assert token_archive.read_archive(spark, f"{path}-empty").count() == 0
    twice = frame(spark, [(1, "b"), (None, "c"), (1, "a")])
    token_archive.write_archive(twice, f"{path}-twice")
    got = token_archive.read_archive(spark, f"{path}-twice").collect()
    assert sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in got) == [(0, None, 2), (2, 1, 2), (4, 1, 2)]  # null ids first


def test_coder_segments_and_damage():
    rng = np.random.default_rng(3)
    ids = (rng.zipf(1.4, 5003) % 700).astype(np.uint16)
    freq = token_archive.quantize(np.bincount(ids), 16)
    assert freq.sum() == 1 << 16 and (freq[np.unique(ids)] > 0).all()
    coder = token_archive.Coder(freq, 16)
    block = coder.encode(ids, lanes=32, segment=20)
    assert np.array_equal(coder.decode(block), ids)
    assert np.array_equal(coder.decode_segment(block, 3), ids[3 * 640 : 4 * 640])  # from a checkpoint, alone
    assert len(block["words"]) < 2 * len(ids)
    broken = block | {"words": block["words"][:8] + bytes([block["words"][8] ^ 255]) + block["words"][9:]}
    with pytest.raises(ValueError, match="damaged"):
        coder.decode(broken)
    assert coder.decode(coder.encode(ids[:0])).size == 0


def test_packing(spark, docs, rows, ids):
    width = 64
    got = packing.pack(docs, width=width).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4")) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    assert len(by_doc) == len(rows)
    for parts, total in [(by_doc[i], len(ids[i])) for i, _ in rows] + [(p, None) for p in by_seq.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == total if total else 0 < at <= width
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert packing.pack(empty(spark)).count() == 0
    twice = packing.pack(frame(spark, [(1, "b"), (None, "c"), (1, "a"), (2, None)])).collect()
    assert sorted((r["offset"], r["length"]) for r in twice) == [(0, 2), (2, 2), (4, 2), (6, 1)] and len({r["sequence_id"] for r in twice}) == 1


def test_shortest_pack_first_places_all():
    rng = random.Random(1)
    histogram = {n: rng.randint(1, 500) for n in rng.sample(range(1, 1024), 300)}
    patterns = packing.shortest_pack_first(histogram, 1024)
    placed = collections.Counter()
    for pattern, count in patterns:
        assert sum(n * k for n, k in pattern.items()) <= 1024
        for n, k in pattern.items():
            placed[n] += k * count
    assert placed == histogram
    used = sum(n * c for n, c in histogram.items())
    assert used / (1024 * sum(c for _, c in patterns)) > 0.95
    assert sum(c for _, c in packing.shortest_pack_first({100: 1000}, 1024)) == 100


def base_counts(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, covered = collections.Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, docs, rows):
    extra = [*rows, (900, "l1\nl1\n \nl2 #*|\nl1"), (901, "😀 é ß"), (None, None)]
    got = quality_rules.text_features(frame(spark, extra)).collect()
    assert {(r["doc_id"], *[r[c] for c in quality_rules.BASE_COUNTS]) for r in got} == {(i, *base_counts(t)) for i, t in extra}


def test_quality_long_texts(spark):
    rows = [(1, " " * 1_000_000 + "x"), (2, "w v " * 400_000), (3, "\n" * 500_000), (3, "y" * 1_000_000), (3, None)]
    got = quality_rules.text_features(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], *[r[c] for c in quality_rules.BASE_COUNTS]) for r in got) == sorted((i, *base_counts(t)) for i, t in rows)


def test_quality_learns_and_holds_out(spark):
    rng, words = random.Random(8), vocabulary()
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(80)]
        if i % 4 == 0:
            w = [x + "%%%" for x in w] if i % 8 else [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, 0 if i % 4 == 0 else 1, 0))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(frame(spark, rows), table.where("doc_id < 200")).collect()}
    held = range(200, 400)
    assert sum(got[i] == (i % 4 != 0) for i in held) / len(held) > 0.97
    # without labels only the base rule decides; labels may be null
    none = quality_rules.judge(frame(spark, rows), table.where("false"))
    assert none.where("kept <> (not base_failed)").count() == 0
    assert quality_rules.judge(empty(spark), table).count() == 0
    assert quality_rules.judge(frame(spark, rows[:5]), table.withColumn("quality", F.lit(None).cast("int"))).count() == 5


PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(d):
    n = [int(c) for c in reversed(d)]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(n)) % 10 == 0


def base_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if [True, k != 1 or all(int(x) <= 255 for x in m.group().split(".")), 12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15][k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_base_spans(spark):
    rng = random.Random(2)
    parts = ["a@b.c", "%foo@bar.com", "_d@e.f", "a@b", "1.2.3.4", ".5.6.7.8", "256.1.1.1", "0255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112",
             "+1 (990) 555-2115", "+", "é", "\n", " ", "-", "12", ".", "@", "🎉", "\x00"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(1500)]
    rows += [(5000, None), (5001, ""), (5002, "1 " * 20000), (5003, "a" * 50000 + "@"), (5004, "+" + "1(" * 20000)]
    got = pii.detect(frame(spark, rows)).collect()
    texts = dict(rows)
    for r in got:
        want = base_spans(texts[r["doc_id"]])
        assert [tuple(x) for x in r["base"]] == want
        assert [r[f"n_{k}"] for k in pii.KINDS[:4]] == [sum(x[1] == k for x in want) for k in range(4)]
        assert {tuple(x) for x in r["base"]} <= {tuple(x) for x in r["spans"]}
    assert len(got) == len(rows)
    assert pii.detect(empty(spark)).count() == 0


def test_pii_learns_secrets_and_redacts(spark):
    rng, words = random.Random(4), vocabulary()
    rows = []
    for i in range(120):
        t = [rng.choice(words) for _ in range(30)]
        if i % 3 == 0:
            t[10] = 'token = "' + hashlib.sha1(str(i).encode()).hexdigest() + '"'
        if i % 5 == 0:
            t[20] = f"invoice-number-{i:08d}"
        rows.append((i, " ".join(t) + " é a.b@c.de"))
    df = frame(spark, rows)
    got = pii.detect(df, "doc_id", "text", "text").withColumn("clean", pii.redacted(F.col("text"), F.col("spans"))).collect()
    found = {r["doc_id"]: [tuple(x) for x in r["spans"] if x["k"] == 4] for r in got}
    want = {i: [(m.start(1), 4, m.end(1)) for m in re.finditer(r'"([0-9a-f]{40})"', t)] for i, t in rows}
    assert sum(found[i] == want[i] for i in want) / len(want) > 0.95
    for r in got:
        assert "@" not in r["clean"] and r["clean"].endswith("é [EMAIL]")


def test_pii_long_and_equal_texts(spark):
    """A megabyte of matches, and equal ids: linear in a text, and every row of its own."""
    many = "a.b@c.de " * 110_000
    rows = [(1, many), (2, "+1 (990) 555-2115 " * 20_000), (3, "x" * 1_000_000), (3, "me@b.org"), (3, None)]
    df = pii.detect(frame(spark, rows), "doc_id", "text", "text").withColumn("clean", pii.redacted(F.col("text"), F.col("spans")))
    got = sorted(df.select("doc_id", "n_email", "n_phone", F.crc32("clean"), F.get("base", F.size("base") - 1)["e"]).collect(), key=lambda r: (r[0], r[1], r[3] or 0))
    crc = lambda t: zlib.crc32(t.encode())
    assert [tuple(r) for r in got] == [
        (1, 110_000, 0, crc("[EMAIL] " * 110_000), 989_999), (2, 0, 20_000, crc("[PHONE] " * 20_000), 359_999),
        (3, 0, 0, None, None), (3, 0, 0, crc("x" * 1_000_000), None), (3, 1, 0, crc("[EMAIL]"), 8),
    ]


def test_pii_redaction_of_overlapping_spans(spark):
    rng, rows = random.Random(5), []
    for i in range(200):
        text = "".join(rng.choice("abé🎉 ") for _ in range(rng.randint(0, 3000)))
        spans = sorted((a, rng.randrange(5), rng.randint(a + 1, min(len(text), a + 900))) for a in (rng.randrange(len(text)) for _ in range(rng.randint(0, 600) if text else 0)))
        rows.append((i, text, spans))
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<s:int,k:int,e:int>>")
    for r in df.withColumn("clean", pii.redacted(F.col("text"), F.col("spans"))).collect():
        want, end = "", 0
        runs = []
        for s, k, e in r["spans"]:
            if runs and s < runs[-1][2]:
                runs[-1][2] = max(runs[-1][2], e)
            else:
                runs.append([s, k, e])
        for s, k, e in runs:
            want, end = want + r["text"][end:s] + f"[{pii.KINDS[k].upper()}]", e
        assert r["clean"] == want + r["text"][end:]


def test_expectation_maximisation_finds_the_bad_labeler():
    rng, counts = random.Random(3), collections.Counter()
    for _ in range(4000):
        y = rng.random() < 0.3
        vote = lambda acc: (1 if y else -1) if rng.random() < acc else (-1 if y else 1)  # noqa: B023, E731
        counts[(vote(0.95), vote(0.9), vote(0.55))] += 1
    prior, rates, post = pii.expectation_maximisation(sorted(counts.items()))
    assert abs(prior - 0.3) < 0.05
    assert rates[0][1][1] > 0.85 and rates[2][1][1] < 0.7
    assert post[(1, 1, -1)] > 0.9 and post[(-1, -1, 1)] < 0.1
    assert pii.expectation_maximisation([])[2] == {}


def repeated_words(rows, window):
    count, split = collections.Counter(), {i: (t or "").encode().split() for i, t in rows}
    for w in split.values():
        count.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = {}
    for i, w in split.items():
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if count[tuple(w[j : j + window])] > 1:
                gone[j : j + window] = [True] * window
        kept = b" ".join(a for a, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


LIMITS = pytest.mark.parametrize(("heavy", "wide"), [(4096, 8192), (1, 8192), (1, 1)])


@LIMITS
def test_substring_dedup(docs, rows, heavy, wide, monkeypatch):
    monkeypatch.setattr(repeats, "HEAVY", heavy)
    monkeypatch.setattr(repeats, "WIDE", wide)
    got = substring_dedup.remove_repeats(docs).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got} == repeated_words(rows, 35)


@LIMITS
def test_bwt_dedup(spark, docs, rows, heavy, wide, monkeypatch):
    monkeypatch.setattr(repeats, "HEAVY", heavy)
    monkeypatch.setattr(repeats, "WIDE", wide)
    window, texts, count = 400, {i: (t or "").encode() for i, t in rows}, collections.Counter()
    for t in texts.values():
        count.update(t[i : i + window] for i in range(len(t) - window + 1))
    want = {}
    for i, t in texts.items():
        gone = [False] * len(t)
        for j in range(len(t) - window + 1):
            if count[t[j : j + window]] > 1:
                gone[j : j + window] = [True] * window
        kept = bytes(a for a, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        want[i] = (len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    got = bwt_dedup.remove_repeats(docs).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want


def test_repeats_edges(spark):
    long = " ".join(vocabulary(50))
    got = substring_dedup.remove_repeats(frame(spark, [(None, long), (1, long), (1, long), (2, "x")])).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 50, 50, 50]
    assert substring_dedup.remove_repeats(empty(spark)).count() == 0
    assert bwt_dedup.remove_repeats(empty(spark)).count() == 0


def test_engines_agree_with_counting():
    rng = random.Random(4)
    for trial in range(80):
        window, step = rng.choice([(8, 2), (12, 3), (8, 4), (6, 6)])
        alphabet = b"ab" if trial % 2 else b"abcd"
        texts = [np.array([rng.choice(alphabet) for _ in range(rng.randint(window, 40))], np.uint8) for _ in range(rng.randint(1, 9))]
        count = collections.Counter(t[i : i + window].tobytes() for t in texts for i in range(len(t) - window + 1))
        want = [[count[t[i : i + window].tobytes()] > 1 for i in range(len(t) - window + 1)] for t in texts]
        assert [x.tolist() for x in bwt_dedup.bwt_engine(window, step, rng.choice([1, 2, 3]))(texts)] == want
        assert [x.tolist() for x in substring_dedup.suffix_tree_engine(window)(texts)] == want


def test_subtree_nodes_are_maximal_repeats():
    rng = random.Random(5)
    for _ in range(60):
        texts = [np.array([rng.choice(b"ab") for _ in range(rng.randint(1, 30))], np.uint8) for _ in range(rng.randint(1, 6))]
        tree, flat, at = substring_dedup.Subtree(texts), [], 0
        for t in texts:
            flat += [t[k:].tobytes() for k in range(len(t))]
        assert [flat[k] for k in tree.order] == sorted(flat)
        places = {depth: {frozenset(leaves.tolist()): size for size, leaves in tree.nodes(depth)} for depth in (3, 5)}
        for depth, nodes in places.items():
            by = collections.defaultdict(set)
            for k, s in enumerate(flat):
                if len(s) >= depth:
                    by[s[:depth]].add(k)
            assert set(nodes) == {frozenset(v) for v in by.values() if len(v) > 1}
            for leaves, size in nodes.items():
                assert len({flat[k][:size] for k in leaves}) == 1
                assert len({flat[k][: size + 1] for k in leaves}) > 1 or any(len(flat[k]) == size for k in leaves)


def test_merge_orders_shards_and_gives_common_prefixes():
    """Interleave and common prefixes of two shards of plain strings against sorting."""
    strings = [[1, 2, 1, 3], [2, 1, 3], [1, 2, 2], [3, 1, 2, 1]]
    flat, length, first, last, at = [], [], [], [], 0
    for s in strings:
        first.append(at)
        flat += s
        length += list(range(len(s), 0, -1))
        at += len(s)
        last.append(at - 1)
    symbols, length = np.array(flat), np.array(length)
    owner = np.repeat([0, 0, 1, 1], [len(s) for s in strings])
    shards = [
        bwt_dedup.Shard(symbols, length, np.flatnonzero(owner == k), 1, 4, np.array(last)[2 * k : 2 * k + 2], np.array(first)[2 * k : 2 * k + 2])
        for k in (0, 1)
    ]
    own, common = bwt_dedup.merge(shards, 4)
    suffix = lambda k: tuple((flat[k : k + length[k]] + [0] * 4)[:4])
    want = sorted((suffix(k), int(owner[k])) for k in range(len(flat)))
    assert own[4:].tolist() == [o for _, o in want]
    keys = [w for w, _ in want]
    for i in range(1, len(keys)):
        shared = next((d for d in range(4) if keys[i][d] != keys[i - 1][d] or keys[i][d] == 0), None)
        if keys[i] != keys[i - 1]:
            assert common[4 + i] == shared


def reference_scores(rows, folds=10, theta_word=1e-5, theta_gram=1e-6, least=2):
    import math

    toks = {i: [*lower((t or "").encode()).split(), None] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % folds == 0 for i, _ in rows}
    c = collections.Counter(w for i in toks if not held[i] for w in toks[i])
    n = sum(c.values())
    z = n + 0.1 * (len(c) + 1)
    lex = {w for w, k in c.items() if k >= max(least, theta_word * n)}

    def grams(size, ok):
        g = collections.Counter(tuple(x[i : i + size]) for d, x in toks.items() if not held[d] for i in range(len(x) - size + 1) if ok(tuple(x[i : i + size])))
        return {a: b for a, b in g.items() if b >= max(least, theta_gram * n)}

    g2 = grams(2, lambda t: t[0] in lex and t[1] in lex)
    g3 = grams(3, lambda t: t[:2] in g2 and t[1:] in g2)
    p1 = lambda w: (c[w] + 0.1) / z
    p2 = {k: (v - 0.5) / c[k[0]] for k, v in g2.items()}
    p3 = {k: (v - 0.5) / g2[k[:2]] for k, v in g3.items()}
    f2, f3 = collections.defaultdict(list), collections.defaultdict(list)
    for a, b in g2:
        f2[a].append(b)
    for a, b, e in g3:
        f3[a, b].append(e)
    al2 = {a: (1 - sum(p2[a, b] for b in bs)) / (1 - sum(map(p1, bs))) for a, bs in f2.items()}
    al3 = {h: (1 - sum(p3[(*h, e)] for e in es)) / (1 - sum(p2[h[1], e] for e in es)) for h, es in f3.items()}
    q2 = lambda a, w: p2[a, w] if (a, w) in p2 else al2.get(a, 1) * p1(w)

    def prob(x, i):
        if i == 0:
            return p1(x[0])
        if i > 1 and (x[i - 2], x[i - 1]) in g2:
            h = (x[i - 2], x[i - 1])
            return p3[(*h, x[i])] if (*h, x[i]) in p3 else al3.get(h, 1) * q2(h[1], x[i])
        return q2(x[i - 1], x[i])

    return {
        i: (held[i], len(x), sum(c[w] > 0 for w in x), n, sum(math.log10(p1(w)) for w in x), sum(math.log10(prob(x, j)) for j in range(len(x))))
        for i, x in toks.items()
    }


@pytest.mark.parametrize("least", [1, 2])
def test_language_model(spark, docs, rows, least):
    want = reference_scores(rows, least=least)
    got = {r["doc_id"]: r for r in ngram_lm.score(docs, min_count=least, block_tokens=700).collect()}
    assert len(got) == len(rows)
    for i, (held, n, known, total, base, score) in want.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_language_model_grows_with_the_corpus(spark):
    # over 200,000 tokens a count of 2 is below a hundred-thousandth: words and n-grams that occur twice must stay
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(3000))) for i in range(100)]
    rows += [(i, f"rare{i // 2} pair{i // 2} once{i}") for i in range(100, 140)]
    want = reference_scores(rows, theta_word=0, theta_gram=0)
    got = {r["doc_id"]: r for r in ngram_lm.score(frame(spark, rows), min_count=2, block_tokens=50_000).collect()}
    for i, (*_, base, score) in want.items():
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9) and got[i]["score"] == pytest.approx(score, rel=1e-9)


def test_language_model_edges(spark):
    assert ngram_lm.score(empty(spark)).count() == 0
    got = ngram_lm.score(frame(spark, [(None, "a b"), (1, None), (1, "a b"), (2, "")])).collect()
    assert sorted(r["n_tokens"] for r in got) == [1, 1, 3, 3]


def test_decontamination_recall_and_precision(spark):
    rng, words = random.Random(6), vocabulary()
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(20, 60)))) for k in range(40)]
    rows, want = [], set()
    for i in range(200):
        t = [rng.choice(words) for _ in range(120)]
        if i % 4 == 0:
            k, passage = items[rng.randrange(len(items))]
            raw = list(passage)
            for _ in range(int(len(raw) * rng.choice([0, 0.02, 0.05]))):
                raw[rng.randrange(len(raw))] = rng.choice("abcdefghij")
            t.insert(50, "".join(raw).replace(" ", rng.choice([" ", "\n", "  "])))
            want.add((i, k))
        rows.append((i, " ".join(t)))
    bench = spark.createDataFrame([*items, (100, None), (101, ""), (102, "0123456")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    assert len(got & want) / len(want) >= 0.97 and not got - want
    assert decontaminate.contaminated(empty(spark), bench).count() == 0
    assert decontaminate.contaminated(frame(spark, rows), bench.where("false")).count() == 0
    assert decontaminate.contaminated(frame(spark, [(None, None), (1, "")]), bench).count() == 0


@pytest.mark.parametrize("share", [0.5, 1.0])
@pytest.mark.parametrize("kind", ["even sub", "even ins", "even del", "random mix"])
def test_decontamination_recall_by_edits(kind, share):
    """Edits evenly spaced or at random, up to the limit of a tenth: all matches get a window, and 0.9 and more are found."""
    rng, words = random.Random(12), vocabulary()
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(12, 60))).encode()) for k in range(80)]
    texts = []
    for _, item in items:
        m, raw = len(item), bytearray(item)
        k = int(m * 0.1 * share)
        for p in sorted((int((i + 0.5) * m / k) for i in range(k)) if "even" in kind else rng.sample(range(m), k), reverse=True):
            op = rng.choice(["sub", "ins", "del"]) if "mix" in kind else kind[-3:]
            raw[p : p + (op != "ins")] = b"" if op == "del" else bytes([rng.choice(b"xyz")])
        around = [" ".join(rng.choice(words) for _ in range(40)).encode() for _ in range(2)]
        texts.append(around[0] + b" " + bytes(raw) + b" " + around[1])
    index = decontaminate.ItemIndex(items, 0.1, 4, 64, 3)
    want = {(i, i) for i, (_, item) in enumerate(items) if decontaminate.nearest(item, texts[i])[0] <= len(item) // 10}
    text, segment, _ = index.candidates(*decontaminate._flat(texts))
    assert want <= set(zip(text.tolist(), index.item[segment].tolist(), strict=True)) and len(want) == 80
    got = {(d, i) for d, i, _ in index.matches(texts)}
    assert len(got & want) >= 0.9 * len(want) and not got - want


def test_decontamination_short_equal_and_long(spark):
    rng, words = random.Random(13), vocabulary()
    passage = " ".join(rng.choice(words) for _ in range(3000))
    items = [(1, "q"), (2, "zq y"), (2, "zebra crossing"), (3, passage), (None, "null item xy"), (4, "\t ")]
    rows = [(1, "Q"), (1, "x ZQ  y k"), (2, "the zebra crosing"), (3, "p " + passage[:5000] + "!!" + passage[5010:] + " s"), (4, "w " * 400_000), (5, "a null item xy"), (None, "zq y")]
    bench = spark.createDataFrame([(i, t, "clash", 7) for i, t in items], "item_id long, text string, doc_id string, n_edits int")
    got = sorted(decontaminate.contaminated(frame(spark, rows), bench).collect(), key=repr)
    assert {(r["doc_id"], r["item_id"]): r["n_edits"] for r in got} == {(1, 1): 0, (1, 2): 0, (2, 2): 1, (3, 3): 10, (5, None): 0, (None, 1): 0, (None, 2): 0} and len(got) == 7


def test_decontamination_beside_periodic_text(spark):
    rng, words = random.Random(8), vocabulary()
    plain = " ".join(rng.choice(words) for _ in range(30))
    items = [(0, "-" * 20 + plain), (1, plain[:90] + "=" * 30 + plain[90:]), (2, "ha " * 9 + plain[::-1])]
    rows = []
    for k, t in items:
        for n in (0, 100, 400, 2000):
            for stretch in ("-" * n, "=" * n, "ha " * (n // 3)):
                rows += [(len(rows) * 10 + k, stretch + t), (len(rows) * 10 + 10 + k, t + " " + stretch)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["n_edits"] for r in decontaminate.contaminated(frame(spark, rows), bench).collect()}
    assert all(got.get((i, i % 10)) == 0 for i, _ in rows)


def test_nearest_equals_dynamic_programming():
    rng = random.Random(9)
    for _ in range(300):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
        b = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 20)))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
            row = new
        assert decontaminate.nearest(a, b)[0] == min(row)
