"""Hashes of spans, and the operators on texts that a polynomial modulo a power of two can't tell apart."""

from __future__ import annotations

import collections
import resource
import zlib

import numpy as np
import pyarrow as pa
import pytest
from test_operators import repeated_words
from tokenizers import Tokenizer

from tessera.llm import bwt_dedup, hashing, near_dedup, ngram_lm, packing, substring_dedup, token_archive, tokens


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


PAIRS = [(thue_morse(n, a, b), thue_morse(n, b, a)) for n in (512, 1024, 4096) for a, b in ("ab", "BM", "6c", "N|", "Xk")]
TEXTS = [t for p in PAIRS for t in p]


@pytest.mark.parametrize("pair", PAIRS[:8])
def test_spans_differ(pair):
    n = len(pair[0])
    sums = hashing.prefix_sums(np.frombuffer("".join(pair).encode(), np.uint8))
    one, two = hashing.span_hashes(sums, np.array([0, n]), np.array([n, 2 * n]))
    assert one != two
    again = hashing.prefix_sums(np.frombuffer((pair[0] * 2).encode(), np.uint8))
    assert len(set(hashing.span_hashes(again, np.array([0, n]), np.array([n, 2 * n])).tolist())) == 1


def library(texts):
    known = Tokenizer.from_file(tokens.tokenizer_path(tokens.DEFAULT_TOKENIZER))
    return [known.encode(t or "", add_special_tokens=False).ids for t in texts]


def encoded(encoder, texts):
    out = []
    for _, ids, at in encoder.encode(pa.array(texts)):
        out += [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)]
    return out


@pytest.mark.parametrize("hashes", [None, 5])
def test_units_equal_the_library(monkeypatch, hashes):
    """Also where only five hashes are left, so that nearly all units share theirs."""
    if hashes:
        real = tokens.span_hashes
        monkeypatch.setattr(tokens, "span_hashes", lambda s, a, b: real(s, a, b) % np.uint64(hashes))
    texts = [*TEXTS, None, "", "one  two <|endoftext|> one", " a" * 300, "naïve\u3000été  x \n y"]
    encoder = tokens.UnitEncoder()
    assert encoded(encoder, texts) == library(texts) == encoded(encoder, texts)


def test_units_are_learned_without_a_call_each():
    """New words took four calls of Python each, as long as the library took for them."""
    import cProfile
    import pstats

    texts = [" ".join(f"w{i * 977 + j}q, x{j}\u00e9{i}" for j in range(400)) for i in range(25)]
    encoder, profile = tokens.UnitEncoder(), cProfile.Profile()
    got = profile.runcall(encoded, encoder, texts)
    calls = sum(n for (file, _, name), (_, n, *_) in pstats.Stats(profile).stats.items() if name != "<listcomp>")
    assert got == library(texts)
    assert len(encoder._known) >= 19000 and calls < 5000


def documents(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)


def test_archive_and_packing(spark, tmp_path):
    want = library(TEXTS)
    path = f"file://{tmp_path}/archive"
    token_archive.write_archive(documents(spark, TEXTS), path)
    found = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_archive.read_archive(spark, path).collect()}
    assert found == {i: (len(t) + 1, zlib.crc32(np.array([*t, 0], "<u4").tobytes())) for i, t in enumerate(want)}
    packed = packing.pack(documents(spark, TEXTS)).groupBy("doc_id").max("doc_tokens").collect()
    assert {r[0]: r[1] for r in packed} == {i: len(t) + 1 for i, t in enumerate(want)}


def test_near_duplicates(spark):
    found = near_dedup.near_duplicates(documents(spark, [t + " end" for t in TEXTS]), shingle=2).collect()
    assert all(r.kept for r in found) and len(found) == len(TEXTS)


def test_repeats(spark):
    # 40 words that differ in one long word only, and bytes of complements with a passage that repeats
    words = [" ".join([*"abcdefghij", t, *"klmnopqrstuvwxyzabcdefghijklm"]) for p in PAIRS for t in p]
    found = substring_dedup.remove_repeats(documents(spark, words)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == repeated_words(list(enumerate(words)), 35)
    texts = [t + "#" * (i % 3) for i, t in enumerate(TEXTS)]
    found = bwt_dedup.remove_repeats(documents(spark, texts)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed) for r in found} == repeated_bytes(texts, 400)


def repeated_bytes(texts, window):
    count = collections.Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = {}
    for d, t in enumerate(texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                gone[i : i + window] = True
        out[d] = (len(t), int(gone.sum()))
    return out


def test_three_word_pages_make_no_pairs():
    """40,000 sets with a common shingle and one of their own: the inverted index of rare shingles stays empty."""
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    own = np.arange(1, 40_001, dtype=np.uint64)
    sets = [np.array([0, x], np.uint64) for x in own]
    labels = np.arange(len(sets))
    assert list(near_dedup._similar(sets, sets, labels, labels + 10**6, lambda x: x, 80, 100)) == [(i, i) for i in range(len(sets))]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1 << 20


@pytest.mark.parametrize(("pairs", "compared"), [(1 << 18, 1 << 21), (50, 300)])
def test_similar_pairs_equal_all_pairs(monkeypatch, pairs, compared):
    monkeypatch.setattr(near_dedup, "PAIRS", pairs)
    monkeypatch.setattr(near_dedup, "COMPARED", compared)
    rng = np.random.default_rng(pairs)
    base = [rng.integers(0, 1 << 62, n, dtype=np.uint64) for n in rng.integers(2, 40, 9)]

    def made():
        x = base[rng.integers(9)]
        x = np.delete(x, rng.choice(len(x), rng.integers(0, min(4, len(x))), replace=False))
        return np.unique(np.concatenate([x, rng.integers(0, 1 << 62, rng.integers(0, 3), dtype=np.uint64)]))

    one, two = ([s for s in (made() for _ in range(50)) if len(s)] for _ in range(2))
    want = {
        (i, k) for i, a in enumerate(one) for k, b in enumerate(two) if 100 * (n := len(np.intersect1d(a, b))) >= 80 * (len(a) + len(b) - n)
    }
    found = near_dedup._similar(one, two, np.arange(len(one)), 1000 + np.arange(len(two)), lambda x: x, 80, 100)
    assert set(found) == want and want


def test_small_sets_are_left_out_of_buckets(spark):
    """Three-word documents with a common start: no pair of such small sets can link, so none reaches a bucket."""
    texts = [f"posted by name{i}" for i in range(3000)] + ["posted by name1"]
    found = near_dedup.near_duplicates(documents(spark, texts), shingle=2).collect()
    assert sorted(r.doc_id for r in found if not r.kept) == [3000]


def test_words_of_the_language_model():
    data = np.frombuffer(" ".join(TEXTS).encode(), np.uint8)
    hashes, before = ngram_lm.word_hashes(data, np.array([0, len(data)]), lower=False)
    assert before[-1] == len(TEXTS) == len(set(hashes.tolist()))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 1000, 70000])
def test_distinct_equals_unique(n):
    rng = np.random.default_rng(n)
    h = rng.integers(0, 1 << 64, max(1, n // 2), dtype=np.uint64)[rng.integers(0, max(1, n // 2), n)]
    h[: n // 4] = (h[: n // 4] & ~np.uint64(7)) | rng.integers(0, 8, n // 4, dtype=np.uint64)  # differ in the bits that hold the place
    keys, place = hashing.distinct(h)
    want, where = np.unique(h, return_inverse=True)
    assert (keys == want).all() and (place == where).all() and len(keys) == len(want)
