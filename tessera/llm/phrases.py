"""Collocations by Suffix-sigma: frequent phrases per language, scored, without those that a longer one explains.

1.  A text is lower-cased (ASCII), cut into pieces at punctuation and line ends, and these into words. Every word starts a suffix of its piece,
    truncated to ``max_n`` words.
2.  What can't be frequent isn't shuffled: a first pass counts words and word pairs in a table of ``1 << sketch_bits`` saturating bytes a task; slices of
    them are added up by slice. A pair whose place holds less than ``min_count`` occurs less often, so a suffix is cut in front of it; a suffix of one such
    word goes. That loses nothing, as each part of a frequent phrase is frequent. The bits, one per place, are broadcast: their size is fixed by the parameter.
3.  Equal suffixes of some runs of texts are one row with a count, so a hot word is a row per ``TALLY_BYTES`` and not per occurrence. The rows are
    dealt out in ranges of (code, language, suffix) and sorted: words of a hot first word, and a hot phrase, spread over as many tasks as their rows fill. The code holds
    24 bits of the first word's hash with its language, then 16 of the second's, so that most comparisons are of two numbers.
4.  One pass with a stack: all rows with the same first n words follow each other, so a stack of ``max_n`` open prefixes, of which those that the next row
    doesn't share are closed, counts every prefix. A prefix that may go on in the next range is passed on as it is; a sum merges these.
    First words whose 24 bits are equal may lie between each other, so their counts are passed on too.
5.  Parts and longer phrases are joined by text afterwards.

Suffixes carry a separator behind each word, so that a prefix of words is a prefix of bytes whatever bytes the words hold. Scores are decimals of 38 digits.

Cases: null and empty texts have no words; a null language is ``und``, an empty one is its own; equal rows count each; ties are settled by count, then by the bytes of
the phrase; a very long text is one run of its own and takes the memory of one text; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize, spread, table
from tessera.llm.hashing import mix, text_chunks

_U = np.uint64
#: Bytes of text that are cut into words at once.
RUN_BYTES = 4 << 20
#: Bytes of text, in runs, whose equal suffixes become one row.
TALLY_BYTES = 32 << 20
#: Suffixes that leave a task at once.
BATCH_ROWS = 1 << 16
#: Places of the table of words and pairs that travel in one row.
SLICE = 1 << 16
#: How many parts a language's phrases are ranked in before the last ranking.
RANK_PARTS = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 in a word, 1 between words, 2 between pieces
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2


#: Masks of the first 0 to 8 bytes of a number.
_FIRST_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], _U)


class Words:
    """The words of a run of texts: ``data`` with one space behind each, where they start and end there, and how many follow in the piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, max_n: int):
        kind = _CLASS[data]
        solid = np.concatenate([[False], kind == 0, [False]])
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        # a word starts where the byte before is none of it or another text's
        first = solid[1:-1] & (~solid[:-2] | edge[:-1])
        last = solid[1:-1] & (~solid[2:] | edge[1:])
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        breaks = np.cumsum((kind == 2) | edge[:-1], dtype=np.int32)
        piece = breaks[starts] if len(starts) else starts
        size = ends - starts + 1
        self.starts = np.cumsum(size) - size
        self.ends = self.starts + size
        self.data = np.full(int(size.sum()), 0x20, np.uint8)
        if len(starts):
            inside = np.ones(len(self.data), bool)
            inside[self.ends - 1] = False
            self.data[inside] = _LOWER[data[kind == 0]]
        n = len(starts)
        self.text = np.searchsorted(offsets, starts, "right") - 1
        self.follow = np.zeros(n, np.int64)  # words that follow in the piece, max_n - 1 at most
        for i in range(1, max_n):
            same = np.zeros(n, bool)
            same[: max(0, n - i)] = piece[: max(0, n - i)] == piece[i:]
            self.follow += same

    def hashes(self) -> np.ndarray:
        """A hash of each word."""
        h, live, at = np.zeros(len(self.starts), _U), np.arange(len(self.starts)), self.starts
        data = np.append(self.data, np.zeros(8, np.uint8))
        size = self.ends - self.starts
        while len(live):  # eight bytes of each word that has more
            part = np.zeros(len(live), _U)
            for j in range(8):
                part |= data[at + j].astype(_U) << _U(8 * j)
            part &= _FIRST_BYTES[np.minimum(size, 8)]
            h[live] = mix(h[live] * _U(0x9FB21C651E98DF25) + part)
            more = size > 8
            live, at, size = live[more], at[more] + 8, size[more] - 8
        return h

    def places(self, salt: np.ndarray, bits: int, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The place of each word, and of the pair of each word that another follows, in a table of ``1 << bits``.

        Equal words, and equal pairs, of a language have equal places. ``h``: the words' hashes, if they are known.
        """
        h = self.hashes() if h is None else h
        pair = np.flatnonzero(self.follow > 0)
        salt = salt[self.text]
        place = lambda x: (mix(x) >> _U(64 - bits)).astype(np.int64)
        return place(h * _U(0xC2B2AE3D27D4EB4F) + salt), place(h[pair] * _U(0xD6E8FEB86659FD93) + h[pair + 1] + salt[pair])


def _salts(langs: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(x.encode()) for x in langs.to_pylist()], _U) << _U(17)


def _pair_tables(bits: int, max_n: int, enough: int):
    """Of each task the table of its word and pair counts, up to ``enough``, in compressed slices (place, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            for lo, data, offsets in text_chunks(batch.column(1), RUN_BYTES):
                langs = _salts(batch.column(0).slice(lo, len(offsets) - 1))
                for places in Words(data, offsets, max_n).places(langs, bits):
                    place, n = np.unique(places, return_counts=True)
                    counts[place] = np.minimum(counts[place] + np.minimum(n, enough), enough)
        for at in range(0, len(counts), SLICE):
            part = counts[at : at + SLICE]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["at", "counts"])

    return run


def _frequent_places(enough: int):
    """Slices (at, counts), sorted, to (at, bits): one bit per place that holds ``enough`` in all tasks together."""

    def packed(at: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(total >= enough).tobytes()], pa.binary())], names=["at", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for at, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(raw.as_buffer()), np.uint8)
                if at != now:
                    if total is not None:
                        yield packed(now, total)
                    now, total = at, np.zeros(len(part), np.uint16)
                total = np.minimum(total + part, enough)
        if total is not None:
            yield packed(now, total)

    return run


def _spans(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.LargeBinaryArray:
    """The bytes from each start on."""
    upto = np.cumsum(size)
    raw = data[np.repeat(start - upto + size, size) + np.arange(int(size.sum()))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(0, upto).astype(np.int64)), pa.py_buffer(raw)])


def _tally(suffixes: pa.LargeBinaryArray, codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[pa.LargeBinaryArray, np.ndarray, np.ndarray]:
    """The distinct suffixes with their codes and how often each occurs."""
    told = suffixes.dictionary_encode()
    at = told.indices.to_numpy()
    code = np.empty(len(told.dictionary), np.int64)
    code[at] = codes
    return told.dictionary, code, np.bincount(at, counts, len(code)).astype(np.int64)


def _suffixes(frequent, bits: int, max_n: int):
    """Batches of (lang, text) to lang, suffix, n, code: the truncated suffixes of some runs of texts; the empty suffix counts the words."""

    def rows(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, runs in held.items():
            suffixes, codes, counts = zip(*runs, strict=True)
            suffixes, codes, counts = _tally(pa.concat_arrays(suffixes), np.concatenate(codes), np.concatenate(counts))
            runs.clear()
            order = np.argsort(codes)  # neighbours begin alike, which packs well
            suffixes = suffixes.take(pa.array(order)).cast(pa.binary())
            batch = pa.RecordBatch.from_arrays([pa.array([lang] * len(order), pa.string()), suffixes, pa.array(counts[order]), pa.array(codes[order])], names=["lang", "suffix", "n", "code"])
            del suffixes, codes, counts, order
            for at in range(0, batch.num_rows, BATCH_ROWS):
                yield batch.slice(at, BATCH_ROWS)
            del batch
        held.clear()
        pa.default_memory_pool().release_unused()  # a worker outlives its task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(frequent.value, np.uint8)
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            for lo, data, offsets in text_chunks(batch.column(1), RUN_BYTES):
                if size + len(data) > TALLY_BYTES:
                    yield from rows(held)
                    size = 0
                size += len(data)
                langs = batch.column(0).slice(lo, len(offsets) - 1)
                words, salts = Words(data, offsets, max_n), _salts(langs)
                h = words.hashes()
                often, pairs = (known[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1 for p in words.places(salts, bits, h))
                on = np.zeros(len(words.starts) + max_n, bool)
                on[np.flatnonzero(words.follow > 0)] = pairs
                more, going = np.zeros(len(words.starts), np.int64), np.ones(len(words.starts), bool)
                for i in range(max_n - 1):
                    going &= on[i : i + len(going)] & (words.follow > i)
                    more += going
                spoken = langs.dictionary_encode()
                of_word = spoken.indices.to_numpy()[words.text] if len(words.starts) else np.zeros(0, int)
                for c, lang in enumerate(spoken.dictionary.to_pylist()):
                    own = np.flatnonzero(of_word == c)
                    if not len(own):
                        continue
                    total, own = len(own), own[(often[own] > 0) | (more[own] > 0)]
                    first, second = mix(h[own] + salts[words.text[own]]), np.where(more[own] > 0, h[np.minimum(own + 1, len(h) - 1)], _U(0))
                    codes = (first >> _U(40) << _U(16) | second >> _U(48)).view(np.int64)
                    spans = _spans(words.data, words.starts[own], words.ends[own + more[own]] - words.starts[own])
                    every = pa.array([b""], pa.large_binary()), np.zeros(1, np.int64), np.array([total])
                    held.setdefault(lang, []).extend([_tally(spans, codes), every])
        yield from rows(held)

    return run


class _Sorted:
    """A batch of sorted (lang, suffix, n): how many words each row has, and how many bytes its first 1 to ``max_n`` words and those it shares with the row before take."""

    def __init__(self, batch: pa.RecordBatch, max_n: int):
        self.lang = batch.column(0).dictionary_encode()
        suffix = batch.column(1).cast(pa.large_binary())
        self.n = batch.column(2).to_numpy()
        at = np.frombuffer(suffix.buffers()[1], np.int64)[suffix.offset : suffix.offset + len(suffix) + 1]
        self.data, self.at = np.frombuffer(suffix.buffers()[2], np.uint8), at
        spaces = np.flatnonzero(self.data[: at[-1]] == 0x20) + 1
        before = np.searchsorted(spaces, at, "right")
        self.depth = np.minimum(np.diff(before), max_n)
        self.ends = [spaces[np.minimum(before[:-1] + d, len(spaces) - 1)] - at[:-1] for d in range(max_n)]
        size = np.minimum(np.diff(at)[1:], np.diff(at)[:-1])
        upto = np.cumsum(size)
        place = np.arange(int(size.sum()))
        unlike = np.flatnonzero(self.data[np.repeat(at[1:-1] - upto + size, size) + place] != self.data[np.repeat(at[:-2] - upto + size, size) + place])
        unlike = np.append(unlike, len(place))
        same = np.minimum(unlike[np.searchsorted(unlike, upto - size)] - (upto - size), size)
        lang = self.lang.indices.to_numpy()
        self.shared = np.append(-1, np.where(lang[1:] == lang[:-1], same, -1))


def _prefix_counts(max_n: int, min_count: int):
    """Sorted (lang, suffix, n) or (lang, suffix, n, code) to lang, phrase, n: the counts of all prefixes, without those that are complete and too rare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the stack: the last row before, and of each depth the count of its open prefix and whether there may be more of it, as in the range before
        last, stack = None, [(0, True)] * max_n
        for batch in (b for b in batches if b.num_rows):
            if last is not None:
                batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            rows = _Sorted(batch, max_n)
            for d in range(max_n):
                own = np.flatnonzero(rows.depth > d)
                if not len(own):
                    stack[d] = (0, False)
                    continue
                opens = np.flatnonzero(rows.shared[own] < rows.ends[d][own])
                n, part = np.add.reduceat(rows.n[own], opens), np.zeros(len(opens), bool)
                if own[0] == 0:
                    n[0], part[0] = n[0] + stack[d][0], stack[d][1]
                if not d and batch.num_columns > 3:
                    code = batch.column(3).to_numpy()[own[opens]] >> 16
                    part[1:] |= code[1:] == code[:-1]
                    part[:-1] |= code[1:] == code[:-1]
                out, stack[d] = part | (n >= min_count), (0, False)
                if own[-1] == batch.num_rows - 1:
                    stack[d], out[-1] = (int(n[-1]), bool(part[-1])), False
                at = own[opens[out]]
                yield pa.RecordBatch.from_arrays(
                    [rows.lang.take(pa.array(at)).cast(pa.string()), _spans(rows.data, rows.at[at], rows.ends[d][at]).cast(pa.binary()), pa.array(n[out])], names=["lang", "phrase", "n"]
                )
            end = batch.slice(batch.num_rows - 1)
            last = pa.RecordBatch.from_arrays([*end.columns[:2], pa.array([0], pa.int64()), *end.columns[3:]], schema=batch.schema)
        if last is not None:
            words = last.column(1)[0].as_py().split(b" ")[:-1][:max_n]
            phrases = [b"".join(w + b" " for w in words[: d + 1]) for d in range(len(words))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(last.column(0).to_pylist() * len(words), pa.string()), pa.array(phrases, pa.binary()), pa.array([n for n, _ in stack[: len(words)]], pa.int64())],
                names=["lang", "phrase", "n"],
            )

    return run


def frequencies(docs: DataFrame, lang_col: str, text_col: str, max_n: int, min_count: int, sketch_bits: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all phrases up to ``max_n`` words with at least ``min_count`` occurrences, and (lang, n), all words."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    slices = texts.mapInArrow(_pair_tables(sketch_bits, max_n, min(min_count, 255)), "at long, counts binary").repartition("at").sortWithinPartitions("at")
    known = np.zeros(1 << sketch_bits >> 3, np.uint8)
    for r in slices.mapInArrow(_frequent_places(min(min_count, 255)), "at long, bits binary").toLocalIterator():  # 1 << sketch_bits bits in all
        known[r["at"] >> 3 : (r["at"] >> 3) + len(r["bits"])] = np.frombuffer(r["bits"], np.uint8)
    frequent = spark.sparkContext.broadcast(known.tobytes())
    suffixes = materialize(texts.mapInArrow(_suffixes(frequent, sketch_bits, max_n), "lang string, suffix binary, n long, code long"), "suffixes", compression="zstd")
    words = materialize(suffixes.where(F.length("suffix") == 0).groupBy("lang").agg(F.sum("n").alias("n")), "words")
    ordered = [F.asc("code"), F.desc("lang"), F.desc("suffix")]
    dealt = suffixes.where(F.length("suffix") > 0).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *ordered).sortWithinPartitions(*ordered)
    parts = dealt.mapInArrow(_prefix_counts(max_n, min_count), "lang string, phrase binary, n long")
    counts = parts.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= min_count)
    counts = materialize(counts.select("lang", F.rtrim(F.col("phrase").cast("string")).alias("phrase"), "f"), "counts")
    discard(suffixes)
    frequent.unpersist()
    return counts, words


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_n: int = 4, min_count: int = 30, top: int = 2000, cover: int = 80, sketch_bits: int = 25
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` phrases of 2 to ``max_n`` words of each language.

    A phrase goes if a longer candidate holds its words with at least ``cover`` hundredths of its count.
    """
    counts, words = frequencies(docs, lang_col, text_col, max_n, min_count, sketch_bits)
    part = F.split("phrase", " ")
    candidates = counts.select("lang", "phrase", F.col("f").alias("a"), part.alias("w")).where(F.size("w") > 1)
    join = lambda w: F.array_join(w, " ")
    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", join(F.slice("w", F.lit(1), F.col("k"))).alias("left"), join(F.slice("w", F.col("k") + 1, F.size("w") - F.col("k"))).alias("right"))
    side = lambda text, f: counts.select("lang", F.col("phrase").alias(text), F.col("f").alias(f))
    cuts = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"])
    score = F.expr("CAST(2000000 * CAST(a AS DECIMAL(20, 0)) AS DECIMAL(38, 0)) DIV CAST(CAST(l AS DECIMAL(20, 0)) + r AS DECIMAL(38, 0))")
    best = cuts.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("x")).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("x").alias("x"))

    spans = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("n")) for n in range(2, max_n) for i in range(1, max_n - n + 2)])
    longer = candidates.where(F.size("w") > 2).select("lang", F.col("a").alias("longer"), "w", F.explode(spans).alias("s"))
    longer = longer.where((F.col("s.n") < F.size("w")) & (F.col("s.i") + F.col("s.n") - 1 <= F.size("w")))
    longer = longer.select("lang", join(F.slice("w", F.col("s.i"), F.col("s.n"))).alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    kept = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer") * 100 < wide("a") * cover))
    kept = kept.select("lang", "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), F.col("x.score").alias("score"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))).orderBy(*order)
    # the first of each part, so that the last ranking holds at most RANK_PARTS * top rows of a language
    few = kept.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top).drop("rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")  # words: one row per language


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spread(table(spark, sf_dir, "documents")))


OP12_SQL = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), f AS MATERIALIZED (
  SELECT lang, words, count(*) AS f FROM (
    SELECT lang, w[i:i + n - 1] AS words FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p), range(1, 5) t(n) WHERE i + n - 1 <= len(w)
  ) GROUP BY 1, 2
), t AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE len(words) = 1 GROUP BY 1
), c AS (SELECT * FROM f WHERE len(words) > 1 AND f >= 30
), s AS (
  SELECT c.lang, c.words, c.f AS a, l.f AS l, r.f AS r, k, CAST(2000000 * CAST(c.f AS HUGEINT) // (l.f + r.f) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, len(words))) AS k FROM c) c
  JOIN f l ON l.lang = c.lang AND l.words = c.words[1:k] JOIN f r ON r.lang = c.lang AND r.words = c.words[k + 1:]
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1
), o AS (
  SELECT lang, sub, max(f) AS longer FROM (SELECT lang, f, words, words[i:i + n - 1] AS sub FROM c, range(2, 4) a(n), range(1, 4) b(i) WHERE i + n - 1 <= len(words) AND n < len(words)) GROUP BY 1, 2
), k AS (SELECT b.*, array_to_string(b.words, ' ') AS phrase FROM b LEFT JOIN o ON o.lang = b.lang AND o.sub = b.words WHERE o.longer IS NULL OR 100 * o.longer < 80 * b.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score FROM k JOIN t ON t.lang = k.lang
QUALIFY row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
