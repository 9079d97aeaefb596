"""Windows of texts that occur more than once, for units that are words or bytes.

Every window of ``window`` units has a minimizer: its ``gram`` units with the
smallest hash, the leftmost of equals.  Equal windows have equal minimizers at equal
places, so windows can only repeat inside the group of their minimizer.  Consecutive
windows with the same minimizer are one piece of text.

1.  Texts go to a table that is bucketed by row, so that later joins with it shuffle no text.
2.  Pieces are rows of (minimizer, hash of the piece, row, first window, windows); equal neighbours, as in periodic
    text, are one row.  Per minimizer
    one aggregate tells whether it has one piece (nothing repeats), equal pieces
    only (everything repeats), or different pieces.
3.  Only in the last case content has to be compared: of equal pieces one goes on, its text is cut from the
    bucketed table and dealt out by minimizer.  A minimizer with very many different
    pieces is extended: by the units after it for windows that reach far enough
    to the right, else by those before it.  Equal windows agree on both.  Beyond ``WIDE`` pieces, whose group no task
    should hold, windows are counted by their hashes, combined before the shuffle.
4.  An engine (suffix tree, or merged Burrows-Wheeler transforms) finds the repeated windows of its groups.

Hashes of 64 bits tell grams and pieces apart.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize, new_path, tasks_for
from tessera.llm.hashing import _BYTE, mix, powers, text_chunks, word_spans, prefix_sums, span_hashes

#: Of a minimizer with more different pieces than this, the key is extended.
HEAVY = 4096
#: Of a minimizer with more than this, windows are counted instead of gathered.
WIDE = 8192
#: Units that an engine looks at together, in whole groups.
BATCH_UNITS = 1 << 20
_LOW32 = np.uint64(0xFFFFFFFF)


@dataclass(frozen=True)
class Units:
    """What a text is a sequence of: ``words`` or ``bytes``."""

    kind: str
    window: int
    gram: int

    @property
    def item_bytes(self) -> int:
        return 8 if self.kind == "words" else 1

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units, their random 64-bit values, and the number of units before each text."""
        if self.kind == "bytes":
            return data, _BYTE[data], offsets
        starts, ends, before = word_spans(data, offsets)
        h = span_hashes(prefix_sums(data), starts, ends)
        return h, h, before


def value_sums(values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=out[1:])
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every ``w`` consecutive numbers, from prefix and suffix minima of blocks of ``w``."""
    n = len(x)
    pad = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    pad[:n] = x
    blocks = pad.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def pieces_of(units: Units, values: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, ...]:
    """text, first window (in the text), windows, minimizer's key, its offset from the first window, hash of the piece, times.

    Equal pieces that follow each other, as in periodic text, are one row with ``times`` above 1.
    """
    none = np.zeros(0, np.int64)
    n, W, k = len(values), units.window, units.gram
    if n < W:
        return (none,) * 7
    sums = value_sums(values)
    at = np.arange(n - k + 1)
    grams = span_hashes(sums, at, at + k)
    order = (mix(grams) & ~_LOW32) | at.astype(np.uint64)
    anchor = (sliding_min(order, W - k + 1) & _LOW32).astype(np.int64)
    lengths = np.diff(before)
    windows = np.maximum(0, lengths - W + 1)
    text = np.repeat(np.arange(len(lengths)), windows)
    p = np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows) + before[:-1][text]
    a = anchor[p]
    new = np.ones(len(p), bool)
    new[1:] = (a[1:] != a[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    r = np.diff(np.append(first, len(p)))
    start, own = p[first], text[first]
    whole = span_hashes(sums, start, start + r - 1 + W)
    key = grams[a[first]]
    new = np.ones(len(start), bool)
    new[1:] = (own[1:] != own[:-1]) | (key[1:] != key[:-1]) | (whole[1:] != whole[:-1])
    k = np.flatnonzero(new)
    times = np.diff(np.append(k, len(start)))
    return own[k], (start - before[:-1][own])[k], r[k], key[k].view(np.int64), (a[first] - start)[k], whole[k].view(np.int64), times


def _pieces(units: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids = batch.column(0).to_numpy()
            for lo, data, offsets in text_chunks(batch.column(1)):
                _, values, before = units.read(data, offsets)
                own, first, r, key, off, whole, times = pieces_of(units, values, before)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key, pa.int64()),
                        pa.array(whole, pa.int64()),
                        pa.array(rids[lo + own], pa.int64()),
                        pa.array(first.astype(np.int32)),
                        pa.array(r.astype(np.int32)),
                        pa.array(off.astype(np.int32)),
                        pa.array(times.astype(np.int32)),
                    ],
                    names=["key", "piece", "rid", "first", "r", "off", "times"],
                )

    return run


def _cut(units: Units):
    """(rid, text, asked: first, r, off, key, piece, n, heavy) to (key, piece, n, rid, first, r, content); heavy keys extended."""
    W, k, half = units.window, units.gram, (units.window - units.gram) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(2)
            for lo, data, offsets in text_chunks(batch.column(1)):
                content, values, before = units.read(data, offsets)
                sums = value_sums(values)
                rows = []
                for i in range(len(offsets) - 1):
                    base = int(before[i])
                    for a in asked[lo + i].as_py():
                        parts = [(a["key"], a["first"], a["r"])]
                        if a["heavy"]:
                            anchor = base + a["first"] + a["off"]
                            # windows that start at most half before the anchor reach half beyond its gram
                            right = min(a["r"], max(0, a["r"] - max(0, a["off"] - half)))
                            n_left = a["r"] - right
                            parts = []
                            if n_left:
                                lo_, hi_ = np.array([anchor - half]), np.array([anchor + k])
                                parts.append((int(mix(span_hashes(sums, lo_, hi_) + np.uint64(1)).view(np.int64)[0]), a["first"], n_left))
                            if right:
                                lo_, hi_ = np.array([anchor]), np.array([anchor + k + half])
                                parts.append((int(mix(span_hashes(sums, lo_, hi_) + np.uint64(2)).view(np.int64)[0]), a["first"] + n_left, right))
                        for key, first, r in parts:
                            cut = content[base + first : base + first + r - 1 + W]
                            rows.append((key, a["n"], a["rid"], first, r, cut.tobytes()))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "n", "rid", "first", "r", "content"]
                    )

    return run


def _windows(units: Units):
    """(rid, text, asked) to (window's hash, n, rid, s) for every window of the pieces asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(2)
            for lo, data, offsets in text_chunks(batch.column(1)):
                _, values, before = units.read(data, offsets)
                sums = value_sums(values)
                own = [(int(before[i]), a) for i in range(len(offsets) - 1) for a in asked[lo + i].as_py()]
                if not own:
                    continue
                r = np.array([a["r"] for _, a in own])
                first = np.repeat([a["first"] for _, a in own], r) + np.arange(int(r.sum())) - np.repeat(np.cumsum(r) - r, r)
                at = np.repeat([b for b, _ in own], r) + first
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(span_hashes(sums, at, at + units.window).view(np.int64)),
                        pa.array(np.repeat([a["n"] for _, a in own], r).astype(np.int64)),
                        pa.array(np.repeat([a["rid"] for _, a in own], r).astype(np.int64)),
                        pa.array(first.astype(np.int32)),
                    ],
                    names=["w", "n", "rid", "s"],
                )

    return run


#: An engine takes the contents of pieces (arrays of units) and returns, for each, which of its windows occur elsewhere among them.
Engine = Callable[[list[np.ndarray]], list[np.ndarray]]


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of every run of true values."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _compare(units: Units, engine: Engine):
    """Whole key groups, in order of keys, through the engine; spans of repeated windows of pieces that occur once."""
    dtype = np.uint64 if units.kind == "words" else np.uint8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None

        def settle() -> pa.RecordBatch:
            rid, start, end = [], [], []
            flags = engine([h[3] for h in held])
            for (n, row, first, _), flag in zip(held, flags, strict=True):
                if n == 1:
                    for a, b in zip(*runs_of(flag), strict=True):
                        rid.append(row)
                        start.append(first + int(a))
                        end.append(first + int(b) + units.window)
            return pa.RecordBatch.from_arrays(
                [pa.array(rid, pa.int64()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["rid", "s", "e"]
            )

        for batch in batches:
            keys = batch.column(0).to_numpy()
            n, rids, firsts = (batch.column(i).to_pylist() for i in (1, 2, 3))
            for i, value in enumerate(batch.column(5)):
                if keys[i] != last and size >= BATCH_UNITS:
                    yield settle()
                    held, size = [], 0
                last = keys[i]
                held.append((n[i], rids[i], firsts[i], np.frombuffer(value.as_buffer(), dtype)))
                size += len(held[-1][3])
        if held:
            yield settle()

    return run


def bucketed(docs: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """The texts as a table bucketed by a row number: ``rid``, ``doc_id``, ``text``."""
    spark = docs.sparkSession
    n = tasks_for(docs)
    table = f"{name}_{uuid.uuid4().hex}"
    (
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            F.col(id_col).cast("long").alias("doc_id"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        )
        .repartition(n, "rid")
        .write.bucketBy(n, "rid")
        .sortBy("rid")
        .option("path", new_path(spark, name))
        .option("compression", "zstd")
        .saveAsTable(table)
    )
    return spark.table(table)


def repeated_spans(texts: DataFrame, units: Units, engine: Engine) -> DataFrame:
    """``rid`` and ``spans`` (array of s, e in units): stretches of windows that also start elsewhere. texts: of bucketed()."""
    n = tasks_for(texts)
    pieces = materialize(
        texts.select("rid", "text").mapInArrow(_pieces(units), "key long, piece long, rid long, first int, r int, off int, times int"),
        "pieces",
    )
    keys = (
        pieces.groupBy("key")
        .agg(F.sum("times").alias("total"), F.min("piece").alias("lo"), F.max("piece").alias("hi"))
        .where("total > 1")
        .select(F.col("key"), (F.col("lo") == F.col("hi")).alias("same"))
    )
    # a table and not an aggregate below the join, so that adaptive execution may split a hot key's pieces
    keys = materialize(keys, "keys")
    shared = materialize(pieces.join(keys, "key"), "shared")
    end = (F.col("first") + F.col("r") * F.col("times") - 1 + units.window).cast("int")
    spans = shared.where("same").select("rid", F.col("first").alias("s"), end.alias("e"))
    differing = shared.where(~F.col("same"))
    distinct = materialize(
        differing.groupBy("key", "piece").agg(F.sum("times").alias("n"), F.min(F.struct("rid", "first", "r", "off")).alias("x")), "distinct"
    )
    copies = differing.join(distinct.where("n > 1").select("key", "piece"), ["key", "piece"], "left_semi")
    spans = spans.unionByName(copies.select("rid", F.col("first").alias("s"), end.alias("e")))
    sizes = distinct.groupBy("key").count().where(F.col("count") > min(HEAVY, WIDE))
    sizes = materialize(sizes.select("key", (F.col("count") > HEAVY).alias("heavy"), (F.col("count") > WIDE).alias("wide")), "sizes")
    one = F.struct("x.first", "x.r", "x.off", "key", "n", F.col("x.rid").alias("rid"), F.coalesce("heavy", F.lit(False)).alias("heavy"))

    def of_texts(rows: DataFrame) -> DataFrame:
        """The texts that pieces are asked of, with the pieces."""
        asked = rows.select(F.col("x.rid").alias("rid"), one.alias("a")).groupBy("rid").agg(F.collect_list("a").alias("asked"))
        return texts.join(asked, "rid").select("rid", "text", "asked")

    sized = distinct.join(sizes, "key", "left")
    cut = (
        of_texts(sized.where(~F.coalesce("wide", F.lit(False))))
        .mapInArrow(_cut(units), "key long, n long, rid long, first int, r int, content binary")
        .repartition(n, "key")
        .sortWithinPartitions("key")
    )
    found = cut.mapInArrow(_compare(units, engine), "rid long, s int, e int")
    if sizes.where("wide").head(1):
        rows = materialize(of_texts(sized.where("wide")).mapInArrow(_windows(units), "w long, n long, rid long, s int"), "windows")
        again = materialize(rows.groupBy("w").agg(F.sum("n").alias("t")).where("t > 1").select("w"), "again")
        wide = rows.where("n = 1").join(again, "w", "left_semi")
        found = found.unionByName(wide.select("rid", "s", (F.col("s") + units.window).cast("int").alias("e")))
    spans = materialize(spans.unionByName(found).groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    discard(pieces, keys, shared, distinct, sizes)
    return spans


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts, so that few rows are Python objects at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def covered(n: int, spans: list[dict] | None) -> np.ndarray:
    """Which of ``n`` units lie in any span."""
    step = np.zeros(n + 1, np.int32)
    if spans:
        np.add.at(step, [x["s"] for x in spans], 1)
        np.add.at(step, [x["e"] for x in spans], -1)
    return np.cumsum(step[:-1]) > 0
