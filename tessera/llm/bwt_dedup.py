"""Byte strings that repeat, by merging Burrows-Wheeler transforms of shards.

A window of 400 bytes is four symbols of 100 bytes.  Each piece of text (see
``repeats``) is read as 100 strings of such symbols, one for each place in a
symbol to start from, so that every byte starts one suffix.  The pieces of a batch are shards by
the row they come from; each shard is sorted once and kept as its transform: of every
suffix, in order, the symbol in front of it.

The merge never compares suffixes of different shards.  It starts with the
shards one after another and refines the interleaving: read the transforms in
the present order, and put each symbol's suffix into the symbol's bucket in the order read.
After h rounds the order is that of the first h symbols, and a border between
neighbours that first shows in round h is a common prefix of h - 1
symbols.  After four rounds the suffixes between two borders are equal windows.

Cases: as in ``substring_dedup``, with bytes of UTF-8 in place of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table
from tessera.llm.hashing import powers, prefix_sums
from tessera.llm.repeats import Units, bucketed, covered, repeated_spans, runs_of, slices

WINDOW = 400
SYMBOL = 100
SHARDS = 4


class Shard:
    """Suffixes of a shard's strings in order, and the transform. Position ``-1`` and symbol 0 stand for string ends."""

    def __init__(self, symbols: np.ndarray, length: np.ndarray, positions: np.ndarray, step: int, depth: int, last: np.ndarray, first: np.ndarray):
        """symbols: rank (from 1) of the symbol at each position of the batch; length: symbols from there to its string's end.
        positions: of the shard's suffixes; last, first: positions of the last and first symbols of its strings."""
        keys = [
            np.where(d < length[positions], symbols[np.minimum(positions + d * step, len(symbols) - 1)], 0)
            for d in range(depth - 1, -1, -1)
        ]
        order = np.lexsort(keys)
        self.positions = np.concatenate([np.full(len(last), -1), positions[order]])
        before = symbols[np.maximum(positions[order] - step, 0)]
        before[np.isin(positions[order], first, assume_unique=True)] = 0
        self.transform = np.concatenate([symbols[last], before])
        self.ends = len(last)


def merge(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each suffix, common prefix with the suffix before, in symbols) after ``rounds`` refinements; -1: so many or more."""
    sizes = np.array([len(s.transform) for s in shards])
    base = np.cumsum(sizes) - sizes
    transform = np.concatenate([s.transform for s in shards])
    ends = np.repeat(np.arange(len(shards)), [s.ends for s in shards])
    own = np.repeat(np.arange(len(shards)), sizes)
    block = np.zeros(len(own), np.int64)
    common = np.full(len(own), -1, np.int64)
    for h in range(1, rounds + 1):
        source = np.empty(len(own), np.int64)
        for s in range(len(shards)):
            mine = own == s
            source[mine] = base[s] + np.arange(sizes[s])
        symbol = transform[source]
        go = np.flatnonzero(symbol > 0)
        order = go[np.argsort(symbol[go], kind="stable")]
        border = np.ones(len(order), bool)
        border[1:] = (symbol[order][1:] != symbol[order][:-1]) | (block[order][1:] != block[order][:-1])
        own = np.concatenate([ends, own[order]])
        border = np.concatenate([np.ones(len(ends), bool), border])
        common[border & (common < 0)] = h - 1
        block = np.cumsum(border)
    return own, common


def bwt_engine(window: int, step: int = SYMBOL, n_shards: int = SHARDS):
    depth = window // step
    assert depth * step == window

    def engine(texts: list[np.ndarray]) -> list[np.ndarray]:
        joined = np.concatenate(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(lengths) - lengths
        owner = np.repeat(np.arange(len(texts)), lengths)
        left = (starts + lengths)[owner] - np.arange(len(joined))
        sums = prefix_sums(joined)
        _, down = powers(len(sums))
        symbols = np.zeros(len(joined), np.int64)
        fits = np.flatnonzero(left >= step)
        symbols[fits] = np.unique((sums[fits + step] - sums[fits]) * down[fits], return_inverse=True)[1] + 1
        again = np.zeros(len(joined), bool)
        # a window with a symbol that stands nowhere else is alone: only the stretches of the others are sorted
        shared = np.bincount(symbols)[symbols] > 1
        at = np.flatnonzero(left >= window)
        for d in range(depth):
            at = at[shared[at + d * step]]
        if len(at):
            text, first = np.unique(owner[at], return_index=True)
            last = np.append(first[1:], len(at)) - 1
            size = at[last] - at[first] + window
            within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            where = np.repeat(at[first], size) + within
            found = _merged(symbols[where], size, text % n_shards)
            again[where[found]] = True
        return [again[a : a + n - window + 1] for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]

    def _merged(symbols: np.ndarray, lengths: np.ndarray, shard_of: np.ndarray) -> np.ndarray:
        """Positions of the joined stretches where a window starts that starts elsewhere too."""
        starts = np.cumsum(lengths) - lengths
        left = np.repeat(starts + lengths, lengths) - np.arange(len(symbols))
        symbols = np.where(left >= step, symbols, 0)
        fits = np.flatnonzero(left >= step)
        # strings of a text: the suffixes at its first `step` places; each ends at the last place of its residue that fits
        offset = np.arange(step)
        first = (starts[:, None] + offset).reshape(-1)
        count = (np.repeat(lengths, step) - np.tile(offset, len(lengths)) - step) // step  # symbols after the first
        last = first + count * step
        string_shard, place_shard = np.repeat(shard_of, step), np.repeat(shard_of, lengths)
        shards = [
            Shard(symbols, left // step, fits[place_shard[fits] == s], step, depth, last[string_shard == s], first[string_shard == s])
            for s in range(n_shards)
            if (shard_of == s).any()
        ]
        own, common = merge(shards, depth)
        block = np.cumsum(common >= 0)  # repeated intervals: suffixes that share a whole window with the one before
        # the k-th suffix of a shard in the merged order is the k-th of the shard's own order
        position = np.empty(len(own), np.int64)
        for s, shard in enumerate(shards):
            position[own == s] = shard.positions
        whole = position >= 0
        whole[whole] = left[position[whole]] >= window
        size = np.bincount(block[whole], minlength=int(block[-1]) + 1)
        return position[whole & (size[block] > 1)]

    return engine


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = 32, step: int = SYMBOL) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay), kept_sha256."""
    units = Units("bytes", window, gram)
    texts = bucketed(docs, id_col, text_col, "byte_texts")
    spans = repeated_spans(texts, units, bwt_engine(window, step))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, gone, runs, kept = [], [], [], []
            for value, found in zip(batch.column(1), batch.column(2), strict=True):
                data = value.as_buffer().to_pybytes()
                n.append(len(data))
                if found.is_valid:
                    out = covered(len(data), found.as_py())
                    gone.append(int(out.sum()))
                    runs.append(len(runs_of(out)[0]))
                    data = np.frombuffer(data, np.uint8)[~out].tobytes()
                else:
                    gone.append(0)
                    runs.append(0)
                kept.append(data)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array(x, pa.int64()) for x in (n, gone, runs)],
                    pa.array(kept, pa.binary()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                ],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )

    return (
        texts.join(spans, "rid", "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")
    )


def op9_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
