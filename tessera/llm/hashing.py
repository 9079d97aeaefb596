"""Hashes of the words of many texts at once, in NumPy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: A random 64-bit number per byte value.
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _BASE_INV)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


#: Longer spans are hashed in blocks: a polynomial modulo a power of two has fixed collisions, those of Thue-Morse strings, from some 512 places on.
BLOCK = 128


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """``S`` such that ``(S[j] - S[i]) * inverse_power[i]`` is a sum of bytes i to j, each times a power by its place from i."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of spans of any length: of the polynomial sums of up to ``BLOCK`` places, chained by a mix that is not linear."""
    starts, ends = np.asarray(starts), np.asarray(ends)
    _, down = powers(len(sums))
    stop = np.minimum(ends, starts + BLOCK)
    h = mix((sums[stop] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    live = np.flatnonzero(stop < ends)
    at = stop[live]
    while len(live):
        stop = np.minimum(ends[live], at + BLOCK)
        h[live] = mix(h[live] * _U(0x9FB21C651E98DF25) + mix((sums[stop] - sums[at]) * down[at] + _U(BLOCK)))
        more = stop < ends[live]
        live, at = live[more], stop[more]
    return h


def text_chunks(column: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of its texts) of runs of texts, each of at most ``max_bytes`` or one text. Null is empty."""
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + max_bytes, "right")) - 1)
        yield lo, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts, and for each text the number of words before it (one more than texts)."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets[:-1]] = True
    edge[n] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and for each text the number of words before it."""
    starts, ends, before = word_spans(data, offsets)
    return span_hashes(prefix_sums(_LOWER[data] if lower else data), starts, ends), before


def distinct(h: np.ndarray, with_first: bool = False) -> tuple[np.ndarray, ...]:
    """The distinct hashes, sorted, the place of each hash among them and, if asked for, where each stands first: ``np.unique``, by a sort of values.

    The place of a hash stands in the low bits of what is sorted. Hashes that differ in these bits alone are few, and are put in order afterwards.
    """
    order = _order(h)
    key = h[order]
    new = np.ones(len(h), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    place = np.empty(len(h), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return (key[new], place, order[new]) if with_first else (key[new], place)


def _order(h: np.ndarray) -> np.ndarray:
    """The stable order of hashes by value."""
    bits = _U(max(1, len(h) - 1).bit_length())
    low = (_U(1) << bits) - _U(1)
    mixed = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    mixed.sort()
    order = (mixed & low).astype(np.int64)
    key = h[order]
    torn = np.flatnonzero((key[1:] != key[:-1]) & (key[1:] >> bits == key[:-1] >> bits))
    if len(torn):
        again = np.flatnonzero(np.isin(key >> bits, key[torn] >> bits))
        order[again] = order[again][np.argsort(key[again], kind="stable")]
    return order


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of the ``k``-word shingles of one text, sorted; of a shorter text its whole sequence."""
    n = len(words)
    if not n:
        return words
    size = min(k, n)
    h = np.full(n - size + 1, _U(size))
    for i in range(size):
        h = mix(h * _U(0x9FB21C651E98DF25) + words[i : n - size + 1 + i])
    return np.unique(h)
