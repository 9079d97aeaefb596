"""Benchmark decontamination by CGK embedding and bit sampling.

A document is contaminated by an item if some stretch of it is within
``max_ratio`` of the item's length in edit distance (both in lower case, white space runs as one
space, bytes).

1.  Where windows of an item's size can stand: with k edits allowed, an item is cut into k + 1 segments, of
    which one occurs unchanged.  Of such segments there is one after which the next has at most one edit (of
    k + 1 numbers on a ring that sum to k, some start keeps every running sum below its length).  Both
    are conditions that every match meets at one seed at least, so no match is lost here.
2.  The CGK walk embeds window and item, outward from the seed in both directions, where they are aligned: at each step it writes
    the current byte and moves on or stays by a random bit that depends on step and byte, so
    that few edits leave most places equal.
3.  Samples of the places, repeated, are the locality-sensitive hash: a window goes on if any
    sample agrees whole.
4.  Myers' bit-parallel automaton then finds the exact edit distance in a stretch that holds every match with this seed.

The items are taken in blocks of bounded size; each block goes to all tasks and is indexed once in a worker. A benchmark of
up to ``BLOCK_BYTES`` is one block and takes one scan of the documents.

Cases: null and empty texts and items match nothing; items too short for an edit match exactly; rows with equal ids are
compared one by one and give one row per document id and item; an empty
table on either side gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import spread, table
from tessera.llm.hashing import _LOWER, powers, prefix_sums

_FILTER_BITS = 22
_LOWER_TABLE = _LOWER.tobytes()
BLOCK_BYTES = 32 << 20
#: Places of CGK walks, seed hits and bytes of text that are held at a time.
_WALK_PLACES, _HITS, _TEXT_BYTES = 1 << 24, 1 << 20, 1 << 22
#: Longest seed; a longer segment is compared after its seed is found.
_SEED = 12
#: Steps after which the random moves repeat.
_MOVES = 1024


def normal(text: str | None) -> bytes:
    """Lower case A-Z, runs of ASCII white space as one space."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_LOWER_TABLE).split())


def nearest(item: bytes, text: bytes) -> tuple[int, int]:
    """The least edit distance of ``item`` to any stretch of ``text``, and where the first such stretch ends."""
    m = len(item)
    if not m:
        return 0, 0
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < best:
            best, end = score, j + 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
    return best, end


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another with a zero byte at the end, and where each begins (one more than texts)."""
    return np.frombuffer(b"".join([*texts, b"\0"]), np.uint8), np.cumsum([0, *map(len, texts)])


class ItemIndex:
    """A block of items: their segments' seeds, and the places that are sampled."""

    def __init__(self, items: list[tuple[int, bytes]], max_ratio: float, walks: int, samples: int, bits: int):
        self.items = [(i, t) for i, t in items if t]
        self.walks, self.samples, self.bits = walks, samples, bits
        self.data, begins = _flat([t for _, t in self.items])
        self.begin, self.length = begins[:-1], np.diff(begins)
        self.edits = np.minimum(np.floor(self.length * max_ratio).astype(np.int64), self.length - 1)
        # segments: item, first byte in the item, bytes
        parts = self.edits + 1
        self.item = np.repeat(np.arange(len(self.items)), parts)
        nth = np.arange(len(self.item)) - np.repeat(np.cumsum(parts) - parts, parts)
        m, n = self.length[self.item], parts[self.item]
        self.place = nth * m // n
        self.size = (nth + 1) * m // n - self.place
        self.has_next = nth + 1 < n
        seed = np.minimum(m // n, _SEED)
        sums = prefix_sums(self.data)
        self.seeds = {}
        for length in np.unique(seed).tolist():
            own = np.flatnonzero(seed == length)
            at = self.begin[self.item[own]] + self.place[own]
            h = self._hash(sums, at, length)
            order = np.argsort(h, kind="stable")
            there = np.zeros(1 << _FILTER_BITS, bool)
            there[self._slot(h)] = True
            self.seeds[length] = (h[order], own[order], there)
        rng = np.random.default_rng(7)
        self.moves = rng.integers(0, 2, (walks, _MOVES, 256), dtype=np.int8)
        self.sampled = rng.random((walks, samples * bits))

    @staticmethod
    def _hash(sums: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        _, down = powers(len(sums))
        return (sums[at + length] - sums[at]) * down[at]

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)

    def hits(self, data: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(segment, place in the texts) wherever a seed occurs, in parts of bounded size."""
        sums = prefix_sums(data[:-1])
        for length, (known, own, there) in self.seeds.items():
            if len(data) <= length:
                continue
            h = self._hash(sums, np.arange(len(data) - length), length)
            at = np.flatnonzero(there[self._slot(h)])
            left = np.searchsorted(known, h[at], "left")
            count = np.searchsorted(known, h[at], "right") - left
            text = np.searchsorted(begins, at, "right") - 1
            count[at + length > begins[text + 1]] = 0
            total = np.cumsum(count)
            lo = 0
            while lo < len(at):
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + _HITS, "right")))
                n = count[lo:hi]
                of = np.repeat(np.arange(lo, hi), n)
                yield own[left[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)], at[of]
                lo = hi

    def _same(self, segment: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the whole segments stand at these places."""
        first, size = self.begin[self.item[segment]] + self.place[segment], self.size[segment]
        good = at + size < len(data)
        for j in range(int(size.max(initial=0))):
            on = np.flatnonzero(good & (j < size))
            good[on] = self.data[first[on] + j] == data[at[on] + j]
        return good

    def _nearly_same(self, segment: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the segments stand at these places with at most one edit."""
        first, size = self.begin[self.item[segment]] + self.place[segment], self.size[segment]
        top = len(data) - 1
        # bytes that agree from the start: where they end one byte may change, be missing or be added
        agree, live = np.zeros(len(segment), np.int64), np.arange(len(segment))
        for j in range(int(size.max(initial=0))):
            live = live[j < size[live]]
            live = live[self.data[first[live] + j] == data[np.minimum(at[live] + j, top)]]
            agree[live] += 1
        good = agree >= size - 1
        for item_skip, text_skip in ((1, 1), (1, 0), (0, 1)):
            rest = np.flatnonzero(~good)
            j = agree[rest]
            while len(rest):
                over = j + item_skip >= size[rest]
                good[rest[over]] = True
                rest, j = rest[~over], j[~over]
                same = self.data[first[rest] + j + item_skip] == data[np.minimum(at[rest] + j + text_skip, top)]
                rest, j = rest[same], j[same] + 1
        return good

    def candidates(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, segment, place in the texts); of seeds that give one item the same place in a text, one."""
        found = []
        for segment, at in self.hits(data, begins):
            same = self._same(segment, data, at)
            segment, at = segment[same], at[same]
            # after the last segment comes the first, whose place is not known to the byte: not tested
            keep = ~self.has_next[segment]
            ask = np.flatnonzero(~keep)
            keep[ask] = self._nearly_same(segment[ask] + 1, data, at[ask] + self.size[segment[ask]])
            found.append((segment[keep], at[keep]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        segment, at = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        text = np.searchsorted(begins, at, "right") - 1
        inside = at + self.size[segment] <= begins[text + 1]
        segment, at, text = segment[inside], at[inside], text[inside]
        offset, item = at - self.place[segment], self.item[segment]
        order = np.lexsort((self.place[segment], offset, item, text))
        segment, at, text, offset, item = (x[order] for x in (segment, at, text, offset, item))
        new = np.ones(len(at), bool)
        new[1:] = (offset[1:] != offset[:-1]) | (item[1:] != item[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        middle = first + np.diff(np.append(first, len(at))) // 2
        return text[middle], segment[middle], at[middle]

    def _walk(self, data: np.ndarray, at: np.ndarray, end: np.ndarray, way: int, walk: int, steps: int) -> np.ndarray:
        """The bytes that a CGK walk from ``at`` towards ``end`` (exclusive) writes, a row each; zero past the end."""
        out = np.zeros((len(at), steps), np.uint8)
        at = at.copy()
        live = np.flatnonzero((end - at) * way > 0)
        for t in range(steps):
            if not len(live):
                break
            c = data[at[live]]
            out[live, t] = c
            at[live] += way * self.moves[walk, t % _MOVES][c]
            live = live[(end[live] - at[live]) * way > 0]
        return out

    def _embedded(self, data: np.ndarray, seed: np.ndarray, lo: np.ndarray, hi: np.ndarray, ahead: np.ndarray, behind: np.ndarray, walk: int) -> np.ndarray:
        """Sampled places of the walks from each seed on to ``hi`` and back to ``lo``, of 2 steps for each byte of the item there."""
        right, left = 2 * ahead, 2 * behind
        spot = (self.sampled[walk] * (right + left)[:, None]).astype(np.int64)
        on = self._walk(data, seed, hi, 1, walk, max(1, int(right.max())))
        back = self._walk(data, seed - 1, lo - 1, -1, walk, max(1, int(left.max())))
        forward = spot < right[:, None]
        a = np.take_along_axis(on, np.where(forward, spot, 0), axis=1)
        b = np.take_along_axis(back, np.where(forward, 0, spot - right[:, None]), axis=1)
        return np.where(forward, a, b)

    def agreeing(self, data: np.ndarray, begins: np.ndarray, text: np.ndarray, segment: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which windows share a whole sample with their item in any walk."""
        item, behind = self.item[segment], self.place[segment]
        ahead = self.length[item] - behind
        lo, hi = np.maximum(begins[text], at - behind), np.minimum(begins[text + 1], at + ahead)
        start = self.begin[item]
        good = np.zeros(len(at), bool)
        for w in range(self.walks):
            some = np.flatnonzero(~good)
            if not len(some):
                break
            ours = self._embedded(data, at[some], lo[some], hi[some], ahead[some], behind[some], w)
            theirs = self._embedded(self.data, (start + behind)[some], start[some], (start + self.length[item])[some], ahead[some], behind[some], w)
            good[some] = (ours == theirs).reshape(len(some), self.samples, self.bits).all(axis=2).any(axis=1)
        return good

    def matches(self, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(text, item, edit distance) of every confirmed stretch."""
        if not self.items or not texts:
            return
        data, begins = _flat(texts)
        text, segment, at = self.candidates(data, begins)
        by = np.argsort(self.length[self.item[segment]], kind="stable")
        good, lo = np.zeros(len(by), bool), 0
        while lo < len(by):
            # as many windows at a time as the longest of them leaves room for
            hi = min(len(by), lo + 4096)
            while hi > lo + 1 and (hi - lo) * 4 * int(self.length[self.item[segment[by[hi - 1]]]]) > _WALK_PLACES:
                hi = lo + max(1, (hi - lo) // 2)
            part = by[lo:hi]
            good[part] = self.agreeing(data, begins, text[part], segment[part], at[part])
            lo = hi
        text, item, offset = text[good], self.item[segment[good]], (at - self.place[segment])[good]
        k = self.edits[item]
        order = np.lexsort((offset // (k + 1), item, text))
        text, item, offset, k = (x[order] for x in (text, item, offset, k))
        cell = offset // (k + 1)
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (cell[1:] != cell[:-1])
        for g in np.split(np.arange(len(text)), np.flatnonzero(new)[1:]) if len(text) else []:
            d, i, slack = int(text[g[0]]), int(item[g[0]]), int(k[g[0]])
            wanted, base = self.items[i][1], int(begins[d])
            first, last = int(offset[g].min()) - base - slack, int(offset[g].max()) - base + len(wanted) + slack
            stretch = texts[d][max(0, first) : max(0, last)]
            distance = 0 if wanted in stretch else nearest(wanted, stretch)[0]
            if distance <= slack:
                yield d, i, distance


_built: dict[str, ItemIndex] = {}


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    max_ratio: float = 0.1,
    walks: int = 4,
    samples: int = 64,
    bits: int = 3,
) -> DataFrame:
    """doc_id, item_id, n_edits: documents with a stretch within ``max_ratio`` edits of an item.

    ``walks`` embeddings with ``samples`` samples of ``bits`` places each: a window whose embedding
    differs from the item's in a share h of places is missed with probability
    ``(1 - (1 - h)**bits) ** (walks * samples)``: 4e-8 at h = 0.6, 0.001 at h = 0.7.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null")
    size = asked.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = int(size // BLOCK_BYTES) + 1
    found = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about BLOCK_BYTES
        index_args = ([(r["item_id"], normal(r["text"])) for r in rows], max_ratio, walks, samples, bits)

        def run(batches: Iterator[pa.RecordBatch], args: tuple = index_args, name: str = uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            if name not in _built:  # one block's index stays in a worker
                _built.clear()
                _built[name] = ItemIndex(*args)
            index = _built[name]
            for batch in batches:
                ids, texts, held, out = [], [], 0, []
                rows = zip(batch.column(0).to_pylist(), batch.column(1), strict=True)
                for key, value in rows:
                    texts.append(normal(value.as_py()))
                    ids.append(key)
                    held += len(texts[-1])
                    if held > _TEXT_BYTES:
                        out += [(ids[d], index.items[i][0], n) for d, i, n in index.matches(texts)]
                        ids, texts, held = [], [], 0
                out += [(ids[d], index.items[i][0], n) for d, i, n in index.matches(texts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in out], pa.int64()) for k in range(3)], names=["doc_id", "item_id", "n_edits"]
                )

        part = plain.mapInArrow(run, "doc_id long, item_id long, n_edits long")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.min("n_edits").alias("n_edits"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
