"""Texts to token ids with the tokenizers library, and ids to bytes.

Encoding whole texts spends most of its time on words that it has met before.
A byte-level BPE never merges across the boundary in front of a space that
precedes another character than white space, so a text is cut there, and the
ids of each unit are looked up or encoded once.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tessera.llm.hashing import distinct, prefix_sums, span_hashes, text_chunks

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Name of the default vocabulary file; a path may stand in its place.
DEFAULT_TOKENIZER = "byte_bpe_50k.json"
#: The id that ends every document.
END_ID = 0
#: Bytes that start a character which is no white space: ASCII above the space, and lead bytes
#: other than those of U+0080-U+00BF and U+1000-U+3FFF, where the further white space lies.
_SOLID_START = np.zeros(256, bool)
_SOLID_START[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True


def tokenizer_path(name: str) -> str:
    """A path as it is, or the place of a public vocabulary file on this machine."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class UnitEncoder:
    """Encodes columns of texts unit by unit; at most about ``max_cached`` units stay in memory.

    A unit begins at each space that a character follows which is surely no white space. There a
    token begins too: white space in front of such a space is a token of its own. Units are
    found by 64-bit hashes for a whole batch at once, and their bytes are compared: a unit that has only the hash of another is encoded on its own.
    """

    def __init__(self, name: str = DEFAULT_TOKENIZER, max_cached: int = 4_000_000):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_path(name))
        # strings that stand for one token wherever they occur: texts that hold one are encoded whole
        self._added = [t.content.encode() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._joins = not any(len(t.split()) > 1 for t in self._added)
        size = self._tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u4" if size > 1 << 16 else "<u2")
        self._max = max_cached
        # tokens that begin with a space: most units have one, at their start
        self._opens = np.zeros(size, bool)
        for token, i in self._tokenizer.get_vocab(with_added_tokens=True).items():
            self._opens[i] = token.startswith("\u0120")
        self._forget()

    def _forget(self) -> None:
        self._known, self._unit = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes, number of the unit
        # in the order in which units were learned: their ids' place in the pool, and how many
        self._at, self._count, self._pool = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, self.dtype)
        # and their bytes: where they start in the store, and how many
        self._from, self._size, self._bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def _learn(self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Encode new units of a text, many plain ones as one text whose ids are cut where a unit opens."""
        spaces = np.flatnonzero(data == 0x20)
        plain = (data[starts] == 0x20) & (np.searchsorted(spaces, ends) - np.searchsorted(spaces, starts) == 1)
        order, n_plain = np.argsort(~plain, kind="stable"), int(plain.sum())
        hashes, starts, size = hashes[order], starts[order], (ends - starts)[order]
        upto = np.cumsum(size)
        own = data[np.repeat(starts - (upto - size), size) + np.arange(int(upto[-1]))]
        raw, cuts = own.tobytes(), np.append(0, upto)
        text = lambda a, b: raw[cuts[a] : cuts[b]].decode("utf-8", "surrogatepass")
        ids, counts = [self._pool], []
        many = 256 if self._joins else 1
        for lo in range(0, n_plain, many):
            hi = min(lo + many, n_plain)
            found = np.array(self._tokenizer.encode_batch_fast([text(lo, hi)], add_special_tokens=False)[0].ids, self.dtype)
            at = np.flatnonzero(self._opens[found])
            if len(at) != hi - lo:
                raise ValueError("the vocabulary does not encode units on their own")
            ids.append(found)
            counts.append(np.diff(np.append(at, len(found))))
        rest = [text(i, i + 1) for i in range(n_plain, len(hashes))]
        ids += [np.array(e.ids, self.dtype) for e in self._tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
        count = np.concatenate([*counts, np.array([len(i) for i in ids[len(ids) - len(rest) :]], np.int64)])
        known = np.concatenate([self._known, hashes])
        by = np.argsort(known, kind="stable")
        self._known = known[by]
        self._unit = np.concatenate([self._unit, len(self._at) + np.arange(len(hashes), dtype=np.int32)])[by]
        self._at = np.concatenate([self._at, len(self._pool) + np.cumsum(count) - count])
        self._count = np.concatenate([self._count, count.astype(np.int32)])
        self._pool = np.concatenate(ids)
        self._from = np.concatenate([self._from, len(self._bytes) + upto - size])
        self._size = np.concatenate([self._size, size])
        self._bytes = np.concatenate([self._bytes, own])

    def encode(self, column: pa.Array, max_bytes: int = 4 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets of its texts' ids) of runs of texts; null is empty."""
        for lo, data, offsets in text_chunks(column, max_bytes):
            whole = self._holding_added(data, offsets)
            yield lo, *(self._mixed(data, offsets, whole) if len(whole) else self._encode(data, offsets))

    def _holding_added(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts hold the string of an added token."""
        raw, found = data.tobytes(), []
        for token in self._added:
            at = raw.find(token)
            while at >= 0:
                text = int(np.searchsorted(offsets, at, "right")) - 1
                if at + len(token) <= offsets[text + 1]:
                    found.append(text)
                    at = raw.find(token, int(offsets[text + 1]))
                else:
                    at = raw.find(token, at + 1)
        return np.unique(np.array(found, np.int64))

    def _mixed(self, data: np.ndarray, offsets: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``_encode``, with the texts ``whole`` encoded by the library in one piece each."""
        ids, counts, lo = [], np.zeros(len(offsets) - 1, np.int64), 0
        for i in [*whole.tolist(), len(counts)]:
            part, before = self._encode(data[offsets[lo] : offsets[i]], offsets[lo : i + 1] - offsets[lo])
            ids.append(part)
            counts[lo:i] = np.diff(before)
            if i < len(counts):
                text = data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "surrogatepass")
                ids.append(np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, self.dtype))
                counts[i] = len(ids[-1])
            lo = i + 1
        return np.concatenate(ids), np.append(0, np.cumsum(counts))

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, self.dtype), np.zeros(len(offsets), np.int64)
        first = np.zeros(len(data), bool)
        first[:-1] = (data[:-1] == 0x20) & _SOLID_START[data[1:]]
        starts_of_texts = offsets[:-1][np.diff(offsets) > 0]
        # a space that ends a text is followed by another text
        first[starts_of_texts[1:] - 1] = False
        first[starts_of_texts] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))
        h = span_hashes(prefix_sums(data), starts, ends)
        units, which, one = distinct(h, with_first=True)
        if len(self._known) > self._max:
            self._forget()
        place = np.minimum(np.searchsorted(self._known, units), max(0, len(self._known) - 1))
        new = np.flatnonzero(self._known[place] != units) if len(self._known) else np.arange(len(units))
        if len(new):
            self._learn(units[new], data, starts[one[new]], ends[one[new]])
            place = np.searchsorted(self._known, units)
        place = self._unit[place][which]
        at, count, pool = self._at[place], self._count[place].astype(np.int64), self._pool
        for i in self._others(data, starts, ends, place).tolist():
            own = self._tokenizer.encode(data[starts[i] : ends[i]].tobytes().decode("utf-8", "surrogatepass"), add_special_tokens=False).ids
            at[i], count[i] = len(pool), len(own)
            pool = np.concatenate([pool, np.array(own, self.dtype)])
        total = np.cumsum(count)
        ids = pool[np.repeat(at - (total - count), count) + np.arange(int(total[-1]))]
        before = np.append(0, total)
        return ids, before[np.searchsorted(starts, offsets)]

    def _others(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The units whose bytes differ from those of the known unit with their hash."""
        size = ends - starts
        fits = size == self._size[place]
        known = np.repeat(self._from[place] - starts, np.where(fits, size, 0)) + (np.arange(len(data)) if fits.all() else np.flatnonzero(np.repeat(fits, size)))
        own = data if fits.all() else data[np.repeat(fits, size)]
        wrong = np.flatnonzero(self._bytes[known] != own)
        inside = np.flatnonzero(fits)
        upto = np.cumsum(size[inside])
        return np.union1d(np.flatnonzero(~fits), inside[np.searchsorted(upto, wrong, "right")])


@lru_cache(maxsize=2)
def encoder(name: str, max_cached: int = 4_000_000) -> UnitEncoder:
    """This worker's encoder, kept for its next tasks."""
    return UnitEncoder(name, max_cached)
