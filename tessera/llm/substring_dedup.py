"""Word windows that repeat, by prefix-partitioned suffix trees.

A group of suffixes shares its prefix, the minimizer of its windows (see
``repeats``); prefixes of groups that are too large for memory are longer.  For
each batch of whole groups the subtree is built, and the leaves below its inner nodes that are as deep as a
window or deeper are the places of repeats; overlapping ones join to maximal repeats.

Cases: null and empty texts, and those shorter than a window, lose nothing; equal rows lose their
whole text if it has a window; ids may be null or repeat; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import table
from tessera.llm.repeats import Units, bucketed, covered, repeated_spans, slices

WINDOW = 35


class Subtree:
    """The suffix tree of some texts as the order of their suffixes and the string depth at which neighbours part.

    Inner nodes are the stretches of this order whose neighbours all share a prefix; the leaves below are
    the stretch.  Suffixes end with their text. Ranks of prefixes of 1, 2, 4, ... units give the order, and,
    from the longest to the shortest, the common prefixes.
    """

    def __init__(self, texts: list[np.ndarray]):
        lengths = np.array([len(t) for t in texts])
        self.left = np.repeat(np.cumsum(lengths), lengths) - np.arange(int(lengths.sum()))  # units up to the end of the text
        ranks = [np.unique(np.concatenate(texts), return_inverse=True)[1].astype(np.int64)]
        while 1 << (len(ranks) - 1) < int(lengths.max()):
            step, last = 1 << (len(ranks) - 1), ranks[-1]
            further = np.zeros(len(last), np.int64)
            on = np.flatnonzero(self.left > step)
            further[on] = last[on + step] + 1
            ranks.append(np.unique(last * np.int64(len(last) + 1) + further, return_inverse=True)[1].astype(np.int64))
        self.order = np.argsort(ranks[-1], kind="stable")
        a, b = self.order[:-1], self.order[1:]
        most = np.minimum(self.left[a], self.left[b])
        self.depth = np.zeros(len(a), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            on = np.flatnonzero(self.depth < most)
            same = on[ranks[level][a[on] + self.depth[on]] == ranks[level][b[on] + self.depth[on]]]
            self.depth[same] = np.minimum(self.depth[same] + (1 << level), most[same])

    def nodes(self, depth: int) -> list[tuple[int, np.ndarray]]:
        """The topmost nodes of at least ``depth``: how long a prefix their leaves share, and the leaves' positions."""
        deep = np.concatenate([[False], self.depth >= depth, [False]])
        first, last = np.flatnonzero(deep[1:] & ~deep[:-1]), np.flatnonzero(deep[:-1] & ~deep[1:])
        return [(int(self.depth[a:b].min()), self.order[a : b + 1]) for a, b in zip(first.tolist(), last.tolist(), strict=True)]

    def repeated(self, depth: int) -> np.ndarray:
        """For every position whether it is a leaf below a node of at least ``depth``: so many units from there on occur elsewhere."""
        out, deep = np.zeros(len(self.order), bool), self.depth >= depth
        out[self.order[:-1][deep]] = True
        out[self.order[1:][deep]] = True
        return out


def suffix_tree_engine(window: int):
    def engine(texts: list[np.ndarray]) -> list[np.ndarray]:
        again, out, at = Subtree(texts).repeated(window), [], 0
        for t in texts:
            out.append(again[at : at + len(t) - window + 1])
            at += len(t)
        return out

    return engine


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = 8) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space), kept_sha256."""
    units = Units("words", window, gram)
    texts = bucketed(docs, id_col, text_col, "word_texts")
    spans = repeated_spans(texts, units, suffix_tree_engine(window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, gone, kept = [], [], []
            for value, found in zip(batch.column(1), batch.column(2), strict=True):
                words = value.as_buffer().to_pybytes().split()
                n.append(len(words))
                if found.is_valid:
                    out = covered(len(words), found.as_py())
                    gone.append(int(out.sum()))
                    words = [w for w, x in zip(words, out.tolist(), strict=True) if not x]
                else:
                    gone.append(0)
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(gone, pa.int64()),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    return (
        texts.join(spans, "rid", "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string")
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP5_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(words, i, i + 34), ' ')) AS k
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 33)) AS i FROM w WHERE len(words) >= 35)
), again AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM windows WHERE k IN (SELECT k FROM again)
), marked AS (
  SELECT p.doc_id, p.j, p.word, g.j IS NOT NULL AS is_gone
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS j FROM w) p
  LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.j = p.j
), kept AS (
  SELECT doc_id, CAST(count(*) FILTER (is_gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT is_gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
