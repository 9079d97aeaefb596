"""N-gram language model as a weighted backoff automaton.

Training.  Documents become blocks of about two million tokens: a dictionary of the
block's distinct words and the tokens as places in it.  Every n-gram that occurs ``min_count`` times or more in the training texts belongs to the
model, at every size of corpus: so do then the n-grams within it.  With 1 held-out texts score better, at three times the shuffle.

The automaton.  A state is a context; an arc (state, word) carries the discounted
log-probability and leads to the longest context that the text then ends in; the
failure arc of a state carries its backoff weight and leads to the state without its
first word.  At the root every word has its smoothed unigram probability.  All texts of a block walk
through it from left to right in step, each with its own state; a state without an arc for the next word takes failure arcs until one has it.

No task holds the model: a block builds the states and arcs that its own n-grams can reach.  Each block deals the sorted hashes of its own distinct n-grams out to buckets by
their first bits.  A bucket adds up the blocks' counts and answers each block in the order of its
hashes; the first block that has an n-gram owns it.  Owners add the n-gram's
discounted count, and that of the same word after the shorter context, to the sums of its context, which are dealt out
and answered in the same way: whole numbers, from which a block works out the context's backoff weight.  Buckets grow in number with the corpus, not in size.

Cases: null and empty texts are the end token alone; a null id counts as training;
rows with equal ids are scored one by one; an empty table gives an empty result; without training
tokens every token is unknown; further columns are ignored.  A very long text is one block, and so one task's memory, and is walked in
segments.  Words and n-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, spread, table
from tessera.llm.hashing import distinct, mix, text_chunks, word_hashes

END = np.uint64(1)
BLOCK_TOKENS = 2 << 20
BUCKET_TOKENS = 4 << 20
#: Tokens of a text that are walked in one go; more are walked side by side.
SEGMENT = 4096
DISCOUNT = 0.5
_BLOCK = "block long, doc_ids array<long>, held_out array<boolean>, lengths array<long>, words array<long>, tokens binary"
_DEALT = "bucket int, block long, size int, keys binary, first binary, second binary"
_ANSWER = "of long, kind int, bucket int, size int, answer binary, types long, tokens long"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _packed(x: np.ndarray) -> bytes:
    """64-bit values as zstd over their byte planes: high planes of small numbers vanish."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def _unpacked(raw: bytes, size: int, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=8 * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, size).T).reshape(-1).view(kind)


def _dealt(block: int, keys: np.ndarray, bits: int, first: np.ndarray, second: np.ndarray | None = None) -> pa.RecordBatch:
    """Sorted keys with one or two values each, a row per bucket."""
    cuts = np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys))
    rows = []
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        part = slice(cuts[b], cuts[b + 1])
        rows.append(
            (b, block, len(keys[part]), _packed(np.diff(keys[part], prepend=np.uint64(0))), _packed(first[part]), second is not None and _packed(second[part]) or b"")
        )
    fields = [f.split() for f in _DEALT.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[f for f, _ in fields])


def _bucket(rows: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's rows by block; their sizes; an order of all their keys by key, then block; the place of each in it; where keys begin."""
    rows = rows.sort_by("block")
    size = rows.column("size").to_numpy()
    key = np.concatenate([np.cumsum(_unpacked(k, n, np.uint64)) for k, n in zip(rows.column("keys").to_pylist(), size.tolist(), strict=True)])
    order = np.argsort(key, kind="stable")
    new = np.append(True, np.diff(key[order]) > 0)
    return rows, size, order, np.cumsum(new) - 1, np.flatnonzero(new)


def _values(rows: pa.Table, size: np.ndarray, name: str, kind: type) -> np.ndarray:
    return np.concatenate([_unpacked(v, n, kind) for v, n in zip(rows.column(name).to_pylist(), size.tolist(), strict=True)])


def _answers(rows: pa.Table, size: np.ndarray, kind: int, value: np.ndarray, types: int, tokens: int) -> pa.Table:
    ends, n = np.cumsum(size), len(size)
    return pa.table(
        {
            "of": rows.column("block"),
            "kind": pa.array(np.full(n, kind, np.int32)),
            "bucket": rows.column("bucket"),
            "size": rows.column("size"),
            "answer": pa.array([_packed(value[e - s : e]) for s, e in zip(size.tolist(), ends.tolist(), strict=True)], pa.binary()),
            "types": pa.array([types] + [0] * (n - 1), pa.int64()),
            "tokens": pa.array([tokens] + [0] * (n - 1), pa.int64()),
        }
    )


def _weighed(rows: pa.Table, kind: int) -> pa.Table:
    """A bucket's contexts answered with their sums at them and below them."""
    rows, size, by, group, first = _bucket(rows)
    made = []
    for i, name in enumerate(("first", "second")):
        value = np.empty(len(by), np.int64)
        value[by] = np.add.reduceat(_values(rows, size, name, np.int64)[by], first)[group]
        made.append(_answers(rows, size, 2 * kind - i, value, 0, 0))
    return pa.concat_tables(made)


def _answered(rows: pa.Table, kind: int, dtype: type) -> np.ndarray:
    """The answers of one kind to a block, in the order of the keys that it dealt out."""
    rows = rows.filter(pa.compute.equal(rows.column("kind"), kind)).sort_by("bucket")
    if not rows.num_rows:
        return np.zeros(0, dtype)
    return _values(rows, rows.column("size").to_numpy(), "answer", dtype)


def _blocks(block_tokens: int):
    """Batches of (doc_id, text, held_out) to blocks; the end token follows every document's words."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, out, lengths, hashes, held = TaskContext.get().partitionId() << 32, [], [], [], [], 0

        def block() -> pa.RecordBatch:
            words, tokens = distinct(np.concatenate(hashes))
            often = np.argsort(-np.bincount(tokens), kind="stable")  # frequent words have small places, which pack well
            rank = np.empty(len(often), np.int64)
            rank[often] = np.arange(len(often))
            values = [[number], [ids], [out], [lengths], [words[often].view(np.int64)], [_packed(rank[tokens])]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in _BLOCK.split(", ")]
            )

        for batch in batches:
            keys, flags = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for lo, data, offsets in text_chunks(batch.column(1)):
                h, before = word_hashes(data, offsets, lower=True)
                hashes.append(np.insert(h, before[1:], END))
                n = np.diff(before) + 1
                ids += keys[lo : lo + len(n)]
                out += flags[lo : lo + len(n)]
                lengths += n.tolist()
                held += len(hashes[-1])
                if held >= block_tokens:
                    yield block()
                    number, ids, out, lengths, hashes, held = number + 1, [], [], [], [], 0
        if ids:
            yield block()

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {k: batch.column(k)[i] for k in batch.schema.names}
            yield {
                "block": row["block"].as_py(),
                "doc_ids": row["doc_ids"].values,
                "held_out": row["held_out"].values.to_numpy(zero_copy_only=False).astype(bool),
                "lengths": row["lengths"].values.to_numpy(),
                "words": row["words"].values.to_numpy().view(np.uint64),
                "tokens": _unpacked(row["tokens"].as_buffer(), int(row["lengths"].values.to_numpy().sum())),
            }


def _since_start(lengths: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _grams(block: dict, order: int, least: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order from ``least`` on: the sorted hashes of a block's n-grams, the tokens that end one, and its place for each of these."""
    words = block["words"][block["tokens"]]
    since, key = _since_start(block["lengths"]), words
    for n in range(1, order + 1):
        if n > 1:
            key = np.append(np.uint64(0), mix(mix(key[:-1]) * np.uint64(0x9FB21C651E98DF25) + words[1:]))
        if n < least:
            continue
        at = np.flatnonzero(since >= n - 1)
        if n == 1:  # the dictionary has these already
            by = np.argsort(block["words"])
            rank = np.empty(len(by), np.int32)
            rank[by] = np.arange(len(by), dtype=np.int32)
            yield block["words"][by], at, rank[block["tokens"]]
        else:
            keys, place = distinct(key[at])
            yield keys, at, place


class Block:
    """A block's n-grams of each order and what the buckets answered."""

    def __init__(self, block: dict, order: int, answers: pa.Table, n_tokens: int, n_words: int):
        self.total = n_tokens + 0.1 * (n_words + 1)
        self.size = len(block["tokens"])
        self.keys, self.place, self.at, self.n, self.own = [None], [None], [None], [None], [None]
        for n, (keys, at, place) in enumerate(_grams(block, order), 1):
            answer = _answered(answers, n, np.int64)
            everywhere = np.full(self.size, -1, np.int32)
            everywhere[at] = place
            self.keys.append(keys if n < order else None)
            self.at.append(at)
            self.place.append(everywhere)
            self.n.append(answer >> 1)
            self.own.append(answer & 1 > 0)

    def p(self, n: int, at: np.ndarray) -> np.ndarray:
        """Probability on the arcs of the kept n-grams that end at these tokens."""
        count = self.n[n][self.place[n][at]]
        if n == 1:
            return (count + 0.1) / self.total
        return (count - DISCOUNT) / self.n[n - 1][self.place[n - 1][at - 1]]

    def parts(self, n: int, at: np.ndarray) -> np.ndarray:
        """The numerator of ``p`` as a whole number: over ten times the total, or twice the count of the context."""
        count = self.n[n][self.place[n][at]]
        return 10 * count + 1 if n == 1 else 2 * count - 1

    def sums(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kept contexts of ``n - 1`` words, and what this block's own arcs add to the numerators at them and below them."""
        at = self.last(n)[self.own[n]]
        context, size = self.place[n - 1][at - 1], len(self.n[n - 1])
        asked = self.contexts(n)
        made = [self.keys[n - 1][asked]]
        for k in (n, n - 1):
            total = np.zeros(size, np.int64)
            np.add.at(total, context, self.parts(k, at))
            made.append(total[asked])
        return tuple(made)

    def weights(self, n: int, answers: pa.Table) -> np.ndarray:
        """Log backoff weights of the kept contexts of ``n - 1`` words: what their arcs leave, over what lies below them."""
        mass, below = _answered(answers, -2 * n, np.int64), _answered(answers, -2 * n - 1, np.int64)
        asked = self.contexts(n)
        count = self.n[n - 1][asked]
        at = self.last(n - 1)[asked]
        under = 10 * self.total if n == 2 else 2 * self.n[n - 2][self.place[n - 2][at]]
        alpha = (2 * count - mass) / (2 * count) / np.maximum(1 - below / under, 1e-12)
        return np.log10(np.maximum(alpha, 1e-300))

    def last(self, n: int) -> np.ndarray:
        """For each n-gram a token that ends it: its parts end there or one before."""
        out = np.zeros(len(self.n[n]), np.int64)
        out[self.place[n][self.at[n]]] = self.at[n]
        return out

    def contexts(self, n: int) -> np.ndarray:
        return np.flatnonzero(self.n[n - 1] > 0)

    def automaton(self, answers: pa.Table) -> Automaton:
        """The part of the automaton that this block's texts can reach."""
        state = [np.zeros(1, np.int64)]  # of each order's n-grams: their state, 0 (the root) where there is none
        fail, weight, made = [np.zeros(1, np.int64)], [np.zeros(1)], 1
        arcs = []
        for n in range(1, len(self.n)):
            known = self.n[n] > 0
            last = self.last(n)
            own = np.zeros(len(known), np.int64)
            if n < len(self.n) - 1:
                own[known] = made + np.arange(int(known.sum()))
                made += int(known.sum())
                fail.append(np.zeros(int(known.sum()), np.int64) if n == 1 else state[n - 1][self.place[n - 1][last[known]]])
                weight.append(self.weights(n + 1, answers))
            if n > 1:
                at = last[known]
                source = state[n - 1][self.place[n - 1][at - 1]]
                # the longest context that the text ends in after the arc: the n-gram itself, or, of full length, without its first word
                target = own[known] if n < len(self.n) - 1 else state[n - 1][self.place[n - 1][at]]
                arcs.append((source, self.place[1][at].astype(np.int64), np.log10(self.p(n, at)), target))
            state.append(own)
        start = self.last(1)
        parts = [np.concatenate(x) for x in zip(*arcs, strict=True)] if arcs else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] + [np.zeros(0, np.int64)]
        return Automaton(np.concatenate(fail), np.concatenate(weight), *parts, np.log10(self.p(1, start)), state[1] if len(self.n) > 2 else np.zeros(len(start), np.int64))


class Automaton:
    """States with arcs (source, word) of a log probability to a target, and a failure arc each; the root, 0, has an arc for every word."""

    def __init__(self, fail, weight, source, word, log_p, target, root_p, root_target):
        self.fail, self.weight, self.root_p, self.root_target = fail, weight, root_p, root_target
        self.words = np.int64(len(root_p))
        key = source * self.words + word
        by = np.argsort(key)
        self.key, self.log_p, self.target = key[by], log_p[by], target[by]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log probabilities of a word each, by failure arcs where a state has no arc for it, and the states after it."""
        out, after, open_ = np.zeros(len(state)), np.zeros(len(state), np.int64), np.arange(len(state))
        while len(open_):
            at_root = state[open_] == 0
            own = open_[at_root]
            out[own] += self.root_p[word[own]]
            after[own] = self.root_target[word[own]]
            open_ = open_[~at_root]
            if not len(open_):
                break
            asked = state[open_] * self.words + word[open_]
            spot = np.minimum(np.searchsorted(self.key, asked), max(0, len(self.key) - 1))
            there = self.key[spot] == asked if len(self.key) else np.zeros(len(open_), bool)
            own = open_[there]
            out[own] += self.log_p[spot[there]]
            after[own] = self.target[spot[there]]
            open_ = open_[~there]
            out[open_] += self.weight[state[open_]]
            state = state.copy()
            state[open_] = self.fail[state[open_]]
        return out, after

    def score(self, words: np.ndarray, lengths: np.ndarray, warm: int, longest: int = SEGMENT) -> np.ndarray:
        """The log probability of each text: one traversal from left to right, all texts in step.

        A long text is walked in segments side by side. A state knows no more than the last ``warm`` words, so a segment starts that many earlier
        at the root and is in the text's own state when its count begins.
        """
        pieces = -(-lengths // longest)
        text = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = (np.cumsum(lengths) - lengths)[text]
        count_from = begin + nth * longest
        stop = np.minimum(count_from + longest, begin + lengths[text])
        at = np.maximum(begin, count_from - warm)
        by = np.argsort(at - stop, kind="stable")  # the longest first, so that those under way are a prefix
        at, stop, count_from = at[by], stop[by], count_from[by]
        total, state = np.zeros(len(at)), np.zeros(len(at), np.int64)
        live = len(at)
        while live:
            while live and at[live - 1] >= stop[live - 1]:
                live -= 1
            part = slice(0, live)
            log_p, state[part] = self.step(state[part], words[at[part]])
            total[part] += np.where(at[part] >= count_from[part], log_p, 0.0)
            at[part] += 1
        return np.bincount(text[by], total, len(lengths))


def _freed(df: DataFrame, name: str) -> DataFrame:
    """``materialize``, without the shuffle files once the table is written."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return materialize(df, name, compression="zstd")
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = 3,
    min_count: int = 2,
    folds: int = 10,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Scores of all texts under the model of those whose ``crc32(id as text) mod folds`` is not 0; ``mean_score`` is the score of a token."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))
    blocks = materialize(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held.alias("held_out")).mapInArrow(
            _blocks(block_tokens), _BLOCK
        ),
        "blocks",
        compression="zstd",
    )
    n_all = blocks.agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = max(6, int(n_all // BUCKET_TOKENS).bit_length())
    counted = None
    for n in range(1, order + 1):

        def deal(batches: Iterator[pa.RecordBatch], n: int = n) -> Iterator[pa.RecordBatch]:
            for b in _rows(batches):
                ((keys, at, place),) = _grams(b, n, n)
                train = np.repeat(~b["held_out"], b["lengths"])[at]
                yield _dealt(b["block"], keys, bits, np.bincount(place[train], minlength=len(keys)))

        def count(key: tuple, rows: pa.Table) -> pa.Table:
            n = key[0].as_py()
            rows, size, by, group, first = _bucket(rows)
            total = np.add.reduceat(_values(rows, size, "first", np.int64)[by], first)
            types, tokens = int((total > 0).sum()), int(total.sum())
            total[total < (min_count if n > 1 else 1)] = 0
            value = np.empty(len(by), np.int64)
            value[by] = 2 * total[group]
            value[by[first]] += total > 0  # the first block owns it
            return _answers(rows, size, n, value, types, tokens)

        part = _freed(blocks.mapInArrow(deal, _DEALT).groupBy(F.lit(n).alias("kind"), "bucket").applyInArrow(count, _ANSWER), f"counts_{n}")
        counted = part if counted is None else counted.unionByName(part)
    sums = counted.where("kind = 1").agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    n_tokens, n_words = sums["n"] or 0, sums["v"] or 0

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for b in _rows(left.to_batches()):
            block = Block(b, order, right, n_tokens, n_words)
            for n in range(2, order + 1):
                keys, mass, below = block.sums(n)
                part = _dealt(b["block"], keys, bits, mass, below)
                made.append(pa.Table.from_batches([part]).append_column("kind", pa.array(np.full(part.num_rows, -n, np.int32))))
        return pa.concat_tables(made)

    def weigh(key: tuple, rows: pa.Table) -> pa.Table:
        return _weighed(rows, key[0].as_py())

    def answered(answers: DataFrame, run, schema: str) -> DataFrame:
        return blocks.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(run, schema)

    weights = _freed(answered(counted, contexts, f"{_DEALT}, kind int").groupBy("kind", "bucket").applyInArrow(weigh, _ANSWER), "weights")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        made = []
        for b in _rows(left.to_batches()):
            block = Block(b, order, right, n_tokens, n_words)
            lengths, every = b["lengths"], np.arange(len(b["tokens"]))
            cuts = np.cumsum(lengths) - lengths
            made.append(
                pa.table(
                    {
                        "doc_id": b["doc_ids"],
                        "held_out": pa.array(b["held_out"]),
                        "n_tokens": pa.array(lengths),
                        "n_known": pa.array(np.add.reduceat(block.n[1][block.place[1]] > 0, cuts, dtype=np.int64)),
                        "train_tokens": pa.array(np.full(len(lengths), n_tokens)),
                        "base_score": pa.array(np.add.reduceat(np.log10(block.p(1, every)), cuts)),
                        "score": pa.array(block.automaton(right).score(block.place[1].astype(np.int64), lengths, order - 1)),
                    }
                )
            )
        return pa.concat_tables(made)

    scored = answered(
        counted.unionByName(weights),
        run,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
    return scored.withColumn("mean_score", F.col("score") / F.col("n_tokens"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spread(table(spark, sf_dir, "documents")))
