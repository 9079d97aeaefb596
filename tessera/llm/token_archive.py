"""Token ids in an archive coded with static range asymmetric numeral systems.

Documents are dealt out by ranges of their ids, encoded once, and gathered into
blocks of whole documents.  Token counts over all blocks give one shared
frequency table.  Every block is then coded on its own, its tokens dealt to interleaved lanes
whose states share one stream of 32-bit words; checkpoints hold the lanes'
states and the place in the stream, so a reader may start at any of them, and
each segment between checkpoints has a CRC-32.

The archive is two Parquet tables below one folder: ``table`` (token, frequency, bits)
and ``blocks`` (one row per block).  Tasks only read and write these tables, so a lost executor
costs its own tasks.

Cases: a null or empty text is the end id alone; equal ids keep all their rows, in
order of their texts; null ids come first; an empty table gives an archive without blocks;
further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import delete_path, new_path, table, tasks_for
from tessera.llm.tokens import DEFAULT_TOKENIZER, END_ID, encoder

LANES = 512
SEGMENT_STEPS = 256  # steps of all lanes from one checkpoint to the next
BLOCK_TOKENS = 1 << 18
_LOW = np.uint64(1 << 32)
_MASK32 = np.uint64(0xFFFFFFFF)


def quantize(counts: np.ndarray, bits: int) -> np.ndarray:
    """Frequencies that sum to ``2**bits``, at least 1 for each counted token."""
    total, size = int(counts.sum()), 1 << bits
    used = np.flatnonzero(counts)
    if len(used) > size:
        raise ValueError(f"{len(used)} tokens don't fit {bits} bits")
    out = np.zeros(len(counts), np.int64)
    if total == 0:
        return out
    out[used] = np.maximum(1, counts[used].astype(np.float64) * size / total).astype(np.int64)
    order = used[np.argsort(-counts[used], kind="stable")]
    left = size - int(out.sum())
    if left > 0:
        out[order[0]] += left
    while left < 0:  # take from the most frequent, never below 1
        spare = np.minimum(out[order] - 1, np.maximum(1, out[order] // 64))
        cut = np.minimum(spare, np.maximum(0, -left - (np.cumsum(spare) - spare)))
        out[order] -= cut
        left += int(cut.sum())
    return out


class Coder:
    """Encodes and decodes blocks under one frequency table."""

    def __init__(self, freq: np.ndarray, bits: int):
        self.bits = np.uint64(bits)
        self.freq = freq.astype(np.uint64)
        self.cum = (np.cumsum(freq) - freq).astype(np.uint64)
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self.limit_shift = np.uint64(64 - bits)
        self.slot_mask = np.uint64((1 << bits) - 1)
        self.rest = np.uint64(1 << bits) - self.freq

    def encode(self, ids: np.ndarray, lanes: int = LANES, segment: int = SEGMENT_STEPS) -> dict:
        """A block as its words, and the decoder's states and word offsets at each checkpoint."""
        n = len(ids)
        steps = -(-n // lanes)
        state = np.full(lanes, _LOW, np.uint64)
        parts, marks, written = [], [], 0
        span = lanes * segment
        for lo in range((steps - 1) // segment * span, -1, -span):
            here = ids[lo : lo + span]
            freq, rest, cum = self.freq[here], self.rest[here], self.cum[here]
            for i in range((len(here) - 1) // lanes * lanes, -1, -lanes):
                f = freq[i : i + lanes]
                x = state[: len(f)]
                over = np.flatnonzero((x >> self.limit_shift) >= f)
                if len(over):
                    full = x[over]
                    parts.append((full & _MASK32).astype("<u4"))
                    written += len(full)
                    x[over] = full >> np.uint64(32)
                # (x // f << bits) + x % f + cum
                q = x // f
                q *= rest[i : i + lanes]
                x += q
                x += cum[i : i + lanes]
            marks.append((written, state.astype("<u8").tobytes()))
        words = np.concatenate(parts[::-1]) if parts else np.zeros(0, "<u4")
        marks = marks[::-1]
        return {
            "n_tokens": n,
            "lanes": lanes,
            "segment": segment,
            "words": words.tobytes(),
            "word_at": [written - w for w, _ in marks],
            "states": [s for _, s in marks],
            "crcs": [zlib.crc32(ids[i : i + span].astype("<u4")) for i in range(0, n, span)],
        }

    def decode_segment(self, block: dict, number: int) -> np.ndarray:
        """The ids from checkpoint ``number`` to the next; raises if their checksum differs."""
        lanes, segment, n = block["lanes"], block["segment"], block["n_tokens"]
        words = np.frombuffer(block["words"], "<u4")
        at, state = block["word_at"][number], np.frombuffer(block["states"][number], "<u8").astype(np.uint64)
        lo, hi = number * segment * lanes, min(n, (number + 1) * segment * lanes)
        out = np.empty(hi - lo, np.uint32)
        for i in range(0, hi - lo, lanes):
            k = min(lanes, hi - lo - i)
            x = state[:k]
            slot = x & self.slot_mask
            found = self.slots[slot]
            out[i : i + k] = found
            x = self.freq[found] * (x >> self.bits) + slot - self.cum[found]
            low = np.flatnonzero(x < _LOW)
            if len(low):
                x[low] = (x[low] << np.uint64(32)) | words[at : at + len(low)]
                at += len(low)
            state[:k] = x
        if zlib.crc32(out.astype("<u4")) != block["crcs"][number]:
            raise ValueError("a segment of the archive is damaged")
        return out

    def decode(self, block: dict) -> np.ndarray:
        found = [self.decode_segment(block, i) for i in range(len(block["crcs"]))]
        return np.concatenate(found) if found else np.zeros(0, np.uint32)


_RAW = "part int, first long, doc_ids array<long>, lengths array<long>, ids binary"
_BLOCK = (
    "start long, doc_ids array<long>, lengths array<long>, n_tokens int, lanes int, segment int, words binary, "
    "word_at array<int>, states array<binary>, crcs array<long>"
)


def _encode_texts(tokenizer: str, block_tokens: int):
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([END_ID], enc.dtype).tobytes()
        part, first, doc_ids, lengths, raw, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def block() -> pa.RecordBatch:
            ids = [[part], [first], [doc_ids], [lengths], [b"".join(raw)]]
            kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(ids, kinds, strict=True)], names=["part", "first", "doc_ids", "lengths", "ids"]
            )

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for lo, ids, offsets in enc.encode(batch.column(1)):
                at = offsets.tolist()
                for key, a, b in zip(keys[lo:], at, at[1:]):
                    doc_ids.append(key)
                    raw.append(ids[a:b].tobytes() + end)
                    lengths.append(b - a + 1)
                    held += lengths[-1]
                    if held >= block_tokens:
                        yield block()
                        first, doc_ids, lengths, raw, held = first + held, [], [], [], 0
        if doc_ids:
            yield block()

    return run


def _count(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype, counts = encoder(tokenizer).dtype, np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                new = np.bincount(np.frombuffer(raw.as_buffer(), dtype))
                if len(new) > len(counts):
                    counts, new = new, counts
                counts[: len(new)] += new
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], names=["token", "n"])

    return run


def write_archive(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = DEFAULT_TOKENIZER,
    block_tokens: int = BLOCK_TOKENS,
    lanes: int = LANES,
) -> None:
    """Encode ``docs`` in ascending order of their ids into the archive ``path``."""
    spark = docs.sparkSession
    n = tasks_for(docs)
    raw_path = f"{path}-raw"
    docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(
        n, "doc_id"
    ).sortWithinPartitions("doc_id", "text").mapInArrow(_encode_texts(tokenizer, block_tokens), _RAW).write.option(
        "compression", "zstd"
    ).parquet(raw_path)
    raw = spark.read.parquet(raw_path)
    counted = (
        raw.select("ids").mapInArrow(_count(tokenizer), "token int, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    )  # at most as many rows as the vocabulary has
    counts = np.zeros(max((r["token"] for r in counted), default=0) + 1, np.int64)
    for r in counted:
        counts[r["token"]] = r["n"]
    bits = max(16, int(np.count_nonzero(counts)).bit_length() + 1)
    freq = quantize(counts, bits)
    sizes = raw.groupBy("part").agg(F.max(F.col("first") + F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    base, before = {}, 0
    for r in sorted(sizes, key=lambda r: r["part"]):  # one row per partition
        base[r["part"]], before = before, before + r["n"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, dtype = Coder(freq, bits), encoder(tokenizer).dtype
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i] for k in batch.schema.names}
                out = coder.encode(np.frombuffer(row["ids"].as_buffer(), dtype), lanes)
                made = [
                    pa.array([base[row["part"].as_py()] + row["first"].as_py()], pa.int64()),
                    batch.column("doc_ids").slice(i, 1),
                    batch.column("lengths").slice(i, 1),
                    pa.array([out["n_tokens"]], pa.int32()),
                    pa.array([out["lanes"]], pa.int32()),
                    pa.array([out["segment"]], pa.int32()),
                    pa.array([out["words"]], pa.binary()),
                    pa.array([out["word_at"]], pa.list_(pa.int32())),
                    pa.array([out["states"]], pa.list_(pa.binary())),
                    pa.array([out["crcs"]], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(made, names=[x.split()[0] for x in _BLOCK.split(", ")])

    raw.mapInArrow(code, _BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    spark.createDataFrame(
        [(int(i), int(freq[i]), bits) for i in np.flatnonzero(freq)], "token int, frequency int, bits int"
    ).coalesce(1).write.parquet(f"{path}/table")
    delete_path(spark, raw_path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the archive: ``doc_id``, ``start``, ``n_tokens``, ``ids`` (4 bytes each, little-endian)."""
    rows = spark.read.parquet(f"{path}/table").collect()  # at most as many rows as the vocabulary has
    freq = np.zeros(max((r["token"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        freq[r["token"]] = r["frequency"]
    bits = rows[0]["bits"] if rows else 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq, bits)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i] for k in batch.schema.names}
                block = {k: row[k].as_py() for k in ("n_tokens", "lanes", "segment", "words", "word_at", "states", "crcs")}
                ids = coder.decode(block).astype("<u4")
                lengths = row["lengths"].values.to_numpy()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                yield pa.RecordBatch.from_arrays(
                    [
                        row["doc_ids"].values,
                        pa.array(row["start"].as_py() + starts),
                        pa.array(lengths),
                        pa.array([ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                        pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids", "ids_crc32"],
                )

    return spark.read.schema(_BLOCK).parquet(f"{path}/blocks").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long"
    )


def op3_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the archive of ``documents`` and report its documents as they are read back."""
    path = new_path(spark, "tokens")
    write_archive(table(spark, sf_dir, "documents"), path)
    return read_archive(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
