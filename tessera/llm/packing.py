"""Packing documents into sequences: shortest-pack-first over the length histogram.

Every document is encoded, closed with the end id and cut into full pieces of
``width`` tokens, each a sequence of its own, and a remainder.  Only the histogram
of the remainders (``width - 1`` numbers, whatever the corpus) comes to the
driver.  ``shortest_pack_first`` places its lengths longest first into the pack
with the most space, and counts how often each packing pattern is used.  A
remainder finds its place by its rank among the remainders of its length.

Ranks need no single task: remainders are range-partitioned by (length, id), each
partition numbers its rows, and the partitions' totals give the offsets.

Cases: a null or empty text is the end id alone; rows with equal ids are documents
of their own; null ids sort first; an empty table gives no pieces; further
columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, spread, table, tasks_for
from tessera.llm.tokens import DEFAULT_TOKENIZER, END_ID, encoder

WIDTH = 1024
#: Units that a worker's encoder keeps, and bytes of text that it encodes at a time: workers outlive their tasks, and what they hold adds to the memory of later stages.
CACHED, ENCODED_BYTES = 500_000, 1 << 20


def token_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, width: int) -> DataFrame:
    """``doc_id``, ``doc_tokens`` and the crc32 of each piece: ``full`` (array) and ``rest`` (of ``rest_len`` ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, CACHED)
        end = np.array([END_ID], "<u4")
        for batch in batches:
            for lo, found, offsets in enc.encode(batch.column(1), ENCODED_BYTES):
                n, full, rest, rest_crc = [], [], [], []
                wide, at = found.astype("<u4"), offsets.tolist()
                for a, b in zip(at, at[1:]):
                    ids = np.concatenate([wide[a:b], end])
                    whole = len(ids) // width
                    n.append(len(ids))
                    full.append([zlib.crc32(ids[i * width : (i + 1) * width]) for i in range(whole)])
                    rest.append(len(ids) - whole * width)
                    rest_crc.append(zlib.crc32(ids[whole * width :]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, len(n)),
                        pa.array(n, pa.int64()),
                        pa.array(full, pa.list_(pa.int64())),
                        pa.array(rest, pa.int32()),
                        pa.array(rest_crc, pa.int64()),
                    ],
                    names=["doc_id", "doc_tokens", "full", "rest_len", "rest_crc"],
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, doc_tokens long, full array<long>, rest_len int, rest_crc long"
    )


def shortest_pack_first(histogram: dict[int, int], width: int) -> list[tuple[dict[int, int], int]]:
    """Packing patterns ``({length: copies}, how often)`` that hold every length of the histogram.

    Lengths are placed longest first; each goes to the packs with the most space
    left, all packs of one pattern at once, and to new packs when none has room.
    """
    by_space: dict[int, list[tuple[dict[int, int], int]]] = {}
    spaces: list[int] = []

    def put(pattern: dict[int, int], space: int, count: int) -> None:
        if space not in by_space:
            by_space[space] = []
            insort(spaces, space)
        by_space[space].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not spaces or spaces[-1] < length:
                # one after another they would fill a new pack before they open the next
                most = width // length
                for copies, packs in ((most, left // most), (left % most, 1)):
                    if copies and packs:
                        put({length: copies}, width - copies * length, packs)
                break
            space = spaces[-1]
            pattern, count = by_space[space].pop()
            if not by_space[space]:
                del by_space[space]
                spaces.pop()
            used = min(count, left)
            if count > used:
                put(pattern, space, count - used)
            put(pattern | {length: pattern.get(length, 0) + 1}, space - length, used)
            left -= used
    return [x for space in sorted(by_space) for x in by_space[space]]


def _slots(patterns: list[tuple[dict[int, int], int]]) -> tuple[list[tuple], int]:
    """For each pattern and length: which ranks of that length it takes, its first sequence and the offset there."""
    taken: dict[int, int] = {}
    rows, first = [], 0
    for pattern, count in patterns:
        offset = 0
        for length, copies in sorted(pattern.items(), reverse=True):
            a = taken.get(length, 0)
            rows.append((length, a, a + count * copies, copies, first, offset))
            taken[length] = a + count * copies
            offset += length * copies
        first += count
    return rows, first


def _numbered(pieces: DataFrame, n: int) -> DataFrame:
    """Rows in order of (rest_len, doc_id), each partition numbering its own from 0."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, whole = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            full = pc.list_value_length(batch.column("full")).to_numpy(zero_copy_only=False)
            before = whole + np.cumsum(full) - full
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(np.full(batch.num_rows, part, np.int32)),
                    pa.array(np.arange(row, row + batch.num_rows, dtype=np.int64)),
                    pa.array(before.astype(np.int64)),
                ],
                names=[*batch.schema.names, "part", "row", "full_before"],
            )
            row, whole = row + batch.num_rows, whole + int(full.sum())

    return (
        pieces.repartitionByRange(n, "rest_len", "doc_id")
        .sortWithinPartitions("rest_len", "doc_id")
        .mapInArrow(
            run,
            "doc_id long, doc_tokens long, full array<long>, rest_len int, rest_crc long, part int, row long, full_before long",
        )
    )


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = DEFAULT_TOKENIZER,
    width: int = WIDTH,
) -> DataFrame:
    """One row per piece: where it comes from and where it stands."""
    spark = docs.sparkSession
    # written first: range partitioning reads its input twice, once for a sample
    pieces = materialize(token_pieces(docs, id_col, text_col, tokenizer, width), "encoded")
    rows = materialize(_numbered(pieces, tasks_for(pieces)), "pieces")
    totals = rows.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.size("full")).cast("long").alias("f")).collect()
    row_base, full_base, r, f = {}, {}, 0, 0
    for t in sorted(totals, key=lambda t: t["part"]):  # one row per partition
        row_base[t["part"]], full_base[t["part"]], r, f = r, f, r + t["n"], f + t["f"]
    counts = {x["rest_len"]: x["count"] for x in rows.groupBy("rest_len").count().collect()}  # at most width rows
    first_of, before = {}, 0
    for length in sorted(counts):
        first_of[length], before = before, before + counts[length]
    counts.pop(0, None)
    slots, n_mixed = _slots(shortest_pack_first(counts, width))
    # both tables are bounded: by the number of partitions, and by the patterns of a histogram of width - 1 lengths
    bases = spark.createDataFrame(
        [(p, row_base[p], n_mixed + full_base[p]) for p in row_base] or [(-1, 0, 0)], "part int, row_base long, full_base long"
    )
    places = spark.createDataFrame(
        [(s[0], first_of[s[0]], *s[1:]) for s in slots] or [(-1, 0, 0, 0, 1, 0, 0)],
        "rest_len int, len_first long, lo long, hi long, copies long, seq0 long, off0 long",
    )
    rows = rows.join(F.broadcast(bases), "part")
    rank = F.col("row_base") + F.col("row") - F.col("len_first")
    t = rank - F.col("lo")
    rest = (
        rows.where("rest_len > 0")
        .join(F.broadcast(places), "rest_len")
        .where((rank >= F.col("lo")) & (rank < F.col("hi")))
        .select(
            "doc_id",
            (F.size("full") * F.lit(width)).cast("long").alias("start"),
            F.col("rest_len").cast("long").alias("length"),
            F.col("rest_crc").alias("ids_crc32"),
            "doc_tokens",
            (F.col("seq0") + F.floor(t / F.col("copies"))).cast("long").alias("sequence_id"),
            (F.col("off0") + (t % F.col("copies")) * F.col("rest_len")).cast("long").alias("offset"),
        )
    )
    full = rows.select(
        "doc_id", "doc_tokens", "full_base", "full_before", F.posexplode("full").alias("i", "ids_crc32")
    ).select(
        "doc_id",
        (F.col("i") * F.lit(width)).cast("long").alias("start"),
        F.lit(width).cast("long").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("full_base") + F.col("full_before") + F.col("i")).cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return rest.unionByName(full)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spread(table(spark, sf_dir, "documents")))
