"""Nearest neighbours, exactly: a stated set of query rows against all known rows, block by block.

A block of query rows, of bounded size, goes to every task; each task keeps the ``k`` nearest of its own rows for each query row, and
these are merged by query row, so what is shuffled is k rows per task and query row, whatever the table. Equal distances go by id.

All pairs are compared, but most by a bound only: one matrix product in single precision gives for each pair a distance that is too small by no
more than its rounding, and pairs that are out of reach by it are passed over. The distances of the others are worked out in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.nn.train import matrix
from tessera.operators.clean import row_index
from tessera.sources.files import scratch_path
from tessera.sources.scratch import drop, stored

#: Query rows that one pass over the known rows serves.
BLOCK = 1 << 14
#: Rows of both sides whose products are held at once, and pairs whose distances are.
_TILE, _PAIRS = 1024, 1 << 14


def neighbours(known: DataFrame, queries: DataFrame, k: int = 15) -> DataFrame:
    """query, id, y, distance (squared) and rank from 1 of the ``k`` nearest of ``known`` (id, x, y) to each of ``queries`` (id, x).

    The driver holds one block of query rows at a time; each block's rows are written before the next one is taken.
    """
    spark = queries.sparkSession
    asked = stored(row_index(queries.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x")), ["id"], "place"), "asked")
    rows = known.select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"), F.col("y").cast("long").alias("y"))
    top = asked.agg(F.max("place")).first()[0]
    if top is None:
        drop(asked)
        return rows.select(F.col("id").alias("query"), "id", "y", F.lit(0.0).alias("distance"), F.lit(1).alias("rank")).where("false")
    w = Window.partitionBy("query").orderBy("distance", "id")
    path, parts = scratch_path(spark, "nearest"), []
    for lo in range(0, top + 1, BLOCK):
        block = asked.where((F.col("place") >= lo) & (F.col("place") < lo + BLOCK)).orderBy("place").select("id", "x").toArrow().combine_chunks()  # BLOCK rows
        ids, x = block["id"].to_numpy(), matrix(block["x"].combine_chunks())
        near = rows.mapInArrow(_nearest(ids, x, k), "query long, id long, y long, distance double")
        near = near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        near.write.parquet(f"{path}/{lo}")
        parts.append(f"{path}/{lo}")
    drop(asked)
    return spark.read.schema(near.schema).parquet(*parts)


def _nearest(ids: np.ndarray, x: np.ndarray, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))  # query's place, distance, id, y
        reach = np.full(len(x), np.inf)  # the k-th distance so far
        even = x[np.isfinite(x).all(axis=1)]
        middle = even.mean(axis=0) if len(even) else np.zeros(x.shape[1])
        seen = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            own, known = batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1))
            y = batch.column(2).to_numpy(zero_copy_only=False)
            kept = _first_of_equal(own, known, k)
            while len(kept):  # short steps at first, as each one brings down the reach
                step, kept = np.split(kept, [max(_TILE, seen)])
                seen += len(step)
                with np.errstate(all="ignore"):  # rows that are not finite have no bound
                    place, at, d = _in_reach(x, known[step], middle, reach, k)
                if not len(place):
                    continue
                held = tuple(np.concatenate(v) for v in zip(held, (place, d, own[step][at], y[step][at]), strict=True))
                order = _in_order(*held[:3])
                rank = np.arange(len(order)) - np.searchsorted(held[0][order], held[0][order])
                held = tuple(v[order[rank < k]] for v in held)
                last = rank[rank < k] == k - 1
                reach[held[0][last]] = held[1][last]
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (ids[held[0]], held[2], held[3], held[1])], names=["query", "id", "y", "distance"])

    return run


def _in_order(place: np.ndarray, distance: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The order by query's place, distance and id; three sorts only where distances are equal."""
    order = np.argsort(distance)
    order = order[np.argsort(place[order].astype(np.min_scalar_type(int(place.max(initial=0)))), kind="stable")]  # small numbers are sorted by their digits
    p, d = place[order], distance[order]
    if ((p[1:] == p[:-1]) & ~(d[1:] > d[:-1])).any():
        return np.lexsort((own, distance, place))
    return order


def _first_of_equal(own: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """The places of the rows that are among the ``k`` of least id of rows equal to them: no others can be among the nearest of any row."""
    order = np.lexsort((own, (x * np.sqrt(np.arange(2, x.shape[1] + 2))).sum(axis=1)))
    starts = np.ones(len(x), bool)
    starts[1:] = (x[order[1:]] != x[order[:-1]]).any(axis=1)
    place = np.arange(len(x))
    return np.sort(order[place - np.maximum.accumulate(np.where(starts, place, 0)) < k])


def _in_reach(x: np.ndarray, known: np.ndarray, middle: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of query row, place of known row and distance of all pairs that are not farther than ``reach``, and of some more.

    With rows a and b, taken from ``middle`` and scaled to lengths of at most 1, |a - b|^2 <= r means a.b - |b|^2 / 2 >= (|a|^2 - r) / 2.
    Rounding of the product to single precision is at most ``slack`` times (|a||b| + |b|^2 / 2), which is added to it by columns of its own.
    """
    a, b = x - middle, known - middle
    size = max((float(np.abs(v[np.isfinite(v)]).max(initial=0.0)) for v in (a, b)), default=0.0) * np.sqrt(x.shape[1])
    scale = float(np.exp2(np.clip(np.ceil(np.log2(size)), -1000, 1000))) if size > 0 else 1.0
    a, b = a / scale, b / scale
    aa, bb = (a**2).sum(axis=1), (b**2).sum(axis=1)
    slack = (x.shape[1] + 8) * 2.0**-23
    left = np.column_stack([a, slack * np.sqrt(aa), np.ones(len(a))]).astype(np.float32)
    right = np.column_stack([b, np.sqrt(bb), (slack - 0.5) * bb]).astype(np.float32)
    out, products, masks = [], np.empty(_TILE * _TILE, np.float32), np.empty(_TILE * _TILE, bool)
    for i in range(0, len(x), _TILE):
        rows = slice(i, i + _TILE)
        within = reach[rows]
        for j in range(0, len(known), _TILE):
            shape = (len(left[rows]), len(right[j : j + _TILE]))
            product, beyond = (v[: shape[0] * shape[1]].reshape(shape) for v in (products, masks))
            np.matmul(left[rows], right[j : j + _TILE].T, out=product)
            if j == 0 and product.shape[1] >= k and np.isinf(within).any():
                first = np.argpartition(-product, k - 1, axis=1)[:, :k]  # k rows at hand bound the k-th distance
                far = _distances(x, known, np.repeat(np.arange(i, i + len(within)), k), first.ravel()).reshape(-1, k).max(axis=1)
                within = np.fmin(within, np.where(np.isnan(far), np.inf, far))
            # squares vanish below 1e-300, products below 1e-38
            least = (aa[rows] - (within + 1e-300) / scale / scale) / 2 - slack * aa[rows] - 1e-30
            least = np.nextafter(least.astype(np.float32), np.float32(-np.inf))
            near = _unset(np.less(product, least[:, None], out=beyond).ravel())  # also where there is no bound
            if len(near):
                place, at = near // product.shape[1] + i, near % product.shape[1] + j
                out.append((place, at, _distances(x, known, place, at)))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def _unset(flags: np.ndarray) -> np.ndarray:
    """The places of the few flags that are not set: eight are looked at together."""
    whole = len(flags) // 8 * 8
    some = np.flatnonzero(flags[:whole].view(np.uint64) != np.uint64(0x0101010101010101)) * 8
    places = np.concatenate([(some[:, None] + np.arange(8)).ravel(), np.arange(whole, len(flags))])
    return places[~flags[places]]


def _distances(x: np.ndarray, known: np.ndarray, place: np.ndarray, at: np.ndarray) -> np.ndarray:
    parts = [((x[place[i : i + _PAIRS]] - known[at[i : i + _PAIRS]]) ** 2).sum(axis=1) for i in range(0, len(place), _PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0)


class Neighbours:
    """p: the share of positives among the ``k`` nearest."""

    def __init__(self, known: DataFrame, k: int = 15):
        self.known, self.k = known, k

    def scored(self, df: DataFrame, *keep: str) -> DataFrame:
        votes = neighbours(self.known, df, self.k).groupBy(F.col("query").alias("id")).agg(F.avg(F.col("y").cast("double")).alias("p"))
        return df.select("id", *keep, F.col("y").cast("long").alias("y")).join(votes, "id").select("id", *keep, "y", F.round("p", 12).alias("p"))
