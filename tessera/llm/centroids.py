"""Centroid clustering of integer vectors by partial-distance search.

1.  Vectors become integers, ``floor(scale * x)``; sums and sums of squares of their components, one aggregate
    over all vectors, give the order of the dimensions, those of high variance first.
2.  The starting centroids are the vectors with the smallest hashes of their ids.
3.  Assignment, in NumPy over Arrow batches: squared differences are added up a few dimensions at a time. The centroid that leads after
    the first of them is finished at once, and its distance is the best so far; a centroid whose partial sum is strictly
    above it is abandoned. Those that survive all dimensions are compared, so ties stay in and the smaller number wins.
4.  A round adds up each task's vectors by centroid before anything is shuffled: one row per task and centroid. The new centroids,
    ``k`` rows, are the only thing that the driver sees.

All sums are exact: 64-bit integers while every component is below 2**27 in magnitude (a squared distance of 64 components is then below 2**63),
Python's integers in batches with larger ones.

Cases: vectors of another length, null, or with a null, NaN or infinite component are left out; rows with null or equal ids are
vectors of their own, and a null id comes last among the starting centroids; among equal ids the smaller vector starts first. With fewer vectors than
``k`` there are as many centroids as vectors, equal vectors give equal centroids of which the first takes all;
an empty table gives an empty result; further columns are ignored. A distance or an inertia beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, spread, table

#: Components at and above this magnitude are calculated in Python's integers.
SAFE = 1 << 27
#: Dimensions that are added between two looks at the best distance.
STEP = 8
_LONG = (1 << 63) - 1


def whole(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, scale: int = 64) -> DataFrame:
    """vec_id and v, the scaled components as doubles, of the complete vectors; their floors are taken in the tasks, as a long might not hold them."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    kept = vectors.where((F.size(x) == dims) & ~bad)
    parts = F.transform(x, lambda c: c.cast("double") * F.lit(float(scale)))
    return kept.select(F.col(id_col).alias("vec_id"), parts.alias("v"))


def _integers(column: pa.Array, dims: int) -> np.ndarray:
    """The floors of a batch's components, as 64-bit integers or, where one is large, as objects."""
    v = np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims))
    return v.astype(np.int64) if not v.size or np.abs(v).max() < SAFE else np.array([[int(c) for c in row] for row in v], object)


def nearest(v: np.ndarray, centroids: np.ndarray, order: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each row (the smaller of equals), and the squared distance."""
    n, k, dims = len(v), len(centroids), len(order)
    v, c = v[:, order], centroids[:, order]
    row, number = np.repeat(np.arange(n), k), np.tile(np.arange(k), n)
    part = _squares(v, c, row, number, 0, step)
    lead = np.argmin(part.reshape(n, k), axis=1)
    best = part.reshape(n, k)[np.arange(n), lead] + _squares(v, c, np.arange(n), lead, step, dims)
    for lo in range(step, dims, step):
        live = np.flatnonzero(part <= best[row])
        row, number = row[live], number[live]
        part = part[live] + _squares(v, c, row, number, lo, min(lo + step, dims))
    live = np.flatnonzero(part <= best[row])
    row, number, part = row[live], number[live], part[live]
    # by row, then distance, then number
    by = np.argsort(part, kind="stable")
    by = by[np.argsort(row[by], kind="stable")]
    first = by[np.flatnonzero(np.diff(row[by], prepend=-1))] if len(by) else by
    return number[first], part[first]


def _squares(v: np.ndarray, c: np.ndarray, row: np.ndarray, number: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Sums of squared differences of the dimensions lo to hi, of pairs of a row and a centroid."""
    if hi <= lo:
        return np.zeros(len(row), v.dtype)
    d = v[row, lo:hi] - c[number, lo:hi]
    return (d * d).sum(axis=1)


def _exact(centroids: list[list[int]]) -> np.ndarray:
    large = any(abs(x) >= SAFE for c in centroids for x in c)
    return np.array(centroids, object if large else np.int64)


def _alike(v: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as objects if one is."""
    return (v.astype(object), c.astype(object)) if object in (v.dtype, c.dtype) and v.dtype != c.dtype else (v, c)


def _summed(centroids: list[list[int]], order: np.ndarray, dims: int):
    """Of each task, per centroid: how many vectors are nearest to it, and the sums of their components as decimal digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed, n, sums = _exact(centroids), [0] * len(centroids), {}
        for batch in batches:
            if not batch.num_rows:
                continue
            v, c = _alike(_integers(batch.column(0), dims), fixed)
            number, _ = nearest(v, c, order)
            for k in np.unique(number).tolist():
                own = v[number == k]
                n[k] += len(own)
                sums[k] = [a + b for a, b in zip(sums.get(k, [0] * dims), own.sum(axis=0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(list(sums), pa.int32()),
                pa.array([n[k] for k in sums], pa.int64()),
                pa.array([[str(x) for x in s] for s in sums.values()], pa.list_(pa.string())),
            ],
            names=["cluster", "n", "sums"],
        )

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tasks' rows of each centroid as one."""
    n, sums = {}, {}
    for batch in batches:
        for k, m, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n[k] = n.get(k, 0) + m
            sums[k] = [a + int(b) for a, b in zip(sums[k], s, strict=True)] if k in sums else [int(b) for b in s]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(list(n), pa.int32()),
            pa.array(list(n.values()), pa.int64()),
            pa.array([[str(x) for x in sums[k]] for k in n], pa.list_(pa.string())),
        ],
        names=["cluster", "n", "sums"],
    )


def _assigned(centroids: list[list[int]], order: np.ndarray, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixed = _exact(centroids)
        for batch in batches:
            v, c = _alike(_integers(batch.column(1), dims), fixed)
            number, distance = nearest(v, c, order) if len(v) else (np.zeros(0, int), np.zeros(0, int))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(number, pa.int32()),
                    pa.array([d if d <= _LONG else None for d in distance.tolist()], pa.int64()),
                ],
                names=["vec_id", "cluster", "distance"],
            )

    return run


def _by_variance(rows: DataFrame, dims: int) -> np.ndarray:
    """The dimensions, those of high variance first; only the speed depends on it, so doubles do."""
    at = [F.col("v")[i] for i in range(dims)]
    found = rows.agg(*[F.var_pop(x).alias(f"d{i}") for i, x in enumerate(at)]).first()
    return np.array(sorted(range(dims), key=lambda i: (-(found[i] or 0.0), i)))


def _start_hash(seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)


def clusters(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every complete vector."""
    spark = vectors.sparkSession
    rows = materialize(whole(vectors, id_col, vector_col, dims, scale), "vectors")
    start = rows.orderBy(_start_hash(seed).asc_nulls_last(), "v").limit(k).select("v").collect()  # k rows
    centroids = [[int(np.floor(x)) for x in r["v"]] for r in start]
    order = _by_variance(rows, dims)
    layout = "cluster int, n long, sums array<string>"
    for _ in range(rounds if centroids else 0):
        sums = rows.select("v").mapInArrow(_summed(centroids, order, dims), layout).repartition("cluster").mapInArrow(_merged, layout)
        for r in sums.collect():  # one row per centroid
            centroids[r["cluster"]] = [int(x) // r["n"] for x in r["sums"]]
    if not centroids:
        found = rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
    else:
        found = materialize(rows.mapInArrow(_assigned(centroids, order, dims), f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"), "assigned")
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    named = spark.createDataFrame(digests, "cluster int, centroid_sha256 string")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    per = found.groupBy("cluster").agg(exact.alias("own"))
    total = per.agg(F.sum("own").alias("all"))
    # k rows and one row: bounded by the parameter k
    per = per.join(F.broadcast(total)).join(F.broadcast(named), "cluster")
    per = per.select("cluster", F.col("own").try_cast("long").alias("cluster_inertia"), F.col("all").try_cast("long").alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(spread(table(spark, sf_dir, "embeddings")))


def _assignment(n: int) -> str:
    return f"""a{n} AS MATERIALIZED (
  SELECT rid, arg_min(c.k, d * 16 + c.k) AS k, min(d) AS d FROM (
    SELECT v.rid, c.k, CAST(list_sum(list_transform(list_zip(v.c, c.c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{n} c) c GROUP BY rid
)"""


def _update(n: int) -> str:
    return f"""c{n + 1} AS MATERIALIZED (
  SELECT c.k, coalesce(m.c, c.c) AS c FROM c{n} c LEFT JOIN (
    SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM (
      SELECT a.k, u.i, sum(u.x) AS s, count(*) AS n FROM a{n} a JOIN (SELECT rid, unnest(c) AS x, unnest(range(1, 65)) AS i FROM v) u ON u.rid = a.rid GROUP BY a.k, u.i
    ) GROUP BY k) m ON m.k = c.k
)"""


OP13_SQL = (
    r"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS c FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h, c) - 1 AS BIGINT) AS k, c FROM (SELECT sha256('1:' || CAST(vec_id AS VARCHAR)) AS h, c FROM v ORDER BY h, c LIMIT 16)
), """
    + ", ".join(f"{_assignment(n)}, {_update(n)}" for n in range(3))
    + ", "
    + _assignment(3)
    + """
SELECT v.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a3 a JOIN v ON v.rid = a.rid JOIN c3 c ON c.k = a.k
"""
)
