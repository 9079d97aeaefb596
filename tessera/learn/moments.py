"""Counts, means and scatter matrices per class, and the classifiers that follow from them: linear and quadratic discriminants, ridge.

Rows are (id, x: array of doubles, y: 0 or 1). Two passes: sums of the components per class, then products of the components centred on
their class's mean, so that large means cost no digits. Each task adds up its rows' matrix products and returns one array per class;
arrays are added by position as a grouped sum with map-side combining. The driver holds one matrix of features x features per class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.nn.train import matrix

CLASSES = 2


def _added(parts: DataFrame, width: int) -> np.ndarray:
    """Arrays ``m`` of one ``width`` per class ``y``, added up: a matrix of classes x width."""
    sums = parts.select("y", F.posexplode("m").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v"))
    out = np.zeros((CLASSES, width))
    for r in sums.collect():  # classes x width rows
        out[r["y"], r["i"]] = r["v"]
    return out


@dataclass
class Moments:
    """Of each class: rows n, mean, and the scatter (sum of outer products of the centred rows)."""

    n: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(df: DataFrame, features: str = "x", label: str = "y") -> Moments:
        rows = df.select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("int").alias("y"))
        width = rows.agg(F.max(F.size("x"))).first()[0] or 0

        def summed(of):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total: dict[int, np.ndarray] = {}
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    x, y = matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
                    for k in np.unique(y).tolist():
                        part = of(x[y == k], k)
                        total[k] = total[k] + part if k in total else part
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["y", "m"]
                )

            return rows.mapInArrow(run, "y int, m array<double>")

        sums = _added(summed(lambda x, k: np.append(x.sum(axis=0), len(x))), width + 1)
        n = sums[:, width]
        mean = sums[:, :width] / np.maximum(n, 1)[:, None]
        centred = _added(summed(lambda x, k: ((x - mean[k]).T @ (x - mean[k])).ravel()), width * width)
        return Moments(n, mean, centred.reshape(CLASSES, width, width))

    def within(self) -> np.ndarray:
        return self.scatter.sum(axis=0)


def _solved(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The solution of a symmetric system by Cholesky factors; the least ridge that makes it definite stands in for a singular one."""
    scale = max(1e-12, float(np.trace(a)) / max(1, len(a)))
    for extra in (0.0, 1e-10, 1e-8, 1e-6, 1e-4):
        try:
            low = np.linalg.cholesky(a + extra * scale * np.eye(len(a)))
        except np.linalg.LinAlgError:
            continue
        return np.linalg.solve(low.T, np.linalg.solve(low, b))
    raise ValueError("the features' covariance can't be factorized")


def dot(x: Column, weights: np.ndarray, shift: float) -> Column:
    """``weights . x + shift`` of an array column, in built-in expressions."""
    w = F.array(*[F.lit(float(v)) for v in weights])
    return F.aggregate(F.zip_with(x.cast("array<double>"), w, lambda a, b: a * b), F.lit(float(shift)), lambda s, v: s + v)


@dataclass
class Linear:
    """A classifier by the sign of ``weights . x + intercept``; p is its logistic."""

    weights: np.ndarray
    intercept: float

    def scored(self, df: DataFrame, *keep: str) -> DataFrame:
        z = dot(F.col("x"), self.weights, self.intercept)
        return df.select("id", *keep, F.col("y").cast("long").alias("y"), F.round(1 / (1 + F.exp(-z)), 12).alias("p"))


def linear_discriminant(m: Moments) -> Linear:
    """Classes with one covariance (within scatter over n minus the number of classes) and priors by frequency."""
    cov = m.within() / max(1.0, m.n.sum() - CLASSES)
    w = _solved(cov, m.mean[1] - m.mean[0])
    return Linear(w, float(-w @ (m.mean[0] + m.mean[1]) / 2 + np.log(max(m.n[1], 1e-300) / max(m.n[0], 1e-300))))


def ridge(m: Moments, alpha: float = 1.0) -> Linear:
    """Least squares on targets -1 and 1 with the squared weights' ``alpha``; the intercept is free."""
    n, target = m.n.sum(), np.array([-1.0, 1.0])
    mean, middle = (m.n @ m.mean) / n, float(m.n @ target / n)
    apart = m.mean - mean
    total = m.within() + (apart * m.n[:, None]).T @ apart
    w = _solved(total + alpha * np.eye(len(total)), apart.T @ (m.n * (target - middle)))
    return Linear(w, middle - float(w @ mean))


@dataclass
class Quadratic:
    """Classes with a covariance each; p by Bayes' rule."""

    mean: np.ndarray
    precision: np.ndarray
    shift: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = []
        for k in range(CLASSES):
            d = x - self.mean[k]
            z.append(self.shift[k] - 0.5 * np.einsum("ni,ij,nj->n", d, self.precision[k], d, optimize=True))
        return z[1] - z[0]

    def scored(self, df: DataFrame, *keep: str) -> DataFrame:
        return scored_by(df, self.log_odds, *keep)


def quadratic_discriminant(m: Moments, shrink: float = 1e-3) -> Quadratic:
    """``shrink``: the part of each covariance that is replaced by the mean variance on the diagonal."""
    width = m.mean.shape[1]
    precision, shift = np.zeros((CLASSES, width, width)), np.zeros(CLASSES)
    for k in range(CLASSES):
        cov = m.scatter[k] / max(1.0, m.n[k] - 1)
        cov = (1 - shrink) * cov + shrink * max(1e-12, np.trace(cov) / width) * np.eye(width)
        precision[k] = _solved(cov, np.eye(width))
        shift[k] = np.log(max(m.n[k], 1e-300) / m.n.sum()) - 0.5 * np.linalg.slogdet(cov)[1]
    return Quadratic(m.mean, precision, shift)


def scored_by(df: DataFrame, log_odds, *keep: str) -> DataFrame:
    """id, ``keep``, y, p of rows whose log odds a function of matrices gives, in Arrow batches."""
    rows = df.select("id", *keep, F.col("y").cast("long").alias("y"), F.col("x").cast("array<double>").alias("x"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = log_odds(matrix(batch.columns[-1])) if batch.num_rows else np.zeros(0)
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64())], names=[*batch.schema.names[:-1], "p"])

    return rows.mapInArrow(run, ", ".join([*kinds, "p double"])).withColumn("p", F.round("p", 12))
