"""Attribution values of tree ensembles: how much each feature moves a row's prediction away from the mean of the trees' training rows.

Path-dependent Shapley values. A fitted forest is saved and its node table read back; each leaf becomes a path: per feature on the way an open-closed
interval that the feature's splits leave, and the share of training rows that go that way at those splits. For one row and one leaf a feature either lies in its
interval or not, so the leaf's part of a value is a sum over subsets of the other features on its path, which depends only on how many of them are chosen: elementary
symmetric sums, in depth squared steps. Rows are taken in Arrow batches; the paths are as many as the model's leaves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from math import factorial, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.nn.train import matrix
from tessera.sources.files import scratch_path


@dataclass
class Path:
    """A leaf: its value times its tree's weight, and its features with their intervals (low, high] and shares."""

    value: float
    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray


def node_table(model, spark) -> DataFrame:
    """tree, id, left, right, feature, threshold, positive (share of class 1), cover (training weight) of a fitted tree or forest classifier."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    found = spark.read.parquet(f"{path}/data")
    node = F.col("nodeData") if "nodeData" in found.columns else F.struct(*found.columns)
    tree = F.col("treeID") if "treeID" in found.columns else F.lit(0)
    found = found.select(tree.alias("tree"), node.alias("n"))
    cover = F.aggregate("n.impurityStats", F.lit(0.0), lambda a, v: a + v)
    return found.select(
        "tree", F.col("n.id").alias("id"), F.col("n.leftChild").alias("left"), F.col("n.rightChild").alias("right"), F.col("n.split.featureIndex").alias("feature"),
        F.get("n.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col("n.split.numCategories").alias("categories"), (F.get("n.impurityStats", F.lit(1)) / cover).alias("positive"), cover.alias("cover"),
    )


def paths_of(nodes: DataFrame) -> list[Path]:
    """The leaves of all trees, each tree with the same weight."""
    trees: dict[int, dict[int, object]] = defaultdict(dict)
    for r in nodes.collect():  # as many rows as the model has nodes
        if r["left"] >= 0 and r["categories"] not in (-1, 0, None):
            raise ValueError("splits on categories have no interval")
        trees[r["tree"]][r["id"]] = r
    out = []
    for tree in trees.values():
        stack = [(0, {})]
        while stack:
            at, seen = stack.pop()
            r = tree[at]
            if r["left"] < 0:
                items = sorted(seen.items())
                out.append(
                    Path(r["positive"] / len(trees), np.array([f for f, _ in items], int), *(np.array([v[i] for _, v in items], float) for i in range(3)))
                )
                continue
            for child, below in ((r["left"], True), (r["right"], False)):
                low, high, share = seen.get(r["feature"], (-inf, inf, 1.0))
                part = tree[child]["cover"] / r["cover"]
                kept = (low, min(high, r["threshold"]), share * part) if below else (max(low, r["threshold"]), high, share * part)
                stack.append((child, {**seen, r["feature"]: kept}))
    return out


def expected(paths: list[Path]) -> float:
    """The mean prediction of the training rows."""
    return float(sum(p.value * p.share.prod() for p in paths))


def values(paths: list[Path], x: np.ndarray) -> np.ndarray:
    """Attribution values: rows x features."""
    out = np.zeros(x.shape)
    for p in paths:
        m = len(p.features)
        own = x[:, p.features]
        inside = ((own > p.low) & (own <= p.high)).astype(float)
        for j in range(m):
            # sums[s]: over all choices of s of the other features, the product of "inside" of the chosen and the shares of the rest
            sums = np.zeros((len(x), m))
            sums[:, 0] = 1.0
            for f in range(m):
                if f != j:
                    sums[:, 1:] = sums[:, 1:] * p.share[f] + sums[:, :-1] * inside[:, f : f + 1]
                    sums[:, 0] *= p.share[f]
            weight = np.array([factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)])
            out[:, p.features[j]] += p.value * (sums @ weight) * (inside[:, j] - p.share[j])
    return out


def attributed(df: DataFrame, paths: list[Path], *keep: str) -> DataFrame:
    """``keep``, base (the mean prediction) and phi (a value per feature); base and the values add up to the prediction."""
    rows = df.select(*keep, F.col("x").cast("array<double>").alias("x"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    base = expected(paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            phi = values(paths, matrix(batch.columns[-1])).tolist() if batch.num_rows else []
            columns = [*batch.columns[:-1], pa.array([base] * batch.num_rows, pa.float64()), pa.array(phi, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "base", "phi"])

    return rows.mapInArrow(run, ", ".join([*kinds, "base double", "phi array<double>"]))


def mean_magnitude(attributions: DataFrame) -> DataFrame:
    """feature (its place) and the mean magnitude of its values, the most important first."""
    return attributions.select(F.posexplode("phi").alias("feature", "v")).groupBy("feature").agg(F.avg(F.abs("v")).alias("importance")).orderBy(F.desc("importance"), "feature")
