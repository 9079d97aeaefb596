"""Model fitting: single models, comparison by folds, random search, blends, and refits.

Algorithms that Spark has come from pyspark.ml, the others from ``tessera.learn``.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import SparkContext
from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    FMClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.learn.moments import Moments, linear_discriminant, quadratic_discriminant, ridge
from tessera.learn.neighbours import Neighbours
from tessera.learn.stumps import boosted_stumps
from tessera.operators import metrics
from tessera.sources.files import scratch_path


def _without_summary(model) -> None:
    """Forget what a fit noted about its training rows.

    The summary of a binary logistic fit holds the session, and a session can't be serialized once an Observation was used in it: then
    every task that scores with the model fails with ``NotSerializableException: ObservationManager``.
    """
    for part in getattr(model, "stages", [model]):
        if getattr(part, "hasSummary", False):
            part._java_obj.setSummary(SparkContext._active_spark_context._jvm.scala.Option.empty())


class Fit:
    """A model of pyspark.ml."""

    def __init__(self, model):
        _without_summary(model)
        self.model = model

    def scored(self, df: DataFrame, *keep: str) -> DataFrame:
        """id, ``keep``, y, p (probability of class 1, or a squashed margin)."""
        out = self.model.transform(df)
        margin = vector_to_array("rawPrediction")[1]
        p = vector_to_array("probability")[1] if "probability" in out.columns else 1 / (1 + F.exp(-margin))
        return out.select("id", *keep, F.col("y").cast("long").alias("y"), F.round(p, 12).alias("p"))


def fit(estimator: Estimator, df: DataFrame) -> Fit:
    return Fit(estimator.fit(df))


def _arrays(df: DataFrame) -> DataFrame:
    """The rows with their vectors as arrays, which the algorithms of ``tessera.learn`` take."""
    return df.withColumn("x", vector_to_array("x"))


class OnArrays:
    """A model of ``tessera.learn`` on rows with vectors."""

    def __init__(self, model):
        self.model = model

    def scored(self, df: DataFrame, *keep: str) -> DataFrame:
        return self.model.scored(_arrays(df), *keep)


def candidates(n_features: int, seed: int = 42) -> dict[str, Callable[[DataFrame], Fit | OnArrays]]:
    """The algorithms by name, each from training rows (id, x, y) to a model that scores."""
    common = {"featuresCol": "x", "labelCol": "y"}
    built_in = {
        "logistic": LogisticRegression(maxIter=20, **common),
        "tree": DecisionTreeClassifier(maxDepth=4, seed=seed, **common),
        "forest": RandomForestClassifier(numTrees=10, maxDepth=4, seed=seed, **common),
        "boosting": GBTClassifier(maxIter=5, maxDepth=3, seed=seed, **common),
        "svm": LinearSVC(maxIter=10, **common),
        "bayes": NaiveBayes(modelType="gaussian", **common),
        "factorization": FMClassifier(maxIter=5, seed=seed, **common),
        "perceptron": MultilayerPerceptronClassifier(layers=[n_features, 4, 2], maxIter=20, seed=seed, **common),
    }
    own = {
        "linear_discriminant": lambda df: linear_discriminant(Moments.of(df)),
        "quadratic_discriminant": lambda df: quadratic_discriminant(Moments.of(df)),
        "ridge": lambda df: ridge(Moments.of(df)),
        "adaptive_boosting": lambda df: boosted_stumps(df, rounds=10),
        "neighbours": lambda df: Neighbours(df),
    }
    return {n: (lambda df, e=e: fit(e, df)) for n, e in built_in.items()} | {n: (lambda df, f=f: OnArrays(f(_arrays(df)))) for n, f in own.items()}


def as_vectors(df: DataFrame, features: str, label: str, key: str, *keep: str) -> DataFrame:
    return df.select(F.col(key).alias("id"), *keep, array_to_vector(F.col(features).cast("array<double>")).alias("x"), F.col(label).cast("double").alias("y"))


def _side_by_side(spark, tasks: Sequence, score: Callable, columns: str, at_once: int) -> DataFrame:
    """The rows of all fits, each written when its fit is done, so that the result is one plain scan."""
    path = scratch_path(spark, "scores")

    def part(task: tuple) -> str:
        place, one = task
        score(one).write.parquet(f"{path}/{place}")  # a folder of its own, as writers to one folder clear each other's files
        return f"{path}/{place}"

    with ThreadPool(at_once) as pool:
        return spark.read.schema(columns).parquet(*pool.map(part, list(enumerate(tasks)), chunksize=1))


def leaderboard(
    df: DataFrame, n_features: int, fold: str = "fold", k: int = 5, names: Sequence[str] | None = None, at_once: int = 4
) -> DataFrame:
    """Mean AUC over ``k`` folds of each algorithm, best first; ``at_once`` fits run side by side."""
    chosen = [(n, f) for n, f in candidates(n_features).items() if not names or n in names]

    def score(task: tuple[str, Callable, int]) -> DataFrame:
        name, learn, i = task
        rows = learn(df.where(F.col(fold) != i)).scored(df.where(F.col(fold) == i))
        return rows.select(F.lit(name).alias("model"), F.lit(i).alias("fold"), "y", "p")

    scores = _side_by_side(df.sparkSession, [(n, f, i) for i in range(k) for n, f in chosen], score, "model string, fold int, y long, p double", at_once)
    return metrics.auc(scores, ["model", "fold"]).groupBy("model").agg(F.avg("auc").alias("auc")).orderBy(F.desc("auc"), "model")


def best(board: DataFrame, n: int = 3) -> DataFrame:
    """The first ``n`` models of a leaderboard."""
    return board.orderBy(F.desc("auc"), "model").limit(n)


def random_search(
    train: DataFrame, val: DataFrame, make: Callable[[dict], Estimator], space: dict[str, list], n: int = 50, seed: int = 42, at_once: int = 4
) -> DataFrame:
    """``n`` settings drawn by a fixed rule from ``space``; setting -1 is the default, which wins ties."""
    rng = random.Random(seed)
    settings = [(i, {} if i < 0 else {k: rng.choice(v) for k, v in sorted(space.items())}) for i in range(-1, n)]

    def score(task: tuple[int, dict]) -> DataFrame:
        i, setting = task
        rows = fit(make(setting), train).scored(val)
        return rows.select(F.lit(i).cast("long").alias("trial"), F.lit(str(sorted(setting.items()))).alias("setting"), "y", "p")

    scores = _side_by_side(train.sparkSession, settings, score, "trial long, setting string, y long, p double", at_once)
    return metrics.auc(scores, ["trial", "setting"]).select("trial", "setting", "auc").orderBy(F.desc("auc"), "trial")


def soft_vote(models: Sequence, df: DataFrame) -> DataFrame:
    """The mean of the models' probabilities."""
    out = None
    for i, m in enumerate(models):
        part = m.scored(df).withColumnRenamed("p", f"p{i}")
        out = part if out is None else out.join(part.drop("y"), "id")
    mean = sum((F.col(f"p{i}") for i in range(1, len(models))), F.col("p0")) / len(models)
    return out.select("id", "y", mean.alias("p"))


def xor_fit(df: DataFrame, seeds: Sequence[int] = (1, 2, 3, 4, 5)) -> tuple[Fit, Fit]:
    """For rows (id, x, y) whose class is the exclusive or of two features: a linear model, and of some networks with a hidden layer the one that is right most often."""
    right = lambda m: m.model.transform(df).where("prediction = y").count()
    linear = fit(LogisticRegression(featuresCol="x", labelCol="y"), df)
    hidden = [fit(MultilayerPerceptronClassifier(layers=[2, 4, 2], featuresCol="x", labelCol="y", seed=s, maxIter=200), df) for s in seeds]
    return linear, max(hidden, key=right)
