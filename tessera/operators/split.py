"""Splits and samples without random generators: rows are ordered by a hash of seed and key.

The order depends on the key alone, so a split is the same whatever the partitioning, and adding rows moves none
of the others relative to each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.clean import row_index

def hash_order(seed: int, key: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def _first_share(df: DataFrame, key: str, fraction: float, seed: int, by: str | None, name: str) -> DataFrame:
    """``name`` true for the first floor(n * fraction) rows in hash order, per class if ``by`` is given.

    The cut of each class is an exact order statistic of 60-bit hash prefixes found by aggregation (no sort of a
    class in one task); the few rows that share the cut's prefix are then told apart by full hash and key.
    """
    order = hash_order(seed, key)
    h = F.conv(F.substring(order, 1, 15), 16, 10).cast("long")
    g = F.col(by) if by else F.lit(0)
    rows = df.withColumn("_g", g).withColumn("_h", h)
    step = 1 << 44
    coarse = rows.groupBy("_g", F.expr(f"_h div {step}").alias("_b")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy("_g").orderBy("_b")  # at most 2**16 rows per class
    coarse = coarse.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).withColumn(
        "_want", F.floor(F.sum("_n").over(Window.partitionBy("_g")) * F.lit(fraction)).cast("long")
    )
    rows = rows.withColumn("_b", F.expr(f"_h div {step}"))
    edge = coarse.where((F.col("_before") < F.col("_want")) & (F.col("_before") + F.col("_n") > F.col("_want")))
    inner = (
        rows.join(edge.select("_g", "_b", "_before", "_want"), ["_g", "_b"])
        .withColumn("_rn", F.row_number().over(Window.partitionBy("_g").orderBy(order, key)))
        .where(F.col("_rn") + F.col("_before") <= F.col("_want"))
        .select(F.col(key).alias("_k"))
    )
    whole = coarse.where(F.col("_before") + F.col("_n") <= F.col("_want")).select("_g", "_b", F.lit(True).alias("_all"))
    return (
        rows.join(whole, ["_g", "_b"], "left")
        .join(inner, F.col(key) == F.col("_k"), "left")
        .withColumn(name, F.coalesce("_all", F.col("_k").isNotNull()))
        .drop("_g", "_h", "_b", "_all", "_k")
    )


def stratified_split(df: DataFrame, key: str, label: str, fraction: float, seed: int = 42, name: str = "is_val") -> DataFrame:
    """Mark floor(n * fraction) rows of each class."""
    return _first_share(df, key, fraction, seed, label, name)


def plain_split(df: DataFrame, key: str, fraction: float, seed: int = 42, name: str = "is_val") -> DataFrame:
    """Mark floor(n * fraction) rows, whatever their class."""
    return _first_share(df, key, fraction, seed, None, name)


def three_way_split(df: DataFrame, key: str, label: str, test: float = 0.2, val: float = 0.25, seed: int = 42) -> DataFrame:
    """``split``: test rows first, then ``val`` of the rest, per class."""
    outer = _first_share(df, key, test, seed, label, "_test")
    rest = _first_share(outer.where("not _test"), key, val, seed + 1, label, "_val")
    return (
        outer.where("_test").withColumn("split", F.lit("test")).drop("_test")
        .unionByName(rest.withColumn("split", F.when(F.col("_val"), "val").otherwise("train")).drop("_test", "_val"))
    )


def fixed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows, the first in hash order."""
    return df.orderBy(hash_order(seed, key), key).limit(n)


def folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """``fold`` 0..k-1, classes dealt evenly in hash order.

    Rows are numbered over a range partitioning by class and hash, so a large class is dealt by many tasks.
    """
    placed = row_index(df.withColumn("_h", hash_order(seed, key)), [label, "_h", key], "_i")
    first = placed.groupBy(F.col(label).alias("_l")).agg(F.min("_i").alias("_f"))
    out = placed.join(first, F.col(label).eqNullSafe(F.col("_l")))
    return out.withColumn("fold", ((F.col("_i") - F.col("_f")) % k).cast("long")).drop("_h", "_i", "_l", "_f")


def by_membership(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is among ``ids``, and the others."""
    return df.join(ids, key, "left_semi"), df.join(ids, key, "left_anti")
