"""Profiles of tables: each is one aggregate, unpivoted where a row per column is wanted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.clean import row_index
from tessera.operators.quantiles import quantiles


def _per_column(df: DataFrame, columns: Sequence[str], stats: dict[str, callable], out: str) -> DataFrame:
    """All statistics of all columns in one pass, then one row per column."""
    row = df.agg(*[f(c).alias(f"{s}|{c}") for c in columns for s, f in stats.items()])
    items = [F.struct(F.lit(c).alias(out), *[F.col(f"`{s}|{c}`").alias(s) for s in stats]) for c in columns]
    return row.select(F.inline(F.array(*items)))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)).cast("long"))


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column and their share in percent, only columns with any."""
    columns = columns or df.columns
    table = _per_column(
        df,
        columns,
        {
            "n_missing": lambda c: F.sum(F.col(c).isNull().cast("long")),
            "pct_missing": lambda c: F.avg(F.col(c).isNull().cast("double")) * 100,
        },
        "column_name",
    )
    return table.where("n_missing > 0")


def duplicate_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How many rows repeat an earlier one."""
    groups = df.groupBy(*(columns or df.columns)).agg(F.count("*").alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("n_duplicates"))


def describe_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, min, exact quartiles, max per column."""
    moments = _per_column(
        df,
        columns,
        {
            "n": lambda c: F.count(c),
            "mean": lambda c: F.avg(F.col(c).cast("double")),
            "std": lambda c: F.stddev_samp(F.col(c).cast("double")),
            "min": lambda c: F.min(F.col(c).cast("double")),
            "max": lambda c: F.max(F.col(c).cast("double")),
        },
        "column_name",
    )
    at = lambda share: F.max(F.when(F.col("share") == share, F.col("value")))
    found = quantiles(df, columns, [0.25, 0.5, 0.75]).groupBy("column_name").agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))
    return moments.join(found, "column_name", "left").select("column_name", "n", "mean", "std", "min", "q1", "median", "q3", "max")


def describe_category(df: DataFrame, column: str) -> DataFrame:
    """count, distinct values, the most frequent (smallest of equals) and its frequency."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    return counts.agg(
        F.sum("n").alias("n"),
        F.count("*").alias("n_unique"),
        F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("top"),
        F.max("n").alias("freq"),
    )


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Rows and percent per label; the total comes from the group counts."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("label", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))  # total: one row


def target_rate(df: DataFrame, group: Column | str, y: str) -> DataFrame:
    g = F.col(group) if isinstance(group, str) else group
    return df.groupBy(g.alias("grp")).agg(F.avg(F.col(y).cast("double")).alias("rate"), F.count("*").alias("n"))


def class_histogram(df: DataFrame, value: str, label: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Density of ``value`` per class over equal bins of [lo, hi]; the last bin is closed."""
    width = (hi - lo) / bins
    index = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1)).cast("long")
    counts = (
        df.where(F.col(value).between(lo, hi)).groupBy(F.col(label).alias("label"), index.alias("bin")).agg(F.count("*").alias("n"))
    )
    totals = counts.groupBy(F.col("label").alias("l2")).agg(F.sum("n").alias("total"))
    return counts.join(totals, F.col("label").eqNullSafe(F.col("l2"))).select(
        "label", "bin", "n", (F.col("n") / (F.col("total") * width)).alias("density")
    )


def vocabulary(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with their places in code-point order, from 0."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("value")).distinct()
    return row_index(values, ["value"], "place")


def cardinality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values per column; pairs of column and value are combined before they are shuffled, and no row is expanded in an aggregate."""
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(cells)).distinct().groupBy("column_name").agg(F.count("value").alias("n_distinct"))


def prevalence(df: DataFrame, y: str) -> DataFrame:
    """Rate of positives, accuracy of the majority class, and the weight that balances positives."""
    pos = F.sum(F.col(y).cast("long"))
    return df.agg(
        F.avg(F.col(y).cast("double")).alias("prevalence"),
        F.greatest(F.avg(F.col(y).cast("double")), 1 - F.avg(F.col(y).cast("double"))).alias("majority_accuracy"),
        ((F.count(y) - pos) / F.greatest(pos, F.lit(1))).alias("positive_weight"),
    )


def center_and_scale(df: DataFrame, columns: Sequence[str], ddof: int = 1) -> DataFrame:
    """Mean and deviation per column; a deviation that is missing or below 1e-8 counts as 1."""
    dev = F.stddev_samp if ddof else F.stddev_pop
    return _per_column(
        df,
        columns,
        {
            "mean": lambda c: F.avg(F.col(c).cast("double")),
            "std": lambda c: F.when(dev(F.col(c).cast("double")) > 1e-8, dev(F.col(c).cast("double"))).otherwise(1.0),
        },
        "column_name",
    )
