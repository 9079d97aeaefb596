"""Cleaning: projections, filters, filling and row identity, as column expressions.

Statistics that a step learns (medians, modes, sparse columns) are one aggregate
over the rows it is fitted on; everything else stays in one projection.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import quantiles
from tessera.sources.scratch import stored


def finite(col: Column | str) -> Column:
    """NaN and infinities as null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~(F.isnan(c) | (F.abs(c) == F.lit(float("inf")))), c)


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.FloatType, T.DoubleType))]


def drop_sparse_columns(df: DataFrame, max_missing: float) -> DataFrame:
    """Drop columns of which more than ``max_missing`` of the rows are null; one aggregate for all columns."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if (shares[c] or 0.0) > max_missing])


def drop_null(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(subset) if subset else None)


def drop_any_null_or_nan(df: DataFrame) -> DataFrame:
    """Rows without null in any column and without NaN in any float column."""
    bad = [F.col(c).isNull() for c in df.columns] + [F.isnan(c) for c in float_columns(df)]
    return df.where(~reduce(or_, bad))


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact medians over values that are not null."""
    return dict(quantiles.medians(df, columns))


def fill_median(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    found = {c: v for c, v in medians(df, columns).items() if v is not None}
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in found.items()})


def mode_of(df: DataFrame, column: str) -> str | None:
    """The most frequent value; the smallest of equals."""
    row = df.where(F.col(column).isNotNull()).groupBy(column).count().orderBy(F.desc("count"), column).limit(1).first()
    return row[0] if row else None


def fill_mode(df: DataFrame, column: str) -> DataFrame:
    found = mode_of(df, column)
    return df if found is None else df.withColumn(column, F.coalesce(F.col(column), F.lit(found)))


def with_token(column: str, token: str) -> Column:
    """A category as string, null as ``token``."""
    return F.coalesce(F.col(column).cast("string"), F.lit(token))


def binarize_text(column: str, positive: str, strip: str = ".") -> Column:
    """1 where the text, without trailing ``strip`` characters, is ``positive``."""
    return (F.rtrim(F.trim(F.col(column)), F.lit(strip)) == positive).cast("long")


def binarize_above(column: str, limit: float = 0) -> Column:
    return (F.col(column) > limit).cast("int")


def coerce_numeric(col: Column | str) -> Column:
    """As a finite double, or null."""
    c = F.col(col) if isinstance(col, str) else col
    return finite(c.try_cast("double"))


def row_index(df: DataFrame, order_by: Sequence[str], name: str = "idx") -> DataFrame:
    """Fresh positions 0..n-1 in the order of a key.

    Each partition of a range partitioning is numbered on its own and shifted by the rows before it,
    so no task sees the whole table.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by).withColumn("_m", F.monotonically_increasing_id())
    placed = stored(placed, "placed")  # both uses must see the same range bounds, which are drawn when first computed
    part = F.shiftright("_m", 33)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, rows = 0, []
    for p in sorted(sizes):  # one row per partition
        rows.append((p, before))
        before += sizes[p]
    shift = spark.createDataFrame(rows or [(0, 0)], "_part long, _before long")
    return (
        placed.join(F.broadcast(shift), part == F.col("_part"))
        .withColumn(name, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_m", "_part", "_before")
    )


def cumulative(df: DataFrame, order_by: Sequence[str | Column], sums: Mapping[str, str]) -> DataFrame:
    """For each name the sum of a column over all rows before, in the order of a key (columns or sort expressions).

    Sums run inside the partitions of a range partitioning, and each is shifted by the totals of the partitions before it,
    so no task sees the whole table.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order_by).withColumn("_part", F.spark_partition_id())
    placed = stored(placed, "placed")  # both uses must see the same range bounds, which are drawn when first computed
    totals = placed.groupBy("_part").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_before_{name}") for name, c in sums.items()])
    before, rows = [0] * len(sums), []
    for r in sorted(totals.collect(), key=lambda r: r["_part"]):  # one row per partition
        rows.append((r["_part"], *before))
        before = [b + t for b, t in zip(before, r[1:], strict=True)]
    kinds = [float if f.dataType == T.DoubleType() else int for f in totals.schema[1:]]
    shift = spark.createDataFrame([(p, *[k(b) for k, b in zip(kinds, own, strict=True)]) for p, *own in rows], totals.schema)
    w = Window.partitionBy("_part").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumns({name: F.coalesce(F.sum(c).over(w), F.lit(0)) for name, c in sums.items()})
    moved = inside.join(F.broadcast(shift), "_part")
    return moved.withColumns({name: F.col(name) + F.col(f"_before_{name}") for name in sums}).drop("_part", *[f"_before_{name}" for name in sums])


def keep_first(df: DataFrame, columns: Sequence[str], order_by: str) -> DataFrame:
    """Of rows equal in ``columns`` the one that comes first by ``order_by``; the group's least key is a combinable aggregate."""
    first = df.groupBy(*columns).agg(F.min(order_by).alias("_first"))
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(first[c]) for c in columns])
    return df.join(first, same & (df[order_by] == first["_first"]), "left_semi")


def reconcile(df: DataFrame, schema: T.StructType, dropped: Sequence[str] = ()) -> DataFrame:
    """The columns of ``schema``: absent ones null, present ones cast leniently, others and ``dropped`` removed."""
    out = []
    for f in schema:
        if f.name in dropped:
            continue
        out.append((F.col(f.name).try_cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name))
    return df.select(*out)


def contract_errors(ranges: Mapping[str, tuple[float | None, float | None]]) -> Column:
    """The names of the columns outside their closed ranges, joined by commas; '' is valid, null always is."""
    tests = []
    for name, (lo, hi) in ranges.items():
        bad = F.lit(False)
        if lo is not None:
            bad = bad | (F.col(name) < lo)
        if hi is not None:
            bad = bad | (F.col(name) > hi)
        tests.append(F.when(bad, F.lit(name)))
    return F.concat_ws(",", *tests)
