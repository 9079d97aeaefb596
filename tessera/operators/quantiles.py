"""Exact order statistics by distributed selection.

An exact ``percentile`` holds all distinct values of a column, or of a category, in one reducer. Here values are
mapped to 64-bit integers in the same order, and the range that holds a wanted rank is narrowed round by round: rows inside it are
counted by up to 4,098 bins per range (combined before they are shuffled, whatever the rows), the bin with the rank is the next range, with the
bin's own least and greatest image as its bounds. So the bits above the range's width are settled in each round as in a radix select,
twelve or more of them, and at most six rounds are needed. A range that holds few rows, or one value, is read out.
Many columns, categories and quantiles are selected side by side; no task's state grows with the number of rows or distinct values.

Nulls are left out; NaN is greater than all other numbers, as in Spark's own order. A group without values has no row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import drop, stored

#: A range with at most so many values is read out; where no group has more, one aggregate does all.
FEW = 1 << 12
_BIN_BITS = 12
_TOP = (1 << 63) - 1


def sortable(value: Column) -> Column:
    """A double as a 64-bit integer in the same order; equal doubles have equal images, others different ones but for rounding of the
    logarithm at powers of two, which keeps the order. 0.0 and -0.0 are equal. Exponent and fraction by arithmetic, as Spark has no function for the bits.
    """
    x = value.cast("double")
    a = F.abs(x)
    # the logarithm of 0 is null; below the least normal number the exponent stays
    e = F.coalesce(F.least(F.greatest(F.floor(F.log2(F.when(a < float("inf"), a))), F.lit(-1022)), F.lit(1023)), F.lit(-1022)).cast("int")
    fraction = F.floor((a / F.pow(F.lit(2.0), e.cast("double")) - 1.0) * float(1 << 52)).cast("long")
    image = (e.cast("long") + 1023) * F.lit(1 << 52) + fraction
    image = F.when(F.isnan(x), F.lit(_TOP)).when(a == float("inf"), F.lit(_TOP - 1)).otherwise(image)
    return F.when(x < 0, -image).otherwise(image)


def _same(a: str, b: str, keys: Sequence[str]) -> Column:
    return reduce(and_, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def quantiles(
    df: DataFrame, columns: Sequence[str], shares: Sequence[float], by: Sequence[str] = (), few: int | None = None
) -> DataFrame:
    """``by``, column_name, share, value, n: each column's exact quantiles per group, linear between neighbours; n: values that are not null.

    ``few`` bounds the values of one group that any task holds.
    """
    few = FEW if few is None else few
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in columns])
    keys = [*[f"_g{i}" for i in range(len(by))], "column_name"]
    rows = df.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(by)], F.inline(cells)).where("x is not null")
    named = [*[F.col(f"_g{i}").alias(c) for i, c in enumerate(by)], "column_name", "share", "value", "n"]
    sized = stored(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("greatest")), "sized")
    if not sized.where(F.col("n") > few).head(1):
        # no group has more: the aggregate holds at most so many values
        held = rows.groupBy(*keys).agg(F.percentile("x", F.array(*[F.lit(float(s)) for s in shares])).alias("v"), F.count("*").alias("n"))
        parts = F.arrays_zip(F.array(*[F.lit(float(s)) for s in shares]).alias("share"), F.col("v").alias("value"))
        return held.select(*keys, "n", F.inline(parts)).select(*named)

    # the places of the lower and the upper neighbour of each quantile
    wanted = sized.select(*keys, "n", F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share"))
    place = F.col("share") * (F.col("n") - 1)
    wanted = wanted.withColumn("place", place).select(
        *keys, "n", "share", "place", F.explode(F.array_distinct(F.array(F.floor("place"), F.ceil("place")))).alias("k")
    )
    targets = wanted.select(*keys, "k").distinct()
    targets = stored(
        targets.alias("t").join(sized.alias("s"), _same("t", "s", keys)).select(
            *[F.col(f"t.{k}") for k in keys], "k", sortable(F.col("least")).alias("lo"), sortable(F.col("greatest")).alias("hi"),
            F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"),
        ),
        "targets",
    )
    rows = rows.withColumn("image", sortable(F.col("x")))
    is_open = (F.col("inside") > few) & (F.col("lo") < F.col("hi"))
    while targets.where(is_open).head(1):
        narrowed = stored(_narrowed(rows, targets.where(is_open), keys).unionByName(targets.where(~is_open)), "targets")
        drop(targets)
        targets = narrowed
    found = _read_out(rows, targets, keys)
    low = found.select(*keys, F.col("k").alias("k_low"), F.col("value").alias("low"))
    high = found.select(*keys, F.col("k").alias("k_high"), F.col("value").alias("high"))
    w = wanted.groupBy(*keys, "n", "share", "place").agg(F.min("k").alias("a"), F.max("k").alias("b"))
    out = w.alias("w").join(low.alias("l"), _same("w", "l", keys) & (F.col("a") == F.col("k_low"))).select("w.*", "low")
    out = out.alias("w").join(high.alias("h"), _same("w", "h", keys) & (F.col("b") == F.col("k_high"))).select("w.*", "high")
    between = (F.col("b") - F.col("place")) * F.col("low") + (F.col("place") - F.col("a")) * F.col("high")
    out = stored(out.withColumn("value", F.when((F.col("a") == F.col("b")) | (F.col("low") == F.col("high")), F.col("low")).otherwise(between)).select(*named), "quantiles")
    drop(sized, targets)
    return out


def _bin(lo: Column, hi: Column) -> Column:
    """How far images are shifted, so that the range falls into at most 4,098 bins."""
    width = hi.cast("double") - lo.cast("double") + 1.0
    return F.greatest(F.lit(0), F.ceil(F.log2(width)).cast("int") - _BIN_BITS)


def _narrowed(rows: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each target with the bin of its range that holds its rank as the new range."""
    ranges = targets.select(*keys, "lo", "hi", "below").distinct().withColumn("shift", _bin(F.col("lo"), F.col("hi")))
    inside = rows.alias("r").join(ranges.alias("s"), _same("r", "s", keys) & F.col("image").between(F.col("lo"), F.col("hi")))
    shifted = lambda c: F.call_function("shiftright", F.col(c), F.col("shift"))
    bins = (
        inside.select(*[f"s.{k}" for k in keys], "lo", "hi", "below", (shifted("image") - shifted("lo")).alias("bin"), "image")
        .groupBy(*keys, "lo", "hi", "below", "bin")
        .agg(F.count("*").alias("n"), F.min("image").alias("bin_lo"), F.max("image").alias("bin_hi"))
    )
    # a range has 4,098 bins at most, so the window is bounded
    before = Window.partitionBy(*keys, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("start", F.col("below") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    at = _same("t", "b", keys) & (F.col("t.lo") == F.col("b.lo")) & (F.col("t.hi") == F.col("b.hi"))
    at = at & (F.col("k") >= F.col("start")) & (F.col("k") < F.col("start") + F.col("b.n"))
    return targets.alias("t").join(bins.alias("b"), at).select(
        *[F.col(f"t.{k}") for k in keys], "k", F.col("bin_lo").alias("lo"), F.col("bin_hi").alias("hi"), F.col("start").alias("below"), F.col("b.n").alias("inside")
    )


def _read_out(rows: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The values at the targets' ranks, whose ranges hold few values or one."""
    ranges = targets.select(*keys, "lo", "hi", "below").distinct()
    inside = rows.alias("r").join(ranges.alias("s"), _same("r", "s", keys) & F.col("image").between(F.col("lo"), F.col("hi")))
    counted = inside.select(*[f"s.{k}" for k in keys], "lo", "hi", "below", "x").groupBy(*keys, "lo", "hi", "below", "x").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*keys, "lo", "hi").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("start", F.col("below") + F.coalesce(F.sum("n").over(before), F.lit(0)))
    at = _same("t", "c", keys) & (F.col("t.lo") == F.col("c.lo")) & (F.col("t.hi") == F.col("c.hi"))
    at = at & (F.col("k") >= F.col("start")) & (F.col("k") < F.col("start") + F.col("c.n"))
    return targets.alias("t").join(counted.alias("c"), at).select(*[F.col(f"t.{k}") for k in keys], "k", F.col("c.x").alias("value"))


def medians(df: DataFrame, columns: Sequence[str], few: int | None = None) -> Mapping[str, float | None]:
    """Exact medians over values that are not null, per column; None without any."""
    found = {r["column_name"]: r["value"] for r in quantiles(df, columns, [0.5], few=few).collect()}  # one row per column
    return {c: found.get(c) for c in columns}
