"""Folds over a training history: one row per epoch, so ordered windows and folds are small by nature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_so_far(history: DataFrame, epoch: str, metric: str, larger: bool = False, least_gain: float = 0.0) -> DataFrame:
    """``best``, ``is_record`` and ``since_record``: epochs since the last strict improvement by more than ``least_gain``."""
    w = Window.orderBy(epoch)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    value = F.col(metric)
    prior = F.max(metric).over(before) if larger else F.min(metric).over(before)
    record = value > prior + least_gain if larger else value < prior - least_gain
    out = history.withColumn("is_record", F.coalesce(record, F.lit(True)))
    out = out.withColumn("best", (F.max(metric) if larger else F.min(metric)).over(w))
    last = F.max(F.when(F.col("is_record"), F.col(epoch))).over(w)
    return out.withColumn("since_record", F.col(epoch) - last)


def stop_epoch(history: DataFrame, epoch: str, metric: str, patience: int, larger: bool = False) -> DataFrame:
    """The first epoch at which ``patience`` epochs went by without a record, else the last."""
    marked = best_so_far(history, epoch, metric, larger)
    return marked.agg(F.coalesce(F.min(F.when(F.col("since_record") >= patience, F.col(epoch))), F.max(epoch)).alias("stop_epoch"))


def reduce_on_plateau(
    history: DataFrame, epoch: str, metric: str, start: float, factor: float = 0.5, patience: int = 2, threshold: float = 1e-4
) -> DataFrame:
    """``lr`` after each epoch: times ``factor`` whenever more than ``patience`` epochs bring no relative improvement."""
    steps = history.agg(F.array_sort(F.collect_list(F.struct(F.col(epoch).alias("e"), F.col(metric).cast("double").alias("m")))).alias("h"))
    kind = "struct<best:double,bad:int,lr:double,out:array<struct<epoch:bigint,lr:double>>>"
    zero = F.struct(
        F.lit(float("inf")).alias("best"), F.lit(0).alias("bad"), F.lit(start).alias("lr"), F.array().cast("array<struct<epoch:bigint,lr:double>>").alias("out")
    ).cast(kind)

    def step(acc, x):
        better = x["m"] < acc["best"] * (1 - threshold)
        bad = F.when(better, 0).otherwise(acc["bad"] + 1)
        cut = bad > patience
        lr = F.when(cut, acc["lr"] * factor).otherwise(acc["lr"])
        row = F.struct(x["e"].cast("bigint").alias("epoch"), lr.alias("lr"))
        return F.struct(
            F.when(better, x["m"]).otherwise(acc["best"]).alias("best"),
            F.when(cut, 0).otherwise(bad).alias("bad"),
            lr.alias("lr"),
            F.concat(acc["out"], F.array(row)).alias("out"),
        ).cast(kind)

    return steps.select(F.inline(F.aggregate("h", zero, step, lambda a: a["out"])))
