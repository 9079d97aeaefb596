"""Streams: the batch scoring expressions over a stream, and windowed request metrics with a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def score_stream(stream: DataFrame, p: Column, threshold: float, *keep: str) -> DataFrame:
    """Stateless: probability, decision, and whether it is fragile. Works on batches as well; the threshold lies between 0 and 1."""
    if not 0 < threshold < 1:
        raise ValueError("a threshold lies between 0 and 1")
    return stream.select(*keep, p.alias("p")).select(
        *keep, "p", (F.col("p") >= threshold).cast("int").alias("decision"), (F.abs(F.col("p") - threshold) < 0.05).alias("fragile")
    )


def request_metrics(scored: DataFrame, ts: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests, positive share and fragile share per window; rows later than the watermark are left out on streams."""
    return (
        scored.withWatermark(ts, late)
        .groupBy(F.window(ts, window).alias("w"))
        .agg(
            F.count("*").alias("n"),
            F.avg(F.col("decision").cast("double")).alias("positive_share"),
            F.avg(F.col("fragile").cast("double")).alias("fragile_share"),
        )
        .select(F.col("w.start").alias("window_start"), "n", "positive_share", "fragile_share")
    )


def drift(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """Means of both frames per column, and their difference in deviations of the reference."""
    a = reference.agg(*[x for c in columns for x in (F.avg(c).alias(f"m|{c}"), F.stddev_samp(c).alias(f"s|{c}"))])
    b = current.agg(*[F.avg(c).alias(f"n|{c}") for c in columns])
    items = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(f"`m|{c}`").alias("reference_mean"), F.col(f"`n|{c}`").alias("current_mean"),
            F.when(F.col(f"`s|{c}`") > 0, (F.col(f"`n|{c}`") - F.col(f"`m|{c}`")) / F.col(f"`s|{c}`")).otherwise(0.0).alias("shift"),
        )
        for c in columns
    ]
    return a.join(b).select(F.inline(F.array(*items)))  # one row each
