"""Intermediate tables in the folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.sources.files import scratch_path


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: a copy that outlives executors, holds no storage memory, and ends the plan.

    It stays there until ``drop`` or until the folder is cleared.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.stored_at = path
    return kept


def drop(*tables: DataFrame) -> None:
    """Remove tables of ``stored`` from which nothing is read any more."""
    for t in tables:
        spark = t.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(t.stored_at.rpartition("/")[0])
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
