"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as a Java character class body; words are what lies between.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where the session names none (tests, local mode) a temporary folder of
    this machine stands in and is remembered in the session.
    """
    for read in (
        lambda: spark.conf.get("spark.checkpoint.dir", None),
        lambda: spark.sparkContext.getConf().get("spark.checkpoint.dir"),
    ):
        found = read()
        if found:
            return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table or folder below the shared folder."""
    return f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage at a copy that outlives any executor.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.stored_at = path
    return kept


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder below the shared folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialize()`` from which nothing is read any more."""
    for t in tables:
        delete_path(t.sparkSession, t.stored_at.rpartition("/")[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of fewer bytes than this per core is dealt out by rows, as its file may be a single split.
SMALL_SPLIT = 16 << 20


def file_bytes(df: DataFrame) -> int | None:
    """Bytes of the files that a frame reads, from the plan's statistics; None where it isn't one plain scan of files."""
    plan = df._jdf.queryExecution().optimizedPlan()
    size = int(str(plan.stats().sizeInBytes()))
    return size if plan.collectLeaves().size() == 1 and size < 1 << 60 else None


def spread(df: DataFrame) -> DataFrame:
    """A table just read, dealt out over all cores where it is too small for as many splits."""
    cores, size = df.sparkSession.sparkContext.defaultParallelism, file_bytes(df)
    return df.repartition(cores) if size is not None and size < cores * SMALL_SPLIT else df


def tasks_for(df: DataFrame, per_task: int = 128 << 20) -> int:
    """How many partitions to deal a table's rows into: those of the session, or more so that each holds ``per_task`` bytes at most."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(file_bytes(df) or 0) // per_task))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]++"), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
