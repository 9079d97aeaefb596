"""Files as tables: delimited text, JSON, zip members, and images; and the sinks that match them."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path that all executors see: below spark.checkpoint.dir, or a temporary folder in local mode without one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}/{name}"


def read_delimited(
    spark: SparkSession, path: str, schema: StructType | str, sep: str = ",", header: bool = False, missing: str = "?",
    comment: str | None = None, padded: bool = True,
) -> DataFrame:
    """Delimited text with a declared schema: ``missing`` becomes null, blanks around values go, ``comment`` lines are skipped."""
    reader = (
        spark.read.schema(schema).option("sep", sep).option("header", header).option("nullValue", missing)
        .option("ignoreLeadingWhiteSpace", padded).option("ignoreTrailingWhiteSpace", padded)
    )
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.option("header", True).option("sep", sep).csv(path)


def read_records(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON that is an object or a list of objects per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_zip_member(spark: SparkSession, path: str, member: str) -> DataFrame:
    """The lines of a member of each zip file, with their numbers; archives are opened where they are read."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(member) as f:
                    lines = [x.rstrip("\r\n") for x in io.TextIOWrapper(f, "utf-8")]
                for lo in range(0, len(lines), 10_000):
                    part = lines[lo : lo + 10_000]
                    yield pd.DataFrame({"path": name, "line_no": np.arange(lo, lo + len(part)), "line": part})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, line_no long, line string")


def parse_lines(lines: DataFrame, schema: StructType | str, sep: str = ",", missing: str = "?") -> DataFrame:
    """Delimited lines of a column to columns."""
    options = {"sep": sep, "nullValue": missing, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    ddl = schema if isinstance(schema, str) else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return lines.where("line <> '' and not startswith(line, '|')").select(F.from_csv("line", ddl, options).alias("r")).select("r.*")


def write_binary(df: DataFrame, path: str) -> int:
    """Each row's ``content`` as a file ``name`` below ``path``, written by the tasks; how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with fs.open_output_stream(f"{base}/{name}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return df.select("name", "content").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_zips(lines: DataFrame, path: str, member: str, head: str = "") -> None:
    """The column ``line`` as zip archives, one for each Arrow batch of rows, each with one member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = io.BytesIO()
            with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr(member, head + "\n".join(batch.column(0).to_pylist()))
                z.writestr("other.data", "0, none")
            yield pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4().hex}.zip"]), pa.array([raw.getvalue()], pa.binary())], names=["name", "content"])

    write_binary(lines.select("line").mapInArrow(run, "name string, content binary"), path)
