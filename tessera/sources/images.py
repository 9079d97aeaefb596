"""Images as tables through Spark's image source, which decodes PNG, JPEG and others in the JVM, and their pixels by built-in expressions.

The source gives a row per file: its origin, height, width, number of channels and the bytes, row by row, blue before green before red. Files
that are no images are left out by the source, or come as rows of their own from ``unreadable``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import write_binary


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, channels, data (bytes); only files that decode."""
    found = spark.read.format("image").option("dropInvalid", True).load(path)
    return found.select(
        F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"),
        F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"),
    )


def unreadable(spark: SparkSession, path: str) -> DataFrame:
    """The paths of files that don't decode."""
    found = spark.read.format("image").option("dropInvalid", False).load(path)
    return found.where(F.col("image.height") < 0).select(F.col("image.origin").alias("path"))


def _byte(data: Column, at: Column) -> Column:
    return F.conv(F.hex(F.substr(data, at + 1, F.lit(1))), 16, 10).cast("int")


def gray(data: Column, channels: Column) -> Column:
    """Grey values 0 to 255, row by row: the byte itself, or 0.299 red + 0.587 green + 0.114 blue, rounded half up."""
    n = (F.length(data) / channels).cast("int")

    def value(i: Column) -> Column:
        at = i * channels
        mixed = _byte(data, at) * 114 + _byte(data, at + 1) * 587 + _byte(data, at + 2) * 299
        return F.when(channels == 1, _byte(data, at)).otherwise(F.floor((mixed + 500) / 1000).cast("int"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), value)).otherwise(F.array().cast("array<int>"))


def inverted(pixels: Column) -> Column:
    return F.transform(pixels, lambda v: 255 - v)


def resized(pixels: Column, width: Column | int, height: Column | int, to: int) -> Column:
    """``to`` x ``to`` values, bilinear between pixel centres, edges held."""
    w, h = (v if isinstance(v, Column) else F.lit(v) for v in (width, height))

    def place(i: Column, size: Column) -> Column:
        return F.least(F.greatest((i + 0.5) * size / F.lit(float(to)) - 0.5, F.lit(0.0)), (size - 1).cast("double"))

    def at(r: Column, c: Column) -> Column:
        return F.get(pixels, (r * w + c).cast("int")).cast("double")

    def value(i: Column) -> Column:
        r, c = place(F.floor(i / to), h), place(i % to, w)
        r0, c0 = F.floor(r), F.floor(c)
        r1, c1, fr, fc = F.least(r0 + 1, h - 1), F.least(c0 + 1, w - 1), r - r0, c - c0
        top = at(r0, c0) * (1 - fc) + at(r0, c1) * fc
        return top * (1 - fr) + (at(r1, c0) * (1 - fc) + at(r1, c1) * fc) * fr

    return F.transform(F.sequence(F.lit(0), F.lit(to * to - 1)), value)


def png(pixels: np.ndarray) -> bytes:
    """A PNG of a matrix of grey values, or of rows x columns x 3 of red, green and blue."""
    raw = np.asarray(pixels, np.uint8)
    h, w = raw.shape[:2]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), raw.reshape(h, -1)], axis=1).tobytes()  # each line unfiltered

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", w, h, 8, 2 if raw.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def write_pngs(df: DataFrame, path: str, name: str, pixels: str, width: int, cut: Column | None = None) -> int:
    """One grey PNG per row, ``<path>/<name>.png``, written by the tasks; pixels are numbers 0 to 255. Where ``cut`` holds only the first half of the file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [png(np.array(values).reshape(-1, width)) for values in batch.column(1).to_pylist()]
            made = [m[: len(m) // 2] if half else m for m, half in zip(made, batch.column(2).to_pylist(), strict=True)]
            names = pa.array([f"{key}.png" for key in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([names, pa.array(made, pa.binary())], names=["name", "content"])

    rows = df.select(F.col(name).cast("string"), F.col(pixels).cast("array<int>"), (F.lit(False) if cut is None else cut).alias("cut"))
    return write_binary(rows.mapInArrow(run, "name string, content binary"), path)
