"""Scoring arrays of features with a network, in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_arrays(df: DataFrame, key: str, features: str, forward, shape: tuple[int, ...] | None = None) -> DataFrame:
    """``key`` and the network's outputs ``z``; rows with a missing or wrongly sized array get null.

    ``forward`` is a network's method, whose first layer gives the size, or takes arrays of ``shape``.
    """
    net = getattr(forward, "__self__", None)
    size = int(np.prod(shape)) if shape else int(net.layers[0].weights.shape[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            fits = pa.compute.equal(pa.compute.list_value_length(column), size).fill_null(False)
            held = column.filter(fits)
            values = held.flatten()
            bad = np.zeros(len(held), bool)
            if values.null_count:
                bad = values.is_null().to_numpy(zero_copy_only=False).reshape(len(held), size).any(axis=1)
                values = values.fill_null(0)
            good = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
            out: list = [None] * len(column)
            if len(good):
                x = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, *(shape or (size,)))
                for i, z, no in zip(good.tolist(), forward(x), bad.tolist(), strict=True):
                    out[i] = None if no else z
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["key", "z"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), features).mapInArrow(run, f"key {kind}, z array<double>").withColumnRenamed("key", key)
