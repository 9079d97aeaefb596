"""Adaptive boosting of decision stumps.

Features are cut into bins at their exact quantiles once, side by side in eight passes. Each round is one pass: a task works out its rows' weights from the stumps so
far, so that no weight is stored, and adds them up per feature, bin and class; the sums are added by position over tasks, and the driver, which holds
features x bins numbers, picks the stump with the least weighted error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.learn.moments import scored_by
from tessera.nn.train import matrix
from tessera.sources.scratch import drop, stored


@dataclass
class Stumps:
    """(feature, cut, side, weight): a row votes ``side * weight`` where its feature is above the cut, and the opposite elsewhere."""

    stumps: list[tuple[int, float, float, float]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for feature, cut, side, weight in self.stumps:
            out += np.where(x[:, feature] > cut, side, -side) * weight
        return out

    def scored(self, df: DataFrame, *keep: str) -> DataFrame:
        return scored_by(df, lambda x: 2 * self.margin(x), *keep)


def cuts(df: DataFrame, width: int, bins: int) -> np.ndarray:
    """``bins - 1`` cuts per feature at exact quantiles, linear between neighbours: features x cuts, ascending."""
    n = np.array(df.agg(*[F.count(F.get("x", F.lit(i))) for i in range(width)]).first() if width else [], np.int64)  # nulls are left out
    if not n.any() or bins < 2:
        return np.zeros((width, bins - 1))
    place = np.arange(1, bins) / bins * np.maximum(n - 1, 0)[:, None]
    a, b = np.floor(place), np.ceil(place)
    low, high = np.split(_at_ranks(df, np.hstack([a, b]).astype(np.int64)), 2, axis=1)
    with np.errstate(invalid="ignore"):  # infinite neighbours
        out = np.where((a == b) | (low == high), low, (b - place) * low + (place - a) * high)
    return np.where(n[:, None] > 0, out, 0.0)


def _images(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order; NaN is the greatest, and 0.0 and -0.0 are equal."""
    bits = (np.where(np.isnan(x), np.nan, x) + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _at_ranks(rows: DataFrame, ranks: np.ndarray) -> np.ndarray:
    """The values at each feature's ``ranks`` (from 0): features x ranks.

    A radix select of the values' images, eight bits a pass: tasks count their rows by the next bits within the ranges that hold a rank,
    so that they and the driver hold 256 numbers at most per feature and rank.
    """
    start, left = np.zeros(ranks.shape, np.uint64), ranks.copy()  # the bits settled, and the rank within them
    for shift in range(56, -1, -8):
        ranges = [np.unique(v) for v in start]
        first = np.concatenate([[0], np.cumsum([len(r) for r in ranges])])  # ranges of the features before
        counts = _counted(rows, ranges, first, shift)
        for f, own in enumerate(ranges):
            upto = counts[first[f] + np.searchsorted(own, start[f])].cumsum(axis=1)
            digit = np.minimum((upto <= left[f][:, None]).sum(axis=1), 255)  # beyond 255: a feature without values
            left[f] -= np.where(digit > 0, upto[np.arange(len(digit)), digit - 1], 0)
            start[f] = (start[f] << np.uint64(8)) | digit.astype(np.uint64)
    return np.where(start >> np.uint64(63), start & np.uint64((1 << 63) - 1), ~start).view(np.float64)


def _counted(rows: DataFrame, ranges: list[np.ndarray], first: np.ndarray, shift: int) -> np.ndarray:
    """How many rows each range holds by the eight bits above ``shift``: ranges x 256. A range is the bits above those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(first[-1] * 256, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, there = np.ascontiguousarray(matrix(batch.column(0)).T), batch.column(0).flatten().is_valid()
            there = there.to_numpy(zero_copy_only=False).reshape(x.shape[::-1]).T
            for f, own in enumerate(ranges):
                bits = _images(x[f]) >> np.uint64(shift)
                head = bits >> np.uint64(8)
                at = np.minimum(np.searchsorted(own, head), len(own) - 1)
                inside = (own[at] == head) & there[f]
                place = at[inside] * 256 + (bits[inside] & np.uint64(255)).astype(np.int64)
                total[first[f] * 256 : first[f + 1] * 256] += np.bincount(place, minlength=len(own) * 256)
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[i])], names=["i", "n"])

    found = rows.mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()  # 256 rows a range at most
    out = np.zeros(first[-1] * 256, np.int64)
    out[found["i"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(-1, 256)


def boosted_stumps(df: DataFrame, rounds: int = 25, bins: int = 16) -> Stumps:
    """``rounds`` stumps at most; an end where none is better than chance, or one is right about all rows."""
    rows = stored(df.select(F.col("x").cast("array<double>").alias("x"), F.col("y").cast("int").alias("y")), "boosting")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    edges, model = cuts(rows, width, bins), Stumps()
    for _ in range(rounds):
        found = _best(_weights(rows, model, edges), edges)
        if found is None:
            break
        feature, cut, side, error = found
        model.stumps.append((feature, cut, side, 0.5 * float(np.log((1 - error) / error))))
        if error <= 1e-10:
            break
    drop(rows)
    return model


def _weights(rows: DataFrame, model: Stumps, edges: np.ndarray) -> np.ndarray:
    """The rows' weights per class, feature and bin; bin b holds values above b cuts."""
    width, bins = edges.shape[0], edges.shape[1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width, bins))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = matrix(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            w = np.exp(-np.where(y == 1, 1.0, -1.0) * model.margin(x))
            for f in range(width):
                at = np.searchsorted(edges[f], x[:, f], "left")  # how many cuts are below the value
                for k in (0, 1):
                    total[k, f] += np.bincount(at[y == k], w[y == k], bins)
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["m"])

    sums = rows.mapInArrow(run, "m array<double>").select(F.posexplode("m").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    out = np.zeros(2 * width * bins)
    for r in sums.collect():  # classes x features x bins
        out[r["i"]] = r["v"]
    return out.reshape(2, width, bins)


def _best(weights: np.ndarray, edges: np.ndarray) -> tuple[int, float, float, float] | None:
    """The stump (feature, cut, side) with the least error, the first of equals; None if no better than chance."""
    whole = weights[:, :1].sum() if weights.size else 0.0
    if not whole or not edges.size:
        return None
    above = weights[:, :, ::-1].cumsum(axis=2)[:, :, ::-1][:, :, 1:]  # class x feature x cut
    of_class = weights[:, :1].sum(axis=(1, 2))
    wrong = (above[0] + of_class[1] - above[1]) / whole  # positives above the cut
    errors = np.stack([wrong, 1 - wrong])
    side, feature, cut = np.unravel_index(np.argmin(np.round(errors, 12)), errors.shape)
    error = max(1e-12, float(errors[side, feature, cut]))
    return (int(feature), float(edges[feature, cut]), 1.0 if side == 0 else -1.0, error) if error < 0.5 - 1e-12 else None
