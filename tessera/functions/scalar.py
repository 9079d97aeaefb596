"""Scalar and array functions of models, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` and the lambdas in it use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def log1p_clipped(x: Column | str) -> Column:
    """log(1 + x), negative values as 0."""
    return F.log1p(F.greatest(_c(x), F.lit(0.0)))


def z_score(x: Column | str, mean: float, std: float) -> Column:
    return (_c(x) - mean) / std


def sigmoid(z: Column | str) -> Column:
    return 1 / (1 + F.exp(-_c(z)))


def softmax(z: Column | str) -> Column:
    """Of an array; the maximum is subtracted first."""
    z = _c(z)
    e = bound(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top)))
    return bound(e, lambda v: bound(_total(v), lambda total: F.transform(v, lambda x: x / total)))


def log_sum_exp(z: Column | str) -> Column:
    z = _c(z)
    return bound(F.array_max(z), lambda top: top + F.log(F.aggregate(z, F.lit(0.0), lambda s, x: s + F.exp(x - top))))


def cross_entropy(z: Column | str, y: Column | str) -> Column:
    return log_sum_exp(z) - F.get(_c(z), _c(y).cast("int"))


def bce_with_logits(z: Column | str, y: Column | str, positive_weight: float = 1.0) -> Column:
    """Binary cross-entropy of a logit, stable for large ones; positives count ``positive_weight`` times."""
    z, y = _c(z), _c(y)
    loss = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
    return loss if positive_weight == 1.0 else F.when(y == 1, positive_weight).otherwise(1.0) * loss


def argmax(z: Column | str) -> Column:
    """Position of the first maximum, from 0."""
    z = _c(z)
    return (F.array_position(z, F.array_max(z)) - 1).cast("long")


def top_indexes(q: Column | str, k: int) -> Column:
    """Positions of the ``k`` largest values, the first of equals first."""
    q = _c(q)
    pairs = F.transform(q, lambda x, i: F.struct((-x).alias("n"), i.alias("i")))
    return F.slice(F.transform(F.array_sort(pairs), lambda p: p["i"]), 1, k)


def top_k(df: DataFrame, key: str, q: str, k: int) -> DataFrame:
    """key, rank from 1, class and probability of the ``k`` most probable classes."""
    pairs = F.transform(F.col(q), lambda x, i: F.struct((-x).alias("n"), i.alias("i")))
    rows = df.select(key, F.posexplode(F.slice(F.array_sort(pairs), 1, k)).alias("r", "x"))
    return rows.select(
        key, (F.col("r") + 1).cast("long").alias("rank"), F.col("x.i").cast("long").alias("class"), (-F.col("x.n")).alias("prob")
    )


def pixel_normalize(pixels: Column | str, mean: float, std: float) -> Column:
    """Bytes 0..255 to normalized values."""
    return F.transform(_c(pixels), lambda x: (x / 255.0 - mean) / std)


def invert(pixels: Column | str) -> Column:
    return F.transform(_c(pixels), lambda x: 255 - x)


def flip_horizontal(pixels: Column | str, width: int) -> Column:
    p = _c(pixels)
    return F.transform(p, lambda x, i: F.get(p, (i - i % width) + (width - 1 - i % width)))


def crop_padded(pixels: Column | str, width: int, height: int, dx: Column, dy: Column) -> Column:
    """The image shifted by (dx, dy), what comes in from outside is 0."""
    p = _c(pixels)

    def at(x: Column, i: Column) -> Column:
        col, row = i % width + dx, F.floor(i / width).cast("int") + dy
        inside = col.between(0, width - 1) & row.between(0, height - 1)
        return F.when(inside, F.get(p, F.when(inside, row * width + col).otherwise(0))).otherwise(F.lit(0).cast("double"))

    return F.transform(p, at)


def rotated(pixels: Column | str, width: int, degrees: Column) -> Column:
    """A square image turned by ``degrees`` about its middle: the nearest pixel, 0 outside."""
    p, c = _c(pixels), (width - 1) / 2

    def turned(way: Column) -> Column:
        def at(i: Column) -> Column:
            x, y = i % width - c, F.floor(i / width) - c
            col = F.rint(way["cos"] * x + way["sin"] * y + c).cast("int")
            row = F.rint(way["cos"] * y - way["sin"] * x + c).cast("int")
            inside = col.between(0, width - 1) & row.between(0, width - 1)
            return F.when(inside, F.get(p, F.when(inside, row * width + col).otherwise(0)).cast("double")).otherwise(0.0)

        return F.when(p.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(width * width - 1)), at))

    angle = F.radians(degrees)
    return bound(F.struct(F.cos(angle).alias("cos"), F.sin(angle).alias("sin")), turned)


def hash_fraction(seed: int, key: Column | str) -> Column:
    """A number in [0, 1) that depends on seed and key alone."""
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), _c(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return h / F.lit(float(1 << 32))
