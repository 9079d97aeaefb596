"""Categorical encoders.

``fit_*`` returns a small DataFrame that maps a category to its columns; ``apply`` is
one left join with defaults for categories that the fit has not seen. The join is left to adaptive
execution, which broadcasts the map when it is small. Where the value depends on the
row and not only on its category (leave-one-out, ordered statistics), there is a form for the rows of the
fit, in the order of a declared key, and a ``_new`` form for others.

Parameters that libraries disagree on (smoothing, direction, hash) are explicit arguments.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.clean import cumulative, row_index
from tessera.operators.quantiles import quantiles


def codes(df: DataFrame, col: str, order_by: str | None = None, mapping: Sequence[str] | None = None) -> DataFrame:
    """``cat``, ``code`` from 1: in the order of ``mapping``, else of first appearance by ``order_by``, else of the values."""
    if mapping is not None:
        return df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(mapping, 1)], "cat string, code long")
    first = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("cat")).agg(F.min(order_by or col).alias("_first"))
    return row_index(first, ["_first", "cat"], "_place").select("cat", (F.col("_place") + 1).cast("long").alias("code"))


def apply(df: DataFrame, fitted: DataFrame, col: str, defaults: dict[str, object] | None = None) -> DataFrame:
    """Left join of the fitted columns by category; unknown categories take ``defaults`` (null where none is given)."""
    out = df.join(fitted.withColumnRenamed("cat", "_cat"), F.col(col) == F.col("_cat"), "left").drop("_cat")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()})


def one_hot(df: DataFrame, col: str, categories: Sequence[str], prefix: str | None = None) -> DataFrame:
    """One indicator per category; other values and null are 0 everywhere."""
    p = prefix or col
    return df.withColumns({f"{p}={v}": F.when(F.col(col) == v, 1).otherwise(0) for v in categories})


def digits(fitted: DataFrame, base: int, k: int, gray: bool = False) -> DataFrame:
    """Digits of the code in ``base``, most significant first, as ``d0``, ``d1``, ...; k: number of codes."""
    width = 1
    while base**width <= k:
        width += 1
    code = F.col("code").bitwiseXOR(F.shiftright("code", 1)) if gray else F.col("code")
    place = [base ** (width - 1 - i) for i in range(width)]
    return fitted.select("cat", *[(F.floor(code / p) % base).cast("long").alias(f"d{i}") for i, p in enumerate(place)])


def rank_hot(fitted: DataFrame, k: int) -> DataFrame:
    """``r1`` .. ``rk``: 1 up to the category's code."""
    return fitted.select("cat", *[F.when(F.col("code") >= j, 1).otherwise(0).alias(f"r{j}") for j in range(1, k + 1)])


def frequency(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("cat")).agg(F.count("*").alias("freq"))


def hashed(df: DataFrame, col: str, n: int) -> DataFrame:
    """``h0`` .. ``h(n-1)``: 1 in the bucket of the value's MD5 (first 32 bits modulo n)."""
    bucket = F.conv(F.substring(F.md5(F.col(col).cast("string")), 1, 8), 16, 10).cast("long") % n
    return df.withColumns({f"h{i}": F.when(bucket == i, 1).otherwise(0) for i in range(n)})


def sum_contrast(fitted: DataFrame, k: int) -> DataFrame:
    """Indicators of all levels but the last, which is -1 everywhere."""
    code = F.col("code")
    return fitted.select(
        "cat", *[F.when(code == k, -1.0).when(code == j, 1.0).otherwise(0.0).alias(f"c{j}") for j in range(1, k)]
    )


def backward_difference(fitted: DataFrame, k: int) -> DataFrame:
    """Each level against the one before."""
    return fitted.select("cat", *[F.when(F.col("code") > j, j / k).otherwise(-(k - j) / k).alias(f"c{j}") for j in range(1, k)])


def helmert(fitted: DataFrame, k: int, subsequent: bool = True) -> DataFrame:
    """Each level against the mean of the levels after it, or before it."""
    code = F.col("code")
    cols = []
    for j in range(1, k):
        if subsequent:
            rest = k - j
            c = F.when(code == j, rest / (rest + 1)).when(code > j, -1 / (rest + 1)).otherwise(0.0)
        else:
            c = F.when(code == j + 1, float(j)).when(code <= j, -1.0).otherwise(0.0)
        cols.append(c.alias(f"c{j}"))
    return fitted.select("cat", *cols)


def polynomial_values(k: int) -> list[list[float]]:
    """Orthonormal polynomials of degree 1..k-1 over the points 1..k, growing at the last point; by Gram-Schmidt."""
    basis: list[list[float]] = [[1 / math.sqrt(k)] * k]
    for degree in range(1, k):
        v = [((i - (k + 1) / 2) / k) ** degree for i in range(1, k + 1)]
        for _ in range(2):
            for b in basis:
                dot = math.fsum(x * y for x, y in zip(v, b, strict=True))
                v = [x - dot * y for x, y in zip(v, b, strict=True)]
        norm = math.sqrt(math.fsum(x * x for x in v)) * (1 if v[-1] > 0 else -1)
        basis.append([x / norm for x in v])
    return basis[1:]


def polynomial(fitted: DataFrame, k: int) -> DataFrame:
    """Linear, quadratic, ... contrasts of the code."""
    cols = []
    for j, values in enumerate(polynomial_values(k), 1):
        c = F.lit(None).cast("double")
        for i, v in enumerate(values, 1):
            c = F.when(F.col("code") == i, v).otherwise(c)
        cols.append(c.alias(f"p{j}"))
    return fitted.select("cat", *cols)


def _target_stats(df: DataFrame, col: str, y: str) -> tuple[DataFrame, float | None]:
    yd = F.col(y).cast("double")
    stats = df.groupBy(F.col(col).alias("cat")).agg(F.count("*").alias("n"), F.sum(yd).alias("s"), F.sum(yd * yd).alias("ss"))
    prior = df.agg(F.avg(yd)).first()[0]
    return stats.where(F.col("cat").isNotNull()), prior


def target_mean(df: DataFrame, col: str, y: str, smoothing: float = 0.0) -> tuple[DataFrame, float | None]:
    """``te``: the category's mean, drawn toward the global mean as if by ``smoothing`` more rows; and the global mean."""
    stats, prior = _target_stats(df, col, y)
    return stats.select("cat", ((F.col("s") + smoothing * F.lit(prior)) / (F.col("n") + smoothing)).alias("te")), prior


def m_estimate(df: DataFrame, col: str, y: str, m: float = 1.0) -> tuple[DataFrame, float | None]:
    return target_mean(df, col, y, m)


def leave_one_out(df: DataFrame, col: str, y: str, prior: float, out: str = "loo") -> DataFrame:
    """Mean of y over the category's other rows; ``prior`` for a category of one row. Sums are combined before the shuffle."""
    sums = df.groupBy(F.col(col).alias("_cat")).agg(F.count("*").alias("_n"), F.sum(F.col(y).cast("double")).alias("_s"))
    value = F.when(F.col("_n") > 1, (F.col("_s") - F.col(y)) / (F.col("_n") - 1)).otherwise(F.lit(prior))
    return df.join(sums, F.col(col).eqNullSafe(F.col("_cat"))).withColumn(out, value).drop("_cat", "_n", "_s")


def leave_one_out_new(df: DataFrame, col: str, y: str) -> tuple[DataFrame, float | None]:
    """``loo`` for rows that the fit has not seen: the category's plain mean; and the mean for unknown categories."""
    fitted, prior = target_mean(df, col, y)
    return fitted.withColumnRenamed("te", "loo"), prior


def ordered_statistic(df: DataFrame, col: str, y: str, order_by: str, prior: float, a: float = 1.0, out: str = "ots") -> DataFrame:
    """Statistic of the category's earlier rows in the order of a unique key; the first takes the prior.

    Running sums over the table in the order of category and key, less those at the category's first row.
    """
    rows = df.withColumns({"_y": F.coalesce(F.col(y).cast("double"), F.lit(0.0)), "_one": F.lit(1).cast("long")})
    rows = cumulative(rows, [col, order_by], {"_s": "_y", "_n": "_one"}).drop("_y", "_one")
    first = rows.groupBy(F.col(col).alias("_cat")).agg(F.min(F.struct("_n", "_s")).alias("_f"))
    value = (F.col("_s") - F.col("_f._s") + a * F.lit(prior)) / (F.col("_n") - F.col("_f._n") + a)
    return rows.join(first, F.col(col).eqNullSafe(F.col("_cat"))).withColumn(out, value).drop("_cat", "_f", "_s", "_n")


def ordered_statistic_new(df: DataFrame, col: str, y: str, a: float = 1.0) -> tuple[DataFrame, float | None]:
    """``ots`` for rows that the fit has not seen: the statistic of all the category's rows; and the mean for unknown categories."""
    fitted, prior = target_mean(df, col, y, a)
    return fitted.withColumnRenamed("te", "ots"), prior


def james_stein(df: DataFrame, col: str, y: str) -> tuple[DataFrame, float | None]:
    """``js``: (1 - B) * category mean + B * global mean, B = var of the mean / (var of the mean + var between means)."""
    stats, prior = _target_stats(df, col, y)
    mean = F.col("s") / F.col("n")
    within = F.when(F.col("n") > 1, (F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1) / F.col("n")).otherwise(0.0)
    rows = stats.select("cat", mean.alias("m"), within.alias("v"))
    between = rows.agg(F.var_pop("m")).first()[0] or 0.0
    b = F.when(F.col("v") + between > 0, F.col("v") / (F.col("v") + between)).otherwise(1.0)
    return rows.select("cat", ((1 - b) * F.col("m") + b * F.lit(prior)).alias("js")), prior


def quantile(df: DataFrame, col: str, value: str, q: float = 0.5, m: float = 0.0) -> tuple[DataFrame, float | None]:
    """``qe``: the quantile of the category's values, drawn toward the global one as if by ``m`` rows."""
    whole = quantiles(df, [value], [q]).first()
    total = whole["value"] if whole else None
    known = df.where(F.col(col).isNotNull())
    rows = known.groupBy(F.col(col).alias("cat")).agg(F.count("*").alias("n"))
    found = quantiles(known, [value], [q], by=[col]).select(F.col(col).alias("cat"), F.col("value").alias("x"))
    rows = rows.join(found, "cat", "left")
    return rows.select("cat", ((F.col("x") * F.col("n") + m * F.lit(total)) / (F.col("n") + m)).alias("qe")), total


def weight_of_evidence(df: DataFrame, col: str, y: str, r: float = 0.0) -> DataFrame:
    """``woe``: log of the category's share of positives over its share of negatives, each with ``r`` more rows.

    With r = 0 a category without positives or negatives has no finite value and gets null.
    """
    yl = F.col(y).cast("long")
    per = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("cat")).agg(F.sum(yl).alias("p"), F.sum(1 - yl).alias("q"))
    total = per.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    ok = (F.col("p") + r > 0) & (F.col("q") + r > 0)
    a, b = (F.col("p") + r) / (F.col("all_p") + 2 * r), (F.col("q") + r) / (F.col("all_q") + 2 * r)
    return per.join(F.broadcast(total)).select("cat", F.when(ok, F.log(a / b)).alias("woe"))  # total: one row


def random_intercept(df: DataFrame, col: str, y: str, rounds: int = 25) -> DataFrame:
    """``glmm``: random intercepts of a logistic model, by penalized Newton steps and moment updates of their variance.

    Works on counts per category; each round is one aggregate over categories.
    """
    yl = F.col(y).cast("double")
    stats = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("cat")).agg(F.count("*").alias("n"), F.sum(yl).alias("s"))
    stats = stats.persist()
    mean = stats.agg(F.sum("s") / F.sum("n")).first()[0]
    if mean is None or not 0 < mean < 1:
        return stats.select("cat", F.lit(0.0).alias("glmm"))
    mu, var = math.log(mean / (1 - mean)), 1.0
    cur = stats.withColumn("b", F.lit(0.0))
    for i in range(rounds):
        p = 1 / (1 + F.exp(-(F.lit(mu) + F.col("b"))))
        h = F.col("n") * p * (1 - p) + 1 / var
        cur = cur.withColumn("b", F.col("b") + (F.col("s") - F.col("n") * p - F.col("b") / var) / h).withColumn("h", h)
        if i % 5 == 4:
            cur = cur.persist()
            var = max(1e-6, cur.agg(F.avg(F.col("b") * F.col("b") + 1 / F.col("h"))).first()[0])
            cur = cur.drop("h")
    return cur.select("cat", F.col("b").alias("glmm"))


def woe_report(fitted: DataFrame, column: str) -> DataFrame:
    return fitted.select(F.lit(column).alias("column_name"), "cat", "woe").orderBy(F.desc("woe"), "cat")
