"""A preprocessing set-up for cross-validation: each fold's rows are coded by what the rows of the other folds say.

All folds are fitted together. A fold's training statistics are the totals less the fold's own sums: counts and sums of numbers, and counts of each category,
come from one aggregate by (fold, column) and one by (fold, column, category). Only exact medians need the training rows themselves, so these
are selected for all folds side by side. Numbers: median for missing values, then z-score with the population's deviation. Categories: mode for missing
values, then an indicator for each of the most frequent, and one for all others and unseen ones where there are more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.clean import coerce_numeric
from tessera.operators.quantiles import quantiles

#: Categories of a column that get an indicator of their own.
MAX_ONE_HOT = 25


class FoldedSetup:
    """``fit`` learns per fold; ``transform`` codes every row by the state of its own fold."""

    def __init__(self, numeric: Sequence[str], categorical: Sequence[str], fold: str = "fold", folds: int = 5, max_one_hot: int = MAX_ONE_HOT):
        self.numeric, self.categorical, self.fold, self.folds, self.max_one_hot = list(numeric), list(categorical), fold, folds, max_one_hot

    def fit(self, df: DataFrame) -> FoldedSetup:
        rows = df.select(F.col(self.fold).cast("int").alias("_fold"), *[coerce_numeric(c).alias(c) for c in self.numeric], *[F.col(c).cast("string").alias(c) for c in self.categorical])
        self.medians, self.means, self.stds = self._numbers(rows)
        self.modes, self.levels, self.pooled = self._categories(rows)
        return self

    def _numbers(self, rows: DataFrame) -> tuple[list[dict], list[dict], list[dict]]:
        every = range(self.folds)
        if not self.numeric:
            return [{} for _ in every], [{} for _ in every], [{} for _ in every]
        others = F.array_except(F.array(*[F.lit(i) for i in every]), F.array("_fold"))
        training = rows.select(F.explode(others).alias("_left"), *self.numeric)
        found = {(r["_left"], r["column_name"]): r["value"] for r in quantiles(training, self.numeric, [0.5], by=["_left"]).collect()}  # folds x columns
        medians = [{c: found.get((i, c)) or 0.0 for c in self.numeric} for i in every]
        center = rows.agg(*[F.avg(c).alias(c) for c in self.numeric]).first()
        mid = {c: center[c] or 0.0 for c in self.numeric}
        sums = {}
        aggregates = [F.count("*").alias("n")]
        for c in self.numeric:
            off = F.col(c) - F.lit(mid[c])
            aggregates += [F.count(c).alias(f"{c}|n"), F.coalesce(F.sum(off), F.lit(0.0)).alias(f"{c}|s"), F.coalesce(F.sum(off * off), F.lit(0.0)).alias(f"{c}|q")]
        for r in rows.groupBy("_fold").agg(*aggregates).collect():  # one row per fold
            sums[r["_fold"]] = r
        means, stds = [], []
        for i in every:
            mean, std = {}, {}
            for c in self.numeric:
                n, held, s, q = (sum(r[k] for f, r in sums.items() if f != i) for k in ("n", f"{c}|n", f"{c}|s", f"{c}|q"))
                # missing values stand at the median
                at = medians[i][c] - mid[c]
                s, q = s + (n - held) * at, q + (n - held) * at * at
                mean[c] = mid[c] + s / n if n else 0.0
                dev = max(0.0, q / n - (s / n) ** 2) ** 0.5 if n else 0.0
                std[c] = dev if dev > 1e-8 else 1.0
            means.append(mean)
            stds.append(std)
        return medians, means, stds

    def _categories(self, rows: DataFrame) -> tuple[list[dict], list[dict], list[dict]]:
        """Per fold: the mode, the levels with an indicator (by count, then name), and whether others are pooled."""
        every = range(self.folds)
        modes, levels, pooled = ([{} for _ in every] for _ in range(3))
        if not self.categorical:
            return modes, levels, pooled
        cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in self.categorical])
        counts = rows.select("_fold", F.inline(cells)).where("v is not null").groupBy("c", "v").agg(
            F.count("*").alias("n"), *[F.count_if(F.col("_fold") == i).alias(f"n{i}") for i in every]
        )
        left = F.array(*[F.struct(F.lit(i).alias("left"), (F.col("n") - F.col(f"n{i}")).alias("m")) for i in every])
        known = counts.select("c", "v", F.inline(left)).where("m > 0")
        w = Window.partitionBy("left", "c").orderBy(F.desc("m"), "v")
        # one more than get an indicator, to see whether there are others; the ranking is cut before it is shuffled
        for r in known.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.max_one_hot + 1).orderBy("left", "c", "rank").collect():
            own = levels[r["left"]].setdefault(r["c"], [])
            if r["rank"] == 1:
                modes[r["left"]][r["c"]] = r["v"]
            if r["rank"] <= self.max_one_hot:
                own.append(r["v"])
            else:
                pooled[r["left"]][r["c"]] = True
        return modes, levels, pooled

    def _of_fold(self, per: list, otherwise: Column) -> Column:
        out = otherwise
        for i, value in enumerate(per):
            out = F.when(F.col("_fold") == i, value).otherwise(out)
        return out

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        """``keep``, a z-score per number, and per category ``<column>_place``: the place of its indicator in the fold's list, the list's length for the pool.

        An unseen value takes no place (null) where nothing is pooled; ``one_hot`` makes indicators of the places.
        """
        rows = df.withColumn("_fold", F.col(self.fold).cast("int"))
        nothing = F.lit(None)
        numbers = []
        for c in self.numeric:
            per = [(F.coalesce(coerce_numeric(c), F.lit(self.medians[i][c])) - self.means[i][c]) / self.stds[i][c] for i in range(self.folds)]
            numbers.append(self._of_fold(per, nothing.cast("double")).alias(c))
        places = []
        for c in self.categorical:
            per = []
            for i in range(self.folds):
                known = self.levels[i].get(c, [])
                value = F.coalesce(F.col(c).cast("string"), F.lit(self.modes[i].get(c)).cast("string"))
                at = F.array_position(F.array(*[F.lit(v) for v in known]).cast("array<string>"), value)
                per.append(F.when(at > 0, (at - 1).cast("int")).otherwise(F.lit(len(known) if self.pooled[i].get(c) else None).cast("int")))
            places.append(self._of_fold(per, nothing.cast("int")).alias(f"{c}_place"))
        return rows.select(*keep, *numbers, *places)

    def one_hot(self, coded: DataFrame, column: str) -> DataFrame:
        """``coded`` with ``<column>_0`` .. of the places, as many as an indicator and the pool need."""
        width = self.max_one_hot + 1
        return coded.withColumns({f"{column}_{i}": F.when(F.col(f"{column}_place") == i, 1).otherwise(0) for i in range(width)})
