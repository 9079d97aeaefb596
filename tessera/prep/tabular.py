"""Fit on the training split, transform anywhere.

``fit`` takes the whole table and the training predicate and filters itself, so nothing can be
learned from other rows. What it learns is a few numbers per column and the
vocabularies, from two aggregates; the same state drives batch scoring and serving.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import log1p_clipped
from tessera.operators.clean import coerce_numeric, medians
from tessera.operators.encode import apply, weight_of_evidence
from tessera.sources.scratch import drop, stored
from tessera.spec import TableSpec

#: A vocabulary is part of the state; one beyond this size is refused (encode such a column otherwise).
MAX_CATEGORIES = 10_000


@dataclass
class TabularState:
    numeric: list[str] = field(default_factory=list)
    log_numeric: list[str] = field(default_factory=list)
    categorical: list[str] = field(default_factory=list)
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)
    vocabularies: dict[str, list[str]] = field(default_factory=dict)
    missing_token: str = "Unknown"

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, indent=2)

    @staticmethod
    def from_json(text: str) -> TabularState:
        return TabularState(**json.loads(text))

    @property
    def feature_names(self) -> list[str]:
        return [*self.numeric, *[f"{c}={v}" for c in self.categorical for v in self.vocabularies[c]]]

    @property
    def n_features(self) -> int:
        return len(self.feature_names)


class TabularPreprocessor:
    """Median, log, z-score for numbers; one-hot blocks with a missing category for the rest."""

    def __init__(self, spec: TableSpec, log: bool = True, scale: bool = True, ddof: int = 1, state: TabularState | None = None):
        self.spec, self.log, self.scale, self.ddof, self.state = spec, log, scale, ddof, state

    def _number(self, c: str, fill: float | None) -> Column:
        value = coerce_numeric(c) if fill is None else F.coalesce(coerce_numeric(c), F.lit(float(fill)))
        return log1p_clipped(value) if self.log and c in self.spec.log_numeric else value

    def _category(self, c: str) -> Column:
        text = F.col(c).cast("string")
        return F.coalesce(F.when(text != "", text), F.lit(self.spec.missing_token))

    def fit(self, df: DataFrame, train: Column | None = None) -> TabularPreprocessor:
        """Learn from the rows where ``train`` holds (all, if None)."""
        rows = df if train is None else df.where(train)
        spec = self.spec
        numbers = rows.select(*[coerce_numeric(c).alias(c) for c in spec.numeric])
        mid = {c: float(v) if v is not None else 0.0 for c, v in (medians(numbers, spec.numeric) if spec.numeric else {}).items()}
        dev = F.stddev_samp if self.ddof else F.stddev_pop
        wanted = [x for c in spec.numeric for x in (F.avg(self._number(c, mid[c])).alias(f"m|{c}"), dev(self._number(c, mid[c])).alias(f"s|{c}"))]
        row = rows.agg(*wanted).first() if wanted else {}
        means = {c: row[f"m|{c}"] if row[f"m|{c}"] is not None else 0.0 for c in spec.numeric}
        stds = {c: row[f"s|{c}"] if (row[f"s|{c}"] or 0.0) > 1e-8 else 1.0 for c in spec.numeric}
        known = self._vocabularies(rows) if spec.categorical else {}
        vocabularies = {}
        for c in spec.categorical:
            found = known.get(c, [])
            vocabularies[c] = found if spec.missing_token in found else [*found, spec.missing_token]
        self.state = TabularState(
            list(spec.numeric), list(spec.log_numeric), list(spec.categorical), mid, means, stds, vocabularies, spec.missing_token
        )
        return self

    def _vocabularies(self, rows: DataFrame) -> dict[str, list[str]]:
        """The sorted categories per column; they are counted before any is collected."""
        cells = F.array(*[F.struct(F.lit(c).alias("c"), self._category(c).alias("v")) for c in self.spec.categorical])
        values = stored(rows.select(F.inline(cells)).distinct(), "vocabularies")
        for r in values.groupBy("c").count().collect():  # one row per column
            if r["count"] > MAX_CATEGORIES:
                raise ValueError(f"{r['c']} has {r['count']} categories")
        out: dict[str, list[str]] = {}
        for r in values.orderBy("c", "v").collect():  # MAX_CATEGORIES per column
            out.setdefault(r["c"], []).append(r["v"])
        drop(values)
        return out

    def columns(self) -> list[Column]:
        """One expression per feature, in order."""
        s = self.state
        out = []
        for c in s.numeric:
            x = self._number(c, s.medians[c])
            out.append(((x - s.means[c]) / s.stds[c] if self.scale else x).alias(c))
        for c in s.categorical:
            value = self._category(c)
            out += [F.when(value == v, 1.0).otherwise(0.0).alias(f"{c}={v}") for v in s.vocabularies[c]]
        return out

    def transform(self, df: DataFrame, *keep: str, out: str = "features") -> DataFrame:
        """``keep`` and the features as an array of floats."""
        return df.select(*keep, F.array(*self.columns()).cast("array<float>").alias(out))

    def transform_wide(self, df: DataFrame, *keep: str) -> DataFrame:
        return df.select(*keep, *self.columns())


class WoePreprocessor:
    """Weight of evidence for categories, median imputation, population z-score; learned from the training rows, kept as JSON."""

    def __init__(self, numeric: Sequence[str], categorical: Sequence[str], label: str, r: float = 0.5, ddof: int = 0):
        self.numeric, self.categorical, self.label, self.r, self.ddof = list(numeric), list(categorical), label, r, ddof

    def fit(self, df: DataFrame, train: Column | None = None) -> WoePreprocessor:
        rows = df if train is None else df.where(train)
        self.spark, self.evidence = df.sparkSession, {}
        for c in self.categorical:
            fitted = stored(weight_of_evidence(rows, c, self.label, self.r), "evidence")
            n = fitted.count()
            if n > MAX_CATEGORIES:
                raise ValueError(f"{c} has {n} categories")
            self.evidence[c] = {str(r["cat"]): r["woe"] for r in fitted.collect()}  # MAX_CATEGORIES rows
            drop(fitted)
        coded = self._coded(rows)
        names = [*self.numeric, *[f"{c}_woe" for c in self.categorical]]
        self.medians = {c: v if v is not None else 0.0 for c, v in medians(coded, names).items()}
        dev = F.stddev_samp if self.ddof else F.stddev_pop
        full = {c: F.coalesce(F.col(c), F.lit(self.medians[c])) for c in names}
        row = coded.agg(*[x for c in names for x in (F.avg(full[c]).alias(f"m|{c}"), dev(full[c]).alias(f"s|{c}"))]).first()
        self.means = {c: row[f"m|{c}"] or 0.0 for c in names}
        self.stds = {c: row[f"s|{c}"] if (row[f"s|{c}"] or 0.0) > 1e-8 else 1.0 for c in names}
        return self

    def to_json(self) -> str:
        names = ("numeric", "categorical", "label", "r", "ddof", "evidence", "medians", "means", "stds")
        return json.dumps({n: getattr(self, n) for n in names}, ensure_ascii=False, indent=2)

    @staticmethod
    def from_json(spark: SparkSession, text: str) -> WoePreprocessor:
        held = json.loads(text)
        out = WoePreprocessor(held["numeric"], held["categorical"], held["label"], held["r"], held["ddof"])
        out.spark, out.evidence, out.medians, out.means, out.stds = spark, held["evidence"], held["medians"], held["means"], held["stds"]
        return out

    def _coded(self, df: DataFrame) -> DataFrame:
        out = df.withColumns({c: coerce_numeric(c) for c in self.numeric})
        for c in self.categorical:
            fitted = self.spark.createDataFrame(list(self.evidence[c].items()), f"cat string, `{c}_woe` double")
            out = apply(out.withColumn("_text", F.col(c).cast("string")), fitted, "_text").drop("_text")
        return out

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        names = [*self.numeric, *[f"{c}_woe" for c in self.categorical]]
        cols = [((F.coalesce(F.col(c), F.lit(self.medians[c])) - self.means[c]) / self.stds[c]).alias(c) for c in names]
        return self._coded(df).select(*keep, *cols)
