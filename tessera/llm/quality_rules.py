"""Quality rules: text statistics and a learned decision list.

``text_features`` turns a text into counts with built-in expressions only.
``learn`` grows an ordered list of threshold conjunctions by sequential covering:
each rule is grown on two thirds of a bounded labelled sample, pruned on the
remaining third, and the rows it covers leave the sample before the next rule.
``DecisionList.column`` is the list as one ``CASE WHEN`` over Spark columns.

The labelled statistics come to the driver as at most ``max_labelled`` rows of
threshold indexes, whatever the size of the corpus; the statistics themselves and
the verdicts cover every document.

Cases: null and empty texts have no words and fail the base rule; labels that are
null are left out, a document with several labels counts with its smallest;
without labels the list is empty and only the base rule decides; rows with equal
ids are judged one by one (their labels apply to each); a null id never has a label.
Further columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, materialize, spread, table, words

#: Features that rules may test, each a double computed from the counts.
FEATURES = (
    "avg_word_len",
    "symbols_per_word",
    "dup_line_share",
    "repeat_share",
    "upper_share",
    "bangs_per_word",
    "distinct_share",
    "digit_share",
    "bars_per_word",
    "words_per_line",
)
BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _count_kept(text: Column, kept: str) -> Column:
    """How many characters of the Java class ``kept`` a text has."""
    return F.length(F.regexp_replace(text, f"[^{kept}]++", "")).cast("long")


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the base counts and ``FEATURES`` of every document, and the columns ``keep``.

    Repeated words: the three-word windows of a text are hashed (64 bits) with their
    positions and sorted, so equal windows stand side by side; every word
    of a window that occurs again counts once.
    """
    text = F.col("_text")
    w = docs.select(F.col(id_col), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn(
        "_words", words(text)
    )
    w = w.withColumn("n_words", F.size("_words").cast("long"))
    at = lambda i: F.get("_words", i)
    windows = F.when(
        F.col("n_words") >= 3,
        F.sort_array(
            F.transform(
                F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")),
                lambda i: F.struct(F.xxhash64(at(i), at(i + 1), at(i + 2)).alias("h"), i.alias("i")),
            )
        ),
    )
    w = w.withColumn("_windows", windows)
    again = F.filter(
        "_windows",
        lambda x, i: (F.get("_windows", i + 1)["h"] == x["h"])
        | ((i > 0) & (F.get("_windows", F.greatest(i - 1, F.lit(0)))["h"] == x["h"])),
    )
    w = w.withColumn("_again", F.sort_array(F.transform(again, lambda x: x["i"])))
    covered = F.aggregate(
        "_again",
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(f"[^{SPACE}]")))
    w = w.withColumn("_lines", lines).select(
        id_col,
        *keep,
        "n_words",
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        _count_kept(text, r"#*$%&|<>").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("double").alias("_n_lines"),
        F.size(F.array_distinct("_words")).cast("double").alias("_n_distinct"),
        _count_kept(text, r"\p{Lu}").cast("double").alias("_n_upper"),
        _count_kept(text, r"!").cast("double").alias("_n_bang"),
        _count_kept(text, r"0-9").cast("double").alias("_n_digit"),
        _count_kept(text, r"|").cast("double").alias("_n_bar"),
    )
    n_words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    n_chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    n_lines = F.greatest(F.col("_n_lines"), F.lit(1.0))
    made = {
        "avg_word_len": F.col("word_chars") / n_words,
        "symbols_per_word": F.col("n_symbols") / n_words,
        "dup_line_share": F.col("n_dup_lines") / n_lines,
        "repeat_share": F.col("n_repeat_words") / n_words,
        "upper_share": F.col("_n_upper") / n_chars,
        "bangs_per_word": F.col("_n_bang") / n_words,
        "distinct_share": F.col("_n_distinct") / n_words,
        "digit_share": F.col("_n_digit") / n_chars,
        "bars_per_word": F.col("_n_bar") / n_words,
        "words_per_line": F.col("n_words") / n_lines,
    }
    return w.select(id_col, *keep, *BASE_COUNTS, *[made[f].alias(f) for f in FEATURES])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``feature > threshold`` or ``feature <= threshold``."""

    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value, limit = F.col(self.feature), F.lit(self.threshold)
        return value > limit if self.above else value <= limit

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


@dataclass(frozen=True)
class DecisionList:
    """Ordered rules; a row that any of them covers is of the target class."""

    rules: tuple[tuple[Condition, ...], ...] = field(default=())

    def column(self) -> Column:
        if not self.rules:
            return F.lit(False)
        out = None
        for rule in self.rules:
            test = rule[0].column()
            for c in rule[1:]:
                test = test & c.column()
            out = F.when(test, True) if out is None else out.when(test, True)
        return out.otherwise(False)


def _below(feature: str):
    return lambda cut: F.col(feature) > cut


def _matches(row: tuple, rule: list) -> bool:
    return all((row[f] > b) == above for f, above, b in rule)


def _grow(rows: list[tuple], n_features: int, max_conditions: int) -> list:
    """Add the condition with the largest information gain for the target until no other row is covered."""
    import math

    rule: list = []
    while len(rule) < max_conditions:
        pos, neg = sum(r[-1] for r in rows), sum(1 - r[-1] for r in rows)
        if not pos or not neg:
            break
        now, best = math.log2(pos / (pos + neg)), (0.0, [])
        for f in range(n_features):
            p: dict[int, int] = {}
            n: dict[int, int] = {}
            for r in rows:
                side = p if r[-1] else n
                side[r[f]] = side.get(r[f], 0) + 1
            p_low = n_low = 0
            for b in sorted({*p, *n}):
                p_low, n_low = p_low + p.get(b, 0), n_low + n.get(b, 0)
                for above, pp, nn in ((True, pos - p_low, neg - n_low), (False, p_low, n_low)):
                    if pp and pp + nn < pos + neg:
                        gain = pp * (math.log2(pp / (pp + nn)) - now)
                        if gain > best[0] + 1e-9:
                            best = (gain, [(f, above, b)])
                        elif best[1] and abs(gain - best[0]) <= 1e-9 and best[1][0][:2] == (f, above):
                            best[1].append((f, above, b))
        if not best[1]:
            break
        rule.append(best[1][len(best[1]) // 2])  # the middle of the thresholds that do equally well
        rows = [r for r in rows if _matches(r, rule[-1:])]
    return rule


def _prune(rule: list, rows: list[tuple]) -> tuple[list, float, int]:
    """The prefix of the rule with the best (p - n) / (p + n) on rows it was not grown on; its precision and reach."""
    best = ([], -2.0, 0.0, 0)
    for k in range(len(rule), 0, -1):
        p = sum(r[-1] for r in rows if _matches(r, rule[:k]))
        n = sum(1 - r[-1] for r in rows if _matches(r, rule[:k]))
        if p + n and (p - n) / (p + n) >= best[1]:
            best = (rule[:k], (p - n) / (p + n), p / (p + n), p)
    return best[0], best[2], best[3]


def learn(
    features: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    label_col: str = "quality",
    target: int = 0,
    max_labelled: int = 20_000,
    n_thresholds: int = 48,
    min_precision: float = 0.9,
    min_reach: int = 4,
    max_rules: int = 12,
    max_conditions: int = 4,
) -> DecisionList:
    """The decision list for ``labels.label_col = target``.

    max_labelled: the bound of the labelled sample, taken in the order of a hash of the id.
    n_thresholds: quantiles of the labelled rows per feature, twice (of all values, of those above 0).
    min_precision, min_reach: what a pruned rule needs on the pruning rows.
    """
    labelled = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg((F.min(label_col) == target).cast("int").alias("_y"))
    )
    rows = features.join(labelled, id_col).where(~base_failed())
    rows = rows.orderBy(F.xxhash64(id_col), id_col, *FEATURES).limit(max_labelled).select(*FEATURES, "_y", F.pmod(F.xxhash64(id_col, F.lit("fold")), F.lit(3)).alias("_fold"))
    points = [(i + 0.5) / n_thresholds for i in range(n_thresholds)]
    rows = materialize(rows, "labelled")
    # quantiles of all values and, since many features are mostly 0, of those above 0
    cut = rows.agg(
        *[F.percentile_approx(f, points, 10_000).alias(f) for f in FEATURES],
        *[F.percentile_approx(F.when(F.col(f) > 0, F.col(f)), points, 10_000).alias(f"{f}+") for f in FEATURES],
        *[(F.min(F.when(F.col(f) > 0, F.col(f))) / 2).alias(f"{f}/2") for f in FEATURES],
    ).first()
    cuts = {f: sorted({*(cut[f] or []), *(cut[f"{f}+"] or []), *([] if cut[f"{f}/2"] is None else [cut[f"{f}/2"]])}) for f in FEATURES}
    # index of a value: how many thresholds lie below it, so index > k means value > threshold k
    coded = rows.select(
        *[
            F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts[f]]).cast("array<double>"), _below(f))).alias(f)
            for f in FEATURES
        ],
        "_fold",
        "_y",
    )
    data = [tuple(r) for r in coded.collect()]  # at most max_labelled rows
    grow, prune = [r[:-2] + r[-1:] for r in data if r[-2] != 0], [r[:-2] + r[-1:] for r in data if r[-2] == 0]
    rules, usable = [], lambda r: all(b < len(cuts[FEATURES[f]]) for f, _, b in r)
    while len(rules) < max_rules:
        grown = _grow(grow, len(FEATURES), max_conditions)
        if not grown:
            break
        rule, precision, reach = _prune(grown, prune)
        if not rule or precision < min_precision or reach < min_reach or not usable(rule):
            break
        rules.append(rule)
        grow, prune = [r for r in grow if not _matches(r, rule)], [r for r in prune if not _matches(r, rule)]
    return DecisionList(
        tuple(tuple(Condition(FEATURES[f], above, float(cuts[FEATURES[f]][b])) for f, above, b in rule) for rule in rules)
    )


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Base counts, ``base_failed`` and ``kept`` of every document."""
    features = materialize(text_features(docs, id_col, text_col), "features")
    verdict = learn(features, labels, id_col, **options)
    return features.select(
        id_col,
        *BASE_COUNTS,
        base_failed().alias("base_failed"),
        (~base_failed() & ~verdict.column()).alias("kept"),
    )


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
