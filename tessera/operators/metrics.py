"""Metrics over a table of scores: id, y in {0, 1}, p, and maybe a subgroup.

Rank metrics are running sums over a range partitioning (``clean.cumulative``), after rows are grouped by distinct score where
that is enough. Curves with a point per row order rows of equal score by the unique id. Undefined values (one class only) are null, ratios without denominator 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.clean import cumulative, row_index


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def _sum(test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, 1).otherwise(0)), F.lit(0)).cast("long")


def confusion(df: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp at ``p >= threshold``."""
    hit, pos = F.col("p") >= threshold, F.col("y") == 1
    return df.groupBy(*by).agg(
        _sum(~hit & ~pos).alias("tn"), _sum(hit & ~pos).alias("fp"), _sum(~hit & pos).alias("fn"), _sum(hit & pos).alias("tp")
    )


def rates() -> dict[str, Column]:
    """Metrics of a confusion row."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": precision,
        "recall": recall,
        "f1": ratio(2 * precision * recall, precision + recall),
        "specificity": ratio(tn, tn + fp),
    }


def auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve by mid-ranks: ties count half."""
    y = F.col("y").cast("long")
    per_score = df.groupBy(*by, "p").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    ranked = cumulative(per_score, [*by, "p"], {"below": "neg"})
    # the negatives of the subgroups in front are below each of a subgroup's scores
    return ranked.groupBy(*by).agg(
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0)).alias("area"), F.min("below").alias("front"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"),
    ).select(
        *by,
        F.when(
            (F.col("n_pos") > 0) & (F.col("n_neg") > 0),
            (F.col("area") - F.col("front") * F.col("n_pos")) / (F.col("n_pos").cast("double") * F.col("n_neg")),
        ).alias("auc"),
    )


def _ranked(df: DataFrame) -> DataFrame:
    """Rows with ``rn``, ``tp``, ``fp`` counted down from the highest score, rows of equal score by id."""
    rows = df.select("id", F.col("y").cast("long").alias("y"), "p", F.lit(1).cast("long").alias("_one"))
    out = cumulative(rows, [F.desc("p"), F.asc("id")], {"rn": "_one", "tp": "y"}).drop("_one")
    return out.withColumns({"rn": F.col("rn") + 1, "tp": F.col("tp") + F.col("y")}).withColumn("fp", F.col("rn") - F.col("tp"))


def average_precision(df: DataFrame) -> DataFrame:
    """Mean of the precision at each positive, in descending score, equal scores by id."""
    return _ranked(df).agg(
        F.when(F.sum("y") > 0, F.sum(F.when(F.col("y") == 1, F.col("tp") / F.col("rn"))) / F.sum("y")).alias("average_precision")
    )


def roc_curve(df: DataFrame) -> DataFrame:
    """A point per row and the origin, point 0."""
    totals = df.agg(F.sum("y").alias("n_pos"), F.sum(1 - F.col("y")).alias("n_neg"))
    points = _ranked(df).join(F.broadcast(totals)).select(  # totals: one row
        F.col("rn").alias("point"), ratio(F.col("fp").cast("double"), F.col("n_neg")).alias("fpr"), ratio(F.col("tp").cast("double"), F.col("n_pos")).alias("tpr")
    )
    origin = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("point"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(points)


def roc_curve_grouped(df: DataFrame) -> DataFrame:
    """A point per distinct score."""
    per = df.groupBy("p").agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("f"))
    totals = df.agg(F.sum("y").alias("n_pos"), F.sum(1 - F.col("y")).alias("n_neg"))
    cum = cumulative(per, [F.desc("p")], {"tp": "t", "fp": "f"})
    cum = cum.select("p", (F.col("tp") + F.col("t")).alias("tp"), (F.col("fp") + F.col("f")).alias("fp")).join(F.broadcast(totals))
    return cum.select("p", ratio(F.col("fp").cast("double"), F.col("n_neg")).alias("fpr"), ratio(F.col("tp").cast("double"), F.col("n_pos")).alias("tpr"))


def pr_curve(df: DataFrame) -> DataFrame:
    total = df.agg(F.sum("y").alias("n_pos"))
    return _ranked(df).join(F.broadcast(total)).select(
        F.col("rn").alias("point"), (F.col("tp") / F.col("rn")).alias("precision"), ratio(F.col("tp").cast("double"), F.col("n_pos")).alias("recall")
    )


def mid_ranks(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with the mean of the ranks that their rows share."""
    per = df.groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    return cumulative(per, ["value"], {"before": "n"}).select("value", "n", (F.col("before") + (F.col("n") + 1) / 2.0).alias("mid_rank"))


def sweep_thresholds(steps: int = 91, first: float = 0.05, step: float = 0.01) -> Column:
    """The thresholds ``first + i * step`` as an array of doubles."""
    return F.array(*[F.lit(first + i * step) for i in range(steps)])


def threshold_sweep(df: DataFrame) -> DataFrame:
    """Confusion counts at all thresholds in one pass: rows fall into the bin of the largest threshold they reach."""
    grid = sweep_thresholds()
    reached = F.size(F.filter(grid, lambda t: t <= F.col("p"))) - 1
    bins = df.groupBy(reached.alias("bin")).agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    i = df.sparkSession.range(91).select(F.col("id").cast("int").alias("i"), F.get(grid, F.col("id").cast("int")).alias("threshold"))
    # both sides are at most 92 rows: the bins and the thresholds
    total = F.broadcast(bins)
    joined = i.join(total, F.col("bin").isNotNull(), "left")
    return joined.groupBy("i", "threshold").agg(
        *[
            F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0)).cast("long").alias(n)
            for n, c, test in (
                ("tn", "neg", F.col("bin") < F.col("i")),
                ("fp", "neg", F.col("bin") >= F.col("i")),
                ("fn", "pos", F.col("bin") < F.col("i")),
                ("tp", "pos", F.col("bin") >= F.col("i")),
            )
        ]
    )


def sweep_metrics(df: DataFrame) -> DataFrame:
    return threshold_sweep(df).select("i", "threshold", *[c.alias(n) for n, c in rates().items()])


def best_threshold(df: DataFrame, criterion: str = "f1") -> DataFrame:
    """The first threshold with the largest value; the threshold rounded to two places."""
    best = sweep_metrics(df).agg(F.max(F.struct(F.col(criterion), (-F.col("i")).alias("neg"), F.col("threshold"))).alias("x"))
    return best.select(F.round("x.threshold", 2).alias("threshold"), F.col(f"x.{criterion}").alias(criterion))


def cheapest_threshold(df: DataFrame, fn_cost: float = 10.0, fp_cost: float = 1.0) -> DataFrame:
    """The first threshold with the least total cost of false decisions."""
    cost = (F.col("fn") * fn_cost + F.col("fp") * fp_cost).alias("cost")
    best = threshold_sweep(df).select("i", "threshold", cost).agg(F.min(F.struct("cost", "i", "threshold")).alias("x"))
    return best.select(F.round("x.threshold", 2).alias("threshold"), F.col("x.cost").alias("cost"))


def at_thresholds(df: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Confusion and rates at a few thresholds, one pass."""
    rows = df.select("y", "p", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    hit, pos = F.col("p") >= F.col("threshold"), F.col("y") == 1
    out = rows.groupBy("threshold").agg(
        _sum(~hit & ~pos).alias("tn"), _sum(hit & ~pos).alias("fp"), _sum(~hit & pos).alias("fn"), _sum(hit & pos).alias("tp")
    )
    return out.select("threshold", *[c.alias(n) for n, c in rates().items()])


def bundle(df: DataFrame, threshold: float) -> DataFrame:
    """All binary metrics as one row."""
    a = confusion(df, threshold).select("tn", "fp", "fn", "tp", (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n"), *[c.alias(n) for n, c in rates().items()])
    return a.join(auc(df)).join(average_precision(df))  # one row each


def imbalanced_report(df: DataFrame, threshold: float = 0.5, alpha: float = 0.1) -> DataFrame:
    """Per class: precision, recall, specificity, F1, geometric mean, index of balanced accuracy, support; and their weighted mean."""
    c = confusion(df, threshold)
    one = c.select(F.lit("1").alias("class"), "tn", "fp", "fn", "tp")
    zero = c.select(F.lit("0").alias("class"), F.col("tp").alias("tn"), F.col("fn").alias("fp"), F.col("fp").alias("fn"), F.col("tn").alias("tp"))
    r = rates()
    rows = one.unionByName(zero).select(
        "class", r["precision"].alias("pre"), r["recall"].alias("rec"), r["specificity"].alias("spe"), r["f1"].alias("f1"), (F.col("tp") + F.col("fn")).alias("sup")
    )
    rows = rows.withColumn("geo", F.sqrt(F.col("rec") * F.col("spe"))).withColumn(
        "iba", (1 + alpha * (F.col("rec") - F.col("spe"))) * F.col("rec") * F.col("spe")
    )
    names = ("pre", "rec", "spe", "f1", "geo", "iba")
    mean = rows.agg(*[ratio(F.sum(F.col(n) * F.col("sup")), F.sum("sup").cast("double")).alias(n) for n in names], F.sum("sup").alias("sup"))
    return rows.select("class", *names, "sup").unionByName(mean.select(F.lit("avg").alias("class"), *names, "sup"))


def kappa_and_mcc(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    chance = ratio((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    kappa = ratio(ratio(tp + tn, n) - chance, 1 - chance)
    mcc = ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)))
    return confusion(df, threshold).select(kappa.alias("kappa"), mcc.alias("mcc"), F.sqrt(rates()["recall"] * rates()["specificity"]).alias("gmean"))


def confusion_table(df: DataFrame, actual: str, predicted: str, n_classes: int) -> DataFrame:
    """Counts on the whole grid of classes, also as share of the actual class."""
    counts = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    one = df.sparkSession.range(n_classes * n_classes)  # the grid itself: classes squared
    grid = one.select((F.col("id") / n_classes).cast("long").alias("actual"), (F.col("id") % n_classes).alias("predicted"))
    full = grid.join(counts, ["actual", "predicted"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy("actual"))
    return full.withColumn("share", F.col("n") / F.greatest(total, F.lit(1)).cast("double"))


def per_class(df: DataFrame, actual: str, predicted: str, n_classes: int) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    grid = confusion_table(df, actual, predicted, n_classes)
    act = grid.groupBy(F.col("actual").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n"))).alias("hits"))
    pre = grid.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("named"))
    p, r = ratio(F.col("hits").cast("double"), F.col("named")), ratio(F.col("hits").cast("double"), F.col("support"))
    return act.join(pre, "class").select("class", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support")


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("long")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("observed"))


def by_subgroup(df: DataFrame, group: str, threshold: float = 0.5) -> DataFrame:
    c = confusion(df, threshold, [group])
    fnr = ratio(F.col("fn").cast("double"), (F.col("fn") + F.col("tp")).cast("double"))
    return c.select(group, *[x.alias(n) for n, x in rates().items()], fnr.alias("fnr"))


def permutation_importance(df: DataFrame, score: callable, columns: Sequence[str], repeats: int = 3, seed: int = 42) -> DataFrame:
    """Mean drop of the AUC when a column's values are dealt out anew by hash order.

    score: from columns of the frame to the score column. Rows and shuffled values are paired by
    position; all columns and repeats share one order and one pass of scoring. Columns are numbers.
    """
    n, rounds = df.count(), [(c, r) for c in columns for r in range(repeats)]
    base = row_index(df, ["id"], "_pos")
    # every column and repeat has n dealt values, so their positions follow from one order of all of them
    dealt = df.select(
        "id",
        F.explode(
            F.array(*[F.struct(F.lit(i).alias("i"), F.md5(F.concat(F.lit(f"{seed}|{c}|{r}|"), F.col("id").cast("string"))).alias("h"), F.col(c).cast("double").alias("new")) for i, (c, r) in enumerate(rounds)])
        ).alias("x"),
    ).select("id", "x.*")
    dealt = row_index(dealt, ["i", "h", "id"], "_at").select("i", (F.col("_at") - F.col("i") * F.lit(n)).alias("_pos"), "new")
    feature, number = (F.get(F.array(*[F.lit(x[k]) for x in rounds]), F.col("i")) for k in (0, 1))
    cols = {c: F.when(feature == c, F.col("new")).otherwise(F.col(c).cast("double")) for c in columns}
    rows = base.join(dealt, "_pos").select(feature.alias("feature"), number.alias("round"), "id", "y", score(cols).alias("p"))
    rows = rows.unionByName(df.select(F.lit("").alias("feature"), F.lit(-1).alias("round"), "id", "y", score({c: F.col(c).cast("double") for c in columns}).alias("p")))
    areas = auc(rows, ["feature", "round"])
    whole = areas.where("round = -1").select(F.col("auc").alias("whole"))
    return areas.where("round >= 0").join(F.broadcast(whole)).groupBy("feature").agg(F.avg(F.col("whole") - F.col("auc")).alias("auc_drop"))


def weighted_mean_loss(df: DataFrame, loss: str, n: str) -> DataFrame:
    """Mean of batch losses by batch size."""
    return df.agg((F.sum(F.col(loss) * F.col(n)) / F.sum(n)).alias("mean_loss"))


def top_features(importance: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` features whose shuffling costs most."""
    return importance.orderBy(F.desc("auc_drop"), "feature").limit(n)


def fold_summary(df: DataFrame, metric: str) -> DataFrame:
    return df.agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))


def leaderboard_gap(df: DataFrame, name: str, metric: str) -> DataFrame:
    """Best, worst, and the gap between first and third."""
    top = df.orderBy(F.desc(metric), name).limit(3)
    return df.agg(F.max(metric).alias("best"), F.min(metric).alias("worst")).join(
        top.agg((F.max(metric) - F.min(metric)).alias("gap_1_3"))
    )
