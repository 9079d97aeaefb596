"""Queries on metrics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import metrics as m
from tessera.plans.frames import LOGITS_SQL, SCORES_SQL, logits, read, scores

QUERIES: dict = {}
_D = "::DOUBLE"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _conf(t: str = "0.25", src: str = SCORES_SQL, by: str = "") -> str:
    key = f"{by}, " if by else ""
    return f"""SELECT {key}CAST(count(*) FILTER (p < {t} AND y = 0) AS BIGINT) AS tn, CAST(count(*) FILTER (p >= {t} AND y = 0) AS BIGINT) AS fp,
CAST(count(*) FILTER (p < {t} AND y = 1) AS BIGINT) AS fn, CAST(count(*) FILTER (p >= {t} AND y = 1) AS BIGINT) AS tp FROM ({src}){f' GROUP BY {by}' if by else ''}"""


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0{_D} END)"


_PRE, _REC, _SPE = _div("tp", "tp + fp"), _div("tp", "tp + fn"), _div("tn", "tn + fp")
_F1 = _div(f"2 * {_PRE} * {_REC}", f"{_PRE} + {_REC}")
_RATES = f"{_div('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {_PRE} AS precision, {_REC} AS recall, {_F1} AS f1, {_SPE} AS specificity"
_AUC = f"""SELECT sum(pos * (below + neg / 2.0{_D})) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc FROM (
SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
FROM (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM ({SCORES_SQL}) GROUP BY p))"""
_RANKED = f"""SELECT id, y, p, row_number() OVER w AS rn, CAST(sum(y) OVER w AS BIGINT) AS tp FROM ({SCORES_SQL}) WINDOW w AS (ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING)"""
_AP = f"SELECT sum(CASE WHEN y = 1 THEN CAST(tp AS DOUBLE) / rn END) / sum(y) AS average_precision FROM ({_RANKED})"
# the thresholds are spelled out so that both engines compare with the same doubles
_GRID = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {0.05 + i * 0.01!r}{_D})" for i in range(91)) + ") g(i, t)"
_SWEEP = f"""SELECT CAST(i AS BIGINT) AS i, t AS threshold, CAST(count(*) FILTER (p < t AND y = 0) AS BIGINT) AS tn, CAST(count(*) FILTER (p >= t AND y = 0) AS BIGINT) AS fp,
CAST(count(*) FILTER (p < t AND y = 1) AS BIGINT) AS fn, CAST(count(*) FILTER (p >= t AND y = 1) AS BIGINT) AS tp FROM ({SCORES_SQL}), ({_GRID}) GROUP BY i, t"""
T = 0.25


@query(_conf())
def confusion_binary(s, d):
    return m.confusion(scores(s, d), T)


@query(f"SELECT c.*, tn + fp + fn + tp AS n, {_RATES}, a.auc, b.average_precision FROM ({_conf()}) c, ({_AUC}) a, ({_AP}) b")
def metric_bundle(s, d):
    return m.bundle(scores(s, d), T)


@query(_AUC)
def auc_midrank(s, d):
    return m.auc(scores(s, d))


@query(_AP)
def average_precision(s, d):
    return m.average_precision(scores(s, d))


@query(f"""SELECT CAST(0 AS BIGINT) AS point, 0.0{_D} AS fpr, 0.0{_D} AS tpr UNION ALL
SELECT rn, CAST(rn - tp AS DOUBLE) / (SELECT sum(1 - y) FROM ({SCORES_SQL})), CAST(tp AS DOUBLE) / (SELECT sum(y) FROM ({SCORES_SQL})) FROM ({_RANKED})""")
def roc_curve(s, d):
    return m.roc_curve(scores(s, d))


@query(f"""SELECT p, CAST(sum(f) OVER w AS DOUBLE) / (sum(f) OVER ()) AS fpr, CAST(sum(t) OVER w AS DOUBLE) / (sum(t) OVER ()) AS tpr
FROM (SELECT p, sum(y) AS t, sum(1 - y) AS f FROM ({SCORES_SQL}) GROUP BY p) WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)""")
def roc_curve_grouped(s, d):
    return m.roc_curve_grouped(scores(s, d))


@query(f"SELECT rn AS point, CAST(tp AS DOUBLE) / rn AS precision, CAST(tp AS DOUBLE) / (SELECT sum(y) FROM ({SCORES_SQL})) AS recall FROM ({_RANKED})")
def pr_curve(s, d):
    return m.pr_curve(scores(s, d))


@query(f"SELECT p AS value, n, r + (n - 1) / 2.0{_D} AS mid_rank FROM (SELECT DISTINCT p, rank() OVER (ORDER BY p) AS r, count(*) OVER (PARTITION BY p) AS n FROM ({SCORES_SQL}))")
def mid_ranks(s, d):
    return m.mid_ranks(scores(s, d), "p")


@query(f"SELECT i, threshold, {_RATES} FROM ({_SWEEP})")
def threshold_sweep(s, d):
    return m.sweep_metrics(scores(s, d)).withColumn("i", F.col("i").cast("long"))


@query(f"SELECT round(threshold, 2) AS threshold, f1 FROM (SELECT i, threshold, {_RATES} FROM ({_SWEEP})) ORDER BY f1 DESC, i LIMIT 1")
def threshold_best_f1(s, d):
    return m.best_threshold(scores(s, d))


@query(f"SELECT round(threshold, 2) AS threshold, fn * 10.0{_D} + fp * 1.0{_D} AS cost FROM ({_SWEEP}) ORDER BY cost, i LIMIT 1")
def cost_threshold(s, d):
    return m.cheapest_threshold(scores(s, d))


@query(" UNION ALL ".join(f"SELECT {t}{_D} AS threshold, {_RATES} FROM ({_conf(str(t))})" for t in (0.3, 0.5, 0.8)))
def threshold_table(s, d):
    return m.at_thresholds(scores(s, d), [0.3, 0.5, 0.8])


_ROWS = f"""SELECT class, {_PRE} AS pre, {_REC} AS rec, {_SPE} AS spe, {_F1} AS f1, tp + fn AS sup FROM (
SELECT '1' AS class, tn, fp, fn, tp FROM ({_conf()}) UNION ALL SELECT '0', tp, fn, fp, tn FROM ({_conf()}))"""
_ROWS2 = f"SELECT class, pre, rec, spe, f1, sqrt(rec * spe) AS geo, (1 + 0.1{_D} * (rec - spe)) * rec * spe AS iba, sup FROM ({_ROWS})"


@query(f"SELECT * FROM ({_ROWS2}) UNION ALL SELECT 'avg', {', '.join(f'sum({c} * sup) / sum(sup)' for c in ('pre', 'rec', 'spe', 'f1', 'geo', 'iba'))}, CAST(sum(sup) AS BIGINT) FROM ({_ROWS2})")
def imbalanced_report(s, d):
    return m.imbalanced_report(scores(s, d), T)


@query(f"""SELECT (po - pe) / (1 - pe) AS kappa, (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) AS mcc, sqrt(rec * spe) AS gmean FROM (
SELECT tp, tn, fp, fn, (tp + tn) / n AS po, ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n) AS pe, {_REC} AS rec, {_SPE} AS spe FROM (
SELECT CAST(tp AS DOUBLE) AS tp, CAST(tn AS DOUBLE) AS tn, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(tp + tn + fp + fn AS DOUBLE) AS n FROM ({_conf()})))""")
def kappa_mcc(s, d):
    return m.kappa_and_mcc(scores(s, d), T)


_PRED_SQL = f"SELECT id, y, z, list_position(z, list_max(z)) - 1 AS pred FROM ({LOGITS_SQL})"
_TABLE = f"""SELECT a.c AS actual, b.c AS predicted, coalesce(n, 0) AS n FROM (SELECT CAST(range AS BIGINT) AS c FROM range(10)) a CROSS JOIN (SELECT CAST(range AS BIGINT) AS c FROM range(10)) b
LEFT JOIN (SELECT y, pred, count(*) AS n FROM ({_PRED_SQL}) GROUP BY 1, 2) t ON t.y = a.c AND t.pred = b.c"""


def _predicted(s, d):
    return logits(s, d).withColumn("pred", scalar.argmax("z"))


@query(_TABLE)
def confusion_multiclass(s, d):
    return m.confusion_table(_predicted(s, d), "y", "pred", 10).select("actual", "predicted", "n")


@query(f"SELECT actual, predicted, n / CAST(greatest(sum(n) OVER (PARTITION BY actual), 1) AS DOUBLE) AS share FROM ({_TABLE})")
def row_normalized_confusion(s, d):
    return m.confusion_table(_predicted(s, d), "y", "pred", 10).select("actual", "predicted", "share")


_PER = f"""SELECT class, {_div('hits', 'named')} AS precision, {_div('hits', 'support')} AS recall, {_div(f"2 * {_div('hits', 'named')} * {_div('hits', 'support')}", f"{_div('hits', 'named')} + {_div('hits', 'support')}")} AS f1, support FROM (
SELECT a.actual AS class, support, hits, named FROM (SELECT actual, CAST(sum(n) AS BIGINT) AS support, sum(CASE WHEN actual = predicted THEN n END) AS hits FROM ({_TABLE}) GROUP BY 1) a
JOIN (SELECT predicted, sum(n) AS named FROM ({_TABLE}) GROUP BY 1) b ON a.actual = b.predicted)"""


@query(_PER)
def per_class_metrics(s, d):
    return m.per_class(_predicted(s, d), "y", "pred", 10)


@query(f"SELECT class, f1 FROM ({_PER}) ORDER BY f1, class LIMIT 3")
def worst_classes(s, d):
    return m.per_class(_predicted(s, d), "y", "pred", 10).orderBy("f1", "class").limit(3).select("class", "f1")


@query(f"SELECT avg(CASE WHEN y = pred THEN 1.0{_D} ELSE 0.0{_D} END) AS accuracy FROM ({_PRED_SQL})")
def accuracy_multiclass(s, d):
    return _predicted(s, d).agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("accuracy"))


@query(f"SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, avg(p) AS mean_p, avg(CAST(y AS DOUBLE)) AS observed FROM ({SCORES_SQL}) GROUP BY 1")
def calibration_bins(s, d):
    return m.calibration(scores(s, d))


@query(f"SELECT grp, {_RATES}, {_div('fn', 'fn + tp')} AS fnr FROM ({_conf(by='grp')})")
def subgroup_metrics(s, d):
    return m.by_subgroup(scores(s, d), "grp", T)


_Z = f"SELECT id, y, (p - 0.3{_D}) * 6.0{_D} AS z FROM ({SCORES_SQL})"
_BCE = f"greatest(z, 0.0{_D}) - z * y + ln(1 + exp(-abs(z)))"


@query(f"SELECT avg({_BCE}) AS loss, avg(CASE WHEN y = 1 THEN 4.0{_D} ELSE 1.0{_D} END * ({_BCE})) AS weighted_loss FROM ({_Z})")
def bce_loss(s, d):
    z = scores(s, d).withColumn("z", (F.col("p") - 0.3) * 6.0)
    return z.agg(F.avg(scalar.bce_with_logits("z", "y")).alias("loss"), F.avg(scalar.bce_with_logits("z", "y", 4.0)).alias("weighted_loss"))


_LSE = "list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z)))))"


@query(f"SELECT avg({_LSE} - z[y + 1]) AS loss FROM ({LOGITS_SQL})")
def cross_entropy(s, d):
    return logits(s, d).agg(F.avg(scalar.cross_entropy("z", "y")).alias("loss"))


_SOFT = f"SELECT id, y, list_transform(z, lambda x: exp(x - list_max(z)) / list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) AS q FROM ({LOGITS_SQL})"
_TOP = f"SELECT id, y, c, prob, row_number() OVER (PARTITION BY id ORDER BY prob DESC, c) AS rank FROM (SELECT id, y, unnest(q) AS prob, CAST(generate_subscripts(q, 1) - 1 AS BIGINT) AS c FROM ({_SOFT}))"


@query(f"SELECT id, rank, c AS class, prob FROM ({_TOP}) WHERE rank <= 3")
def topk_classes(s, d):
    return scalar.top_k(logits(s, d).select("id", scalar.softmax("z").alias("q")), "id", "q", 3)


@query(f"SELECT avg(CASE WHEN hit THEN 1.0{_D} ELSE 0.0{_D} END) AS top2_accuracy FROM (SELECT id, bool_or(c = y) AS hit FROM ({_TOP}) WHERE rank <= 2 GROUP BY id)")
def top2_accuracy(s, d):
    q = logits(s, d).select("id", "y", scalar.softmax("z").alias("q"))
    return q.agg(F.avg(F.array_contains(scalar.top_indexes("q", 2), F.col("y").cast("int")).cast("double")).alias("top2_accuracy"))


@query(f"SELECT id, y, pred, conf FROM (SELECT id, y, list_position(q, list_max(q)) - 1 AS pred, list_max(q) AS conf FROM ({_SOFT})) WHERE y <> pred ORDER BY conf DESC, id LIMIT 12")
def confident_errors(s, d):
    q = logits(s, d).select("id", "y", scalar.softmax("z").alias("q"))
    q = q.select("id", "y", scalar.argmax("q").alias("pred"), F.array_max("q").alias("conf"))
    return q.where("y <> pred").orderBy(F.desc("conf"), "id").limit(12)


_LIN = "0.004{D} * {a} + 0.02{D} * {b} - 0.00001{D} * {c}".replace("{D}", _D)
_FEAT = "SELECT event_id AS id, CAST(event_type = 'purchase' AS BIGINT) AS y, value AS a, CAST(user_id AS DOUBLE) AS b, CAST(event_id % 97 AS DOUBLE) AS c FROM events"


def _importance_sql() -> str:
    def area(src: str) -> str:
        return f"""(SELECT sum(pos * (below + neg / 2.0{_D})) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
FROM (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM ({src}) GROUP BY p)))"""

    whole = area(f"SELECT y, round({_LIN.format(a='a', b='b', c='c')}, 9) AS p FROM ({_FEAT})")
    rows = []
    for col in "abc":
        areas = []
        for r in range(3):
            args = {k: ("n.v" if k == col else f"o.{k}") for k in "abc"}
            src = f"""SELECT y, round({_LIN.format(**args)}, 9) AS p FROM (SELECT *, row_number() OVER (ORDER BY id) AS pos FROM ({_FEAT})) o
JOIN (SELECT {col} AS v, row_number() OVER (ORDER BY md5('42|{col}|{r}|' || CAST(id AS VARCHAR)), id) AS pos FROM ({_FEAT})) n ON o.pos = n.pos"""
            areas.append(area(src))
        rows.append(f"SELECT '{col}' AS feature, {whole} - ({' + '.join(areas)}) / 3.0{_D} AS auc_drop")
    return " UNION ALL ".join(rows)


def _linear(c):
    return F.round(c["a"] * 0.004 + c["b"] * 0.02 - c["c"] * 0.00001, 9)


@query(_importance_sql())
def permutation_importance(s, d):
    e = read(s, d, "events").select(
        F.col("event_id").alias("id"), (F.col("event_type") == "purchase").cast("long").alias("y"), F.col("value").alias("a"),
        F.col("user_id").cast("double").alias("b"), (F.col("event_id") % 97).cast("double").alias("c"),
    )
    return m.permutation_importance(e, _linear, ["a", "b", "c"])


@query(f"SELECT * FROM ({_importance_sql()}) ORDER BY auc_drop DESC, feature LIMIT 2")
def top_features(s, d):
    return m.top_features(permutation_importance(s, d), 2)


_BATCH = f"SELECT CAST(floor(id / 256) AS BIGINT) AS batch, avg({_BCE}) AS loss, count(*) AS n FROM ({_Z}) GROUP BY 1"


@query(f"SELECT sum(loss * n) / sum(n) AS mean_loss FROM ({_BATCH})")
def weighted_mean_loss(s, d):
    z = scores(s, d).withColumn("z", (F.col("p") - 0.3) * 6.0)
    batches = z.groupBy(F.floor(F.col("id") / 256).alias("batch")).agg(F.avg(scalar.bce_with_logits("z", "y")).alias("loss"), F.count("*").alias("n"))
    return m.weighted_mean_loss(batches, "loss", "n")


_FOLD = f"SELECT CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42|' || CAST(id AS VARCHAR)), id) - 1) % 5 AS BIGINT) AS fold, y, p FROM ({SCORES_SQL})"


@query(f"""SELECT avg(auc) AS mean, stddev_samp(auc) AS std FROM (SELECT fold, sum(pos * (below + neg / 2.0{_D})) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc FROM (
SELECT fold, pos, neg, coalesce(sum(neg) OVER (PARTITION BY fold ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
FROM (SELECT fold, p, sum(y) AS pos, sum(1 - y) AS neg FROM ({_FOLD}) GROUP BY fold, p)) GROUP BY fold)""")
def kfold_auc(s, d):
    from tessera.operators import split

    return m.fold_summary(m.auc(split.folds(scores(s, d), "id", "y"), ["fold"]), "auc")


#: A training history made from the events: one epoch per user group.
_HIST = "SELECT CAST(user_id % 40 AS BIGINT) AS epoch, avg(value) AS train_loss, stddev_samp(value) AS val_loss, count(*) AS n FROM events GROUP BY 1"


def _history(s, d):
    return read(s, d, "events").groupBy((F.col("user_id") % 40).cast("long").alias("epoch")).agg(
        F.avg("value").alias("train_loss"), F.stddev_samp("value").alias("val_loss"), F.count("*").alias("n")
    )


_STOP = f"""SELECT epoch, val_loss, best, is_record, epoch - max(CASE WHEN is_record THEN epoch END) OVER (ORDER BY epoch) AS since_record FROM (
SELECT *, coalesce(val_loss < min(val_loss) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_record,
min(val_loss) OVER (ORDER BY epoch) AS best FROM ({_HIST}))"""


@query(_STOP)
def early_stopping(s, d):
    from tessera.operators import training

    return training.best_so_far(_history(s, d), "epoch", "val_loss").select("epoch", "val_loss", "best", "is_record", "since_record")


@query(f"SELECT epoch, val_loss - train_loss AS gap, val_loss - train_loss > 0.15{_D} AS overfits FROM ({_HIST})")
def overfit_gap(s, d):
    gap = F.col("val_loss") - F.col("train_loss")
    return _history(s, d).select("epoch", gap.alias("gap"), (gap > 0.15).alias("overfits"))


@query()
def plateau_schedule(s, d):
    from tessera.operators import training

    return training.reduce_on_plateau(_history(s, d), "epoch", "val_loss", start=1e-3)


@query(f"SELECT max(n) AS best, min(n) AS worst, max(n) - (SELECT n FROM ({_HIST}) ORDER BY n DESC, epoch LIMIT 1 OFFSET 2) AS gap_1_3 FROM ({_HIST})")
def leaderboard_gap(s, d):
    return m.leaderboard_gap(_history(s, d), "epoch", "n")


@query(f"SELECT id, p, y, CAST(p >= 0.25 AS INTEGER) AS decision, CASE WHEN abs(p - 0.25{_D}) < 0.05{_D} THEN 'low' ELSE 'ok' END AS confidence, CAST(p >= 0.25 AS INTEGER) = y AS correct, repeat('#', CAST(floor(p * 40) AS INTEGER)) AS bar FROM ({SCORES_SQL})")
def fragile_decisions(s, d):
    p = F.col("p")
    return scores(s, d).select(
        "id", "p", "y", (p >= T).cast("int").alias("decision"), F.when(F.abs(p - T) < 0.05, "low").otherwise("ok").alias("confidence"),
        ((p >= T).cast("int") == F.col("y")).alias("correct"), F.repeat(F.lit("#"), F.floor(p * 40).cast("int")).alias("bar"),
    )


@query(f"SELECT id, list_max(q) AS top, list_max(q) < 0.5{_D} AS unsure FROM ({_SOFT})")
def low_confidence(s, d):
    q = logits(s, d).select("id", scalar.softmax("z").alias("q"))
    return q.select("id", F.array_max("q").alias("top"), (F.array_max("q") < 0.5).alias("unsure"))
