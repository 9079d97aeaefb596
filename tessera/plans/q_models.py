"""Queries on preprocessing, networks, models, serving and monitoring, with SQL where results are exact."""

from __future__ import annotations

import json

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.nn import layers, score, train
from tessera.operators import clean, encode, metrics, split
from tessera.plans import models
from tessera.plans.frames import HOLED_SQL, ORDERS_SQL, holed_customers, labelled_orders, logits, read
from tessera.prep import TabularPreprocessor, TabularState, WoePreprocessor
from tessera.sources.scratch import stored
from tessera.spec import TableSpec
from tessera.streaming import scoring

QUERIES: dict = {}
_D = "::DOUBLE"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_SPLIT_SQL = f"""SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) <= floor(count(*) OVER (PARTITION BY y) * 0.2{_D}) AS is_val FROM ({ORDERS_SQL})"""


def _split_orders(s, d):
    return split.stratified_split(labelled_orders(s, d), "o_orderkey", "y", 0.2)


_WOE = f"""SELECT o_orderpriority AS cat, round(ln((CAST(sum(y) AS DOUBLE) / (SELECT sum(y) FROM ({_SPLIT_SQL}) WHERE NOT is_val)) / (CAST(sum(1 - y) AS DOUBLE) / (SELECT sum(1 - y) FROM ({_SPLIT_SQL}) WHERE NOT is_val))), 12) AS woe
FROM ({_SPLIT_SQL}) WHERE NOT is_val GROUP BY 1"""


@query(f"""WITH v AS (SELECT y, coalesce(woe, 0) AS p FROM ({_SPLIT_SQL}) LEFT JOIN ({_WOE}) ON o_orderpriority = cat WHERE is_val),
g AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM v GROUP BY p),
c AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
SELECT sum(pos * (below + neg / 2.0{_D})) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc, (SELECT count(*) FROM v) AS n FROM c""")
def flagship_woe_auc(s, d):
    """Split, weight of evidence fitted on the training rows, AUC of it as a score on the others."""
    rows = stored(_split_orders(s, d).select("o_orderpriority", "y", "is_val"))  # the fit and the score read it
    fitted = encode.weight_of_evidence(rows.where("not is_val"), "o_orderpriority", "y")
    fitted = fitted.withColumn("woe", F.round("woe", 12))
    val = encode.apply(rows.where("is_val"), fitted, "o_orderpriority", {"woe": 0.0}).select("y", F.col("woe").alias("p"))
    return metrics.auc(val).join(val.agg(F.count("*").alias("n")))


def _customer_spec() -> TableSpec:
    return TableSpec(numeric=("c_acctbal", "c_nationkey"), log_numeric=("c_acctbal",), categorical=("c_mktsegment",))


_TRAIN = "c_custkey % 5 <> 0"
_FILLED = f"""SELECT c_custkey, ln(1 + greatest(coalesce(c_acctbal, (SELECT median(c_acctbal) FROM h WHERE {_TRAIN})), 0.0{_D})) AS a,
coalesce(CAST(c_nationkey AS DOUBLE), (SELECT median(CAST(c_nationkey AS DOUBLE)) FROM h WHERE {_TRAIN})) AS b, coalesce(c_mktsegment, 'Unknown') AS seg FROM h"""
_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "Unknown")
_WIDE = f"""WITH h AS ({HOLED_SQL}), f AS ({_FILLED}), st AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb FROM f WHERE {_TRAIN})
SELECT c_custkey, (a - ma) / sa AS c_acctbal, (b - mb) / sb AS c_nationkey, {', '.join(f'''CASE WHEN seg = '{v}' THEN 1.0{_D} ELSE 0.0{_D} END AS "c_mktsegment={v}" ''' for v in _SEGMENTS)} FROM f, st"""


def _customers(s, d):
    """Holed customers; segments of the held-out fifth are all missing by construction, so the token is unseen in training."""
    return holed_customers(s, d).drop("deck")


def _fitted(s, d):
    return TabularPreprocessor(_customer_spec()).fit(_customers(s, d), F.expr(_TRAIN))


@query(_WIDE)
def prep_full_features(s, d):
    return _fitted(s, d).transform_wide(_customers(s, d), "c_custkey")


@query(f"SELECT c_custkey, c_acctbal + c_nationkey AS total FROM ({_WIDE})")
def prep_json_round_trip(s, d):
    """The state through JSON gives the same features."""
    state = TabularState.from_json(_fitted(s, d).state.to_json())
    wide = TabularPreprocessor(_customer_spec(), state=state).transform_wide(_customers(s, d), "c_custkey")
    return wide.select("c_custkey", (F.col("c_acctbal") + F.col("c_nationkey")).alias("total"))


@query("""SELECT o_orderkey, round((ln(1 + o_totalprice) - avg(ln(1 + o_totalprice)) OVER ()) / stddev_samp(ln(1 + o_totalprice)) OVER (), 6) AS z FROM orders""")
def log1p_zscore(s, d):
    spec = TableSpec(numeric=("o_totalprice",), log_numeric=("o_totalprice",))
    orders = read(s, d, "orders")
    return TabularPreprocessor(spec).fit(orders).transform_wide(orders, "o_orderkey").select("o_orderkey", F.round("o_totalprice", 6).alias("z"))


_W2 = f"""SELECT o_orderpriority AS cat, ln(((sum(y) + 0.5{_D}) / ((SELECT sum(y) FROM ({_SPLIT_SQL}) WHERE NOT is_val) + 1.0{_D})) / ((sum(1 - y) + 0.5{_D}) / ((SELECT sum(1 - y) FROM ({_SPLIT_SQL}) WHERE NOT is_val) + 1.0{_D}))) AS woe FROM ({_SPLIT_SQL}) WHERE NOT is_val GROUP BY 1"""
_W3 = f"SELECT o_orderkey, is_val, o_totalprice, woe FROM ({_SPLIT_SQL}) JOIN ({_W2}) ON o_orderpriority = cat"


@query(f"""WITH t AS ({_W3}), st AS (SELECT avg(o_totalprice) AS m1, stddev_pop(o_totalprice) AS s1, avg(woe) AS m2, stddev_pop(woe) AS s2 FROM t WHERE NOT is_val)
SELECT o_orderkey, (o_totalprice - m1) / s1 AS o_totalprice, (woe - m2) / s2 AS o_orderpriority_woe FROM t, st""")
def woe_impute_scale(s, d):
    rows = _split_orders(s, d)
    prep = WoePreprocessor(["o_totalprice"], ["o_orderpriority"], "y").fit(rows, ~F.col("is_val"))
    return prep.transform(rows, "o_orderkey")


def _auc_sql(inner: str) -> str:
    return f"""(SELECT sum(pos * (below + neg / 2.0{_D})) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM ({inner}) GROUP BY p)))"""


def _leak(filter_: str) -> str:
    tot = f"SELECT sum(y) AS tp, sum(1 - y) AS tn FROM ({_CUSTOMER_ORDERS}) WHERE {filter_}"
    return f"SELECT cat, round(ln(((p + 0.5{_D}) / (tp + 1.0{_D})) / ((n + 0.5{_D}) / (tn + 1.0{_D}))), 12) AS woe FROM (SELECT cust AS cat, sum(y) AS p, sum(1 - y) AS n FROM ({_CUSTOMER_ORDERS}) WHERE {filter_} GROUP BY 1), ({tot})"


_CUSTOMER_ORDERS = f"SELECT CAST(o_custkey AS VARCHAR) AS cust, y, is_val FROM ({_SPLIT_SQL})"


@query(f"""SELECT {_auc_sql(f"SELECT y, coalesce(woe, 0) AS p FROM ({_CUSTOMER_ORDERS}) LEFT JOIN ({_leak('true')}) ON cust = cat WHERE is_val")} AS auc_leaky,
{_auc_sql(f"SELECT y, coalesce(woe, 0) AS p FROM ({_CUSTOMER_ORDERS}) LEFT JOIN ({_leak('NOT is_val')}) ON cust = cat WHERE is_val")} AS auc_clean""")
def leakage_gap(s, d):
    """The same encoder fitted on all rows and on the training rows."""
    rows = _split_orders(s, d).withColumn("cust", F.col("o_custkey").cast("string"))
    out = []
    for name, fit_rows in (("auc_leaky", rows), ("auc_clean", rows.where("not is_val"))):
        fitted = encode.weight_of_evidence(fit_rows, "cust", "y", 0.5).withColumn("woe", F.round("woe", 12))
        val = encode.apply(rows.where("is_val"), fitted, "cust", {"woe": 0.0}).select("y", F.col("woe").alias("p"))
        out.append(metrics.auc(val).withColumnRenamed("auc", name))
    return out[0].join(out[1])


def _mlp() -> layers.Mlp:
    """64 inputs, 4 hidden units, one logit, weights by rule."""
    hidden = layers.fold_batch_norm(layers.fixed_weights(64, 4), np.array([1.0, 0.5, 1.5, 1.0]), np.array([0.0, 0.1, -0.1, 0.2]), np.array([0.0, 0.05, 0.0, -0.05]), np.ones(4), 0.0)
    return layers.Mlp([hidden, layers.Dense(layers.fixed_weights(4, 1, 2), np.array([0.1]), relu=False)])


def _mlp_sql() -> str:
    gamma, beta, mean = (1.0, 0.5, 1.5, 1.0), (0.0, 0.1, -0.1, 0.2), (0.0, 0.05, 0.0, -0.05)
    w = lambda i, j, seed: ((7 * i + 3 * j + seed) % 11 - 5) / 10.0
    units = []
    for j in range(4):
        dot = " + ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * {w(i, j, 1)}{_D}" for i in range(64))
        units.append(f"greatest((({dot}) - {mean[j]}{_D}) * {gamma[j]}{_D} + {beta[j]}{_D}, 0.0{_D})")
    z = " + ".join(f"{u} * {w(j, 0, 2)}{_D}" for j, u in enumerate(units))
    return f"SELECT vec_id, round(0.1{_D} + {z}, 9) AS z FROM embeddings"


@query(_mlp_sql())
def mlp_forward(s, d):
    x = [F.col("embedding")[i].cast("double") for i in range(64)]
    return read(s, d, "embeddings").select("vec_id", F.round(_mlp().columns(x)[0], 9).alias("z"))


@query(_mlp_sql())
def mlp_forward_batches(s, d):
    """The same network in Arrow batches, its weights through JSON."""
    net = layers.Mlp.from_json(_mlp().to_json())
    out = score.score_arrays(read(s, d, "embeddings"), "vec_id", "embedding", net.forward)
    return out.select("vec_id", F.round(F.col("z")[0], 9).alias("z"))


@query(f"SELECT id, list_max(q) AS top, CAST(list_sum(q) > 0.999999 AND list_sum(q) < 1.000001 AS BOOLEAN) AS sums FROM (SELECT id, list_transform(z, lambda x: exp(x - list_max(z)) / list_sum(list_transform(z, lambda v: exp(v - list_max(z))))) AS q FROM (SELECT vec_id AS id, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE) * 10.0{_D}) AS z FROM embeddings))")
def softmax_scores(s, d):
    q = logits(s, d).select("id", scalar.softmax("z").alias("q"))
    total = F.aggregate("q", F.lit(0.0), lambda a, x: a + x)
    return q.select("id", F.array_max("q").alias("top"), total.between(0.999999, 1.000001).alias("sums"))


def _pool_sql() -> str:
    """Max-pooled ReLU of a 3x3 sum over an 8x8 image: 16 values, summed."""
    px = lambda r, c: f"CAST(embedding[{r * 8 + c + 1}] AS DOUBLE)"
    conv = lambda r, c: "(" + " + ".join(px(a, b) for a in (r - 1, r, r + 1) for b in (c - 1, c, c + 1) if 0 <= a < 8 and 0 <= b < 8) + ")"
    pooled = [f"greatest(0.0{_D}, {', '.join(conv(2 * r + i, 2 * c + j) for i in (0, 1) for j in (0, 1))})" for r in range(4) for c in range(4)]
    return f"SELECT vec_id, round({' + '.join(pooled)}, 9) AS total FROM embeddings"


@query(_pool_sql())
def conv_pool_forward(s, d):
    net = layers.ConvNet([(np.ones((1, 1, 3, 3)), np.zeros(1))], layers.Mlp([layers.Dense(np.ones((16, 1)), np.zeros(1), relu=False)]))
    out = score.score_arrays(read(s, d, "embeddings"), "vec_id", "embedding", net.forward, (1, 8, 8))
    return out.select("vec_id", F.round(F.col("z")[0], 9).alias("total"))


@query("""WITH w AS (SELECT 3 + count(DISTINCT c_mktsegment) AS n FROM customer WHERE c_custkey % 5 <> 0)
SELECT 'tabular' AS model, n AS n_inputs, CAST(64 * n + 128 + 64 * 32 + 64 + 33 AS BIGINT) AS n_parameters FROM w UNION ALL SELECT 'plain', n, CAST(16 * n + 16 + 16 * 8 + 8 + 9 AS BIGINT) FROM w""")
def param_count(s, d):
    """Parameters of two networks on the features that the preprocessor makes of the customers."""
    n = _fitted(s, d).state.n_features
    rows = [("tabular", n, layers.parameter_count([n, 64, 32, 1])), ("plain", n, layers.parameter_count([n, 16, 8, 1], batch_norm=False))]
    return s.createDataFrame(rows, "model string, n_inputs long, n_parameters long")


_PIX = "list_transform(embedding, lambda x: CAST(floor(abs(x) * 255) AS BIGINT) % 256)"


def _pixels(s, d):
    return read(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(F.abs(x) * 255) % 256).alias("px"))


@query(f"SELECT vec_id, px[1] AS first, round(list_sum(list_transform(px, lambda x: (x / 255.0{_D} - 0.286{_D}) / 0.353{_D})), 6) AS total FROM (SELECT vec_id, {_PIX} AS px FROM embeddings)")
def image_normalize(s, d):
    z = scalar.pixel_normalize("px", 0.286, 0.353)
    return _pixels(s, d).select("vec_id", F.col("px")[0].alias("first"), F.round(F.aggregate(z, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"SELECT vec_id, px[8] AS a, px[1] AS b, 255 - px[57] AS c FROM (SELECT vec_id, {_PIX} AS px FROM embeddings)")
def image_flip_invert(s, d):
    f = _pixels(s, d).withColumn("f", scalar.flip_horizontal("px", 8)).withColumn("v", scalar.invert("px"))
    return f.select("vec_id", F.col("f")[0].alias("a"), F.col("f")[7].alias("b"), F.col("v")[56].alias("c"))


@query(f"SELECT vec_id, CAST(px[10] AS DOUBLE) AS a, 0.0{_D} AS z FROM (SELECT vec_id, {_PIX} AS px FROM embeddings)")
def image_crop_shift(s, d):
    px = _pixels(s, d).withColumn("px", F.transform("px", lambda x: x.cast("double")))
    c = px.select("vec_id", scalar.crop_padded("px", 8, 8, F.lit(1), F.lit(1)).alias("c"))
    return c.select("vec_id", F.col("c")[0].alias("a"), F.col("c")[63].alias("z"))


@query("SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, embedding[33] = list_slice(embedding, 33, 40)[1] AS same FROM embeddings")
def reshape_flatten(s, d):
    """Rows of an 8x8 image and back."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, F.lit(8)))
    e = read(s, d, "embeddings").select("vec_id", "embedding", rows.alias("r"))
    return e.select("vec_id", F.size(F.flatten("r")).cast("long").alias("n"), (F.col("embedding")[32] == F.col("r")[4][0]).alias("same"))


@query("SELECT event_id, '{\"k\":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS js FROM events")
def json_round_trip(s, d):
    parsed = F.from_json("props", "k int")
    return read(s, d, "events").select("event_id", F.to_json(parsed).alias("js"))


@query("SELECT doc_id, CASE WHEN lang IN ('en', 'de', 'es', 'fr') THEN ['English', 'German', 'Spanish', 'French'][list_position(['en', 'de', 'es', 'fr'], lang)] END AS name FROM documents")
def class_names(s, d):
    names = F.array(*[F.lit(n) for n in ("English", "German", "Spanish", "French")])
    codes = F.array(*[F.lit(n) for n in ("en", "de", "es", "fr")])
    at = F.array_position(codes, F.col("lang"))
    return read(s, d, "documents").select("doc_id", F.when(at > 0, F.get(names, (at - 1).cast("int"))).alias("name"))


def _vectors(s, d):
    e = read(s, d, "embeddings").select("vec_id", "embedding", (F.col("label") > 4).cast("long").alias("y"))
    return split.folds(e, "vec_id", "y", 5)


def _fold_rows(s, d):
    """Vectors, labels and folds, written once for all fits in parts of equal size, one for each core: a table in one file, or of few row groups, would keep few cores busy in every fit."""
    rows = models.as_vectors(_vectors(s, d), "embedding", "y", "vec_id", "fold")
    return stored(rows.repartition(s.sparkContext.defaultParallelism, "id").sortWithinPartitions("id"), "vectors")


@query()
def logreg_fit_score(s, d):
    rows = _fold_rows(s, d)
    return models.candidates(64)["logistic"](rows.where("fold <> 0")).scored(rows.where("fold = 0"))


@query()
def model_leaderboard(s, d):
    """Thirteen algorithms on five folds."""
    return models.leaderboard(_fold_rows(s, d), 64)


@query()
def random_search(s, d):
    from pyspark.ml.classification import LogisticRegression

    rows = _fold_rows(s, d)
    make = lambda p: LogisticRegression(featuresCol="x", labelCol="y", maxIter=10, **p)
    return models.random_search(rows.where("fold <> 0"), rows.where("fold = 0"), make, {"regParam": [0.0, *(10.0**k for k in range(-4, 2))], "elasticNetParam": [k / 10 for k in range(11)]})


@query()
def soft_vote_blend(s, d):
    rows = _fold_rows(s, d)
    fitted = [models.candidates(64)[n](rows.where("fold <> 0")) for n in ("logistic", "tree", "bayes")]
    return metrics.auc(models.soft_vote(fitted, rows.where("fold = 0")).withColumn("p", F.round("p", 12)))


@query("SELECT c_custkey, CAST((c_custkey % 2 + c_nationkey % 2) % 2 AS BIGINT) AS predicted, true AS linear_fails FROM customer")
def xor_demo(s, d):
    """The exclusive or of two parities of each customer: predicted by a network with a hidden layer, and whether a linear model is wrong about one of the four cases at least."""
    a, b = F.col("c_custkey") % 2, F.col("c_nationkey") % 2
    rows = read(s, d, "customer").select(F.col("c_custkey").alias("id"), array_to_vector(F.array(a.cast("double"), b.cast("double"))).alias("x"), ((a + b) % 2).cast("double").alias("y"))
    rows = stored(rows, "parities")
    linear, hidden = models.xor_fit(rows)
    wrong = linear.model.transform(rows).where("prediction <> y").select("x").distinct().agg((F.count("*") > 0).alias("linear_fails"))
    found = hidden.model.transform(rows).select(F.col("id").alias("c_custkey"), F.col("prediction").cast("long").alias("predicted"))
    return found.join(F.broadcast(wrong))  # wrong: one row


@query()
def mlp_training(s, d):
    """A network with normalization by the whole protocol but for its steps, of half the training rows each; its history, and the test AUC and F1 at the chosen threshold, looked at once."""
    rows = _vectors(s, d).select("vec_id", F.col("embedding").alias("x"), "y", "fold")
    part = lambda *k: rows.where(F.col("fold").isin(*k))
    chosen = train.fit_selected(part(2, 3, 4), part(1), "x", "y", "vec_id", [64, 32, 1], batches=2, lr=5e-3, normalize=True)
    again = train.Selected.from_json(chosen.to_json())
    test = train.probabilities(part(0), "x", "y", "vec_id", again.model)
    final = metrics.bundle(test, again.threshold).first()
    out = [(f"epoch {e}", loss, auc) for e, loss, auc in chosen.history] + [("test", float(final["f1"]), float(final["auc"]))]
    return s.createDataFrame(out, "step string, value double, auc double")


_SCORE = f"1 / (1 + exp(-(0.8{_D} * c_acctbal - 0.3{_D} * c_nationkey + 0.4{_D} * \"c_mktsegment=BUILDING\")))"


def _served(s, d, state: TabularState, frame):
    wide = TabularPreprocessor(_customer_spec(), state=state).transform_wide(frame, "c_custkey")
    z = F.col("c_acctbal") * 0.8 - F.col("c_nationkey") * 0.3 + F.col("c_mktsegment=BUILDING") * 0.4
    return wide.select("c_custkey", scalar.sigmoid(z).alias("p"))


@query(f"SELECT c_custkey, p, CAST(p >= 0.5 AS INTEGER) AS decision, abs(p - 0.5{_D}) < 0.05{_D} AS fragile FROM (SELECT c_custkey, {_SCORE} AS p FROM ({_WIDE}))")
def score_batch(s, d):
    frame = clean.reconcile(_customers(s, d), _customers(s, d).schema)
    return scoring.score_stream(_served(s, d, _fitted(s, d).state, frame), F.col("p"), 0.5, "c_custkey")


@query(f"SELECT c_custkey, round({_SCORE}, 9) AS trained, round({_SCORE}, 9) AS served FROM ({_WIDE})")
def serve_parity(s, d):
    """Scores of the fitted preprocessor beside those of its JSON state, records as text."""
    state = _fitted(s, d).state
    trained = _served(s, d, state, _customers(s, d))
    text = _customers(s, d).select("c_custkey", F.to_json(F.struct("c_acctbal", "c_nationkey", "c_mktsegment")).alias("body"))
    parsed = text.select("c_custkey", F.from_json("body", "c_acctbal string, c_nationkey string, c_mktsegment string").alias("r")).select("c_custkey", "r.*")
    served = _served(s, d, TabularState.from_json(json.dumps(json.loads(state.to_json()))), parsed).withColumnRenamed("p", "q")
    return trained.join(served, "c_custkey").select("c_custkey", F.round("p", 9).alias("trained"), F.round("q", 9).alias("served"))


@query(f"""SELECT 'value' AS column_name, a.m AS reference_mean, b.m AS current_mean, (b.m - a.m) / a.s AS shift FROM (SELECT avg(value) AS m, stddev_samp(value) AS s FROM events WHERE event_id % 2 = 0) a, (SELECT avg(value) AS m FROM events WHERE event_id % 2 = 1) b
UNION ALL SELECT 'user_id', a.m, b.m, (b.m - a.m) / a.s FROM (SELECT avg(user_id) AS m, stddev_samp(user_id) AS s FROM events WHERE event_id % 2 = 0) a, (SELECT avg(user_id) AS m FROM events WHERE event_id % 2 = 1) b""")
def drift_means(s, d):
    e = read(s, d, "events")
    return scoring.drift(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["value", "user_id"])


@query(f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, avg(CASE WHEN value / 200 >= 0.25 THEN 1.0{_D} ELSE 0.0{_D} END) AS positive_share,
avg(CASE WHEN abs(value / 200 - 0.25) < 0.05 THEN 1.0{_D} ELSE 0.0{_D} END) AS fragile_share FROM events GROUP BY 1""")
def request_metrics(s, d):
    return scoring.request_metrics(scoring.score_stream(read(s, d, "events"), F.col("value") / 200, 0.25, "ts"), "ts")


def _woe_sql(col: str) -> str:
    src = f"(SELECT * FROM ({_SPLIT_SQL}) WHERE NOT is_val)"
    return f"""SELECT {col} AS cat, ln((CAST(sum(y) AS DOUBLE) / (SELECT sum(y) FROM {src})) / (CAST(sum(1 - y) AS DOUBLE) / (SELECT sum(1 - y) FROM {src}))) AS woe FROM {src} GROUP BY 1"""


_GAP = " UNION ALL ".join(
    f"""SELECT '{name}' AS variant, CAST(o_custkey % 3 AS BIGINT) AS grp, count(*) AS n, avg(CAST(round({z}, 9) > 0 AS INTEGER)) AS positive_rate,
avg(CASE WHEN y = 1 THEN CAST(round({z}, 9) > 0 AS INTEGER) END) AS recall FROM ({_SPLIT_SQL}) r
JOIN ({_woe_sql("o_orderpriority")}) a ON a.cat = r.o_orderpriority JOIN ({_woe_sql("o_custkey % 3")}) b ON b.cat = r.o_custkey % 3 WHERE is_val GROUP BY 2"""
    for name, z in (("with", "a.woe + b.woe"), ("without", "a.woe"))
)


@query(_GAP)
def sensitive_attribute_gap(s, d):
    """Decisions per subgroup by evidence learned with the sensitive attribute and without it."""
    rows = _split_orders(s, d).withColumn("grp", (F.col("o_custkey") % 3).cast("long"))
    known, z = rows.where("not is_val"), {}
    for col in ("o_orderpriority", "grp"):
        fitted = encode.weight_of_evidence(known, col, "y").withColumnRenamed("woe", f"w_{col}")
        rows = encode.apply(rows, fitted, col)
    z = {"with": F.col("w_o_orderpriority") + F.col("w_grp"), "without": F.col("w_o_orderpriority")}
    out = None
    for name, value in z.items():
        hit = (F.round(value, 9) > 0).cast("int")
        part = rows.where("is_val").groupBy("grp").agg(F.count("*").alias("n"), F.avg(hit).alias("positive_rate"), F.avg(F.when(F.col("y") == 1, hit)).alias("recall"))
        part = part.select(F.lit(name).alias("variant"), "grp", "n", "positive_rate", "recall")
        out = part if out is None else out.unionByName(part)
    return out


_FOLDED = f"""SELECT y, o_orderpriority AS cat, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1) % 5 AS BIGINT) AS fold FROM ({ORDERS_SQL})"""
_SWAP = f"""WITH t AS (SELECT cat, fold, CAST(sum(y) AS DOUBLE) AS p, CAST(sum(1 - y) AS DOUBLE) AS q FROM ({_FOLDED}) GROUP BY 1, 2),
c AS (SELECT cat, sum(p) AS p, sum(q) AS q FROM t GROUP BY 1), g AS (SELECT fold, sum(p) AS p, sum(q) AS q FROM t GROUP BY 1), a AS (SELECT sum(p) AS p, sum(q) AS q FROM t),
m AS (SELECT t.fold, t.p AS pos, t.q AS neg, round((c.p - t.p) / (c.p + c.q - t.p - t.q), 12) AS one_hot, round(ln(((c.p - t.p) / (a.p - g.p)) / ((c.q - t.q) / (a.q - g.q))), 12) AS woe
FROM t JOIN c ON c.cat = t.cat JOIN g ON g.fold = t.fold CROSS JOIN a)
""" + " UNION ALL ".join(
    f"""SELECT '{n}' AS encoder, avg(auc) AS mean, stddev_samp(auc) AS std FROM (SELECT fold, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM
(SELECT fold, pos, neg, coalesce(sum(neg) OVER (PARTITION BY fold ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT fold, {n} AS z, sum(pos) AS pos, sum(neg) AS neg FROM m GROUP BY 1, 2)) GROUP BY 1)"""
    for n in ("one_hot", "woe")
)


@query(_SWAP)
def encoder_swap_folds(s, d):
    """Mean and deviation of the AUC over five folds, one-hot against evidence of one category.

    A logistic fit on the indicators of one category gives each its rate; both scores of a fold come from the other folds' counts.
    """
    rows = split.folds(labelled_orders(s, d), "o_orderkey", "y", 5).select(F.col("o_orderpriority").alias("cat"), "fold", "y", F.col("o_orderkey").alias("id"))
    t = rows.groupBy("cat", "fold").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    c = t.groupBy("cat").agg(F.sum("p").alias("cp"), F.sum("q").alias("cq"))
    g = t.groupBy("fold").agg(F.sum("p").alias("gp"), F.sum("q").alias("gq"))
    a = t.agg(F.sum("p").alias("ap"), F.sum("q").alias("aq"))
    p, q = F.col("cp") - F.col("p"), F.col("cq") - F.col("q")
    fitted = t.join(c, "cat").join(g, "fold").join(F.broadcast(a)).select(  # a: one row
        "cat", "fold", F.round(p / (p + q), 12).alias("one_hot"), F.round(F.log((p / (F.col("ap") - F.col("gp"))) / (q / (F.col("aq") - F.col("gq")))), 12).alias("woe")
    )
    scored = rows.join(fitted, ["cat", "fold"]).select("fold", "y", F.inline(F.array(*[F.struct(F.lit(n).alias("encoder"), F.col(n).alias("p")) for n in ("one_hot", "woe")])))
    areas = metrics.auc(scored, ["encoder", "fold"])
    return areas.groupBy("encoder").agg(F.avg("auc").alias("mean"), F.stddev_samp("auc").alias("std"))


@query("""SELECT c_custkey, balance, errors, errors = '' AS accepted FROM (SELECT c_custkey, balance, nation, concat_ws(',', CASE WHEN balance < -999 OR balance > 9000 THEN 'balance' END, CASE WHEN nation < 0 OR nation > 24 THEN 'nation' END) AS errors
FROM (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 1000000.0::DOUBLE WHEN 3 THEN NULL ELSE c_acctbal END AS balance,
CASE c_custkey % 6 WHEN 3 THEN NULL WHEN 4 THEN -1.0::DOUBLE ELSE CAST(c_nationkey AS DOUBLE) END AS nation FROM customer))""")
def pathological_records(s, d):
    """Records as text, broken in turn: no number, infinite, out of range, all null, a negative code; what is coerced and what is refused."""
    k = F.col("c_custkey") % 6
    text = read(s, d, "customer").select(
        "c_custkey",
        F.when(k == 0, "abc").when(k == 1, "Infinity").when(k == 2, "1e6").when(k != 3, F.col("c_acctbal").cast("string")).alias("balance"),
        F.when(k == 4, "-1").when(k != 3, F.col("c_nationkey").cast("string")).alias("nation"),
    )
    rows = text.select("c_custkey", clean.coerce_numeric("balance").alias("balance"), clean.coerce_numeric("nation").alias("nation"))
    rows = rows.withColumn("errors", clean.contract_errors({"balance": (-999, 9000), "nation": (0, 24)}))
    return rows.select("c_custkey", "balance", "errors", (F.col("errors") == "").alias("accepted"))


@query()
def best_models(s, d):
    """The best three of the algorithms that need few passes, on five folds."""
    quick = ("logistic", "tree", "bayes", "svm", "linear_discriminant", "quadratic_discriminant", "ridge")
    return models.best(models.leaderboard(_fold_rows(s, d), 64, names=quick))
