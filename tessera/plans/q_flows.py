"""Whole flows: cleaning in order, set-up for model comparison, saved models, ablations, with SQL where results are exact."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tessera.nn import layers, score
from tessera.operators import clean, encode, metrics, split
from tessera.plans import models
from tessera.plans.frames import HOLED_SQL, ORDERS_SQL, SCORES_SQL, holed_customers, labelled_orders, read, scores
from tessera.prep import TabularPreprocessor
from tessera.sources import files
from tessera.spec import TableSpec
from tessera.streaming import scoring

QUERIES: dict = {}
_D = "::DOUBLE"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


@query(f"""WITH h AS ({HOLED_SQL}), a AS (SELECT c_custkey, c_acctbal, c_mktsegment FROM h WHERE c_mktsegment IS NOT NULL)
SELECT min(c_custkey) AS c_custkey, coalesce(c_acctbal, (SELECT median(c_acctbal) FROM a)) AS c_acctbal, c_mktsegment FROM a GROUP BY 2, 3""")
def clean_flow(s, d):
    """Drop columns, drop rows, then fill by the median of what is left, then keep the first of equal rows."""
    rows = clean.drop_null(holed_customers(s, d).drop("deck", "c_nationkey"), ["c_mktsegment"])
    filled = clean.fill_median(rows, ["c_acctbal"])
    return clean.keep_first(filled, ["c_acctbal", "c_mktsegment"], "c_custkey").select("c_custkey", "c_acctbal", "c_mktsegment")


@query("""SELECT c_custkey, 'number' AS kind, CAST(c_acctbal AS VARCHAR) IS NOT NULL AS present FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'category', c_mktsegment IS NOT NULL FROM customer WHERE c_custkey % 2 = 1""")
def append_rows(s, d):
    c = read(s, d, "customer")
    a = c.where("c_custkey % 2 = 0").select("c_custkey", F.lit("number").alias("kind"), F.col("c_acctbal").isNotNull().alias("present"))
    b = c.where("c_custkey % 2 = 1").select("c_custkey", F.lit("category").alias("kind"), F.col("c_mktsegment").isNotNull().alias("present"))
    return a.unionByName(b)


@query("SELECT o.o_orderkey, o.o_totalprice, l.n AS n_lines, l.qty FROM orders o JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1) l ON o.o_orderkey = l.l_orderkey")
def join_feature_blocks(s, d):
    """Blocks of features side by side, by key; the larger side is aggregated before the join."""
    block = read(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("qty"))
    orders = read(s, d, "orders").select("o_orderkey", "o_totalprice")
    return orders.join(block, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


@query("""SELECT 'o_orderkey' AS column_name, 'bigint' AS kind, count(o_orderkey) AS n FROM orders UNION ALL SELECT 'o_custkey', 'bigint', count(o_custkey) FROM orders UNION ALL SELECT 'o_orderstatus', 'string', count(o_orderstatus) FROM orders
UNION ALL SELECT 'o_totalprice', 'double', count(o_totalprice) FROM orders UNION ALL SELECT 'o_orderpriority', 'string', count(o_orderpriority) FROM orders""")
def column_types(s, d):
    """Columns with their types and how many values they hold."""
    orders = read(s, d, "orders")
    kinds = [(n, k) for n, k in orders.dtypes if n != "o_orderdate"]
    counts = orders.agg(*[F.count(n).alias(n) for n, _ in kinds])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column_name"), F.lit(k).alias("kind"), F.col(n).alias("n")) for n, k in kinds])))


@query("SELECT c_custkey, c_acctbal FROM customer")
def json_object_or_list(s, d):
    """One file with an object, and files with lists of up to a thousand objects."""
    rows = read(s, d, "customer").select("c_custkey", F.to_json(F.struct("c_custkey", "c_acctbal")).alias("js"))
    alone = rows.where("c_custkey = 1").select(F.lit("one").alias("g"), F.col("js").alias("value"))
    part = (F.col("c_custkey") / 1000).cast("long").cast("string").alias("g")
    lists = rows.where("c_custkey <> 1").groupBy(part).agg(F.concat(F.lit("["), F.array_join(F.collect_list("js"), ",\n"), F.lit("]")).alias("value"))
    path = files.scratch_path(s, "records")
    alone.unionByName(lists).write.partitionBy("g").option("lineSep", "\n").text(path)
    return files.read_records(s, path, "c_custkey long, c_acctbal double").select("c_custkey", "c_acctbal")


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_partkey LIMIT 20")
def csv_head(s, d):
    path = files.scratch_path(s, "part_head")
    files.write_delimited(read(s, d, "part").select("p_partkey", "p_retailprice"), path)
    return files.read_delimited(s, path, "p_partkey long, p_retailprice double", header=True).orderBy("p_partkey").limit(20)


_SETUP = f"""SELECT *, CAST((row_number() OVER (PARTITION BY y ORDER BY md5('7|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1) % 5 AS BIGINT) AS fold FROM (
SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) <= floor(count(*) OVER (PARTITION BY y) * 0.2{_D}) AS held FROM ({ORDERS_SQL})) WHERE NOT held"""


@query(f"SELECT fold, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, avg(o_totalprice) AS mean_price FROM ({_SETUP}) GROUP BY 1")
def comparison_setup(s, d):
    """Hold out a fifth, deal the rest into five stratified folds."""
    rows = split.stratified_split(labelled_orders(s, d), "o_orderkey", "y", 0.2).where("not is_val")
    return split.folds(rows, "o_orderkey", "y", 5, 7).groupBy("fold").agg(
        F.count("*").alias("n"), F.sum("y").alias("positives"), F.avg("o_totalprice").alias("mean_price")
    )


@query(f"""SELECT 'none' AS left_out, avg(z) AS mean, stddev_samp(z) AS std FROM (SELECT ln(1 + o_totalprice) AS z FROM orders WHERE o_orderkey % 5 <> 0)
UNION ALL SELECT 'log', avg(o_totalprice), stddev_samp(o_totalprice) FROM orders WHERE o_orderkey % 5 <> 0""")
def ablation_statistics(s, d):
    """What z-scores are learned with and without the logarithm."""
    spec, out = TableSpec(numeric=("o_totalprice",), log_numeric=("o_totalprice",)), []
    for name, log in (("none", True), ("log", False)):
        state = TabularPreprocessor(spec, log=log).fit(read(s, d, "orders"), F.expr("o_orderkey % 5 <> 0")).state
        out.append((name, state.means["o_totalprice"], state.stds["o_totalprice"]))
    return s.createDataFrame(out, "left_out string, mean double, std double")


def _auc(src: str) -> str:
    return f"""SELECT sum(pos * (below + neg / 2.0{_D})) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) AS auc FROM (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
FROM (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM ({src}) GROUP BY p))"""


@query(" UNION ALL ".join(f"SELECT CAST({g} AS BIGINT) AS grp, auc FROM ({_auc(f'SELECT * FROM ({SCORES_SQL}) WHERE grp = {g}')})" for g in range(4)))
def subgroup_auc(s, d):
    return metrics.auc(scores(s, d), ["grp"])


@query(f"SELECT id, y, p FROM ({SCORES_SQL}) WHERE y = 1 OR md5('42|' || CAST(id AS VARCHAR)) < '40000000000000000000000000000000'")
def rebalanced_sample(s, d):
    """All positives and the quarter of the negatives that comes first in hash order."""
    return scores(s, d).where((F.col("y") == 1) | (split.hash_order(42, "id") < "4" + "0" * 31)).select("id", "y", "p")


def _export_sql() -> str:
    w = lambda i, j: ((7 * i + 3 * j + 1) % 11 - 5) / 10.0
    units = [f"greatest(0.0{_D}, {w(0, j)}{_D} + " + " + ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * {w(i, j)}{_D}" for i in range(64)) + ")" for j in range(3)]
    z = f"round({w(0, 0)}{_D} + " + " + ".join(f"{u} * {w(j, 0)}{_D}" for j, u in enumerate(units)) + ", 9)"
    return f"SELECT vec_id, {z} AS expressions, {z} AS batches FROM embeddings"


@query(_export_sql())
def export_parity(s, d):
    """A network scored as expressions and, from its exported JSON, in batches."""
    net = layers.Mlp([layers.Dense(layers.fixed_weights(64, 3), layers.fixed_weights(1, 3)[0]), layers.Dense(layers.fixed_weights(3, 1), layers.fixed_weights(1, 1)[0], relu=False)])
    e = read(s, d, "embeddings")
    a = e.select("vec_id", net.columns([F.col("embedding")[i].cast("double") for i in range(64)])[0].alias("a"))
    b = score.score_arrays(e, "vec_id", "embedding", layers.Mlp.from_json(net.to_json()).forward)
    return a.join(b, "vec_id").select("vec_id", F.round("a", 9).alias("expressions"), F.round(F.col("z")[0], 9).alias("batches"))


def _order_pipeline(s, d):
    rows = split.stratified_split(labelled_orders(s, d), "o_orderkey", "y", 0.2)
    fitted, prior = encode.target_mean(rows.where("not is_val"), "o_orderpriority", "y", 10.0)
    coded = encode.apply(rows, fitted, "o_orderpriority", {"te": prior}).withColumn("price", F.col("o_totalprice") / 1e5)
    steps = Pipeline(stages=[VectorAssembler(inputCols=["te", "price"], outputCol="x"), LogisticRegression(featuresCol="x", labelCol="y", maxIter=20)])
    return coded.withColumn("y", F.col("y").cast("double")).withColumnRenamed("o_orderkey", "id"), steps


@query()
def encoder_logistic_pipeline(s, d):
    rows, steps = _order_pipeline(s, d)
    return metrics.auc(models.fit(steps, rows.where("not is_val")).scored(rows.where("is_val")))


@query("SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_different FROM orders")
def saved_model_parity(s, d):
    """A pipeline written, loaded again, and its scores on all rows compared."""
    rows, steps = _order_pipeline(s, d)
    model = steps.fit(rows.where("not is_val"))
    path = files.scratch_path(s, "model")
    model.write().overwrite().save(path)
    a, b = models.Fit(model).scored(rows), models.Fit(PipelineModel.load(path)).scored(rows).withColumnRenamed("p", "q").drop("y")
    return a.join(b, "id").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("p") - F.col("q")) > 1e-12).alias("n_different"))


@query()
def refit_on_all(s, d):
    """Coefficients after the last fit, on training and held-out rows together."""
    rows, steps = _order_pipeline(s, d)
    lr = steps.fit(rows).stages[-1]
    return s.createDataFrame([(i, float(c)) for i, c in enumerate([lr.intercept, *lr.coefficients])], "place long, coefficient double")


@query()
def boosting_baseline(s, d):
    rows, steps = _order_pipeline(s, d)
    gbt = Pipeline(stages=[steps.getStages()[0], GBTClassifier(featuresCol="x", labelCol="y", maxIter=3, maxDepth=3, seed=1)])
    return metrics.auc(models.fit(gbt, rows.where("not is_val")).scored(rows.where("is_val")))


@query(f"SELECT id, p FROM ({SCORES_SQL}) WHERE abs(p - 0.25{_D}) < 0.05{_D}")
def low_confidence_log(s, d):
    """The scored requests that a person should look at."""
    return scoring.score_stream(scores(s, d), F.col("p"), 0.25, "id").where("fragile").select("id", "p")
