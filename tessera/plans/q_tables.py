"""Queries on cleaning, profiles and splits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import clean, profile, split
from tessera.plans.frames import HOLED_SQL, ORDERS_SQL, SCORES_SQL, holed_customers, labelled_orders, read, scores

QUERIES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


_MISSING_LIST = "c_acctbal,c_nationkey,c_mktsegment,deck"


@query(f"WITH h AS ({HOLED_SQL}) SELECT c_custkey, c_acctbal, c_nationkey, c_mktsegment FROM h")
def drop_sparse_columns(s: SparkSession, d: str) -> DataFrame:
    return clean.drop_sparse_columns(holed_customers(s, d), 0.7)


@query(f"WITH h AS ({HOLED_SQL}) SELECT c_custkey, c_acctbal FROM h WHERE c_mktsegment IS NOT NULL")
def drop_null_subset(s, d):
    return clean.drop_null(holed_customers(s, d), ["c_mktsegment"]).select("c_custkey", "c_acctbal")


@query(f"WITH h AS ({HOLED_SQL}) SELECT c_custkey, c_acctbal, c_mktsegment FROM h WHERE c_acctbal IS NOT NULL AND NOT isnan(c_acctbal) AND c_mktsegment IS NOT NULL AND c_nationkey IS NOT NULL")
def drop_any_null_nan(s, d):
    return clean.drop_any_null_or_nan(holed_customers(s, d).drop("deck")).select("c_custkey", "c_acctbal", "c_mktsegment")


@query(f"WITH h AS ({HOLED_SQL}) SELECT c_custkey, coalesce(c_acctbal, (SELECT median(c_acctbal) FROM h)) AS c_acctbal FROM h")
def fill_median(s, d):
    return clean.fill_median(holed_customers(s, d), ["c_acctbal"]).select("c_custkey", "c_acctbal")


@query(f"WITH h AS ({HOLED_SQL}), m AS (SELECT c_mktsegment AS v FROM h WHERE c_mktsegment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) SELECT c_custkey, coalesce(c_mktsegment, (SELECT v FROM m)) AS c_mktsegment FROM h")
def fill_mode(s, d):
    return clean.fill_mode(holed_customers(s, d), "c_mktsegment").select("c_custkey", "c_mktsegment")


@query(f"WITH h AS ({HOLED_SQL}) SELECT c_custkey, coalesce(c_mktsegment, 'Unknown') AS segment FROM h")
def null_token_category(s, d):
    return holed_customers(s, d).select("c_custkey", clean.with_token("c_mktsegment", "Unknown").alias("segment"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS priority FROM orders")
def marker_to_null(s, d):
    return read(s, d, "orders").select("o_orderkey", F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("priority"))


@query("SELECT DISTINCT event_type, user_id FROM events")
def dedupe_rows(s, d):
    return read(s, d, "events").select("event_type", "user_id").dropDuplicates()


@query("SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY text, lang")
def dedupe_keep_first(s, d):
    docs = read(s, d, "documents").select("doc_id", "text", "lang")
    return clean.keep_first(docs, ["text", "lang"], "doc_id").select("doc_id", "lang")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS bad FROM events")
def coerce_numeric(s, d):
    return read(s, d, "events").select(
        "event_id",
        clean.coerce_numeric(F.get_json_object("props", "$.k")).alias("k"),
        clean.coerce_numeric("event_type").alias("bad"),
    )


@query("SELECT o_orderkey, CAST(o_orderstatus = 'F' AS BIGINT) AS y FROM orders")
def binarize_text_label(s, d):
    dotted = read(s, d, "orders").select("o_orderkey", F.concat(F.lit(" "), "o_orderstatus", F.lit(".")).alias("t"))
    return dotted.select("o_orderkey", clean.binarize_text("t", "F").alias("y"))


@query("SELECT vec_id, CAST(label > 0 AS INTEGER) AS y FROM embeddings")
def binarize_ordinal_label(s, d):
    return read(s, d, "embeddings").select("vec_id", clean.binarize_above("label").alias("y"))


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, CAST(c_acctbal AS DOUBLE) AS c_acctbal, CAST(NULL AS VARCHAR) AS region, TRY_CAST(c_name AS DOUBLE) AS c_name FROM customer")
def reconcile_schema(s, d):
    schema = T.StructType.fromDDL("c_custkey long, c_acctbal double, region string, c_name double, secret string")
    return clean.reconcile(read(s, d, "customer"), schema, ["secret"])


@query("""SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 OR c_acctbal > 9000 THEN 'c_acctbal' END, CASE WHEN c_nationkey < 2 OR c_nationkey > 20 THEN 'c_nationkey' END) AS errors
FROM customer""")
def validate_contract(s, d):
    ranges = {"c_acctbal": (0, 9000), "c_nationkey": (2, 20)}
    return read(s, d, "customer").select("c_custkey", clean.contract_errors(ranges).alias("errors"))


@query("SELECT o_orderkey, o_orderdate, CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS BIGINT) AS idx FROM orders")
def row_index(s, d):
    return clean.row_index(read(s, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])


@query("SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_totalprice > 250000")
def select_rename_filter(s, d):
    return read(s, d, "orders").where("o_totalprice > 250000").select("o_orderkey", "o_totalprice").withColumnsRenamed({"o_orderkey": "id", "o_totalprice": "price"})


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sorted_head(s, d):
    return read(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("""SELECT f.doc_id, f.n_chars, l.quality FROM documents f JOIN labels l ON f.doc_id = l.doc_id""")
def attach_labels(s, d):
    return read(s, d, "documents").select("doc_id", "n_chars").join(read(s, d, "labels").select("doc_id", "quality"), "doc_id")


@query("""SELECT 'in' AS part, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'out', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def membership_split(s, d):
    inside, outside = split.by_membership(read(s, d, "documents"), read(s, d, "labels").select("doc_id"), "doc_id")
    return inside.agg(F.lit("in").alias("part"), F.count("*").alias("n")).unionByName(
        outside.agg(F.lit("out").alias("part"), F.count("*").alias("n"))
    )


@query("SELECT (SELECT count(*) FROM orders) AS n_rows, CAST(6 AS BIGINT) AS n_columns")
def shape(s, d):
    return profile.shape(read(s, d, "orders"))


@query(f"""WITH h AS ({HOLED_SQL}) SELECT * FROM (
{' UNION ALL '.join(f"SELECT '{c}' AS column_name, CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing, avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 AS pct_missing FROM h" for c in ('c_custkey', *_MISSING_LIST.split(',')))}) WHERE n_missing > 0""")
def null_profile(s, d):
    return profile.null_profile(holed_customers(s, d), ["c_custkey", *_MISSING_LIST.split(",")])


@query("SELECT CAST(sum(n - 1) AS BIGINT) AS n_duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)")
def duplicate_count(s, d):
    return profile.duplicate_rows(read(s, d, "documents"), ["text", "lang"])


def _describe_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count({c}) AS n, avg(CAST({c} AS DOUBLE)) AS mean, stddev_samp(CAST({c} AS DOUBLE)) AS std, min(CAST({c} AS DOUBLE)) AS min,
        quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1, median(CAST({c} AS DOUBLE)) AS median, quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3, max(CAST({c} AS DOUBLE)) AS max FROM {table}"""
        for c in columns
    )


@query(_describe_sql("part", ["p_size", "p_retailprice"]))
def describe_numeric(s, d):
    return profile.describe_numeric(read(s, d, "part"), ["p_size", "p_retailprice"])


@query("""WITH c AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS n_unique, (SELECT v FROM c ORDER BY n DESC, v LIMIT 1) AS top, max(n) AS freq FROM c""")
def describe_categorical(s, d):
    return profile.describe_category(read(s, d, "orders"), "o_orderpriority")


@query("SELECT o_orderstatus AS label, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM orders) AS pct FROM orders GROUP BY 1")
def class_balance(s, d):
    return profile.class_balance(read(s, d, "orders"), "o_orderstatus")


@query(f"SELECT o_orderpriority AS grp, avg(CAST(y AS DOUBLE)) AS rate, count(*) AS n FROM ({ORDERS_SQL}) GROUP BY 1")
def target_rate_by_group(s, d):
    return profile.target_rate(labelled_orders(s, d), "o_orderpriority", "y")


@query(f"SELECT p AS grp, avg(CAST(y AS DOUBLE)) AS rate, count(*) AS n FROM ({SCORES_SQL}) GROUP BY 1")
def target_rate_by_value(s, d):
    return profile.target_rate(scores(s, d), "p", "y").orderBy("grp")


@query(f"""WITH c AS (SELECT y AS label, CAST(least(floor((o_totalprice - 0.0::DOUBLE) / 20000.0::DOUBLE), 24) AS BIGINT) AS bin, count(*) AS n FROM ({ORDERS_SQL}) WHERE o_totalprice BETWEEN 0 AND 500000 GROUP BY 1, 2)
SELECT label, bin, n, n / (sum(n) OVER (PARTITION BY label) * 20000.0::DOUBLE) AS density FROM c""")
def class_histogram(s, d):
    return profile.class_histogram(labelled_orders(s, d), "o_totalprice", "y", 0.0, 500000.0, 25)


@query("SELECT p_brand AS value, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS BIGINT) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def vocabulary(s, d):
    return profile.vocabulary(read(s, d, "part"), "p_brand")


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS n_distinct FROM part" for c in ("p_brand", "p_type", "p_size")))
def cardinality(s, d):
    return profile.cardinality(read(s, d, "part"), ["p_brand", "p_type", "p_size"])


@query(f"""SELECT avg(CAST(y AS DOUBLE)) AS prevalence, greatest(avg(CAST(y AS DOUBLE)), 1 - avg(CAST(y AS DOUBLE))) AS majority_accuracy,
CAST(count(y) - sum(y) AS DOUBLE) / greatest(sum(y), 1) AS positive_weight FROM ({ORDERS_SQL})""")
def prevalence_and_weight(s, d):
    return profile.prevalence(labelled_orders(s, d), "y")


@query("""SELECT 'p_size' AS column_name, avg(CAST(p_size AS DOUBLE)) AS mean, stddev_samp(CAST(p_size AS DOUBLE)) AS std FROM part
UNION ALL SELECT 'flat', 3.0::DOUBLE, 1.0::DOUBLE""")
def scale_statistics(s, d):
    return profile.center_and_scale(read(s, d, "part").withColumn("flat", F.lit(3.0)), ["p_size", "flat"])


_HASH = "md5('42|' || CAST({k} AS VARCHAR))"
_VAL = f"""SELECT *, row_number() OVER (PARTITION BY y ORDER BY {_HASH.format(k='o_orderkey')}, o_orderkey) <= floor(count(*) OVER (PARTITION BY y) * 0.2::DOUBLE) AS is_val FROM ({ORDERS_SQL})"""


@query(f"SELECT o_orderkey, y, is_val FROM ({_VAL})")
def stratified_split(s, d):
    return split.stratified_split(labelled_orders(s, d), "o_orderkey", "y", 0.2).select("o_orderkey", "y", "is_val")


@query(f"SELECT event_id, row_number() OVER (ORDER BY {_HASH.format(k='event_id')}, event_id) <= floor(count(*) OVER () * 0.1::DOUBLE) AS is_val FROM events")
def random_split(s, d):
    return split.plain_split(read(s, d, "events"), "event_id", 0.1).select("event_id", "is_val")


@query(f"""WITH a AS (SELECT o_orderkey, y, row_number() OVER (PARTITION BY y ORDER BY {_HASH.format(k='o_orderkey')}, o_orderkey) <= floor(count(*) OVER (PARTITION BY y) * 0.2::DOUBLE) AS t FROM ({ORDERS_SQL})),
b AS (SELECT o_orderkey, row_number() OVER (PARTITION BY y ORDER BY md5('43|' || CAST(o_orderkey AS VARCHAR)), o_orderkey) <= floor(count(*) OVER (PARTITION BY y) * 0.25::DOUBLE) AS v FROM a WHERE NOT t)
SELECT a.o_orderkey, a.y, CASE WHEN t THEN 'test' WHEN v THEN 'val' ELSE 'train' END AS split FROM a LEFT JOIN b ON a.o_orderkey = b.o_orderkey""")
def three_way_split(s, d):
    return split.three_way_split(labelled_orders(s, d), "o_orderkey", "y").select("o_orderkey", "y", "split")


@query(f"SELECT event_id, value FROM events ORDER BY {_HASH.format(k='event_id')}, event_id LIMIT 500")
def fixed_sample(s, d):
    return split.fixed_sample(read(s, d, "events"), "event_id", 500).select("event_id", "value")


@query(f"SELECT o_orderkey, y, CAST((row_number() OVER (PARTITION BY y ORDER BY {_HASH.format(k='o_orderkey')}, o_orderkey) - 1) % 5 AS BIGINT) AS fold FROM ({ORDERS_SQL})")
def stratified_folds(s, d):
    return split.folds(labelled_orders(s, d), "o_orderkey", "y").select("o_orderkey", "y", "fold")
