"""The frames that many queries start from, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Customers with holes: null balances, NaN balances, null segments, and a mostly empty column.
HOLED_SQL = """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS c_nationkey,
CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
CASE WHEN c_custkey % 10 < 8 THEN NULL ELSE 'A' END AS deck FROM customer"""


def holed_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(k % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(k % 11 != 0, F.col("c_nationkey")).alias("c_nationkey"),
        F.when(k % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(k % 10 >= 8, F.lit("A")).alias("deck"),
    )


ORDERS_SQL = "SELECT *, CAST(o_orderstatus = 'F' AS BIGINT) AS y FROM orders"


def labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").withColumn("y", (F.col("o_orderstatus") == "F").cast("long"))


#: Scores with ties: id, label, probability, subgroup.
SCORES_SQL = """SELECT event_id AS id, CAST(event_type = 'purchase' AS BIGINT) AS y, floor(least(value, 200.0::DOUBLE)) / 200.0::DOUBLE AS p,
CAST(user_id % 4 AS BIGINT) AS grp FROM events"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.col("event_type") == "purchase").cast("long").alias("y"),
        (F.floor(F.least("value", F.lit(200.0))) / F.lit(200.0)).alias("p"),
        (F.col("user_id") % 4).cast("long").alias("grp"),
    )


#: Ten logits per vector: its first ten coordinates, times 10.
LOGITS_SQL = "SELECT vec_id AS id, CAST(label AS BIGINT) AS y, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE) * 10.0::DOUBLE) AS z FROM embeddings"


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("long").alias("y"),
        F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 10.0).alias("z"),
    )
