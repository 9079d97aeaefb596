"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a
DataFrame; ``run`` writes each stage's rows as Parquet in the shared folder and
reads them back for the next.  Stages but the last return the columns of ``documents``.

Cases: a null or empty text fails the quality rules, so it goes in the first stage.  Rows with null or equal ids are
documents of their own: the near-duplicate stage numbers the rows, keeps of each group the row with the smallest id (null
ids last), and so loses none but copies; the other stages judge row by row.  An
empty table gives an empty result; columns beyond those of ``documents`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, near_dedup, packing, pii, quality_rules
from tessera.llm.common import materialize, spread, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep."""
    labels = table(spark, sf_dir, "labels")
    features = materialize(quality_rules.text_features(docs.select(*COLUMNS), keep=("lang", "source", "n_chars", "text")), "features")
    verdict = quality_rules.learn(features, labels)
    return features.where(~quality_rules.base_failed() & ~verdict.column()).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, five-word shingles at 0.8 or more: the one with the smallest id."""
    # rows are known by a number, as ids may be null or repeat; written, so that it stays the same
    rows = materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows", compression="zstd")
    groups = near_dedup.near_duplicates(rows, "row", shingle=5, num=4, den=5).select(F.col("doc_id").alias("row"), "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    first = rows.select("row", "doc_id").join(groups, "row").groupBy("component_id").agg(F.min(place).alias("first"))
    return rows.join(first.select("first.row"), "row", "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage close to a benchmark item."""
    # a row is known by its id and text, as ids may be null or repeat
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("row"))
    found = decontaminate.contaminated(rows, table(spark, sf_dir, "benchmark"), "row").select(F.col("doc_id").alias("row")).distinct()
    return rows.join(found, "row", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    found = pii.detect(docs.select(*COLUMNS), "doc_id", "text", "text", "lang", "source", "n_chars")
    text = pii.redacted(F.col("text"), F.col("spans"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("packing", pack),
]

#: Learned rules, signatures and tokenizers have no SQL form; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
