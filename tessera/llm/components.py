"""Connected components of a table of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``node``, ``label``: the smallest node that is reachable over ``links`` (a, b).

    Each round takes the smallest label among a node's neighbours and then the
    label of its label, so chains halve and the rounds are as many as the logarithm of the longest
    chain; every round is one table in the shared folder, which says of each node whether its label changed.
    Groups are combined before they are shuffled, so a node with very many
    links costs one row per task.
    """
    edges = materialize(
        links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        .where("u <> v")
        .distinct(),
        "edges",
    )
    labels = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label"))
    changed, spent = True, None
    while changed:
        near = edges.join(labels, F.col("u") == F.col("node")).groupBy("v").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("v"), "left").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        far = step.select(F.col("node").alias("via"), F.col("label").alias("far"))
        jumped = step.join(far, F.col("label") == F.col("via"), "left").select("node", "old", F.least("label", "far").alias("label"))
        # a column and not an Observation, which would stay in the session, where models that hold the session can't be sent to tasks any more
        labels = materialize(jumped.select("node", "label", (F.col("label") != F.col("old")).alias("moved")), "labels")
        changed = bool(labels.where("moved").head(1))
        if spent is not None:
            discard(spent)
        spent = labels
    discard(edges)
    kept = labels.select("node", "label")
    kept.stored_at = labels.stored_at
    return kept
