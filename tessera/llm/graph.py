"""Connected components of an edge table, without bringing edges or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all ends of the edges a, b (longs, any order, repeats allowed).

    Labels start as the smallest neighbour; each round takes the smallest label around and then the label's own label,
    so chains shorten by powers. Every round is a table in the shared folder.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v")
    both = stored(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "cc-edges")
    labels = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "cc-labels")
    while True:
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels["node"] == near["u"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = moved.select(F.col("node").alias("at"), F.col("label").alias("up"))
        jumped = moved.join(up, moved["label"] == up["at"], "left").select("node", "was", F.coalesce(F.least("label", "up"), F.col("label")).alias("label"))
        jumped = stored(jumped, "cc-labels")
        labels = jumped.select("node", "label")
        if jumped.where("label <> was").limit(1).count() == 0:
            return labels.withColumnRenamed("label", "component")
