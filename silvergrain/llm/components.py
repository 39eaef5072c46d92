"""Connected components of a graph given as a table of edges."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from silvergrain.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of the edges ``u, v``: the label is the smallest node that can be reached.

    Each round takes the smallest label among neighbours and then the label of
    that label, so stars settle in two rounds and long chains in logarithmically
    many. Only small rows move; each round is a written table.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).where("u <> v").distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("u"), F.min("v")).alias("label")))
    while True:
        near = (both.join(labels, both["v"] == labels["node"]).groupBy(F.col("u").alias("node"))
                .agg(F.min("label").alias("near")))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        lower = cut_lineage(lower)
        of_label = lower.select(F.col("node").alias("label"), F.col("label").alias("next"))
        stepped = cut_lineage(lower.join(of_label, "label").select("node", "was", F.col("next").alias("label")))
        labels = stepped.select("node", "label")
        if stepped.where("label <> was").isEmpty():
            return labels
