"""Connected components of a graph whose edges fit no single machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trustweave.sources.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b), where label is the least node that can be reached.

    Labels go to neighbours, then each label is replaced by its own label, until nothing changes: the rounds grow with
    the logarithm of the longest shortest path, mostly. Each round is a stored table. Edges between equal nodes and
    repeated edges do no harm; an empty table gives an empty result.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")))
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        near = labels.join(heard, "node").select("node", "label", F.least("label", "low").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        step = stored(near.join(jump, "new").select("node", F.col("label").alias("old"), F.least("new", "far").alias("label")))
        labels = step.select("node", "label")
        if step.where("label <> old").limit(1).count() == 0:
            return labels
