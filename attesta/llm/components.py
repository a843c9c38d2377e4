"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.scratch import stored


def components(edges: DataFrame) -> DataFrame:
    """The smallest node reachable from each node: (node, label), for edges (a, b).

    Each round takes the smallest label among a node and its neighbours and then the label
    of that label, so paths shrink by more than half; rounds end when nothing changes and
    are stored tables. Smallest labels are combined before every shuffle; a node with very
    many edges is left to the splitting of skewed joins.
    """
    # both directions of one row: edges worked out twice need not be the same edges
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(edges.where("a <> b").select(F.inline(ways)).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(
        F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy("a").agg(F.min("label").alias("near")))
        step = labels.join(near, labels["node"] == near["a"]).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = stored(step.join(jump, step["label"] == jump["via"]).select(
            "node", "old", F.least("label", "far").alias("label")), "labels")
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels
