"""Pointer jumping: walks of length n in log2(n) joins.

``links`` is one row per node with the node it points to. Doubling the pointers
each round replaces row-at-a-time recursion, so a chain holding a third of all rows
costs 30 rounds, not a billion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.plans.lineage import cut


def _double(jump: DataFrame) -> DataFrame:
    """Pointers twice as long; nodes whose walk ends earlier drop out."""
    far = jump.select(F.col("node").alias("nxt"), F.col("nxt").alias("far"))
    return jump.join(far, "nxt").select("node", F.col("far").alias("nxt"))


def follow(starts: DataFrame, links: DataFrame) -> DataFrame:
    """Every node on the walk from each start: (origin, node, hops)."""
    jump = cut(links.filter(F.col("nxt").isNotNull()).select("node", "nxt"))
    reached = starts.select("origin", F.col("origin").alias("node"), F.lit(0).cast("bigint").alias("hops"))
    step = 1
    while not jump.isEmpty():
        ahead = (reached.join(jump, "node")
                 .select("origin", F.col("nxt").alias("node"), (F.col("hops") + step).alias("hops")))
        reached = cut(reached.unionByName(ahead))
        jump = cut(_double(jump))
        step *= 2
    return reached


def ends(links: DataFrame) -> DataFrame:
    """The last node on the walk from every node, and its distance: (node, end, hops)."""
    state = cut(links.select("node", F.coalesce("nxt", "node").alias("end"),
                             F.col("nxt").isNotNull().cast("bigint").alias("hops")))
    while True:
        far = state.select(F.col("node").alias("end"), F.col("end").alias("far"),
                           F.col("hops").alias("more"))
        new = cut(state.join(far, "end", "left").select(
            "node", F.coalesce("far", "end").alias("end"),
            (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"),
            (F.coalesce("more", F.lit(0)) > 0).alias("moved")))
        state = new.drop("moved")
        if new.filter("moved").isEmpty():
            return state


def subtree_sizes(links: DataFrame) -> DataFrame:
    """Nodes strictly below every node: (node, below).

    Round i adds, to each node, the sizes found so far of the nodes exactly 2**i
    below it; the sums combine map-side, so a node with many children is no hot spot.
    """
    size = links.select("node", F.lit(1).cast("bigint").alias("size"))
    jump = cut(links.filter(F.col("nxt").isNotNull()).select("node", "nxt"))
    while not jump.isEmpty():
        gained = (size.join(jump, "node").groupBy("nxt").agg(F.sum("size").alias("more"))
                  .withColumnRenamed("nxt", "node"))
        size = cut(size.join(gained, "node", "left")
                   .select("node", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size")))
        jump = cut(_double(jump))
    return size.select("node", (F.col("size") - 1).alias("below"))


def reachable(starts: DataFrame, links: DataFrame) -> DataFrame:
    """The set of nodes on the walks from ``starts`` (column ``node``)."""
    jump = cut(links.filter(F.col("nxt").isNotNull()).select("node", "nxt"))
    reached = starts.select("node")
    while not jump.isEmpty():
        ahead = reached.join(jump, "node").select(F.col("nxt").alias("node"))
        reached = cut(reached.union(ahead).distinct())
        jump = cut(_double(jump))
    return reached
