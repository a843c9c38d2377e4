"""Totals over the subtrees of a forest by parallel tree contraction.

Rake rounds remove all leaves and add their totals to their parents. Compress rounds splice
nodes with one child out of their chains, an independent third of them at a time. Chains and
bushes shrink by a constant share per round, so a chain of n nodes takes some 2.5 ln n rounds
of joins, not n. The rounds are then undone in reverse, which gives every node its total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.scratch import stored


def _rake(state: DataFrame, values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The nodes left, and the leaves taken off with their totals. What leaves give their
    parent is summed before the shuffle, so a parent of very many leaves is no hot key."""
    leaves = state.where("kids = 0 AND parent IS NOT NULL")
    gifts = leaves.groupBy(F.col("parent").alias("__to")).agg(
        F.count(F.lit(1)).alias("__lost"), F.bit_xor("id").alias("__xor"),
        *[F.sum(F.col(v) + F.col(f"more_{v}")).alias(f"__{v}") for v in values])
    left = state.where("kids > 0 OR parent IS NULL").join(gifts, F.col("id") == F.col("__to"), "left")
    none = F.lit(0).cast("long")
    left = left.select(
        "id", "parent", (F.col("kids") - F.coalesce("__lost", none)).alias("kids"),
        F.col("kid").bitwiseXOR(F.coalesce("__xor", none)).alias("kid"),
        *[(F.col(v) + F.coalesce(F.col(f"__{v}"), F.lit(0))).alias(v) for v in values], *[f"more_{v}" for v in values])
    return stored(left, "raked"), leaves.select("id", *values)


def _lot(node: Column | str, turn: int) -> Column:
    return F.xxhash64(F.lit(turn), node)


def _compress(state: DataFrame, values: Sequence[str], turn: int) -> tuple[DataFrame, DataFrame]:
    """The nodes left, and the nodes spliced out with their child and what they have more
    than it. A node with one child is taken if its lot is above those of its child and its
    parent, so no two neighbours are. Every join is on unique ids."""
    out = ((F.col("kids") == 1) & F.col("parent").isNotNull()
           & (_lot("id", turn) > _lot("kid", turn)) & (_lot("id", turn) > _lot("parent", turn)))
    taken = state.where(out)
    none = F.lit(None).cast("long")
    down = taken.select(F.col("kid").alias("__to"), F.col("parent").alias("__parent"), F.col("id").alias("__over"),
                        F.lit(0).cast("long").alias("__xor"),
                        *[F.col(v).alias(f"__{v}") for v in values], *[F.col(f"more_{v}").alias(f"__m_{v}") for v in values])
    up = taken.select(F.col("parent").alias("__to"), none.alias("__parent"), none.alias("__over"),
                      F.col("id").bitwiseXOR(F.col("kid")).alias("__xor"),
                      *[none.alias(f"__{v}") for v in values], *[none.alias(f"__m_{v}") for v in values])
    news = down.unionByName(up).groupBy("__to").agg(
        F.max("__parent").alias("__parent"), F.max("__over").alias("__over"), F.bit_xor("__xor").alias("__xor"),
        *[F.max(f"__{v}").alias(f"__{v}") for v in values], *[F.max(f"__m_{v}").alias(f"__m_{v}") for v in values])
    met = state.where(~out).join(news, F.col("id") == F.col("__to"), "left")
    moved = stored(met.select(
        "id", F.coalesce("__parent", "parent").alias("parent"), "kids",
        F.col("kid").bitwiseXOR(F.coalesce("__xor", F.lit(0).cast("long"))).alias("kid"), *values,
        *[(F.col(f"more_{v}") + F.coalesce(F.col(f"__{v}") + F.col(f"__m_{v}"), F.lit(0))).alias(f"more_{v}") for v in values],
        "__over", *[(F.col(f"more_{v}") + F.col(f"__{v}")).alias(f"__plus_{v}") for v in values]), "compressed")
    spliced = moved.where("__over IS NOT NULL").select(
        F.col("__over").alias("id"), F.col("id").alias("child"), *[F.col(f"__plus_{v}").alias(f"plus_{v}") for v in values])
    return moved.drop("__over", *[f"__plus_{v}" for v in values]), spliced


def subtree_totals(nodes: DataFrame, values: Sequence[str], id_col: str = "id", parent_col: str = "parent") -> DataFrame:
    """(id, *values): each long value summed over the node and all below it.

    Ids are longs, unique and not null; a null parent marks a root, and every other parent is
    a node. Null values count as 0; other columns are not read; an empty table gives no rows.
    Nodes on a cycle make the rounds stop with an error.
    """
    forest = nodes.select(F.col(id_col).cast("long").alias("id"), F.col(parent_col).cast("long").alias("parent"),
                          *[F.coalesce(F.col(v).cast("long"), F.lit(0)).alias(v) for v in values])
    # a node with one child knows it: ids of children are kept as their exclusive or
    kids = forest.where("parent IS NOT NULL").groupBy(F.col("parent").alias("__of")).agg(
        F.count(F.lit(1)).alias("kids"), F.bit_xor("id").alias("kid"))
    none = F.lit(0).cast("long")
    state = stored(forest.join(kids, F.col("id") == F.col("__of"), "left").select(
        "id", "parent", F.coalesce("kids", none).alias("kids"), F.coalesce("kid", none).alias("kid"),
        *values, *[none.alias(f"more_{v}") for v in values]), "forest")

    undo: list[tuple[str, DataFrame]] = []
    turn = 0
    while True:
        below, unary, leaves = state.where("parent IS NOT NULL").agg(
            F.count(F.lit(1)), F.count_if(F.col("kids") == 1), F.count_if(F.col("kids") == 0)).first()
        if not below:
            break
        if not leaves:
            raise ValueError("some nodes are their own ancestors")
        state, gone = _rake(state, values)
        undo.append(("rake", gone))
        if unary:
            state, gone = _compress(state, values, turn)
            undo.append(("compress", gone))
        turn += 1

    totals = state.select("id", *values)
    for kind, gone in reversed(undo):
        if kind == "compress":
            known = totals.select(F.col("id").alias("child"), *[F.col(v).alias(f"under_{v}") for v in values])
            gone = gone.join(known, "child").select("id", *[(F.col(f"under_{v}") + F.col(f"plus_{v}")).alias(v) for v in values])
            totals = stored(totals.unionByName(gone), "expanded")
        else:
            totals = totals.unionByName(gone)
    return totals
