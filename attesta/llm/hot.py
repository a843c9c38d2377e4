"""Joining rows to per-group facts when a few groups hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADS, SALTS = 1000, 64


def join_groups(rows: DataFrame, key: str, groups: DataFrame, weight: str, spread: Column) -> DataFrame:
    """Left join of ``rows`` with ``groups``, a stored table with one row per string
    ``key`` and in ``weight`` the number of rows that have it.

    A group above one thousandth of all rows is a head. There are at most a thousand of
    them whatever the data, so their keys are broadcast; their rows are spread over
    ``SALTS`` keys by ``spread`` and their facts repeated for each. No key then has more
    than a thousandth of all rows, or a 64th of the largest group.
    """
    total = groups.agg(F.sum(weight)).first()[0] or 0
    head = F.col(weight) * HEADS > total
    heads = groups.where(head).select(F.col(key).alias("__head"))
    facts = [c for c in groups.columns if c != key]
    dealt = groups.select(
        F.struct(*facts).alias("__facts"),
        F.explode(F.when(head, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("__salt"),
        F.col(key).alias("__of")).select("__facts", F.concat_ws("#", "__of", "__salt").alias("__to"))
    salt = F.when(F.col("__head").isNull(), 0).otherwise(F.pmod(spread, F.lit(SALTS)).cast("int"))
    met = (rows.join(F.broadcast(heads), rows[key] == heads["__head"], "left")
           .withColumn("__at", F.concat_ws("#", F.col(key), salt)).drop("__head"))
    met = met.join(dealt, met["__at"] == dealt["__to"], "left").drop("__at", "__to")
    return met.withColumns({c: F.col("__facts")[c] for c in facts}).drop("__facts")
