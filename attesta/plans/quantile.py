"""Exact medians without holding a group's values in one buffer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.plans.scan import running


def exact_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median",
                 bucket: float = 1.0) -> DataFrame:
    """(keys, median): mean of the two middle values for an even count.

    Equal values are counted map-side, then ranked over buckets of ``bucket`` units.
    """
    keys = list(keys)
    counted = (df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("__v"))
               .agg(F.count("*").alias("__n")))
    ranked = running(counted, keys, ["__v"], F.floor(F.col("__v") / bucket).cast("bigint"),
                     {"__upto": ("sum", F.col("__n"))})
    total = counted.groupBy(*keys).agg(F.sum("__n").alias("__all"))
    placed = ranked.join(total, keys)
    before = F.col("__upto") - F.col("__n")

    def at(rank):
        return F.max(F.when((before < rank) & (F.col("__upto") >= rank), F.col("__v")))

    low, high = F.floor((F.col("__all") + 1) / 2), F.floor(F.col("__all") / 2) + 1
    return placed.groupBy(*keys).agg(((at(low) + at(high)) / 2).alias(name))
