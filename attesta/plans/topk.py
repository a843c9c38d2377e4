"""Top-k per key without gathering a key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int,
          rank: str = "rank", salt_on: Sequence[str] = (), salts: int = 32) -> DataFrame:
    """Rows ranked 1..k per key.

    The rank filter becomes a per-task limit before the shuffle, so a task sends at
    most k rows per key. With ``salt_on`` a first round also ranks inside
    (key, hash of those columns), which bounds the last task to ``salts * k`` rows.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    if salt_on:
        df = df.withColumn("__salt", F.pmod(F.xxhash64(*salt_on), F.lit(salts)))
        part = W.partitionBy(*keys, "__salt").orderBy(*order)
        df = (df.withColumn("__rn", F.row_number().over(part))
              .filter(F.col("__rn") <= k).drop("__rn", "__salt"))
    full = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(full)).filter(F.col(rank) <= k)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first whole row per key in ``order`` (ascending), as one map-side
    combined aggregate: no sort, no window, one row per key and task shuffled."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)
