"""Running aggregates over a key that may not fit one task.

A window partitioned by the key alone sends the whole key to one task. Here each
key is cut into blocks of its (numeric) position, the running value is computed
inside each block, and what precedes a block is found from one row per block. The
rows themselves are only ever partitioned by (key, block).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCK = 4096
_B = "__block"


def _key_list(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _join_carry(left: DataFrame, right: DataFrame, keys: list[str], null_keys: bool) -> DataFrame:
    """Left join on the block. Plain equality lets the join keep the partitioning of
    the window below it; null-safe equality costs a shuffle, so it is opt-in."""
    if not null_keys:
        return left.join(right, keys, "left")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    return left.join(renamed, cond, "left").drop(*[f"__r_{k}" for k in keys])


def running(
    df: DataFrame,
    keys: str | Sequence[str],
    order: Sequence[Column | str],
    block: Column,
    aggs: Mapping[str, tuple[str, Column]],
    *,
    inclusive: bool = True,
    null_keys: bool = False,
) -> DataFrame:
    """Add running aggregates to ``df``.

    ``order`` is a total order inside a key and ``block`` must be non-decreasing
    along it. Each entry of ``aggs`` is ``name -> (kind, column)`` with kind one of
    ``sum``, ``max``, ``min`` (a ``max`` over ``struct(position, value)`` gives the
    last value so far). Keys are taken as not null unless ``null_keys``.
    """
    keys = _key_list(keys)
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    kinds = {"sum": F.sum, "max": F.max, "min": F.min}
    base = df.withColumn(_B, block)
    for name, (_, col) in aggs.items():
        base = base.withColumn(f"__v_{name}", col)

    inside = W.partitionBy(*keys, _B).orderBy(*order).rowsBetween(
        W.unboundedPreceding, 0 if inclusive else -1)
    before = W.partitionBy(*keys).orderBy(_B).rowsBetween(W.unboundedPreceding, -1)

    totals = base.groupBy(*keys, _B).agg(
        *[kinds[kind](f"__v_{name}").alias(f"__t_{name}") for name, (kind, _) in aggs.items()])
    carried = totals.select(
        *keys, _B,
        *[kinds[kind](f"__t_{name}").over(before).alias(f"__c_{name}")
          for name, (kind, _) in aggs.items()])
    local = base
    for name, (kind, _) in aggs.items():
        local = local.withColumn(f"__l_{name}", kinds[kind](f"__v_{name}").over(inside))
    out = _join_carry(local, carried, [*keys, _B], null_keys)
    drop = [_B]
    for name, (kind, _) in aggs.items():
        here, carry = F.col(f"__l_{name}"), F.col(f"__c_{name}")
        if kind == "sum":
            value = F.coalesce(here, F.lit(0)) + F.coalesce(carry, F.lit(0))
        elif kind == "max":
            value = F.greatest(here, carry)
        else:
            value = F.least(here, carry)
        out = out.withColumn(name, value)
        drop += [f"__v_{name}", f"__l_{name}", f"__c_{name}"]
    return out.drop(*drop)


def by_position(pos: str | Column, width: int = BLOCK) -> Column:
    """Block number of a numeric position."""
    pos = F.col(pos) if isinstance(pos, str) else pos
    return F.floor(pos / F.lit(width)).cast("bigint")


def number_rows(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column | str],
                block: Column, name: str) -> DataFrame:
    """1-based row number inside a key, computed block-wise."""
    return running(df, keys, order, block, {name: ("sum", F.lit(1).cast("bigint"))})


def previous_row(df: DataFrame, keys: str | Sequence[str], order: Sequence[str],
                 block: Column, value: Column, name: str) -> DataFrame:
    """``lag(value)`` inside a key, computed block-wise; null on the first row.

    ``value`` must be a struct so that a missing row and a null field differ.
    """
    stamped = F.struct(*[F.col(o) for o in order], value.alias("__prev"))
    out = running(df, keys, order, block, {"__p": ("max", stamped)}, inclusive=False)
    return out.withColumn(name, F.col("__p.__prev")).drop("__p")
