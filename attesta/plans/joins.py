"""Joining a result-sized table to a corpus-sized one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.plans.lineage import cut

SMALL_ROWS = 200_000


def small_side(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """Materialise a narrow table and, if it proves small, have joins broadcast it.

    Search hits or citations are few next to the chunks and spans they point into, but
    the planner only sees where they came from. Counting the stored rows settles it:
    up to ``rows`` the large side is scanned in place, beyond that both sides shuffle
    as usual.
    """
    stored = cut(df)
    if stored.limit(rows + 1).count() <= rows:
        return F.broadcast(stored)
    return stored
