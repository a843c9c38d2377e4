"""Every row against every row of a second table, by blocks.

For comparisons that no key narrows down (vectors by cosine). The second table is dealt
into groups of bounded size and the rows into parts; each cell of the grid (part, group)
is one stretch of a sorted partition, in which the group is held and the rows stream past
it. Both sides travel by shuffle alone: neither reaches the driver, no task holds more than
one group, and no pairs leave a task but those that the kernel returns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GROUP_ROWS = 1024


class Cell(Protocol):
    """A group that rows stream past."""

    def meet(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]: ...

    def close(self) -> Iterator[pa.RecordBatch]: ...


def groups_of(n: int, group: int = GROUP_ROWS) -> int:
    """How many groups ``n`` rows are dealt into by hash, so that none exceeds ``group``
    by more than chance."""
    return 1 if n <= group else -(-2 * n // group)


def meet(rows: DataFrame, others: DataFrame, kernel: Callable[[pa.Table], Cell], schema: str, *,
         row_key: str, other_key: str, groups: int, cells: int | None = None) -> DataFrame:
    """What ``kernel`` returns for every cell. ``kernel`` takes a group of ``others``.

    The keys deal rows to parts and groups, so they should be ids. ``others`` may bring its
    own ``__group`` (0 to groups - 1), and rows that need some groups only a list
    ``__groups``. ``cells`` is the number of parts times groups, by default the number of
    shuffle partitions.
    """
    cells = cells or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, cells // groups)
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    row_columns = [c for c in rows.columns if c != "__groups"]
    other_columns = [c for c in others.columns if c != "__group"]
    row_type, other_type = (df.select(F.struct(*c).alias("s")).schema["s"].dataType
                            for df, c in ((rows, row_columns), (others, other_columns)))
    visits = F.col("__groups") if "__groups" in rows.columns else F.lit(list(range(groups)))
    group = F.col("__group") if "__group" in others.columns else deal(other_key, groups)
    left = rows.select(F.struct(*row_columns).alias("__row"), deal(row_key, parts).alias("__part"), F.explode(visits).alias("__g"))
    right = others.select(F.struct(*other_columns).alias("__other"), group.alias("__g"),
                          F.explode(F.lit(list(range(parts)))).alias("__part"))
    cell = (F.col("__part") * groups + F.col("__g")).alias("__cell")
    both = right.select(cell, F.lit(0).alias("__side"), F.lit(None).cast(row_type).alias("__row"), "__other").unionByName(
        left.select(cell, F.lit(1).alias("__side"), "__row", F.lit(None).cast(other_type).alias("__other")))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, now = None, [], None
        for batch in batches:
            cell, side = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            if not len(cell):
                continue
            edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(cell)]):
                if cell[lo] != at:
                    if now is not None:
                        yield from now.close()
                    at, held, now = cell[lo], [], None
                if side[lo] == 0:
                    held.append(pa.RecordBatch.from_struct_array(batch.column(3).slice(lo, hi - lo)))
                elif held:
                    if now is None:
                        now = kernel(pa.Table.from_batches(held).combine_chunks())
                    yield from now.meet(pa.RecordBatch.from_struct_array(batch.column(2).slice(lo, hi - lo)))
        if now is not None:
            yield from now.close()

    # the cell is the partition
    return both.repartitionById(parts * groups, F.col("__cell")).sortWithinPartitions("__cell", "__side").mapInArrow(walk, schema)
