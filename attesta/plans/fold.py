"""Order-dependent folds that stream instead of gathering a group.

Rows are partitioned by key, sorted, and fed through a small state machine one batch
at a time, so a task holds the state of one key and never its rows. Callers split
keys into independent islands first (see ``islands``), so that a large key spreads
over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.plans.scan import by_position, running

#: machine: () -> object with ``row(tuple) -> rows`` and ``end() -> rows``
Machine = Callable[[], object]


def together(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Shuffle so that a key's rows are in one partition, whatever lies below.

    Partitioning by the plain keys may be planned away when an input (a union, say)
    claims to have it, and adaptive execution may later break that claim, because a
    Python map states no requirement. Nothing claims to be partitioned by this hash.
    """
    return df.repartition(F.xxhash64(*keys))


def fold_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
                machine: Machine, schema: str | T.StructType) -> DataFrame:
    """Run one ``machine`` per key over its rows in ``order``.

    ``machine().row(values)`` gets the ``columns`` of one row and returns an iterable
    of output tuples; ``end()`` does so at the end of the key. Outputs are prefixed
    with the key columns.
    """
    keys, columns = list(keys), list(columns)
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    out = T.StructType([*df.select(*keys).schema.fields, *schema.fields])
    names = out.fieldNames()
    width = len(keys)
    slim = (df.select(*keys, *[c for c in columns if c not in keys],
                      *[c for c in order if c not in keys and c not in columns])
            .transform(together, keys).sortWithinPartitions(*keys, *order))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for frame in frames:
            rows: list[tuple] = []
            cols = [frame[c].tolist() for c in (*keys, *columns)]
            for values in zip(*cols):
                key = values[:width]
                if key != current:
                    if state is not None:
                        rows.extend((*current, *r) for r in state.end())
                    current, state = key, machine()
                rows.extend((*key, *r) for r in state.row(values[width:]))
            if rows:
                yield pd.DataFrame(rows, columns=names)
        if state is not None:
            rows = [(*current, *r) for r in state.end()]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return slim.mapInPandas(run, out)


def annotate_sorted(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str],
                    machine: Machine, name: str) -> DataFrame:
    """Add a bigint column by a state machine run over each key's rows in ``order``.

    ``machine().rows(*lists)`` gets the ``columns`` of consecutive rows of its key and
    returns one int each. Only keys and those columns become Python values; the rest of
    a batch passes through as it is.
    """
    keys, columns = list(keys), list(columns)
    out = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])
    rows = df.transform(together, keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            held = [batch.column(k) for k in keys]
            edge = np.zeros(n, bool)
            edge[0] = [k[0].as_py() for k in held] != last
            for k in held:
                edge[1:] |= np.asarray(pc.fill_null(pc.not_equal(k[1:], k[:-1]), True))
            values = [batch.column(c).to_pylist() for c in columns]
            found: list[int] = []
            cuts = np.flatnonzero(edge).tolist()
            if not edge[0]:
                found.extend(state.rows(*[v[:cuts[0] if cuts else n] for v in values]))
            for a, z in zip(cuts, [*cuts[1:], n]):
                state = machine()
                found.extend(state.rows(*[v[a:z] for v in values]))
            last = [k[n - 1].as_py() for k in held]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())],
                                             names=[*batch.schema.names, name])

    return rows.mapInArrow(run, out)


def islands(df: DataFrame, keys: Sequence[str], start: str, end: str, bucket: float = 1.0,
            name: str = "island") -> DataFrame:
    """Number groups of rows inside a key so that [start, end) intervals of different
    groups never overlap.

    Starts are first combined map-side into buckets of ``bucket`` units, and only those
    are scanned, so rows closer than a bucket may share a group that could be split.
    """
    keys = list(keys)
    at = F.floor(F.col(start) / bucket).cast("bigint")
    coarse = df.groupBy(*keys, at.alias("__at")).agg(F.min(start).alias("__lo"), F.max(end).alias("__hi"))
    reach = running(coarse, keys, ["__at"], by_position("__at", 1024), {"__reach": ("max", F.col("__hi"))},
                    inclusive=False)
    opens = (F.col("__reach").isNull() | (F.col("__lo") >= F.col("__reach"))).cast("bigint")
    numbered = running(reach, keys, ["__at"], by_position("__at", 1024), {name: ("sum", opens)})
    return df.withColumn("__at", at).join(numbered.select(*keys, "__at", name), [*keys, "__at"]).drop("__at")
