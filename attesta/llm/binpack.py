"""Best-fit packing of documents into sequences by minimum bin slack."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.llm.scratch import stored
from attesta.llm.tokens import Encoder, slices

#: rows of counts per length and input part that are broadcast; more are shuffled
OFFSET_ROWS = 500_000


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """The token ids of every document, cut into pieces of ``size`` where it is longer.

    Only the first piece may be shorter. Columns: doc_id, piece (from 0), start, length,
    ids (little-endian unsigned 32-bit), part (the task that made it) and nth (its number
    among the task's pieces of that length). Every document has its end id, so null and
    empty texts make one piece of one token.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        own = Encoder(tokenizer, end_id)
        seen = np.zeros(size + 1, np.int64)
        for batch in slices(batches):
            row = 0
            for ids, at in own.ids(batch.column(1)):
                n = len(at) - 1
                yield _cut(batch.column(0).slice(row, n), ids, at, size, part, seen)
                row += n

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids binary, part int, nth long")


def _cut(names: pa.Array, ids: np.ndarray, at: np.ndarray, size: int, part: int, seen: np.ndarray) -> pa.RecordBatch:
    """The pieces of a run of documents; ``seen`` counts the task's pieces by length."""
    n = np.diff(at)
    pieces = -(-n // size)
    row = np.repeat(np.arange(len(n)), pieces)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = n - (pieces - 1) * size
    start = np.where(piece == 0, 0, first[row] + (piece - 1) * size)
    length = np.where(piece == 0, first[row], size)
    order = np.argsort(length, kind="stable")
    runs, begin, count = np.unique(length[order], return_index=True, return_counts=True)
    nth = np.empty(len(row), np.int64)
    nth[order] = np.arange(len(row)) - np.repeat(begin, count) + seen[length[order]]
    seen[runs] += count
    data = pa.py_buffer(ids.astype("<u4"))
    ends = np.append(at[row] + start, at[-1]) * 4  # pieces follow one another
    binary = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.astype(np.int32)), data])
    return pa.RecordBatch.from_arrays(
        [names.take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), binary,
         pa.array(np.full(len(row), part, np.int32)), pa.array(nth)],
        names=["doc_id", "piece", "start", "length", "ids", "part", "nth"])


def fullest(left: dict[int, int], size: int) -> list[tuple[int, int]]:
    """The lengths and how many of each that fill one bin best, the longest left being one.

    Bit b of ``reach`` says that some choice of lengths adds up to b. Lengths go in from
    long to short, each in powers of two of its number, with a shift and an or; the states
    passed on the way give the choice back.
    """
    longest = max(left)
    room = size - longest
    goal, limit = 1 << room, (1 << room + 1) - 1
    reach, steps = 1, []
    for length in sorted(left, reverse=True):
        many = min(left[length] - (length == longest), room // length)
        share = 1
        while many > 0 and not reach & goal:
            share = min(share, many)
            steps.append((reach, length, share))
            reach |= reach << length * share & limit
            many -= share
            share *= 2
        if reach & goal:
            break
    at, taken = reach.bit_length() - 1, {longest: 1}
    for before, length, share in reversed(steps):
        if not before >> at & 1:
            at -= length * share
            taken[length] = taken.get(length, 0) + share
    return sorted(taken.items(), reverse=True)


def bins(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Minimum bin slack over all pieces: (number of bins, their lengths) until none is left.

    The fullest combination for the longest piece left is taken as often as its lengths
    last, which is the same as finding it again for bin after bin. Each round uses up a
    length or leaves too few of it, so the work depends on ``size``, not on the number of
    pieces.
    """
    left = {length: n for length, n in counts.items() if n}
    out = []
    while left:
        chosen = fullest(left, size)
        times = min(left[length] // k for length, k in chosen)
        out.append((times, chosen))
        for length, k in chosen:
            left[length] -= k * times
            if not left[length]:
                del left[length]
    return out


def intervals(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """For runs of the ranks of a length: the first sequence and the place in it."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for times, chosen in plan:
        offset = 0
        for length, k in chosen:
            for _ in range(k):
                rows.append((length, used.get(length, 0), base, offset))
                used[length] = used.get(length, 0) + times
                offset += length
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(docs: DataFrame, tokenizer: str, end_id: int, size: int = 1024, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """``pieces`` with the sequence_id and offset at which each lies, in few sequences.

    Pieces are written once and not shuffled. Only their counts per length matter for the
    plan, and these are at most ``size`` numbers; minimum bin slack turns them into runs of
    ranks per length. A piece's rank is its number in its task plus what earlier tasks have
    of its length. Offsets are gapless from 0. An empty table packs into no rows.
    """
    cut = stored(pieces(docs, tokenizer, end_id, size, id_col, text_col), "pieces")
    counts = stored(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = intervals(bins(totals, size))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    if counts.count() <= OFFSET_ROWS:
        offsets = F.broadcast(offsets)
    wide = np.int64(1) << 44
    keys = plan["length"] * wide + plan["rank"]

    @F.arrow_udf("struct<sequence_id:long,offset:long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        length, rank = length.to_numpy(), rank.to_numpy()
        i = np.searchsorted(keys, length * wide + rank, "right") - 1
        return pa.StructArray.from_arrays(
            [pa.array(plan["sequence"][i] + rank - plan["rank"][i]), pa.array(plan["offset"][i])],
            names=["sequence_id", "offset"])

    placed = cut.join(offsets, ["part", "length"]).withColumn(
        "__at", place(F.col("length"), F.col("nth") + F.col("__before")))
    return placed.select("doc_id", "piece", "start", "length", "ids",
                         F.col("__at.sequence_id").alias("sequence_id"), F.col("__at.offset").alias("offset"))
