"""Exact top-k by vector: one job, no pairs shuffled.

Up to ``BLOCK_ROWS`` questions are one bounded block that is sent to the tasks, and the
rows are scanned where they lie. More questions, and vectors on both sides, meet on a grid
(``plans.grid``) and never pass the driver. A task scores its batches with matrix products
and keeps only the best k per question, so what it returns does not depend on how many rows
it read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from attesta.plans import grid
from attesta.plans.lineage import cut
from attesta.plans.topk import top_k

BLOCK_ROWS = 1024
CELLS = 1 << 22  # scores held at once per task
GROUP_BYTES = 1 << 25  # a group of vectors, in double, that others stream past


def vector_groups(vectors: DataFrame) -> int:
    """How many groups a table of vectors (``embedding``) is dealt into. Every row that streams
    past travels once per group, so a group is as large as a task holds with ease."""
    n, dim = vectors.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    return grid.groups_of(n, max(grid.GROUP_ROWS, GROUP_BYTES // (8 * max(1, dim or 0))))


def to_matrix(column: pa.ChunkedArray | pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Unit row vectors in double and a mask of the usable rows."""
    arr = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(pc.fill_null(pc.list_value_length(arr), 0), dtype=np.int64)
    dim = dim or (int(sizes.max()) if len(sizes) else 0)
    usable = (sizes == dim) & (dim > 0)
    out = np.zeros((len(sizes), dim))
    if usable.any():
        kept = arr.filter(pa.array(usable))
        out[usable] = np.asarray(kept.flatten(), dtype=np.float64).reshape(-1, dim)
        norms = np.linalg.norm(out, axis=1)
        usable &= norms > 0
        out[usable] /= norms[usable, None]
    return out, usable


@dataclass
class _SparseBlock:
    """Question tokens as postings: token -> (question, weight) runs."""

    vocabulary: pa.Array
    start: np.ndarray
    question: np.ndarray
    weight: np.ndarray

    @classmethod
    def build(cls, tokens: pa.Array, weights: pa.Array) -> _SparseBlock:
        sizes = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0), dtype=np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        coded = tokens.flatten().dictionary_encode()
        ids = np.asarray(coded.indices, dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        counts = np.bincount(ids, minlength=len(coded.dictionary))
        return cls(coded.dictionary, np.concatenate([[0], np.cumsum(counts)]), owner[order],
                   np.asarray(weights.flatten(), dtype=np.float64)[order])

    def scores(self, tokens: pa.Array, weights: pa.Array, questions: int) -> np.ndarray:
        """Inner product of every row with every question."""
        sizes = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0), dtype=np.int64)
        out = np.zeros(len(sizes) * questions)
        token = np.asarray(pc.fill_null(pc.index_in(tokens.flatten(), value_set=self.vocabulary), -1),
                           dtype=np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        weight = np.asarray(weights.flatten(), dtype=np.float64)
        hit = token >= 0
        token, row, weight = token[hit], row[hit], weight[hit]
        fan = self.start[token + 1] - self.start[token]
        edges = np.concatenate([[0], np.cumsum(fan)])
        lo = 0
        while lo < len(token):
            hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + CELLS, side="right")) - 1)
            n = fan[lo:hi]
            at = np.arange(edges[hi] - edges[lo]) - np.repeat(edges[lo:hi] - edges[lo], n)
            at += np.repeat(self.start[token[lo:hi]], n)
            cell = np.repeat(row[lo:hi], n) * questions + self.question[at]
            out += np.bincount(cell, np.repeat(weight[lo:hi], n) * self.weight[at], len(out))
            lo = hi
        return out.reshape(len(sizes), questions)


class _Best:
    """Best k rows per question by (score descending, id ascending)."""

    def __init__(self, questions: int, k: int) -> None:
        self.k, self.n = k, questions
        self.q = np.empty(0, np.int64)
        self.s = np.empty(0)
        self.i = np.empty(0, np.int64)
        self.floor = np.full(questions, -np.inf)
        self.floor_id = np.full(questions, np.iinfo(np.int64).max)

    def offer(self, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        better = allowed & ((scores > self.floor) |
                            ((scores == self.floor) & (ids[:, None] < self.floor_id)))
        r, q = np.nonzero(better)
        self.q = np.concatenate([self.q, q])
        self.s = np.concatenate([self.s, scores[r, q]])
        self.i = np.concatenate([self.i, ids[r]])
        if len(self.q) > 4 * self.n * self.k:
            self.compact()

    def compact(self) -> None:
        order = np.lexsort((self.i, -self.s, self.q))
        q, s, i = self.q[order], self.s[order], self.i[order]
        first = np.searchsorted(q, np.arange(self.n))
        place = np.arange(len(q)) - first[q]
        keep = place < self.k
        last = place == self.k - 1
        self.floor[q[last]], self.floor_id[q[last]] = s[last], i[last]
        self.q, self.s, self.i = q[keep], s[keep], i[keep]


def score_topk(
    rows: DataFrame,
    questions: DataFrame,
    k: int,
    *,
    row_id: str = "chunk_id",
    question_id: str = "query_id",
    dense: bool = True,
    sparse: bool = False,
    scope: DataFrame | None = None,
    scope_key: str = "document_id",
    digits: int | None = None,
) -> DataFrame:
    """(question, branch, row, score, rnk): the best ``k`` rows per question.

    ``rows`` has the id, ``embedding`` for the dense branch, ``tokens``/``weights``
    arrays for the sparse branch; ``questions`` likewise. ``scope`` lists the
    (question, scope_key) pairs a question may see; questions with a true
    ``unscoped`` column see everything. Rows with a null vector are not ranked.
    """
    wanted = [question_id] + (["embedding"] if dense else []) + (["tokens", "weights"] if sparse else [])
    if scope is not None:
        wanted.append("unscoped")
    if sparse:  # one null rule for both arrays
        paired = F.when(F.col("tokens").isNotNull(), F.col("weights"))
        rows, questions = rows.withColumn("weights", paired), questions.withColumn("weights", paired)
    asked = questions.select(*wanted)
    kernel = partial(_Scores, k=k, names=(question_id, row_id), digits=digits)
    source = rows.select(row_id, *(["embedding"] if dense else []), *(["tokens", "weights"] if sparse else []),
                         *([scope_key] if scope is not None else []))
    schema = f"{question_id} bigint, branch string, {row_id} bigint, score double"
    few = asked.limit(BLOCK_ROWS + 1).toArrow()
    if few.num_rows <= BLOCK_ROWS:
        result = _past_one_block(source, few, kernel, schema, question_id, scope, scope_key)
    else:
        result = _past_groups(source, asked, kernel, schema, row_id, question_id, scope, scope_key)
    return top_k(result, [question_id, "branch"], [F.desc("score"), F.asc(row_id)], k,
                 rank="rnk", salt_on=[row_id])


def _past_one_block(source, block, kernel, schema, question_id, scope, scope_key) -> DataFrame:
    """One scan of the rows: the questions, at most ``BLOCK_ROWS``, are sent to the tasks."""
    spark = source.sparkSession
    if not block.num_rows:
        return spark.createDataFrame([], schema)
    block = block.append_column("__place", pa.array(np.arange(block.num_rows, dtype=np.int32)))
    if scope is not None:
        place = spark.createDataFrame(block.select([question_id, "__place"]))
        # at most one row per scope_key, at most as many places in it as there are questions
        seats = (scope.join(F.broadcast(place), question_id).groupBy(scope_key)
                 .agg(F.collect_set("__place").alias("__seats")))
        source = source.join(seats, scope_key, "left").drop(scope_key)
        if not pc.any(pc.fill_null(block["unscoped"], False)).as_py():
            source = source.filter(F.col("__seats").isNotNull())
    sent = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = kernel(sent.value)
        for batch in batches:
            yield from cell.meet(batch)
        yield from cell.close()

    return source.mapInArrow(run, schema)


def _past_groups(source, asked, kernel, schema, row_id, question_id, scope, scope_key) -> DataFrame:
    """One job for any number of questions, which travel by shuffle in groups."""
    groups = grid.groups_of(asked.count())
    placed = asked.withColumn("__group", F.pmod(F.xxhash64(question_id), F.lit(groups)).cast("int"))
    placed = cut(placed.withColumn("__place", (F.row_number().over(
        Window.partitionBy("__group").orderBy(question_id)) - 1).cast("int")))
    if scope is not None:
        seats = (scope.join(placed.select(question_id, "__group", "__place"), question_id)
                 .groupBy(F.col(scope_key).alias("__k"), "__group").agg(F.collect_set("__place").alias("__seats")))
        # groups with an unscoped question are passed by all rows; there are few groups
        open_ = [r[0] for r in placed.where("unscoped").select("__group").distinct().collect()]
        closed = seats.where(~F.col("__group").isin(open_)) if open_ else seats
        met = source.join(closed, F.col(scope_key) == F.col("__k"))
        if open_:
            every = source.withColumn("__g", F.explode(F.lit(open_)))
            every = every.join(seats, (F.col(scope_key) == F.col("__k")) & (F.col("__g") == F.col("__group")), "left")
            met = met.unionByName(every.withColumn("__group", F.col("__g")).drop("__g"))
        source = met.withColumn("__groups", F.array("__group")).drop("__k", "__group", scope_key)
    return grid.meet(source, placed, kernel, schema, row_key=row_id, other_key=question_id, groups=groups)


class _Scores:
    """A group of questions; each keeps the best k of the rows that pass."""

    def __init__(self, group: pa.Table, k: int, names: tuple[str, str], digits: int | None) -> None:
        group = group.sort_by("__place").combine_chunks()
        (self.question, self.row), self.digits = names, digits
        self.qids, self.n = np.asarray(group[self.question], dtype=np.int64), group.num_rows
        self.open = np.asarray(pc.fill_null(group["unscoped"], False)) if "unscoped" in group.column_names else None
        self.best: dict[str, _Best] = {}
        if "embedding" in group.column_names:
            self.q, self.q_ok = to_matrix(group["embedding"])
            self.best["dense"] = _Best(self.n, k)
        if "tokens" in group.column_names:
            self.s = _SparseBlock.build(group["tokens"].combine_chunks(), group["weights"].combine_chunks())
            self.s_ok = np.asarray(pc.is_valid(group["tokens"]))
            self.best["sparse"] = _Best(self.n, k)

    def meet(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // self.n)
        for at in range(0, rows.num_rows, step):
            batch = rows.slice(at, step)
            ids = np.asarray(batch.column(self.row), dtype=np.int64)
            allowed = np.ones((len(ids), self.n), bool)
            if self.open is not None:
                allowed &= self.open
                seats = batch.column("__seats")
                size = np.asarray(pc.fill_null(pc.list_value_length(seats), 0), dtype=np.int64)
                allowed[np.repeat(np.arange(len(ids)), size), np.asarray(seats.flatten(), dtype=np.int64)] = True
            if "dense" in self.best:
                x, ok = to_matrix(batch.column("embedding"), self.q.shape[1])
                self._offer("dense", x @ self.q.T, ids, allowed & ok[:, None] & self.q_ok)
            if "sparse" in self.best:
                tokens = batch.column("tokens")
                sims = self.s.scores(tokens, batch.column("weights"), self.n)
                self._offer("sparse", sims, ids, allowed & np.asarray(pc.is_valid(tokens))[:, None] & self.s_ok)
        return iter(())

    def _offer(self, branch: str, sims: np.ndarray, ids: np.ndarray, may: np.ndarray) -> None:
        self.best[branch].offer(sims if self.digits is None else np.round(sims, self.digits), ids, may)

    def close(self) -> Iterator[pa.RecordBatch]:
        for branch, found in self.best.items():
            found.compact()
            yield pa.RecordBatch.from_pydict({
                self.question: self.qids[found.q], "branch": pa.array([branch] * len(found.q), pa.string()),
                self.row: found.i, "score": found.s})


class _Nearest:
    """The right rows of a group that come nearest to each row passing by."""

    def __init__(self, group: pa.Table, k: int, digits: int | None, earlier: bool, names: tuple[str, str]) -> None:
        self.k, self.digits, self.earlier, (self.left, self.right) = k, digits, earlier, names
        group = group.sort_by(self.right)
        matrix, ok = to_matrix(group["embedding"])
        self.ids, self.vectors = np.asarray(group[self.right], dtype=np.int64)[ok], matrix[ok]

    def meet(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        take, step = min(self.k, len(self.ids)), max(1, CELLS // max(1, len(self.ids)))
        for at in range(0, rows.num_rows if take else 0, step):
            part = rows.slice(at, step)
            x, usable = to_matrix(part.column("embedding"), self.vectors.shape[1])
            sims = x[usable] @ self.vectors.T
            if self.digits is not None:
                sims = np.round(sims, self.digits)
            mine = np.asarray(part.column(self.left), dtype=np.int64)[usable]
            if self.earlier:
                sims = np.where(self.ids[None, :] <= mine[:, None], sims, -np.inf)
            # of ties the smaller id, as ids ascend: the first maximum, or a stable sort
            order = (sims.argmax(axis=1)[:, None] if take == 1 else
                     np.argsort(-sims, axis=1, kind="stable")[:, :take])
            best = np.take_along_axis(sims, order, axis=1).ravel()
            real = np.isfinite(best)
            yield pa.RecordBatch.from_pydict({
                self.left: np.repeat(mine, take)[real], self.right: self.ids[order].ravel()[real], "similarity": best[real]})

    def close(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def nearest(left: DataFrame, right: DataFrame, k: int = 1, *, left_id: str = "left_id",
            right_id: str = "right_id", digits: int | None = None, earlier: bool = False) -> DataFrame:
    """(left_id, right_id, similarity, rnk): the k nearest right rows of each left row.

    Both sides have an id and an ``embedding``. Every left row keeps only its best k per
    group of right vectors, so the groups merge in one small top-k. With ``earlier`` only
    right rows whose id is at most the left row's are considered.
    """
    rows = left.select(left_id, "embedding").filter("embedding IS NOT NULL")
    others = right.select(F.col(right_id).cast("bigint").alias(right_id), "embedding").filter("embedding IS NOT NULL")
    found = grid.meet(rows, others, partial(_Nearest, k=k, digits=digits, earlier=earlier, names=(left_id, right_id)),
                      f"{left_id} bigint, {right_id} bigint, similarity double",
                      row_key=left_id, other_key=right_id, groups=vector_groups(others))
    return top_k(found, [left_id], [F.desc("similarity"), F.asc(right_id)], k, rank="rnk")


class _Band:
    """Pairs of a row and a vector of the group with low <= cosine < high and a < b."""

    def __init__(self, group: pa.Table, low: float, high: float) -> None:
        matrix, ok = to_matrix(group["embedding"])
        self.ids, self.vectors = np.asarray(group["id"], dtype=np.int64)[ok], matrix[ok]
        self.weights = np.asarray(group["weight"], dtype=np.int64)[ok]
        self.low, self.high = low, high

    def meet(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // max(1, len(self.ids)))
        for at in range(0, rows.num_rows, step):
            part = rows.slice(at, step)
            x, usable = to_matrix(part.column("embedding"), self.vectors.shape[1])
            mine, weight = (np.asarray(part.column(c), dtype=np.int64)[usable] for c in ("id", "weight"))
            sims = x[usable] @ self.vectors.T
            i, j = np.nonzero((sims >= self.low) & (sims < self.high) & (mine[:, None] < self.ids[None, :]))
            yield pa.RecordBatch.from_pydict({"a": mine[i], "b": self.ids[j], "similarity": sims[i, j],
                                              "a_weight": weight[i], "b_weight": self.weights[j]})

    def close(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def similar_pairs(nodes: DataFrame, low: float, high: float) -> DataFrame:
    """(a, b, similarity, a_weight, b_weight) with a < b and low <= cosine < high.

    ``nodes``: id, embedding and perhaps weight (a number, else 0), which comes with the pairs
    so that they need no join afterwards. Vectors meet on the grid; only the pairs in the
    band, which are the result, leave the tasks.
    """
    weight = F.col("weight").cast("bigint") if "weight" in nodes.columns else F.lit(0).cast("bigint")
    rows = nodes.select(F.col("id").cast("bigint").alias("id"), "embedding", weight.alias("weight")).filter("embedding IS NOT NULL")
    return grid.meet(rows, rows, partial(_Band, low=low, high=high),
                     "a bigint, b bigint, similarity double, a_weight bigint, b_weight bigint",
                     row_key="id", other_key="id", groups=vector_groups(rows))
