"""A pruned vector index: rows stored by cell, questions meet only their nearest cells.

Cells are the nearest of ``cells`` centroids, which are fitted on a bounded sample. Each cell
is a directory of the stored table, so a search reads the directories of the cells that its
questions ask for and multiplies each question only with the rows of its own cells.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from attesta.operators.search import _Scores, to_matrix
from attesta.plans import grid
from attesta.plans.lineage import cut, shared_folder
from attesta.plans.topk import top_k

SAMPLE_ROWS = 20_000  # rows that centroids are fitted on, picked by hash of their id
ROUNDS = 8


@dataclass(frozen=True)
class VectorIndex:
    """``rows`` has the row id, ``embedding`` and the partition column ``cell``."""
    rows: DataFrame
    centroids: np.ndarray
    row_id: str


def _centroids(vectors: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means from evenly spread rows; a cell that runs empty keeps its centroid."""
    centres = vectors[np.linspace(0, len(vectors) - 1, min(cells, len(vectors))).astype(int)].copy()
    for _ in range(ROUNDS):
        own = (vectors @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, vectors)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def build_index(rows: DataFrame, cells: int = 64, *, row_id: str = "chunk_id", sample: int = SAMPLE_ROWS,
                path: str | None = None) -> VectorIndex:
    """Store ``rows`` (row id, embedding) by cell, by default in the shared folder.

    Every row with a usable vector is stored; rows without one are left out, as no search
    ranks them. Centroids come from at most ``sample`` rows.
    """
    spark = rows.sparkSession
    path = path or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    usable = rows.select(F.col(row_id).cast("bigint").alias(row_id), "embedding").where(
        F.exists("embedding", lambda x: x != 0))
    some = usable.orderBy(F.xxhash64(row_id), row_id).limit(sample).toArrow()
    matrix, ok = to_matrix(some["embedding"])
    centroids = _centroids(matrix[ok], cells) if ok.any() else np.zeros((1, 1))
    sent = spark.sparkContext.broadcast(centroids)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = to_matrix(batch.column(1), sent.value.shape[1])
            cell = (x @ sent.value.T).argmax(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[row_id, "embedding", "cell"]).filter(pa.array(good))

    placed = usable.mapInArrow(place, f"{row_id} bigint, embedding array<float>, cell int")
    placed.write.partitionBy("cell").parquet(path)
    return VectorIndex(spark.read.schema(placed.schema).parquet(path), centroids, row_id)


def nearest_cells(index: VectorIndex, questions: DataFrame, probes: int, question_id: str = "query_id") -> DataFrame:
    """(question, embedding, cell): the ``probes`` cells whose centroids are nearest."""
    sent = questions.sparkSession.sparkContext.broadcast(index.centroids)  # cells x dimensions, both parameters

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, good = to_matrix(batch.column(1), sent.value.shape[1])
            near = np.argsort(-(x @ sent.value.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * near.shape[1], pa.int32()), pa.array(near.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, cells], names=[question_id, "embedding", "cells"]).filter(pa.array(good))

    asked = questions.select(F.col(question_id).cast("bigint").alias(question_id), F.col("embedding").cast("array<float>").alias("embedding"))
    found = asked.where("embedding IS NOT NULL").mapInArrow(
        probe, f"{question_id} bigint, embedding array<float>, cells array<int>")
    return found.select(question_id, "embedding", F.explode("cells").alias("cell"))


def search_index(index: VectorIndex, questions: DataFrame, k: int, probes: int, *, question_id: str = "query_id",
                 digits: int | None = None) -> DataFrame:
    """(question, row, score, rnk): the best ``k`` rows among those of the ``probes`` nearest
    cells. With as many probes as cells the result is exact."""
    asked = cut(nearest_cells(index, questions, probes, question_id))
    spark, row_id = questions.sparkSession, index.row_id
    # one row per cell: the questions of a much wanted cell are dealt into several groups
    wanted = {r["cell"]: grid.groups_of(r["n"]) for r in asked.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    schema = f"{question_id} bigint, branch string, {row_id} bigint, score double"
    if not wanted:
        return top_k(spark.createDataFrame([], schema).drop("branch"), [question_id], [F.desc("score"), F.asc(row_id)], k, rank="rnk")
    cells = sorted(wanted)
    first = dict(zip(cells, accumulate([0, *(wanted[c] for c in cells[:-1])])))
    lists = F.lit([first.get(c, 0) for c in range(cells[-1] + 1)])
    sizes = F.lit([wanted.get(c, 0) for c in range(cells[-1] + 1)])
    begin, size = lists[F.col("cell")], sizes[F.col("cell")]
    placed = asked.withColumn("__group", begin + F.pmod(F.xxhash64(question_id), size).cast("int")).drop("cell")
    placed = placed.withColumn("__place", F.row_number().over(Window.partitionBy("__group").orderBy(question_id)) - 1)
    rows = index.rows.where(F.col("cell").isin(cells)).withColumn("__groups", F.sequence(begin, begin + size - 1)).drop("cell")
    found = grid.meet(rows, placed, partial(_Scores, k=k, names=(question_id, row_id), digits=digits), schema,
                      row_key=row_id, other_key=question_id, groups=sum(wanted.values())).drop("branch")
    return top_k(found, [question_id], [F.desc("score"), F.asc(row_id)], k, rank="rnk", salt_on=[row_id])
