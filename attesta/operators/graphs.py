"""Greedy keep-or-drop over an ordered set, without a sequential pass.

Keep a node exactly when no earlier kept node conflicts with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators.search import CELLS, to_matrix, vector_groups
from attesta.plans import grid
from attesta.plans.lineage import cut


def _followed(alias: DataFrame) -> DataFrame:
    """Every alias (id, of, flip) led on to a node that is none itself, by pointer jumping."""
    while True:
        far = alias.select(F.col("id").alias("of"), F.col("of").alias("__far"), F.col("flip").alias("__flip"))
        alias = cut(alias.join(far, "of", "left").select(
            "id", F.coalesce("__far", "of").alias("of"), (F.col("flip") != F.coalesce("__flip", F.lit(False))).alias("flip"),
            F.col("__far").isNotNull().alias("moved")))
        if alias.filter("moved").isEmpty():
            return alias.drop("moved")
        alias = alias.drop("moved")


def greedy_leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, kept, keeper): fixpoint over given conflicts.

    ``nodes``: id, ord (a total order); ``edges``: a, b in any direction. A node is kept
    unless an earlier neighbour is, so every node waits for a list of literals "that one is
    kept" or, after contraction, "that one is not". In each round

    - a node with an empty list is kept, one with a true literal or with a literal and its
      opposite is dropped, and false literals go;
    - a node with one literal has the fate of another node or the opposite: such nodes are
      led on along their whole chain by pointer jumping and replaced in all lists.

    So a chain of n nodes takes log2(n) joins. The keeper is the earliest kept neighbour.
    """
    order = nodes.select("id", "ord")
    both = edges.select("a", "b").union(edges.select("b", "a"))
    directed = (both.join(order.toDF("a", "__oa"), "a").join(order.toDF("b", "__ob"), "b")
                .filter("__oa < __ob").select(F.col("a").alias("src"), F.col("__oa").alias("src_ord"),
                                              F.col("b").alias("dst")).distinct())
    directed = cut(directed)
    open_ = cut(order.select("id"))
    waits = directed.select("dst", "src", F.lit(False).alias("neg"))
    told = open_.limit(0).select("id", F.lit(True).alias("kept"))  # decided, not yet told to those who wait
    decided, aliases = [], []
    while not open_.isEmpty():
        free = open_.join(waits.select(F.col("dst").alias("id")), "id", "left_anti").select("id", F.lit(True).alias("kept"))
        torn = (waits.groupBy("dst", "src").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
                .select(F.col("dst").alias("id"), F.lit(False).alias("kept")).distinct())
        known = cut(free.unionByName(torn))
        news = told.unionByName(known).withColumnRenamed("id", "src")
        heard = waits.join(news, "src").filter("kept <> neg").select(F.col("dst").alias("id")).distinct()
        hit = cut(heard.join(known.select("id"), "id", "left_anti").select("id", F.lit(False).alias("kept")))
        settled = known.unionByName(hit)
        decided.append(settled)
        gone = settled.select(F.col("id").alias("dst"))
        waits = cut(waits.join(news.select("src"), "src", "left_anti").join(gone, "dst", "left_anti"))
        open_ = open_.join(settled.select("id"), "id", "left_anti")
        told = hit
        single = (waits.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("of"), F.bool_or("neg").alias("neg"))
                  .filter("n = 1").select(F.col("dst").alias("id"), "of", (~F.col("neg")).alias("flip")))
        single = cut(single)
        if not single.isEmpty():
            single = _followed(single)
            aliases.append(single)
            named = single.select(F.col("id").alias("src"), "of", "flip")
            rest = waits.join(single.select(F.col("id").alias("dst")), "dst", "left_anti")
            waits = cut(rest.join(named, "src", "left").select(
                "dst", F.coalesce("of", "src").alias("src"),
                (F.col("neg") != F.coalesce("flip", F.lit(False))).alias("neg")).distinct())
            open_ = open_.join(single.select("id"), "id", "left_anti")
        open_ = cut(open_)
    status = reduce(DataFrame.unionByName, decided) if decided else told
    if aliases:
        ends = _followed(reduce(DataFrame.unionByName, aliases))
        fate = status.select(F.col("id").alias("of"), "kept")
        status = status.unionByName(ends.join(fate, "of").select("id", (F.col("kept") != F.col("flip")).alias("kept")))
    status = cut(status)
    winners = status.filter("kept").select(F.col("id").alias("src"))
    keeper = (directed.join(winners, "src", "left_semi").groupBy(F.col("dst").alias("id"))
              .agg(F.min_by("src", "src_ord").alias("keeper")))
    return (status.join(keeper, "id", "left")
            .select("id", "kept", F.when(~F.col("kept"), F.col("keeper")).alias("keeper")))


class _Claims:
    """Leaders or undecided nodes in order: which of them comes first among those that are
    earlier than a row and close to it."""

    def __init__(self, group: pa.Table, threshold: float) -> None:
        group = group.sort_by([("ord", "ascending"), ("id", "ascending")])
        self.ids, self.ords = (np.asarray(group[c]) for c in ("id", "ord"))
        self.vectors, self.usable = to_matrix(group["embedding"])
        self.threshold = threshold

    def meet(self, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        step = max(1, CELLS // len(self.ids))
        for at in range(0, rows.num_rows, step):
            part = rows.slice(at, step)
            x, usable = to_matrix(part.column("embedding"), self.vectors.shape[1])
            ids, ords = (np.asarray(part.column(c))[:, None] for c in ("id", "ord"))
            sims = x @ self.vectors.T
            close = (sims >= self.threshold) & usable[:, None] & self.usable
            close &= (self.ords < ords) | ((self.ords == ords) & (self.ids < ids))
            hit = np.flatnonzero(close.any(axis=1))
            first = close[hit].argmax(axis=1)
            yield pa.RecordBatch.from_pydict({
                "id": ids[hit, 0], "keeper_ord": self.ords[first], "keeper": self.ids[first], "similarity": sims[hit, first]})

    def close(self) -> Iterator[pa.RecordBatch]:
        return iter(())


def _claims(rows: DataFrame, leaders: DataFrame, threshold: float) -> DataFrame:
    """(id, keeper, similarity): rows with an earlier close leader, and the earliest such."""
    found = grid.meet(rows, leaders, partial(_Claims, threshold=threshold),
                      "id bigint, keeper_ord double, keeper bigint, similarity double",
                      row_key="id", other_key="id", groups=vector_groups(leaders))
    best = found.groupBy("id").agg(F.min(F.struct("keeper_ord", "keeper", "similarity")).alias("__b"))
    return best.select("id", "__b.keeper", "__b.similarity")


#: nodes settled in one task at most, and the share of the rest that their leaders should cover
SETTLED, COVERED = 4096, 1 / 8


def _settled(first: DataFrame, threshold: float) -> DataFrame:
    """The leaders among a bounded number of nodes, one after the other in one task."""
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches).combine_chunks()
        vectors, usable = to_matrix(whole["embedding"])
        sims = vectors @ vectors.T
        leaders: list[int] = []
        for i in range(len(vectors)):
            if not (usable[i] and leaders and (sims[i, leaders] >= threshold).any()):
                leaders.append(i)
        yield from whole.take(leaders).to_batches()

    return first.coalesce(1).sortWithinPartitions("ord", "id").mapInArrow(walk, first.schema)


def greedy_vector_leaders(nodes: DataFrame, threshold: float, batch: int = grid.GROUP_ROWS) -> DataFrame:
    """(id, kept, keeper, similarity) where conflict means cosine >= ``threshold``.

    ``nodes``: id, ord (a total order, numeric), embedding; vectors that are zero or
    shorter than the longest conflict with nothing. The keeper is the
    earliest kept neighbour.

    Equal vectors are folded first, so a group of copies is one node. In each round the first
    undecided nodes, ``batch`` and then twice as many up to ``SETTLED``, are settled in one
    task, and what the kept ones cover is dropped. Where they cover little, every node without
    an earlier undecided neighbour is kept as well, all at once; nodes wait for one another
    only along chains of close vectors, so only this compares all with all. Comparisons run on
    the grid: neither vectors nor pairs reach the driver, and no pairs are stored.
    """
    base = cut(nodes.select(F.col("id").cast("bigint").alias("id"), F.col("ord").cast("double").alias("ord"), "embedding"))
    longest = base.agg(F.max(F.size("embedding"))).first()[0] or 0
    usable = (F.size("embedding") == longest) & F.exists("embedding", lambda x: x != 0)
    groups = (base.where(usable).groupBy("embedding").agg(F.min(F.struct("ord", "id")).alias("__f"))
              .select("__f.id", "__f.ord", "embedding"))
    classes = cut(groups)
    left, found, n = classes, [], classes.count()
    uncovered = lambda rows, leaders: cut(rows.join(
        _claims(rows, leaders, threshold).select("id"), "id", "left_anti"))
    while n:
        if n <= batch:
            found.append(cut(_settled(left, threshold)))
            break
        first = cut(left.orderBy("ord", "id").limit(batch))
        leaders = cut(_settled(first, threshold))
        found.append(leaders)
        left = uncovered(cut(left.join(first.select("id"), "id", "left_anti")), leaders)
        rest, n = n - batch, left.count()
        if batch >= SETTLED and n > (1 - COVERED) * rest:
            free = uncovered(left, left)
            found.append(free)
            left = uncovered(cut(left.join(free.select("id"), "id", "left_anti")), free)
            n = left.count()
        batch = max(batch, min(2 * batch, SETTLED))
    spark = nodes.sparkSession
    leaders = cut(reduce(DataFrame.unionByName, found)) if found else spark.createDataFrame([], classes.schema)
    covered = _claims(classes.join(leaders.select("id"), "id", "left_anti"), leaders, threshold)
    fate = (leaders.select("id", F.lit(None).cast("bigint").alias("keeper"), F.lit(None).cast("double").alias("similarity"))
            .unionByName(covered))
    own = classes.select("embedding", F.col("id").alias("__first")).join(fate.withColumnRenamed("id", "__first"), "__first")
    folded = base.where(usable).select("id", "embedding").join(own, "embedding")
    copy = F.col("id") != F.col("__first")
    keeper = F.coalesce("keeper", F.when(copy, F.col("__first")))
    out = folded.select("id", keeper.isNull().alias("kept"), keeper.alias("keeper"),
                        F.coalesce("similarity", F.when(copy, F.lit(1.0))).alias("similarity"))
    alone = base.where(~F.coalesce(usable, F.lit(False))).select(
        "id", F.lit(True).alias("kept"), F.lit(None).cast("bigint").alias("keeper"), F.lit(None).cast("double").alias("similarity"))
    return out.unionByName(alone)
