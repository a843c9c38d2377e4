"""Near duplicates by exact Jaccard similarity of word shingles, with count-vector R-trees."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from attesta.llm import kernels as K
from attesta.llm.components import components
from attesta.llm.hot import join_groups
from attesta.llm.scratch import stored

#: token groups that are counted over the corpus, which orders tokens from rare to frequent
COUNTED = 1 << 20
COUNT_BLOCK = 1 << 14
#: token groups whose counts are a document's point
DIMENSIONS = 64
LEAF = 32
#: a unit of comparison has at most this many documents and shingles, about
UNIT_ROWS, UNIT_SHINGLES = 1024, 1 << 20
#: members of a list that are tied to one of them, so that no node gets many edges
FAN = 256
#: rare shingles that similar sets must share, and the longest list whose pairs are counted
SHARED, SHORT = 3, 16
#: rows of a table of ids that is broadcast; more are shuffled
FEW = 1_000_000

WORD = ~K.SPACE


def shingles(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of every row and where rows begin in these: runs of
    ``width`` words, or all words of a row with fewer."""
    starts, ends, first = K.words(data, at, WORD)
    words = K.span_hashes(K.LOWER[data], starts, ends)
    count = np.diff(first)
    sizes = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(begin[-1], np.uint64)
    start = np.repeat(first[:-1], sizes) + np.arange(begin[-1]) - np.repeat(begin[:-1], sizes)
    length = np.repeat(np.minimum(count, width), sizes)
    for i in range(width):
        on = length > i
        out[on] = out[on] * np.uint64(K.BASE) + words[start[on] + i]
    return K.mix(out + length.astype(np.uint64)), begin


def sets(data: np.ndarray, at: np.ndarray, width: int) -> Iterator[np.ndarray]:
    hashes, begin = shingles(data, at, width)
    for i in range(len(at) - 1):
        yield np.unique(hashes[begin[i]:begin[i + 1]])


def group_counts(docs: DataFrame, width: int, text_col: str) -> np.ndarray:
    """How often each of ``COUNTED`` groups of shingles occurs, over all documents. Tasks
    add up their own before anything is shuffled; the result has a fixed size."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTED, np.int64)
        for batch in batches:
            for data, at in K.chunks(batch.column(0)):
                hashes, _ = shingles(data, at, width)
                total += np.bincount((hashes % np.uint64(COUNTED)).astype(np.int64), minlength=COUNTED)
        blocks = total.reshape(-1, COUNT_BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()),
                                          pa.array([b.tobytes() for b in blocks], pa.binary())], names=["block", "n"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNT_BLOCK, np.int64)
        for batch in batches:
            for n in batch.column("n"):
                total += np.frombuffer(n.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                         names=["block", "n"])

    parts = docs.select(text_col).mapInArrow(count, "block int, n binary")
    blocks = parts.groupBy("block").applyInArrow(add, "block int, n binary").collect()
    out = np.zeros((COUNTED // COUNT_BLOCK, COUNT_BLOCK), np.int64)
    for r in blocks:
        out[r["block"]] = np.frombuffer(r["n"], np.int64)
    return out.reshape(-1)


PROFILE = T.StructType([T.StructField("n", T.LongType()), T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()),
                        T.StructField("prefix", T.ArrayType(T.LongType()))])


def _profile(spark, counts: np.ndarray, width: int, percent: int):
    """A column function: the size of a text's shingle set, 128 bits that name the set, and
    its rarest shingles, of which every set as similar as asked for has ``needed`` ones among
    its own."""
    rank = np.argsort(np.argsort(counts, kind="stable"), kind="stable").astype(np.uint64)
    held = spark.sparkContext.broadcast(rank)

    @F.arrow_udf(PROFILE)
    def profile(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        rank = held.value
        for text in parts:
            sizes, hi, lo, prefixes, lengths = [], [], [], [np.zeros(0, np.uint64)], [0]
            for data, at in K.chunks(text):
                for own in sets(data, at, width):
                    n = len(own)
                    keep = min(n, n - (percent * n + 99) // 100 + needed(percent))
                    order = np.lexsort((own, rank[(own % np.uint64(COUNTED)).astype(np.int64)]))[:keep]
                    sizes.append(n)
                    hi.append(int(np.sum(own, dtype=np.uint64)))
                    lo.append(int(np.sum(K.mix(own ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
                    prefixes.append(own[order])
                    lengths.append(keep)
            names = [pa.array(K.mix(np.array(x, np.uint64)).view(np.int64)) for x in (hi, lo)]
            yield pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), *names,
                 K.lists(pa.array(np.concatenate(prefixes).view(np.int64)), np.cumsum(lengths))],
                names=PROFILE.names)

    return profile


def _set_column(width: int):
    @F.arrow_udf(T.BinaryType())
    def as_set(text: pa.Array) -> pa.Array:
        return pa.array([own.tobytes() for data, at in K.chunks(text) for own in sets(data, at, width)], pa.binary())

    return as_set


def needed(percent: int) -> int:
    """How many of the rarest shingles two different but similar sets have in common at
    least: their intersection has percent / (100 - percent) shingles for each that is not
    in it."""
    return max(1, min(SHARED, -(-percent // max(1, 100 - percent))))


def _ties(percent: int):
    """Rows (token, n, node), sorted, to weighted edges (a, b, w): the pairs of lists up to
    ``SHORT`` with weight 1, so that weights count shared tokens; for longer lists, edges
    that connect the list, with full weight: nodes are tied to the first of their run of
    ``FAN``, and that to the first of the run before. A list is cut where sizes leap so far
    that no two sets across can be similar enough."""
    full = needed(percent)
    corners = [np.triu_indices(size, 1) for size in range(SHORT + 1)]

    def pairs(n: np.ndarray, node: np.ndarray, heads: np.ndarray, runs: np.ndarray) -> list:
        out = []
        for size in np.unique(runs[(runs > 1) & (runs <= SHORT)]):
            at = heads[runs == size][:, None]
            i, j = (at + c for c in corners[size])
            near = (n[i] * 100 >= n[j] * percent) & (node[i] != node[j])
            out.append((node[i][near], node[j][near], 1))
        return out

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        held = (none, none, none)  # the last list so far, while it is short
        token, size, place, head = 0, 0, 0, 0  # of a long list that may go on; place 0: none
        for batch in chain(batches, [None]):
            more = held if batch is None else [c.to_numpy() for c in batch.columns]
            t, n, node = (np.concatenate([h, x]) for h, x in zip(held, (none, none, none) if batch is None else more, strict=True))
            held = (none, none, none)
            if not len(t):
                continue
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (n[1:] * percent > n[:-1] * 100)
            goes_on = place > 0 and t[0] == token and n[0] * percent <= size * 100
            heads = np.flatnonzero(new)
            runs = np.diff(np.append(heads, len(t)))
            long = runs > SHORT
            long[0] |= goes_on
            if batch is not None and not long[-1]:
                held = tuple(x[heads[-1]:] for x in (t, n, node))
                heads, runs, long = heads[:-1], runs[:-1], long[:-1]
            edges = pairs(n, node, heads[~long], runs[~long])
            for h, r in zip(heads[long], runs[long], strict=True):
                if h or not goes_on:
                    place = 0
                own = node[h:h + r]
                at = np.arange(place, place + r)
                step = at % FAN
                parent = np.arange(r) - np.where(step == 0, FAN, step)
                a = np.where(parent >= 0, own[np.maximum(parent, 0)], head)
                inner = (at > 0) & (a != own)
                edges.append((a[inner], own[inner], full))
                last = r - 1 - int(step[-1])
                head = int(own[last]) if last >= 0 else head
                place += r
            if not len(long) or not long[-1] or held[0].size:
                place = 0
            token, size = int(t[-1]), int(n[-1])
            a, b, w = (np.concatenate([none, *x]) for x in (
                [e[0] for e in edges], [e[1] for e in edges], [np.full(len(e[0]), e[2]) for e in edges]))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(w)],
                                             names=["a", "b", "w"])

    return tie


def points(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The count vector of every set: how many of its shingles are in each group."""
    row = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    group = (values >> np.uint64(58)).astype(np.int64)
    return np.bincount(row * DIMENSIONS + group, minlength=(len(begin) - 1) * DIMENSIONS).reshape(-1, DIMENSIONS).astype(np.int32)


def similar(values: np.ndarray, begin: np.ndarray, percent: int, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets that join all those whose Jaccard similarity is ``percent`` or
    more, directly or by others; with ``side``, of pairs with one set on each side.

    The sets' count vectors are packed into the leaves of an R-tree by size and by distance
    from their mean. Two sets share at most the sum of the smaller coordinates, and two
    leaves' sets that of their boxes: pairs of leaves, then of points, that can't reach what
    their sizes ask for are left out. So are pairs that other links already join. What is
    left is verified on the sets.
    """
    n = np.diff(begin)
    point = points(values, begin)
    away = np.abs(point - point.mean(axis=0)).sum(axis=1)
    order = np.lexsort((away, n)) if n.max() * percent > n.min() * 100 else np.argsort(away, kind="stable")
    leaves = [order[i:i + LEAF] for i in range(0, len(order), LEAF)]
    high = np.array([point[leaf].max(axis=0) for leaf in leaves])
    least = np.array([n[leaf].min() for leaf in leaves])
    _, dense = np.unique(values, return_inverse=True)
    flag = np.zeros(dense.max() + 1, bool)
    label, links = np.arange(len(n)), []
    for x, leaf in enumerate(leaves):
        bound = np.minimum(high[x], high[x:]).sum(axis=1)
        for y in np.flatnonzero((100 + percent) * bound >= percent * (least[x] + least[x:])) + x:
            other = leaves[y]
            if len(np.union1d(label[leaf], label[other])) == 1:
                continue
            share = np.minimum(point[leaf][:, None, :], point[other][None, :, :]).sum(axis=2)
            can = (100 + percent) * share >= percent * (n[leaf][:, None] + n[other][None, :])
            if side is not None:
                can &= side[leaf][:, None] != side[other][None, :]
            for r in np.flatnonzero(can.any(axis=1)):
                i = leaf[r]
                rest = other[can[r] & (label[other] != label[i])]
                if not len(rest):
                    continue
                flag[dense[begin[i]:begin[i + 1]]] = True
                for j in rest:
                    if label[j] != label[i]:
                        both = int(np.count_nonzero(flag[dense[begin[j]:begin[j + 1]]]))
                        if 100 * both >= percent * (n[i] + n[j] - both):
                            links.append((int(i), int(j)))
                            label[label == label[j]] = label[i]
                flag[dense[begin[i]:begin[i + 1]]] = False
    return links


def _linked(percent: int):
    """Rows (unit, side, node, set), sorted by unit, side and node, to the links (a, b) within
    units. Which of the links that join the same sets are given depends on the order of rows."""
    def solve(rows: list) -> pa.RecordBatch:
        node = np.array([r[0] for r in rows])
        begin = np.concatenate([[0], np.cumsum([len(r[2]) // 8 for r in rows])])
        values = np.frombuffer(b"".join(r[2] for r in rows), np.uint64)
        side = np.array([r[1] for r in rows])
        links = similar(values, begin, percent, side if (side > 0).any() else None) if len(rows) > 1 else []
        a, b = (node[[x[i] for x in links]] if links else np.zeros(0, np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for batch in batches:
            for u, s, x, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if u != unit and rows:
                    yield solve(rows)
                    rows = []
                unit = u
                rows.append((x, s, own))
        if rows:
            yield solve(rows)

    return link


def _boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (label, block, set) to partial boxes (label, block, least, most, high)."""
    found: dict[tuple, list] = {}
    for batch in batches:
        for label, block, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            values = np.frombuffer(own, np.uint64)
            p = points(values, np.array([0, len(values)]))[0]
            box = found.setdefault((label, block), [len(values), len(values), p])
            box[:] = min(box[0], len(values)), max(box[1], len(values)), np.maximum(box[2], p)
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in found], pa.int64()), pa.array([k[1] for k in found], pa.int64()),
         *(pa.array([b[i] for b in found.values()], pa.int64()) for i in (0, 1)),
         pa.array([b[2].tolist() for b in found.values()], pa.list_(pa.int64()))], names=["label", "block", "least", "most", "high"])


def _units(held: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """Rows (unit, side, node, set): components that fit are a unit each; of larger ones, every
    pair of blocks whose boxes leave similar sets possible, the two blocks on a side each."""
    columns = ["unit", "side", "node", "set"]
    small = held.where("block IS NULL").select(F.col("label").cast("string").alias("unit"), F.lit(0).alias("side"), "node", "set")
    if large.isEmpty():
        return small
    big = held.where("block IS NOT NULL")
    parts = big.select("label", "block", "set").mapInArrow(
        _boxes, "label long, block long, least long, most long, high array<long>")
    boxes = stored(parts.groupBy("label", "block").agg(
        F.min("least").alias("least"), F.max("most").alias("most"),
        F.array(*(F.max(F.col("high")[i]) for i in range(DIMENSIONS))).alias("high")), "boxes")
    one = boxes.select("label", F.col("block").alias("x"), F.col("least").alias("lx"), F.col("most").alias("mx"),
                       F.col("high").alias("hx"))
    two = boxes.select("label", F.col("block").alias("y"), F.col("least").alias("ly"), F.col("high").alias("hy"))
    shared = F.aggregate(F.zip_with("hx", "hy", lambda p, q: F.least(p, q)), F.lit(0).cast("long"), lambda s, v: s + v)
    pairs = one.join(two, "label").where("x <= y").where(F.col("mx") * 100 >= F.col("ly") * percent).where((100 + percent) * shared >= percent * (F.col("lx") + F.col("ly")))
    name = F.concat_ws("/", "label", "x", "y").alias("unit")
    sides = stored(pairs.select("label", name, F.explode(F.when(F.col("x") == F.col("y"), F.array(
        F.struct(F.col("x").alias("block"), F.lit(0).alias("side")))).otherwise(F.array(
            F.struct(F.col("x").alias("block"), F.lit(1).alias("side")),
            F.struct(F.col("y").alias("block"), F.lit(2).alias("side"))))).alias("s"))
        .select("label", "unit", "s.block", "s.side"), "block-pairs")
    return small.unionByName(big.join(sides, ["label", "block"]).select(columns))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: its id, text_hash, n_shingles and component_id.

    A-Z are lower-cased; words are runs of anything but ASCII white space; a text's set holds
    its distinct runs of ``width`` words, or all words of a shorter text as one. Sets link
    when 100 * intersection >= percent * union. The component is the smallest id reachable by
    links. Texts without words (or null) link with nothing and have their own id. Null ids
    never are the smallest; a group of only null ids has component null. Repeated rows get
    equal results each. An empty table gives an empty one.

    1. One scan counts shingles in a fixed number of groups, which orders shingles from rare
       to frequent. 2. Equal sets become one node. Two similar sets share three shingles among
       the rarest of each (so many that the rest can't reach the similarity asked for). Nodes
       that do are tied; for this the short lists of the nodes of a shingle are counted by
       pairs, while a long list ties all its nodes in a chain of stars. The connected
       components of the ties hold every link. 3. Each component is joined within itself by
       R-trees over count vectors; one that is too large for a task is cut into blocks, and
       those pairs of blocks are joined whose boxes allow it. 4. The links make the final
       components. No list, set of links or component passes through the driver.

    Nodes and shingles are named by 64-bit hashes.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    profile = _profile(spark, group_counts(docs, width, text_col), width, percent)
    seen = stored(keyed.withColumn("__p", profile(F.col("text"))).select("id", "text_hash", "__p.*"), "profiles")
    nodes = stored(seen.where("n > 0").groupBy("hi", "lo", "n").agg(
        F.min(F.struct(F.isnull("id").alias("none"), "id", "text_hash")).alias("first"),
        F.count(F.lit(1)).alias("docs"), F.first("prefix").alias("prefix")), "sets")
    lists = (nodes.select(F.explode("prefix").alias("token"), "n", F.col("hi").alias("node"))
             .repartition(F.col("token")).sortWithinPartitions("token", "n", "node"))
    shared = lists.mapInArrow(_ties(percent), "a long, b long, w long").groupBy("a", "b").agg(F.sum("w").alias("w"))
    tied = components(shared.where(F.col("w") >= needed(percent)))
    ids = nodes.select(F.col("hi").alias("node"), "n", "first.id", "first.text_hash")
    members = stored(tied.join(ids, "node"), "members")
    sizes = members.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    large = stored(sizes.where((F.col("rows") > UNIT_ROWS) | (F.col("shingles") > UNIT_SHINGLES)).select("label"), "large")
    run = F.coalesce(F.sum(F.col("n") / UNIT_SHINGLES + 1 / UNIT_ROWS).over(_by_size()), F.lit(0.0))
    blocks = members.join(large, "label", "left_semi").withColumn("block", F.floor(run))
    members = blocks.unionByName(members.join(large, "label", "left_anti").withColumn("block", F.lit(None).cast("long")))
    members = stored(members.withColumnsRenamed({"id": "own", "text_hash": "__hash"}), "placed")
    if members.count() <= FEW:
        members = F.broadcast(members)
    found = keyed.join(members, (F.col("text_hash") == F.col("__hash")) & F.col("id").eqNullSafe(F.col("own")))
    held = stored(found.select("label", "block", "node", _set_column(width)(F.col("text")).alias("set")), "node-sets")
    units = _units(held.dropDuplicates(["node"]) if _repeats(held) else held, large, percent)
    ordered = units.select("unit", "side", "node", "set").repartition(F.col("unit")).sortWithinPartitions("unit", "side", "node")
    joined = components(ordered.mapInArrow(_linked(percent), "a long, b long"))
    named = joined.join(ids.select("node", "id"), "node")
    smallest = named.groupBy("label").agg(F.min("id").alias("component_id"))
    named = named.join(smallest, "label").select("node", "component_id")
    key = F.concat(F.hex("hi"), F.hex("lo"))
    groups = stored(nodes.select(key.alias("key"), F.col("hi").alias("node"), "docs", F.col("first.id").alias("alone"))
                    .join(named, "node", "left").select("key", "docs", F.coalesce("component_id", "alone").alias("component_id")),
                    "set-components")
    rows = seen.select("id", "text_hash", F.col("n").alias("n_shingles"), key.alias("key"))
    met = join_groups(rows, "key", groups, "docs", F.xxhash64("id", "text_hash"))
    return met.select(F.col("id").alias(id_col), "text_hash", "n_shingles",
                      F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def _by_size():
    return Window.partitionBy("label").orderBy("n", "node").rowsBetween(Window.unboundedPreceding, -1)


def _repeats(held: DataFrame) -> bool:
    """Whether a row of the input occurs several times, so that a node's set does."""
    counts = held.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("node").alias("nodes")).first()
    return counts["rows"] != counts["nodes"]
