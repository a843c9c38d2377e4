"""Removal of lines that many documents share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm import kernels as K
from attesta.llm.hot import HEADS, join_groups
from attesta.llm.mphf import Index
from attesta.llm.scratch import stored

#: distinct lines per shard of the index, on average
SHARD = 1 << 14


def line_keys(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """All lines (starts, ends, first per row), their keys' 64-bit hashes, and which keys
    are not empty. A key is the line stripped of white space, A-Z lower-cased."""
    starts, ends, first = K.lines(data, at)
    s, e = K.stripped(data, starts, ends)
    return starts, ends, first, K.span_hashes(K.LOWER[data], s, e), e > s


@F.arrow_udf(T.ArrayType(T.LongType()))
def distinct_lines(text: pa.Array) -> pa.Array:
    """Per document the hashes of its distinct line keys that are not empty."""
    values, sizes = [], [np.zeros(1, np.int64)]
    for data, at in K.chunks(text):
        _, _, first, keys, full = line_keys(data, at)
        row = K.row_of(first)[full]
        keys = keys[full]
        order = np.lexsort((keys, row))
        row, keys = row[order], keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
        values.append(keys[new].view(np.int64))
        sizes.append(np.bincount(row[new], minlength=len(at) - 1))
    return K.lists(pa.array(np.concatenate(values) if values else np.zeros(0, np.int64)), np.cumsum(np.concatenate(sizes)))


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()),
                           T.StructField("n_dropped", T.LongType())]))
def without(text: pa.Array, drop: pa.Array) -> pa.Array:
    """Texts without the lines whose hashes are in ``drop``; text is null where none is."""
    out, totals, gone = [], [], []
    row = 0
    for data, at in K.chunks(text):
        starts, ends, first, keys, full = line_keys(data, at)
        totals.extend(np.diff(first).tolist())
        for i in range(len(at) - 1):
            bad = drop[row]
            row += 1
            if not bad.is_valid or not len(bad):
                out.append(None)
                gone.append(0)
                continue
            lo, hi = first[i], first[i + 1]
            out_of = full[lo:hi] & np.isin(keys[lo:hi], bad.values.to_numpy(zero_copy_only=False).view(np.uint64))
            gone.append(int(out_of.sum()))
            kept = np.flatnonzero(~out_of) + lo
            out.append(b"\n".join(data[starts[j]:ends[j]].tobytes() for j in kept).decode("utf-8"))
    return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(totals, pa.int64()), pa.array(gone, pa.int64())],
                                      names=["text", "n_lines", "n_dropped"])


def build_index(counts: DataFrame, shards: int) -> DataFrame:
    """The index of distinct lines (hash, n): one row (shard, index) per shard, a minimal
    perfect hash with its fingerprint and count arrays. Hashes are even, so a shard holds
    about ``SHARD`` of them."""
    def build(key: tuple, rows: pa.Table) -> pa.Table:
        index = Index.build(rows["hash"].to_numpy().view(np.uint64), rows["n"].to_numpy())
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "index": pa.array([index.dump()], pa.binary())})

    return (counts.withColumn("shard", F.pmod("hash", F.lit(shards))).groupBy("shard")
            .applyInArrow(build, "shard long, index binary"))


def probe(index: DataFrame, probes: DataFrame, least: int) -> DataFrame:
    """The rows (shard, hash, key) of ``probes`` whose line is in ``least`` documents or more.

    Rows are dealt out by shard and each task streams them past the arrays of their shard,
    which come first; one shard's arrays are held at a time.
    """
    both = index.select("shard", F.lit(0).alias("kind"), "index", F.lit(None).cast("long").alias("hash"),
                        F.lit(None).cast("string").alias("key")).unionByName(
        probes.select("shard", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("index"), "hash", "key"))
    ordered = both.repartition(F.col("shard")).sortWithinPartitions("shard", "kind")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            kind = batch.column(1).to_numpy()
            heads = np.flatnonzero(kind == 0)
            edges = np.unique(np.concatenate([[0], heads, heads + 1, [len(kind)]])).astype(int)
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if kind[lo] == 0:
                    held = Index.load(batch.column(2)[int(lo)].as_py())
                    continue
                part = batch.slice(lo, hi - lo)
                found = held.count(part.column(3).to_numpy().view(np.uint64)) >= least
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(found)) for c in (part.column(3), part.column(4))],
                                                 names=["hash", "key"])

    return ordered.mapInArrow(scan, "hash long, key string")


def text_key(text: Column) -> Column:
    """128 bits of a text, as a string: what is decided for a text holds for its copies."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(7), text)))


def drop_common_lines(docs: DataFrame, least: int = 10, text_col: str = "text", spread_col: str = "doc_id",
                      copies_once: bool = False) -> DataFrame:
    """All rows and columns of ``docs`` with the text column shortened, n_lines (before) and
    n_dropped.

    A line's key is the line without white space at its ends, A-Z lower-cased. Keys that are
    not empty and found in ``least`` documents or more (255 at most) lose all their lines;
    other lines stay, joined by line feeds. Null and empty texts have one empty line; null
    stays null. With ``copies_once``, documents with the same set of keys count as one, so
    that the lines of a text are not common because of its own copies. Columns named n_lines or n_dropped are replaced; names beginning with two
    underscores are reserved.

    Lines are 64-bit hashes from the first scan on, distinct per document. Counting them
    combines before the shuffle. The distinct ones go into shards of a minimal perfect hash
    with fingerprints and counts; the documents' hashes stream past their shard. Lines in
    more than a thousandth of all documents ask the index once each and their answers are
    broadcast to the scan, so that no shard meets a hot line: there are at most a thousand times as many of these as a
    document has lines on average. Copies of a text ask once. Only the answers go back to
    the documents, in one shuffle of the texts, spread by ``spread_col`` where a text is
    that of many documents.
    """
    if not 1 <= least <= 255:
        raise ValueError("least must be from 1 to 255: counts in the index stop there")
    docs = docs.drop("n_lines", "n_dropped")
    keyed = docs.withColumn("__key", text_key(F.col(text_col)))
    seen = stored(keyed.select("__key", distinct_lines(F.col(text_col)).alias("lines")), "lines")
    counted = seen.select("lines")
    if copies_once:
        own = (F.xxhash64("lines").alias("one"), F.xxhash64(F.lit(7), "lines").alias("two"))
        counted = stored(counted.groupBy(*own).agg(F.first("lines").alias("lines")).select("lines"), "lines-once")
    counts = stored(counted.select(F.explode("lines").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n")),
                    "line-counts")
    shards = max(1, -(-counts.count() // SHARD))
    index = stored(build_index(counts, shards), "line-index")
    total = counted.count()
    place = F.pmod("hash", F.lit(shards)).alias("shard")
    heads = counts.where(F.col("n") * HEADS > total).select("hash")
    common = probe(index, heads.select(place, "hash", F.lit(None).cast("string").alias("key")), least)
    heads = stored(heads.join(common.select("hash", F.lit(True).alias("__bad")), "hash", "left")
                   .withColumnRenamed("hash", "__hash"), "line-heads")
    asked = (seen.select(F.col("__key").alias("key"), F.explode("lines").alias("hash"))
             .join(F.broadcast(heads), F.col("hash") == F.col("__hash"), "left"))
    known = asked.where("__bad").select("hash", "key")
    probes = asked.where("__hash IS NULL").select("hash", "key", place).distinct()
    bad = (known.unionByName(probe(index, probes, least)).groupBy("key")
           .agg(F.collect_set("hash").alias("__drop")))
    weights = seen.groupBy("__key").agg(F.count(F.lit(1)).alias("__docs"))
    groups = stored(weights.join(bad, weights["__key"] == bad["key"], "left").drop("key"), "line-drops")
    met = join_groups(keyed, "__key", groups, "__docs", F.xxhash64(F.col(spread_col)))
    cut = met.withColumn("__cut", without(F.col(text_col), F.col("__drop")))
    return (cut.withColumns({text_col: F.coalesce(F.col("__cut.text"), F.col(text_col)),
                             "n_lines": F.col("__cut.n_lines"), "n_dropped": F.col("__cut.n_dropped")})
            .select(*docs.columns, "n_lines", "n_dropped"))
