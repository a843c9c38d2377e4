"""Importance resampling towards a target: array-scored weights, exact selection by medians.

Features are runs of words, hashed into buckets. Counts per bucket in the corpus and in the
target give every bucket a gain; a document's weight is the floored mean gain of its
features, and Gumbel noise drawn from its id turns weights into scores, of which the highest
are a sample without replacement. The cutoff among the scores is found by weighted
median-of-medians rounds over stored keys, so the whole table is never sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from attesta.llm.kernels import ALNUM, LOWER, chunks, words
from attesta.llm.scratch import stored

LONG_WORD = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def crc_from(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 of the bytes of each span, continued from ``state`` (the CRC of what came before).

    All spans advance by one byte per step; the few that are longer than ``LONG_WORD`` bytes
    are finished one by one, so steps are bounded whatever the words.
    """
    state = ~state
    size = np.minimum(ends - starts, LONG_WORD)
    order = np.argsort(-size, kind="stable")
    left = np.searchsorted(-size[order], -np.arange(1, LONG_WORD + 1), "right")
    for step, n in enumerate(left):
        if not n:
            break
        at = order[:n]
        state[at] = CRC[(state[at] ^ data[starts[at] + step]) & 0xFF] ^ (state[at] >> np.uint32(8))
    state = ~state
    for i in np.flatnonzero(ends - starts > LONG_WORD):
        state[i] = crc32(data[starts[i] + LONG_WORD:ends[i]].tobytes(), int(state[i]))
    return state


def feature_buckets(data: np.ndarray, at: np.ndarray, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and buckets of all features of a run of texts, and words per row. Features are
    runs of 1 to ``runs`` consecutive words of a row, joined by one space."""
    data = LOWER[data]
    starts, ends, first = words(data, at, ALNUM)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    state = crc_from(data, starts, ends, np.zeros(len(starts), np.uint32))
    rows, found = [row], [state % buckets]
    for n in range(2, runs + 1):
        whole = np.flatnonzero(row[n - 1:] == row[:len(row) - n + 1]) if len(row) >= n else np.zeros(0, np.int64)
        # the run that begins at word i is the shorter run there, a space, and word i + n - 1
        last = whole + n - 1
        before = np.zeros(len(starts), np.uint32)
        before[whole] = ~(CRC[(~state[whole] ^ np.uint32(0x20)) & 0xFF] ^ (~state[whole] >> np.uint32(8)))
        grown = np.zeros(len(starts), np.uint32)
        grown[whole] = crc_from(data, starts[last], ends[last], before[whole])
        state = grown
        rows.append(row[whole])
        found.append(state[whole] % buckets)
    return np.concatenate(rows), np.concatenate(found), np.diff(first)


def bucket_counts(texts: DataFrame, text_col: str, runs: int, buckets: int) -> DataFrame:
    """(bucket, n) over all texts; each task sends one sum per bucket it has met."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data, at in chunks(batch.column(0)):
                total += np.bincount(feature_buckets(data, at, runs, buckets)[1], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    return (texts.select(F.col(text_col)).mapInArrow(count, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, per bucket. Two tables of at most
    ``buckets`` rows come to the driver: the size is a parameter, whatever the data."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, into in ((corpus, s), (target, t)):
        got = counts.toPandas()
        into[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str, text_col: str, runs: int) -> DataFrame:
    """(id, n_words, n_features, weight) of every row: gains are looked up as one array per
    batch and averaged, rounding down."""
    held = docs.sparkSession.sparkContext.broadcast(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = held.value
        for batch in batches:
            done = 0
            for data, at in chunks(batch.column(1)):
                n = len(at) - 1
                row, bucket, n_words = feature_buckets(data, at, runs, len(gain))
                n_features = np.bincount(row, minlength=n)
                total = np.bincount(row, gain[bucket], n).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, n), pa.array(n_words.astype(np.int64)),
                     pa.array(n_features.astype(np.int64)), pa.array(total // np.maximum(n_features, 1))],
                    names=[id_col, "n_words", "n_features", "weight"])
                done += n

    kind = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(
        weigh, f"`{id_col}` {kind}, n_words long, n_features long, weight long")


KEY = ["score", "__id", "__place"]


@dataclass(frozen=True)
class Key:
    """A key in drawing order: higher scores first, then smaller ids (null last), then
    earlier places in the stored table. Places make keys unique."""
    score: int
    id: int | None
    place: int

    def order(self) -> tuple:
        return -self.score, self.id is None, self.id or 0, self.place

    def before(self) -> "F.Column":
        """Whether a row comes strictly before this key."""
        later = F.col("__place") < self.place
        if self.id is None:
            same = F.col("__id").isNotNull() | later
        else:
            same = F.coalesce((F.col("__id") < self.id) | ((F.col("__id") == self.id) & later), F.lit(False))
        return (F.col("score") > self.score) | ((F.col("score") == self.score) & same)


def medians(keys: DataFrame, group: int) -> list[tuple[Key, int]]:
    """The median key and the size of every group of at most ``group`` keys of a task: one
    row per group comes to the driver."""
    def middle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks()
            score, place = (whole.column(c).to_numpy() for c in (0, 2))
            none = whole.column(1).is_null().to_numpy()
            ids = whole.column(1).fill_null(0).to_numpy()
            i = np.lexsort((place, ids, none, -score))[len(score) // 2]
            return pa.RecordBatch.from_arrays(
                [*(whole.column(c).slice(i, 1).combine_chunks() for c in range(3)), pa.array([len(score)], pa.int64())],
                names=[*KEY, "n"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= group:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    rows = keys.select(*KEY).mapInArrow(middle, "score long, __id long, __place long, n long").collect()
    return [(Key(r[0], r[1], r[2]), r[3]) for r in rows]


def weighted_median(found: list[tuple[Key, int]]) -> Key:
    """The first median with at least half of all keys in groups up to it."""
    half, seen = sum(n for _, n in found) / 2, 0
    for key, n in sorted(found, key=lambda x: x[0].order()):
        seen += n
        if seen >= half:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, k: int, base: int = 4096, group: int = 1 << 18) -> Key | None:
    """The ``k``-th key of a stored table with columns score, __id and __place, in drawing
    order; null for k = 0. ``k`` is at most the number of keys.

    Each round takes the weighted median of the groups' medians as pivot. At least a quarter
    of the keys lie on either side of it, so counting the keys before it always discards a
    quarter or more. When a third of the stored keys is left, they are stored anew; the last
    ``base`` or fewer are sorted.
    """
    if not k:
        return None
    left = total = keys.count()
    while left > base:
        pivot = weighted_median(medians(keys, group))
        ahead = keys.where(pivot.before()).count()
        if ahead >= k:
            keys, left = keys.where(pivot.before()), ahead
        elif ahead == k - 1:
            return pivot
        else:
            at = (F.col("score") == pivot.score) & F.col("__id").eqNullSafe(F.lit(pivot.id)) & (F.col("__place") == pivot.place)
            keys, left, k = keys.where(~pivot.before() & ~at), left - ahead - 1, k - ahead - 1
        if left * 3 < total:
            keys, total = stored(keys, "keys"), left
    last = keys.orderBy(F.desc("score"), F.asc_nulls_last("__id"), "__place").limit(k).collect()[-1]
    return Key(last["score"], last["__id"], last["__place"])


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with rank 1, 2, 3 ... in drawing order: sorted by ranges, each partition
    numbered on its own and moved on by the sizes of those before it."""
    order = [F.desc("score"), F.asc_nulls_last("__id"), F.asc("__place")]
    sorted_rows = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                         .withColumn("__at", F.monotonically_increasing_id()), "winners")
    part = F.shiftright("__at", 33)
    sizes = sorted_rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # a row per partition
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    return (sorted_rows.withColumn("__part", part).join(F.broadcast(before), "__part")
            .withColumn("rank", F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1)
            .drop("__part", "__at", "__before"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, runs: int = 1,
             buckets: int = 10_000, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text",
             base: int = 4096, group: int = 1 << 18) -> DataFrame:
    """Weights of all documents towards ``target`` and a sample without replacement:
    (id, n_words, n_features, weight, score, rank), one row for every row of ``docs``.

    Of the documents with at least ``min_words`` words, ``percent`` in a hundred (rounded
    down) with the highest scores have a rank from 1; equal scores go to smaller ids, a null
    id counts last and is hashed as the word ``null``, and rows that repeat an id with the
    same score are ranked in any one order. Null and empty texts have no features, weight 0
    and a score, but no rank. Empty tables give no rows; an empty target has no features.
    Other columns of both tables, whatever their names, are not read.
    """
    corpus = bucket_counts(docs, text_col, runs, buckets)
    gain = gains(corpus, bucket_counts(target, text_col, runs, buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.encode(F.concat(
        F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), "UTF-8"), 256), 1, 8), 16, 10)
    noise = F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))
    scored = stored(weighted(docs, gain, id_col, text_col, runs)
                    .withColumn("score", F.col("weight") + noise)
                    .withColumn("__id", F.col(id_col).cast("long"))
                    .withColumn("__place", F.monotonically_increasing_id()), "scored")
    eligible = scored.where(F.col("n_words") >= min_words)
    keys = eligible.select(*KEY)
    last = cutoff(keys, percent * keys.count() // 100, base, group)
    shown = [id_col, "n_words", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        return scored.select(*shown, none)
    drawn = (F.col("n_words") >= min_words) & (last.before() | (F.col("__place") == last.place))
    return (ranked(scored.where(drawn)).select(*shown, "rank")
            .unionByName(scored.where(~drawn).select(*shown, none)))
