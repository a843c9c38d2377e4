"""Language identification with bit-sliced Bloom filters over n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm import kernels as K
from attesta.llm.scratch import stored

GRAMS = (3, 4)
SLOTS = 1 << 20
HASHES = 3
CHUNK = 2 << 20

#: letters of lower-cased text as they are, all else a space
LETTERS = np.full(256, 0x20, dtype=np.uint8)
LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
LETTERS[0x80:] = np.arange(0x80, 0x100)

RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def grams(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the n-byte grams of each row, each row in spaces; grams that are
    all spaces are left out. Places count one space before and after every row."""
    rows = len(at) - 1
    wide = np.full(len(data) + 2 * rows, 0x20, np.uint64)
    wide[np.arange(len(data)) + 2 * np.repeat(np.arange(rows), np.diff(at)) + 1] = LETTERS[data]
    if len(wide) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    packed, blank = np.zeros(len(wide) - n + 1, np.uint64), np.uint64(0)
    for i in range(n):
        packed = packed << np.uint64(8) | wide[i:len(wide) - n + 1 + i]
        blank = blank << np.uint64(8) | np.uint64(0x20)
    own = packed != blank
    starts = at[1:-1] + 2 * np.arange(1, rows)
    for i in range(1, n):  # those that begin in one row and end in the next
        own[np.clip(starts - i, 0, len(own) - 1)] = False
    place = np.flatnonzero(own)
    return place, K.mix(packed[place] + np.uint64(n << 48))


def slots(hashes: np.ndarray, i: int) -> np.ndarray:
    return (hashes >> np.uint64(20 * i) & np.uint64(SLOTS - 1)).astype(np.int64)


@F.arrow_udf(T.ArrayType(T.LongType()))
def distinct_grams(text: pa.Array) -> pa.Array:
    values, sizes = [], [0]
    for data, at in K.chunks(text, CHUNK):
        for i in range(len(at) - 1):
            row = data[at[i]:at[i + 1]]
            own = [grams(row, np.array([0, len(row)]), n)[1] for n in GRAMS]
            values.append(np.unique(np.concatenate(own)).view(np.int64))
            sizes.append(len(values[-1]))
    return K.lists(pa.array(np.concatenate([np.zeros(0, np.int64), *values])), np.cumsum(sizes))


@dataclass
class Filters:
    """For each slot a bit per language, eight to a byte: the filters of all languages, laid
    side by side, so one look returns all languages whose filter has the slot."""

    languages: list[str]
    bits: np.ndarray  # slots x bytes
    wrong: np.ndarray  # per language the rate at which an n-gram it lacks passes
    usual: str

    def counts(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row the number of n-grams, and of those that each language's filter has."""
        rows = len(at) - 1
        edges = at + 2 * np.arange(rows + 1)
        total, hits = np.zeros(rows, np.int64), np.zeros((rows, len(self.languages)), np.int64)
        for n in GRAMS:
            place, hashes = grams(data, at, n)
            first = np.searchsorted(place, edges)
            total += np.diff(first)
            masks = self.bits[slots(hashes, 0)]
            for i in range(1, HASHES):
                masks &= self.bits[slots(hashes, i)]
            for j in range(len(self.languages)):
                sums = np.zeros(len(place) + 1, np.int64)
                np.cumsum(masks[:, j >> 3] >> (j & 7) & 1, out=sums[1:])
                hits[:, j] += np.diff(sums[first])
        return total, hits

    def decide(self, data: np.ndarray, at: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language whose n-grams are most of the row's, and its share of all languages'.

        Of h passes among n n-grams, about (h - n * wrong) / (1 - wrong) are no false ones.
        """
        total, hits = self.counts(data, at)
        likely = np.maximum(0, (hits - total[:, None] * self.wrong) / (1 - self.wrong))
        best, every = likely.argmax(axis=1), likely.sum(axis=1)
        score = np.where(every > 0, likely[np.arange(len(best)), best] / np.maximum(every, 1e-12), 0.0)
        return [self.languages[b] if e > 0 else self.usual for b, e in zip(best, every, strict=True)], score


def fit(labelled: DataFrame, max_docs: int = 1000, least_docs: int = 2, text_col: str = "text",
        lang_col: str = "lang") -> Filters | None:
    """Filters from at most about ``max_docs`` texts of each language, picked by a hash of
    the text.

    An n-gram goes into the filter of a language if ``least_docs`` of its texts have it and
    at least half as large a share of its texts as in the language where that is largest.
    Rows without text or language are left out; None if nothing is left.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    sizes = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(max_docs)) / F.col("n"))
    # a row per language
    picked = (rows.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < share * (1 << 20))
              .select("lang", "n", distinct_grams(F.lower("text")).alias("grams")))
    picked = stored(picked, "language-samples")
    totals = picked.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.max("n").alias("n")).collect()
    if not totals:
        return None
    languages = sorted(r["lang"] for r in totals)
    usual = max(totals, key=lambda r: (r["n"], r["lang"]))["lang"]
    seen = (picked.select("lang", F.explode("grams").alias("gram")).groupBy("lang", "gram")
            .agg(F.count(F.lit(1)).alias("k")))
    ranks = labelled.sparkSession.createDataFrame(
        [(r["lang"], languages.index(r["lang"]), float(r["docs"])) for r in totals], "lang string, j int, docs double")
    rate = F.col("k") / F.col("docs")
    seen = seen.join(F.broadcast(ranks), "lang").withColumn("rate", rate)  # a row per language
    top = seen.groupBy("gram").agg(F.max("rate").alias("top"), F.collect_list(F.struct("j", "k", "rate")).alias("own"))
    kept = top.select("gram", "top", F.explode("own").alias("own")).where(
        (F.col("own.k") >= least_docs) & (F.col("own.rate") * 2 >= F.col("top")))
    at = F.explode(F.array(*(F.shiftrightunsigned("gram", 20 * i).bitwiseAND(SLOTS - 1) for i in range(HASHES))))
    planes = (kept.select(at.alias("slot"), (F.col("own.j") / 8).cast("int").alias("byte"),
                          F.expr("shiftleft(1, own.j % 8)").alias("bit"))
              .groupBy("slot", "byte").agg(F.bit_or("bit").alias("bits"))).toArrow()
    bits = np.zeros((SLOTS, -(-len(languages) // 8)), np.uint8)
    bits[planes["slot"].to_numpy(), planes["byte"].to_numpy()] = planes["bits"].to_numpy()
    fill = np.array([np.mean(bits[:, j >> 3] >> (j & 7) & 1) for j in range(len(languages))])
    return Filters(languages, bits, fill ** HASHES, usual)


def identify(docs: DataFrame, model: Filters | None, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with lang_pred and score (0 to 1).

    The whole text counts. Null texts and texts without a letter are ``und`` with score 0,
    as is everything if nothing was learned. Texts with letters of which no filter knows an
    n-gram get the most frequent language with score 0; ties go to the language first in
    order. The filters have ``SLOTS`` bytes per eight languages and go out with the tasks;
    texts are not shuffled. Columns with the results' names are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def named(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held.value
        for text in parts:
            names, scores = [], [np.zeros(0)]
            for data, at in K.chunks(text, CHUNK):
                n, s = own.decide(data, at)
                names.extend(n)
                scores.append(s)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(scores))],
                                             names=["lang_pred", "score"])

    met = docs.withColumn("__l", named(F.lower(F.col(text_col))))
    letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return met.select(*docs.columns, F.when(letter, F.col("__l.lang_pred")).otherwise(F.lit("und")).alias("lang_pred"),
                      F.when(letter, F.col("__l.score")).otherwise(F.lit(0.0)).alias("score"))
