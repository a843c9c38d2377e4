"""Toxicity from the nearest labelled examples by exact TF-IDF cosine."""

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

#: letters and digits of lower-cased text, and everything beyond ASCII
WORD = K.ALNUM
#: beginnings of words that are terms as well, in bytes, so inflected forms share a term
STEMS = (4, 5)
BLOCK = 64
FIRST_BLOCKS = 4

VECTOR = T.StructType([T.StructField("terms", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))])
RESULT = T.StructType([
    T.StructField("score", T.DoubleType()),
    T.StructField("evidence", T.ArrayType(T.StructType([
        T.StructField("example", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("label", T.IntegerType())])))])


def _terms(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every term of every row: words, and stems of longer words."""
    starts, ends, first = K.words(data, at, WORD)
    row = K.row_of(first)
    rows, hashes = [row], [K.span_hashes(data, starts, ends)]
    for n in STEMS:
        long = ends - starts > n
        rows.append(row[long])
        hashes.append(K.mix(K.span_hashes(data, starts[long], starts[long] + n) + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(hashes)


def _counted(row: np.ndarray, term: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms per row and their counts: terms, counts, and where rows begin."""
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    new = np.ones(len(row), bool)
    new[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(row)))
    return term[at], counts, np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=rows))])


def _vectors(vocabulary: np.ndarray | None):
    """A column function: the counts of all terms, or of those of a sorted vocabulary, in
    which case terms are places in it."""
    @F.arrow_udf(VECTOR)
    def vectors(text: pa.Array) -> pa.Array:
        terms, counts, sizes = [], [], [np.zeros(1, np.int64)]
        for data, at in K.chunks(text):
            row, term = _terms(data, at)
            if vocabulary is not None:
                row, term = _known(vocabulary, row, term)
            t, c, first = _counted(row, term, len(at) - 1)
            terms.append(t.astype(np.uint64).view(np.int64))
            counts.append(c)
            sizes.append(np.diff(first))
        first = np.cumsum(np.concatenate(sizes))
        t, c = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (terms, counts))
        return pa.StructArray.from_arrays([K.lists(pa.array(t), first), K.lists(pa.array(c), first)], names=["terms", "counts"])

    return vectors


def _known(vocabulary: np.ndarray, row: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(vocabulary):
        return row[:0], np.zeros(0, np.int64)
    slot = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
    own = vocabulary[slot] == term
    return row[own], slot[own]


@dataclass
class Examples:
    """Labelled examples as unit TF-IDF vectors in a block-max inverted index.

    Postings of a term are in the order of the examples, in blocks of ``BLOCK`` examples;
    each term has for each block it occurs in the largest weight there.
    """

    vocabulary: np.ndarray
    idf: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    starts: np.ndarray  # of a term's blocks
    blocks: np.ndarray  # their numbers
    most: np.ndarray  # their largest weights
    at: np.ndarray  # where their postings begin
    examples: np.ndarray  # the postings
    weights: np.ndarray
    silent: float = 0.0  # score of texts without any known term
    votes: np.ndarray | None = None  # calibration: votes and their scores, both ascending
    scores: np.ndarray | None = None

    @classmethod
    def build(cls, vocabulary: np.ndarray, idf: np.ndarray, ids: np.ndarray, labels: np.ndarray,
              example: np.ndarray, term: np.ndarray, weight: np.ndarray) -> Examples:
        order = np.lexsort((example, term))
        example, term, weight = example[order], term[order], weight[order]
        key = term * (len(ids) // BLOCK + 1) + example // BLOCK
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        at = np.append(np.flatnonzero(new), len(key))
        most = np.maximum.reduceat(weight, at[:-1]) if len(key) else np.zeros(0)
        starts = np.searchsorted(term[at[:-1]], np.arange(len(vocabulary) + 1))
        return cls(vocabulary, idf, ids, labels, starts, example[at[:-1]] // BLOCK, most, at, example, weight)

    def unit(self, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        weights = (1 + np.log(counts)) * self.idf[slots]
        return weights / np.sqrt(np.sum(weights * weights))

    def nearest(self, slots: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of largest cosine above 0, ties to the earlier one, exactly.

        A block's bound is the sum of its terms' largest weights. Blocks are scored in order
        of their bounds until no bound left reaches the k-th cosine.
        """
        runs = np.concatenate([np.arange(self.starts[s], self.starts[s + 1]) for s in slots])
        if not len(runs):
            return runs, np.zeros(0)
        own = np.repeat(weights, self.starts[slots + 1] - self.starts[slots])
        block, inverse = np.unique(self.blocks[runs], return_inverse=True)
        bound = np.bincount(inverse, own * self.most[runs])
        order = np.argsort(-bound, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        by = np.argsort(place[inverse], kind="stable")
        runs, own, turn = runs[by], own[by], place[inverse][by]
        found, cosines, done, step = np.zeros(0, np.int64), np.zeros(0), 0, FIRST_BLOCKS
        while done < len(order):
            if len(cosines) >= k and cosines[k - 1] > bound[order[done]] + 1e-9:
                break
            lo, hi = np.searchsorted(turn, (done, done + step))
            r, size = runs[lo:hi], self.at[runs[lo:hi] + 1] - self.at[runs[lo:hi]]
            posting = np.repeat(self.at[r] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            who, back = np.unique(self.examples[posting], return_inverse=True)
            scored = np.bincount(back, np.repeat(own[lo:hi], size) * self.weights[posting])
            fresh = who != without
            found, cosines = np.concatenate([found, who[fresh]]), np.concatenate([cosines, scored[fresh]])
            best = np.lexsort((found, -cosines))[:k]
            found, cosines = found[best], cosines[best]
            done, step = done + step, step * 2
        return found, np.minimum(cosines, 1.0)

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        """The share of label 1 among the neighbours, each weighted by its nearness."""
        near = 1 / (1.05 - cosines)
        return float(np.sum(near * self.labels[found]) / np.sum(near))

    def calibrate(self, slots: list[np.ndarray], counts: list[np.ndarray], k: int) -> None:
        """Turn votes into rates: each example's own vote without itself against its label,
        made monotone by pooling neighbours that are out of order."""
        votes, truth, quiet = [], [], []
        for i, (s, c) in enumerate(zip(slots, counts, strict=True)):
            found, cosines = self.nearest(s, self.unit(s, c), k, without=i) if len(s) else (s, c)
            if len(found):
                votes.append(self.vote(found, cosines))
                truth.append(self.labels[i])
            else:
                quiet.append(self.labels[i])
        self.silent = (sum(quiet) + 0.5 * (sum(self.labels) > 0)) / (len(quiet) + 1)
        pools: list[list[float]] = []
        order = np.argsort(votes, kind="stable")
        for i in order:
            pools.append([votes[i], votes[i], float(truth[i]), 1.0])
            while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
                low, high = pools[-2], pools.pop()
                pools[-1] = [low[0], high[1], low[2] + high[2], low[3] + high[3]]
        self.votes = np.array([x for p in pools for x in (p[0], p[1])])
        self.scores = np.array([p[2] / p[3] for p in pools for _ in range(2)])

    def score(self, vote: float) -> float:
        if not len(self.votes):
            return vote
        return float(np.interp(vote, self.votes, self.scores))


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = 12_000, max_terms: int = 20_000, least_docs: int = 5,
        chi2: float = 25.0, neighbours: int = 15, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic") -> Examples:
    """Examples from at most about ``max_examples`` rows of ``labels`` (id, label), picked by
    a hash of the id, and their texts in ``docs``. The picked labels are few by that
    parameter and are broadcast, so no text is shuffled.

    Terms are words of the lower-cased text and the first bytes of longer ones. Those of
    them that stand out with label 1 in the sample (chi-square above ``chi2``, in
    ``least_docs`` examples or more; the strongest ``max_terms``) make up the space in
    which cosines are taken. Rows without text, id or label are left out. Without examples
    of both labels, every score is the labels' mean (0 without any).
    """
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
    n = marked.count()
    share = 1 << 20 if n <= max_examples else (1 << 20) * max_examples // n
    picked = stored(marked.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share), "example-labels")
    whole = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).dropna()
    rows = stored(whole.join(F.broadcast(picked), "id").withColumn("text", F.lower("text")), "examples")
    counted = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ones, total = counted.get(1, 0), sum(counted.values())
    none, zero = np.zeros(0, np.int64), np.zeros(0)
    if not ones or ones == total:
        out = Examples.build(none.view(np.uint64), zero, none, none, none, none, zero)
        out.silent, out.votes, out.scores = float(bool(ones)), zero, zero
        return out
    term = rows.select("label", F.explode(_vectors(None)(F.col("text"))["terms"]).alias("term"))
    table = term.groupBy("term").agg(F.sum((F.col("label") == 1).cast("double")).alias("a"), F.count(F.lit(1)).alias("df"))
    a, df, n1, n0 = F.col("a"), F.col("df"), F.lit(float(ones)), F.lit(float(total - ones))
    stands = (a * (n0 - (df - a)) - (df - a) * (n1 - a))
    strength = F.lit(float(total)) * stands * stands / (n1 * n0 * df * (F.lit(float(total)) - df))
    chosen = (table.where((df >= least_docs) & (df < total) & (stands > 0)).withColumn("chi2", strength)
              .where(F.col("chi2") > chi2).orderBy(F.col("chi2").desc(), "term").limit(max_terms)).toArrow()
    vocabulary = chosen["term"].to_numpy().view(np.uint64)
    order = np.argsort(vocabulary)
    vocabulary = np.ascontiguousarray(vocabulary[order])
    idf = np.log(total / chosen["df"].to_numpy()[order]) + 1
    vectors = rows.select("id", "label", _vectors(vocabulary)(F.col("text")).alias("v")).select(
        "id", "label", "v.terms", "v.counts").orderBy("id", "label").toArrow()
    ids, y = vectors["id"].to_numpy(), vectors["label"].to_numpy()
    slots = [np.array(x, np.int64) for x in vectors["terms"].to_pylist()]
    counts = [np.array(x, np.float64) for x in vectors["counts"].to_pylist()]
    out = Examples.build(vocabulary, idf, ids, y, none, none, zero)
    weights = [out.unit(s, c) if len(s) else zero for s, c in zip(slots, counts, strict=True)]
    out = Examples.build(vocabulary, idf, ids, y, np.repeat(np.arange(len(ids)), [len(s) for s in slots]),
                         np.concatenate([*slots, none]), np.concatenate([*weights, zero]))
    out.calibrate(slots, counts, neighbours)
    return out


def score(docs: DataFrame, model: Examples, neighbours: int = 15, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with score (0 to 1) and evidence (the neighbours).

    The whole text is scored. Texts that share no term with the examples, null and empty
    ones included, get the rate of label 1 among such examples, and no evidence. The model
    is bounded by its parameters and goes out with the tasks; texts are not shuffled.
    Columns named score or evidence are replaced.
    """
    docs = docs.drop("score", "evidence")
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(RESULT)
    def scored(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = held.value
        for text in parts:
            scores, shown = [], []
            for data, at in K.chunks(text):
                row, slot = _known(own.vocabulary, *_terms(data, at))
                slots, counts, first = _counted(row, slot, len(at) - 1)
                for i in range(len(at) - 1):
                    s, c = slots[first[i]:first[i + 1]], counts[first[i]:first[i + 1]]
                    found, cosines = own.nearest(s, own.unit(s, c), neighbours) if len(s) else (s, c)
                    scores.append(own.score(own.vote(found, cosines)) if len(found) else own.silent)
                    shown.append([{"example": int(own.ids[j]), "cosine": float(x), "label": int(own.labels[j])}
                                  for j, x in zip(found, cosines, strict=True)])
            kind = pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64()), ("label", pa.int32())]))
            yield pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(shown, kind)], names=["score", "evidence"])

    met = docs.withColumn("__s", scored(F.lower(F.col(text_col))))
    return met.select(*docs.columns, F.col("__s.score").alias("score"), F.col("__s.evidence").alias("evidence"))
