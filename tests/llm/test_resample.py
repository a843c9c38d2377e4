import hashlib
import math
import random
import re
from fractions import Fraction
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta.llm.kernels import texts
from attesta.llm.resample import cutoff, feature_buckets, medians, resample, weighted_median


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def features_of(text, runs):
    w = words_of(text)
    return [" ".join(w[i:i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def one_by_one(docs, target, percent, seed, runs, buckets, min_words):
    """The same by plain loops: {(id, text): (n_features, weight, score, rank)}."""
    def counted(chosen):
        out = [0] * buckets
        for text in chosen:
            for f in features_of(text, runs):
                out[crc32(f.encode()) % buckets] += 1
        return out
    s, t = counted([x for _, x in docs]), counted(target)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for place, (i, text) in enumerate(docs):
        f = features_of(text, runs)
        weight = math.floor(Fraction(sum(gain[crc32(x.encode()) % buckets] for x in f), len(f))) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, text, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, place])
    able = sorted((r for r in rows if len(words_of(r[1])) >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[6]))
    for rank, r in enumerate(able[:percent * len(able) // 100], 1):
        r[5] = rank
    return sorted(tuple(r[:1] + r[2:6]) for r in rows)


@pytest.mark.parametrize("runs", [1, 3])
def test_equals_plain_loops(spark, docs_of, odd, runs):
    rng = random.Random(runs)
    vocabulary = ["Ash", "birch", "cedar", "élan", "ÉLAN", "w" * 200, "w" * 199 + "x", "12", "x" * 64, "x" * 65]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 30)))) for i in range(10, 200)]
    rows += [(i, t) for i, t in odd if i not in (7, None)]
    target = ["Birch cedar cedar, élan", "", None, "12 12 " + "w" * 200]
    goal = spark.createDataFrame([(str(i), t, 9) for i, t in enumerate(target)], "item_id string, text string, score int")
    docs = docs_of(rows).withColumns({"score": F.lit("mine"), "rank": F.lit(0), "weight": F.lit(1)})
    got = resample(docs, goal, percent=30, seed=7, runs=runs, buckets=50, min_words=5, base=4, group=16)
    want = one_by_one(rows, target, 30, 7, runs, 50, 5)
    assert sorted((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got.collect()) == want


def test_crc_of_every_run():
    column = pa.array(["a bc  def", None, "", "x", "Ä-b " + "q" * 300 + " c"])
    data, at = texts(column)
    row, bucket, n_words = feature_buckets(data, at, 3, (1 << 32) - 1)
    want = sorted((i, crc32(f.encode()) % ((1 << 32) - 1)) for i, t in enumerate(column.to_pylist()) for f in features_of(t, 3))
    assert sorted(zip(row.tolist(), bucket.tolist())) == want
    assert n_words.tolist() == [len(words_of(t)) for t in column.to_pylist()]


def test_cutoff_is_the_kth_key(spark):
    rng = random.Random(5)
    rows = [(rng.choice([0, 0, 0, 5, rng.randint(-9, 9)]), rng.choice([None, 1, rng.randint(0, 50)]), p) for p in range(500)]
    rows += [(0, None, p) for p in range(500, 900)]  # one key in nearly half of all rows
    keys = spark.createDataFrame(rows, "score long, __id long, __place long").repartition(5)
    ordered = sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0, r[2]))
    for k in (1, 2, 137, 450, 899, 900):
        last = cutoff(keys, k, base=3, group=20)
        assert (last.score, last.id, last.place) == ordered[k - 1]
        assert keys.where(last.before()).count() == k - 1
    assert cutoff(keys, 0) is None


def test_pivot_leaves_a_quarter_on_either_side(spark):
    keys = spark.createDataFrame([(int(x), int(x), int(x)) for x in np.random.default_rng(3).permutation(4000)],
                                 "score long, __id long, __place long").repartition(7)
    ahead = keys.where(weighted_median(medians(keys, 100)).before()).count()
    assert 950 <= ahead <= 3050


def test_empty_tables_repeats_and_null_ids(spark, docs_of):
    none = docs_of([]).select("doc_id", "text")
    goal = spark.createDataFrame([], "item_id string, text string")
    assert resample(none, goal).count() == 0
    rows = [(None, "one two three")] * 3 + [(1, "one two three")] * 4 + [(2, None), (None, None)]
    got = resample(docs_of(rows), goal, percent=100, min_words=1).collect()
    assert len(got) == 9 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 8))
    assert all(r["rank"] is None for r in got if r["n_features"] == 0)
    assert {r["weight"] for r in got if r["doc_id"] == 2} == {0}
