"""Blocked scans, medians, pointer jumping, greedy leaders and top-k."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.operators import graphs as G
from attesta.operators.graphs import greedy_leaders, greedy_vector_leaders
from attesta.plans.fold import islands
from attesta.plans.jumps import ends, follow, reachable, subtree_sizes
from attesta.plans.quantile import exact_median
from attesta.plans.scan import by_position, number_rows, previous_row, running
from attesta.plans.topk import first_per_key, top_k


def test_running_equals_plain_loop_across_blocks_and_null_keys(spark):
    rng = random.Random(1)
    rows = [(k, p, rng.randint(0, 9)) for k in ("a", None) for p in rng.sample(range(100), 40)]
    df = spark.createDataFrame(rows, "k string, p long, v long")
    got = {(r.k, r.p): (r.s, r.m) for r in running(
        df, "k", ["p"], by_position("p", 7), {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))},
        null_keys=True).collect()}
    for k in ("a", None):
        seen = []
        for _, p, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            seen.append(v)
            assert got[(k, p)] == (sum(seen), max(seen))


def test_previous_row_and_numbers(spark):
    df = spark.createDataFrame([(1, p, p * 10) for p in (3, 9, 4, 20)], "k long, p long, v long")
    prev = previous_row(df, "k", ["p"], by_position("p", 4), F.struct("v"), "prev")
    assert {r.p: r.prev and r.prev.v for r in prev.collect()} == {3: None, 4: 30, 9: 40, 20: 90}
    numbered = number_rows(df, "k", ["p"], by_position("p", 4), "n")
    assert {r.p: r.n for r in numbered.collect()} == {3: 1, 4: 2, 9: 3, 20: 4}


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [3.5, 3.5, 9.25, 1.0], [7.0, 100.0, 7.0, 7.5, 8.0]])
def test_exact_median(spark, values):
    df = spark.createDataFrame([(1, v) for v in values], "k long, v double")
    assert exact_median(df, ["k"], "v").first()["median"] == statistics.median(values)


def _forest(seed, n=60):
    rng = random.Random(seed)
    return {i: (rng.randrange(i) if i and rng.random() < 0.95 else None) for i in range(n)}


@pytest.mark.parametrize("seed", [1, 2])
def test_jumps_equal_walks(spark, seed):
    up = _forest(seed)
    links = spark.createDataFrame(list(up.items()), "node long, nxt long")

    def walk(n):
        while n is not None:
            yield n
            n = up[n]

    starts = spark.createDataFrame([(n,) for n in (59, 40, 0)], "origin long")
    got = {(r.origin, r.node): r.hops for r in follow(starts, links).collect()}
    assert got == {(s, n): h for s in (59, 40, 0) for h, n in enumerate(walk(s))}
    assert {r.node: r.end for r in ends(links).collect()} == {n: list(walk(n))[-1] for n in up}
    below = {n: sum(n in list(walk(m))[1:] for m in up) for n in up}
    assert {r.node: r.below for r in subtree_sizes(links).collect()} == below
    seen = reachable(starts.withColumnRenamed("origin", "node"), links)
    assert {r.node for r in seen.collect()} == {n for s in (59, 40, 0) for n in walk(s)}


def _greedy(order, conflict):
    kept, keeper = [], {}
    for node in order:
        first = next((k for k in kept if conflict(k, node)), None)
        if first is None:
            kept.append(node)
        else:
            keeper[node] = first
    return set(kept), keeper


@pytest.mark.parametrize("seed", range(3))
def test_greedy_leaders_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    n = 40
    order = rng.sample(range(n), n)
    edges = {frozenset(rng.sample(range(n), 2)) for _ in range(70)}
    nodes = spark.createDataFrame([(v, i) for i, v in enumerate(order)], "id long, ord long")
    pairs = spark.createDataFrame([tuple(e) for e in edges], "a long, b long")
    kept, keeper = _greedy(order, lambda a, b: frozenset((a, b)) in edges)
    rows = greedy_leaders(nodes, pairs).collect()
    assert {r.id for r in rows if r.kept} == kept
    assert {r.id: r.keeper for r in rows if not r.kept} == keeper


def test_a_chain_takes_a_logarithm_of_rounds(spark, monkeypatch):
    """Alternating fates along 20,000 nodes, a comb of side nodes, and a diamond."""
    n, rounds, cut = 20_000, [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: rounds.append(1) or cut(df))
    chain = spark.range(1, n).selectExpr("id - 1 AS a", "id AS b")
    comb = spark.range(0, n, 10).selectExpr("id AS a", f"id + {n} AS b")
    diamond = spark.createDataFrame([(n - 1, 2 * n + 1), (n - 1, 2 * n + 2), (2 * n + 1, 2 * n + 3), (2 * n + 2, 2 * n + 3),
                                     (2 * n + 3, 2 * n + 4)], "a long, b long")
    nodes = spark.range(n).union(comb.select("b")).union(diamond.select("b")).distinct().selectExpr("id", "id AS ord")
    rows = greedy_leaders(nodes, chain.union(comb).union(diamond))
    kept = rows.filter("kept")
    assert kept.filter(f"id < {n}").count() == n // 2 and kept.filter(f"id < {n} AND id % 2 = 1").isEmpty()
    assert kept.filter(f"id >= {n} AND id < {2 * n}").isEmpty()  # every side node hangs on a kept one
    assert {r.id - 2 * n for r in kept.filter(f"id > {2 * n}").collect()} == {1, 2, 4}
    assert rows.count() == n + n // 10 + 4 and len(rounds) < 50


@pytest.mark.parametrize("batch", [3, 1000])
def test_vector_leaders_equal_the_loop(spark, batch):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((40, 4)).astype(np.float32)
    vectors[20:25] = vectors[3]
    unit = vectors.astype(np.float64) / np.linalg.norm(vectors.astype(np.float64), axis=1, keepdims=True)
    kept, keeper = _greedy(range(40), lambda a, b: unit[a] @ unit[b] >= 0.6)
    nodes = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(vectors)],
                                  "id long, ord long, embedding array<float>")
    rows = greedy_vector_leaders(nodes, 0.6, batch).collect()
    assert len(rows) == 40
    assert {r.id for r in rows if r.kept} == kept
    assert {r.id: r.keeper for r in rows if not r.kept} == keeper


def test_vector_leaders_along_a_chain_and_in_a_crowd(spark):
    """Each vector of the chain is close to the next only; half of the rows are one vector."""
    turn = lambda i: [float(np.cos(i)), float(np.sin(i))]
    chain = [(i, i, turn(i * 0.02)) for i in range(60)]
    crowd = [(100 + i, i % 3, turn(3.0)) for i in range(60)]
    odd = [(300, 0, [0.0, 0.0]), (301, 0, [0.0, 0.0]), (302, 0, [1.0]), (303, 0, None), (304, -1, turn(2.999))]
    rows = chain + crowd + odd
    order = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    unit = {i: np.float64(np.float32(v)) / np.linalg.norm(np.float64(np.float32(v))) for i, _, v in rows if v and len(v) == 2 and any(v)}
    kept, keeper = _greedy(order, lambda a, b: a in unit and b in unit and unit[a] @ unit[b] >= np.cos(0.025))
    nodes = spark.createDataFrame(rows, "id long, ord long, embedding array<float>")
    got = greedy_vector_leaders(nodes, float(np.cos(0.025)), 8).collect()
    assert len(got) == len(rows)
    assert {r.id for r in got if r.kept} == kept
    assert {r.id: r.keeper for r in got if not r.kept} == keeper


def test_islands_split_only_where_nothing_overlaps(spark):
    rows = [(1, 0.0, 10.0), (1, 5.0, 8.0), (1, 9.0, 20.0), (1, 20.0, 25.0), (1, 700.0, 701.0)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    out = islands(df, ["k"], "a", "b")
    assert [r.island for r in out.orderBy("a").collect()] == [1, 1, 1, 2, 3]


def test_top_k_with_and_without_salt(spark):
    df = spark.range(500).selectExpr("id", "id % 3 AS k", "(id * 7919) % 101 AS v")
    order = [F.desc("v"), F.asc("id")]
    plain = {(r.k, r.id, r.rank) for r in top_k(df, ["k"], order, 5).select("k", "id", "rank").collect()}
    salted = {(r.k, r.id, r.rank) for r in top_k(df, ["k"], order, 5, salt_on=["id"]).select("k", "id", "rank").collect()}
    assert plain == salted and len(plain) == 15


def test_first_per_key(spark):
    df = spark.createDataFrame([(1, 5, "x"), (1, 2, "y"), (2, 9, "z")], "k long, o long, v string")
    assert sorted(map(tuple, first_per_key(df, ["k"], ["o"]).collect())) == [(1, 2, "y"), (2, 9, "z")]
