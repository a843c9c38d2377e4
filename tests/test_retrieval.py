"""Search kernel, fusion, scopes and reranking against plain computation."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.functions import vectors as V
from attesta.operators import retrieval as R
from attesta.operators import search as S
from attesta.operators import vector_index as VI


def corpus(spark, n=90, seed=0):
    rng = np.random.default_rng(seed)
    vectors = rng.standard_normal((n, 5)).astype(np.float32)
    words = [[f"w{rng.integers(12)}" for _ in range(rng.integers(0, 9))] for _ in range(n)]
    rows = [(i, i % 7, v.tolist() if i % 11 else None, w if i % 13 else None, [1.0] * len(w))
            for i, (v, w) in enumerate(zip(vectors, words))]
    df = spark.createDataFrame(rows, "chunk_id long, document_id long, embedding array<float>, "
                                     "tokens array<string>, weights array<double>")
    return rows, df.withColumn("text", F.concat(F.lit("t"), "chunk_id")).repartition(5)


def questions(spark, n=6, seed=9):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(5).astype(np.float32).tolist(), [f"w{rng.integers(12)}" for _ in range(4)],
             [2.0, 1.0, 1.0, 1.0], i % 2 == 0) for i in range(n)]
    df = spark.createDataFrame(rows, "query_id long, embedding array<float>, tokens array<string>, "
                                     "weights array<double>, unscoped boolean")
    return rows, df.withColumn("text", F.concat(F.lit("q"), "query_id"))


def plain(rows, asked, k, allowed=lambda q, d: True):
    out = {}
    for qid, qv, qt, qw, _ in asked:
        dense, sparse = [], []
        for cid, doc, v, toks, _w in rows:
            if not allowed(qid, doc):
                continue
            if v is not None:
                a, b = np.float64(v), np.float64(qv)
                dense.append((-round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 6), cid))
            if toks is not None:
                sparse.append((-float(sum(w for t, w in zip(qt, qw) for u in toks if u == t)), cid))
        out[qid, "dense"] = [c for _, c in sorted(dense)[:k]]
        out[qid, "sparse"] = [c for _, c in sorted(sparse)[:k]]
    return {key: ids for key, ids in out.items() if ids}


def ranked(df):
    got = {}
    for r in df.orderBy("rnk").collect():
        got.setdefault((r.query_id, r.branch), []).append(r.chunk_id)
    return got


@pytest.mark.parametrize("block", [1024, 2])
def test_topk_equals_the_plain_search(spark, block, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", block)
    monkeypatch.setattr(S.grid.groups_of, "__defaults__", (block,))
    rows, df = corpus(spark)
    asked, q = questions(spark)
    got = ranked(S.score_topk(df, q, 7, dense=True, sparse=True, digits=6))
    assert got == plain(rows, asked, 7)


@pytest.mark.parametrize("block", [1024, 2])
def test_scope_restricts_before_ranking(spark, block, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_ROWS", block)
    monkeypatch.setattr(S.grid.groups_of, "__defaults__", (block,))
    rows, df = corpus(spark)
    asked, q = questions(spark)
    pairs = [(i, d) for i in (1, 3) for d in range(7) if (i + d) % 3 == 0]
    scope = spark.createDataFrame(pairs, "query_id long, document_id long")
    got = ranked(S.score_topk(df, q, 7, dense=True, sparse=True, scope=scope, digits=6))
    want = plain(rows, asked, 7, lambda i, d: i % 2 == 0 or (i, d) in pairs)
    assert got == want and not any(k[0] == 5 for k in got)


def test_index_reads_only_the_cells_asked_for(spark, monkeypatch):
    _, df = corpus(spark, 400)
    _, q = questions(spark)
    exact = ranked(S.score_topk(df, q, 10))
    index = VI.build_index(df, 8, sample=100)
    assert index.rows.count() == df.where(F.exists("embedding", lambda x: x != 0)).count()
    dense = lambda out: ranked(out.withColumn("branch", F.lit("dense")))
    assert dense(VI.search_index(index, q, 10, 8)) == exact
    monkeypatch.setattr(VI.grid.groups_of, "__defaults__", (2,))
    assert dense(VI.search_index(index, q, 10, 8)) == exact
    some = VI.search_index(index, q, 10, 3)
    found = sum(len(set(exact[k]) & set(dense(some).get(k, []))) for k in exact)
    assert found >= 0.9 * 60
    one = VI.search_index(index, q.where("query_id = 0"), 10, 2)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN \(\d,\d\)", plan)
    assert VI.search_index(index, q.where("false"), 10, 2).count() == 0


def test_nearest_with_and_without_order(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal((30, 4)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>")
    u = np.float64(v) / np.linalg.norm(np.float64(v), axis=1, keepdims=True)
    sims = u @ u.T
    out = S.nearest(df.withColumnRenamed("id", "left_id"), df.filter("id % 3 = 1").withColumnRenamed("id", "right_id"),
                    earlier=True)
    got = {r.left_id: r.right_id for r in out.collect()}
    assert got == {i: max((j for j in range(1, i + 1, 3)), key=lambda j: sims[i, j]) for i in range(1, 30)}


def test_similar_pairs(spark):
    rng = np.random.default_rng(4)
    v = rng.standard_normal((25, 3)).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<float>")
    u = np.float64(v) / np.linalg.norm(np.float64(v), axis=1, keepdims=True)
    want = {(i, j) for i in range(25) for j in range(i + 1, 25) if 0.3 <= u[i] @ u[j] < 0.7}
    assert {(r.a, r.b) for r in S.similar_pairs(df, 0.3, 0.7).collect()} == want


def test_fusion_is_the_sum_of_reciprocal_ranks(spark):
    dense = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id long, chunk_id long, rnk long")
    sparse = spark.createDataFrame([(1, 6, 1), (1, 7, 2)], "query_id long, chunk_id long, rnk long")
    got = {r.chunk_id: (r.score, r.dense_rank, r.sparse_rank) for r in R.rrf_fuse(dense, sparse).collect()}
    assert got == {5: (round(1 / 61, 9), 1, None), 6: (round(1 / 62 + 1 / 61, 9), 2, 1), 7: (round(1 / 62, 9), None, 2)}


HITS = "query_id long, chunk_id long, document_id long, text string, hit_rank int"


def test_dedupe_and_cap(spark):
    ids = [(1, "a"), (2, "a"), (1, "a"), (3, "a"), (4, "b"), (5, "c")]
    df = spark.createDataFrame([(1, c, ord(d), "", i) for i, (c, d) in enumerate(ids)], HITS)
    order = lambda d: [r.chunk_id for r in d.orderBy("hit_rank").collect()]
    assert order(R.dedupe_cap(df)) == [1, 2, 3, 4, 5]
    assert order(R.dedupe_cap(df, 2)) == [1, 2, 4, 5]


def test_a_failing_scorer_keeps_the_fused_order(spark):
    hits = spark.createDataFrame([(q, q * 10 + i, 0, t, i) for q in (1, 2) for i, t in enumerate(["b", "aaa", "aa"])], HITS)
    asked = spark.createDataFrame([(1, "good"), (2, "bad")], "query_id long, text string")

    def scorer(question, passages):
        if question == "bad":
            raise RuntimeError("scorer is down")
        return [float(len(p)) for p in passages]

    out = R.rerank(hits, asked, scorer, 2).orderBy("query_id", "rerank_rank").collect()
    assert [(r.chunk_id, r.rerank_score) for r in out] == [(11, 3.0), (12, 2.0), (20, None), (21, None)]
    assert [bool(r.rerank_error) for r in out] == [False, False, True, True]


def test_interleaving_equals_taking_turns(spark):
    rng = random.Random(3)
    queues = {s: rng.sample(range(12), rng.randint(0, 8)) for s in range(4)}
    rows = [(1, s, i, c, 0.5, None) for s, q in queues.items() for i, c in enumerate(q)]
    df = spark.createDataFrame(rows, "question_id long, subquery long, hit_rank int, chunk_id long, score double, rerank_score double")
    want, turn = [], 0
    while turn < 9 and len(want) < 10:
        for q in queues.values():
            if turn < len(q) and q[turn] not in want and len(want) < 10:
                want.append(q[turn])
        turn += 1
    assert [r.chunk_id for r in R.interleave(df).orderBy("sid").collect()] == want


def test_sparse_text_form(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, map('40', 2.125D, '11', 0.0625D)), (2, map('0', 3.0D)),
        (3, map('8', 98765432.0D, '6', 0.0D, '19', -1.0D)) t(id, w)""")
    got = [r[0] for r in df.orderBy("id").select(V.sparsevec_text(V.normalise_sparse("w"), 100)).collect()]
    assert got == ["{12:0.0625,41:2.125}/100", "{1:3}/100", "{9:9.87654e+07}/100"]
    empty = spark.sql("SELECT map_from_arrays(array(), array()) w").select(F.col("w").cast("map<int,double>").alias("w"))
    assert empty.select(V.sparsevec_text("w", 250002)).first()[0] == "{}/250002"


def test_cosine_edge_cases(spark):
    df = spark.sql("SELECT array(3f, 4f) a, array(0f, 0f) z, cast(null AS array<float>) n, array() e")
    got = df.select(V.cosine("a", "a"), V.cosine("a", "z"), V.cosine("a", "n"),
                    V.cosine("a", F.col("e").cast("array<float>"))).first()
    assert [round(v, 12) for v in got] == [1.0, 0.0, 0.0, 0.0]


def test_embedding_is_deterministic_across_batches(spark):
    df = spark.createDataFrame([(i, f"word{i % 3} shared") for i in range(40)], "id long, text string")
    one = V.embed_batches(df.coalesce(1), batch=3).orderBy("id").collect()
    two = V.embed_batches(df.repartition(4), batch=16).orderBy("id").collect()
    assert one == two and one[0].sparse == one[3].sparse


def test_retry_stops_when_satisfied_and_widens_when_stuck(spark):
    _, df = corpus(spark)
    _, q = questions(spark, 4)
    q = q.withColumn("unscoped", F.lit(False))
    scope = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (3, 99)], "query_id long, document_id long")
    cols = ["text", "embedding", "tokens", "weights"]
    same = q.filter("query_id = 1").select("query_id", F.lit(1).alias("round"), *cols)
    moved = q.filter("query_id = 2").select("query_id", F.lit(1).alias("round"), F.lit("other").alias("text"), *cols[1:])
    rewrites = same.unionByName(moved).withColumn("sufficient", F.lit(False))
    out = R.retry_rounds(q, rewrites, scope, df, 5)
    seen = {q_: {(r.round, r.out_of_scope) for r in out.filter(F.col("query_id") == q_).collect()} for q_ in range(4)}
    assert seen[0] == {(1, False)}                       # nobody complained
    assert {r for r, _ in seen[1]} == {2} and (2, True) in seen[1]  # same words again: whole corpus
    assert seen[2] == {(2, False)}                       # new words, same documents
    assert seen[3] == {(1, True)}                        # nothing in scope: widened at once


def reranked_and_capped(hits, cap):
    """rerank_hits and dedupe_adjacent of the reference, for one question."""
    out, seen = [], {}
    for r in sorted(hits, key=lambda r: (-float(r.text[1:]), r.hit_rank))[:10]:
        seen[r.document_id] = seen.get(r.document_id, 0) + 1
        if seen[r.document_id] <= cap:
            out.append(r.chunk_id)
    return out


def test_rounds_rerank_before_the_cap(spark):
    def by_number(question, passages):  # far from the fused order
        return [float(p[1:]) for p in passages]

    _, df = corpus(spark)
    df = df.withColumn("document_id", F.col("document_id") % 3)
    _, q = questions(spark, 4)
    q = q.withColumn("unscoped", F.col("query_id") == 0)
    scope = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 99)], "query_id long, document_id long")
    inside, wide = R.hybrid_search(q, df, 40, scope=scope).cache(), {}
    for r in R.hybrid_search(q, df, 40).collect():
        wide.setdefault(r.query_id, []).append(r)
    own = {i: [r for r in inside.collect() if r.query_id == i] for i in range(4)}
    want = {i: reranked_and_capped(own[i], 4) for i in range(3)} | {3: reranked_and_capped(wide[3], 2)}

    def ids(out, i):
        return [r.chunk_id for r in out.filter(F.col("query_id") == i).orderBy("rerank_rank").collect()]

    out = R.escalate(inside, q, scope, df, scorer=by_number)
    assert {i: ids(out, i) for i in range(4)} == want and all(want.values())
    fused = R.escalate(inside, q, scope, df)
    assert any({r.chunk_id for r in fused.filter(F.col("query_id") == i).collect()} != set(want[i]) for i in range(4))
    same = q.filter("query_id = 2").select("query_id", F.lit(1).alias("round"), F.lit(False).alias("sufficient"),
                                           "text", "embedding", "tokens", "weights")
    out = R.retry_rounds(q, same, scope, df, scorer=by_number)
    want[2] = reranked_and_capped(wide[2], 4)  # stuck: the second round sees the whole corpus
    assert {i: ids(out, i) for i in range(4)} == want
