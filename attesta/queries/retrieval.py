"""Vector and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import vectors as V
from attesta.operators import retrieval as R
from attesta.operators import search as S
from attesta.operators import vector_index as VI
from attesta.queries import fixtures as fx
from attesta.queries.checksum import CRC_STEPS, crc_of
from attesta.queries.registry import query

DIGITS = 5


def corpus(spark, sf):
    """Searchable chunks: ready, sparse side null for every 19th."""
    c = fx.token_lists(fx.chunks(spark, sf).filter("status = 'ready'"), "chunk_id")
    return c.withColumn("tokens", F.expr("CASE WHEN chunk_id % 19 > 0 THEN tokens END"))


def asked(spark, sf, flags=True):
    q = fx.token_lists(fx.queries(spark, sf), "query_id")
    return q.join(fx.scope_flags(spark, sf), "query_id") if flags else q


def dense_cte(name="dense", k=120, scope=""):
    return f"""{name} AS (
      SELECT query_id, chunk_id, score, rnk FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rnk FROM (
          SELECT q.query_id, c.chunk_id,
                 round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 5) AS score
          FROM queries q, chunks c
          WHERE c.embedding IS NOT NULL AND c.status = 'ready' {scope}))
      WHERE rnk <= {k})"""


def sparse_cte(name="sparse", k=120, scope=""):
    return f"""{name} AS (
      SELECT query_id, chunk_id, score, rnk FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rnk FROM (
          SELECT q.query_id, c.chunk_id, coalesce(p.score, 0.0) AS score
          FROM queries q CROSS JOIN chunks c LEFT JOIN (
            SELECT qt.query_id, t.chunk_id, sum(qt.w * t.w) AS score
            FROM query_tokens qt JOIN tokens t USING (token) GROUP BY ALL) p
            ON p.query_id = q.query_id AND p.chunk_id = c.chunk_id
          WHERE c.status = 'ready' AND c.chunk_id % 19 > 0 {scope}))
      WHERE rnk <= {k})"""


IN_SCOPE = """AND (EXISTS (SELECT 1 FROM scope_flags f WHERE f.query_id = q.query_id AND f.unscoped)
                   OR EXISTS (SELECT 1 FROM scope s WHERE s.query_id = q.query_id
                              AND s.document_id = c.document_id))"""


def fused_cte(name="fused", dense="dense", sparse="sparse"):
    return f"""{name} AS (
      SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + coalesce(d, s))), 9) AS score,
             max(d) AS dense_rank, max(s) AS sparse_rank
      FROM (SELECT query_id, chunk_id, rnk AS d, NULL::BIGINT AS s FROM {dense}
            UNION ALL SELECT query_id, chunk_id, NULL, rnk FROM {sparse})
      GROUP BY query_id, chunk_id)"""


def hits_cte(name="hits", fused="fused", k=40):
    return f"""{name} AS (
      SELECT h.*, c.document_id, c.text FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS hit_rank
        FROM {fused}) h JOIN chunks c USING (chunk_id)
      WHERE hit_rank <= {k})"""


SEARCH = ("queries", "chunks", "tokens", "query_tokens", "scope", "scope_flags")


def with_ctes(*ctes, body, extra=()):
    return fx.sql(*SEARCH, *extra, body="WITH " + ",\n".join(ctes) + "\n" + body)


# ------------------------------------------------------------------------ vectors

@query("ve1_embed_batches", f"""WITH {CRC_STEPS},
  items AS (SELECT -item_id - 1 AS item_id, text FROM benchmark UNION ALL SELECT doc_id, text FROM documents),
  said AS (SELECT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM items),
  hashed AS (SELECT w, {crc_of("w")} AS h FROM (SELECT DISTINCT w FROM said), crc_step),
  side AS (SELECT item_id, h % 64 AS d, sum(CASE WHEN (h >> 16) & 1 = 1 THEN 1 ELSE -1 END) AS v
           FROM said JOIN hashed USING (w) GROUP BY 1, 2),
  norms AS (SELECT item_id, max(CASE WHEN v <> 0 THEN 1.0::DOUBLE ELSE 0.0 END) AS norm FROM side GROUP BY 1),
  sizes AS (SELECT item_id, count(DISTINCT h % 250002) AS n FROM said JOIN hashed USING (w) GROUP BY 1)
  SELECT item_id, 64 AS dim, coalesce(norm, 0.0) AS norm, coalesce(n, 0)::INTEGER AS n_tokens
  FROM (SELECT item_id FROM items)
       LEFT JOIN norms USING (item_id) LEFT JOIN sizes USING (item_id)""")
def _(spark, sf):
    out = V.embed_batches(fx.table(spark, sf, "benchmark").selectExpr("-item_id - 1 AS item_id", "text").unionByName(
        fx.table(spark, sf, "documents").selectExpr("doc_id AS item_id", "text")))
    return out.select("item_id", F.size("embedding").alias("dim"),
                      F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0),
                                                 lambda a, x: a + x.cast("double") * x)), 4).alias("norm"),
                      F.size("sparse").alias("n_tokens"))


def _weights(spark, sf):
    """token id (as text) -> weight, zeros included, per document"""
    return fx.table(spark, sf, "documents").selectExpr(
        "doc_id AS chunk_id",
        """map_from_entries(transform(sequence(0, cast(doc_id % 9 AS int)), i -> struct(
             cast((i * 37 + doc_id * 11) % 1000 AS string) AS k,
             cast(((i * 7 + doc_id) % 5) * 1234567 / 1000000.0D AS float) AS v))) AS weights""")


_WEIGHTS_SQL = """
  weights AS (SELECT chunk_id, ((i * 37 + chunk_id * 11) % 1000)::INTEGER AS token_id,
                     (((i * 7 + chunk_id) % 5) * 1234567 / 1000000.0::DOUBLE)::FLOAT AS weight
              FROM (SELECT doc_id AS chunk_id, unnest(range(0, doc_id % 9 + 1)) AS i FROM documents)),
  positive AS (SELECT * FROM weights WHERE weight > 0)"""


@query("ve2_normalise_sparse", f"WITH {_WEIGHTS_SQL} SELECT chunk_id, token_id, weight::DOUBLE AS weight FROM positive")
def _(spark, sf):
    return (_weights(spark, sf)
            .select("chunk_id", F.explode(V.normalise_sparse("weights")).alias("token_id", "weight"))
            .withColumn("weight", F.col("weight").cast("double")))


@query("ve3_sparsevec_text", f"""WITH {_WEIGHTS_SQL}
  SELECT doc_id AS chunk_id, coalesce(v, '{{}}/250002') AS vec FROM documents LEFT JOIN (
    SELECT chunk_id, '{{' || string_agg((token_id + 1) || ':' || format('{{:.6g}}', weight::DOUBLE), ','
                                        ORDER BY token_id) || '}}/250002' AS v
    FROM positive GROUP BY chunk_id) ON chunk_id = doc_id""")
def _(spark, sf):
    sparse = V.normalise_sparse("weights")
    return _weights(spark, sf).select("chunk_id", V.sparsevec_text(sparse, V.SPARSE_DIM).alias("vec"))


@query("ve4_cosine", fx.sql("chunks", "topics", body="""
  SELECT chunk_id, round(CASE WHEN c.embedding IS NULL THEN 0.0
         ELSE list_cosine_similarity(c.embedding::DOUBLE[], t.embedding::DOUBLE[]) END, 6) AS sim
  FROM chunks c JOIN topics t ON t.id = c.chunk_id % 200"""))
def _(spark, sf):
    c = fx.chunks(spark, sf)
    t = fx.topics(spark, sf).select("id", F.col("embedding").alias("other"))
    return (c.join(t, t.id == c.chunk_id % 200)
            .select("chunk_id", F.round(V.cosine("embedding", "other"), 6).alias("sim")))


@query("ve5_dense_topk", with_ctes(dense_cte(), body="SELECT * FROM dense"))
def _(spark, sf):
    out = R.dense_topk(asked(spark, sf, False), corpus(spark, sf), 120, digits=DIGITS)
    return out.withColumn("rnk", F.col("rnk").cast("bigint"))


@query("ve6_sparse_topk", with_ctes(sparse_cte(), body="SELECT * FROM sparse"))
def _(spark, sf):
    out = R.sparse_topk(asked(spark, sf, False), corpus(spark, sf), 120, digits=DIGITS)
    return out.withColumn("rnk", F.col("rnk").cast("bigint"))


@query("ve7_approx_dense_topk")
def _(spark, sf):
    """Recall of the index against exact search, and the share of rows read, per question.
    The vectors of the test table are random, so most cells must be probed for most hits."""
    q, c = asked(spark, sf, False), corpus(spark, sf)
    index = VI.build_index(c, 32)
    near = VI.search_index(index, q, 10, 20, digits=DIGITS)
    both = R.dense_topk(q, c, 10, digits=DIGITS).join(
        near.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    sizes = index.rows.groupBy("cell").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("all"))
    read = VI.nearest_cells(index, q, 20).join(sizes, "cell").groupBy("query_id").agg(F.sum("n").alias("n"))
    read = read.join(F.broadcast(total)).select("query_id", (F.col("n") / F.col("all")).alias("read_share"))
    return both.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found")).join(read, "query_id")


@query("ve8_nearest", fx.sql("queries", "topics", body="""
  SELECT query_id, id AS topic_id, similarity FROM (
    SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) rn
    FROM (SELECT q.query_id, t.id,
                 round(list_cosine_similarity(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), 5) AS similarity
          FROM queries q, topics t WHERE t.id % 7 <> 3))
  WHERE rn = 1"""))
def _(spark, sf):
    live = fx.topics(spark, sf).filter("id % 7 <> 3").withColumnRenamed("id", "topic_id")
    return S.nearest(fx.queries(spark, sf), live, left_id="query_id", right_id="topic_id",
                     digits=DIGITS).drop("rnk")


# ---------------------------------------------------------------------- retrieval

@query("rt1_scope_filter", with_ctes(dense_cte(), body=f"""
  SELECT q.query_id, c.chunk_id, q.rnk FROM dense q JOIN chunks c USING (chunk_id)
  WHERE true {IN_SCOPE}"""))
def _(spark, sf):
    chunks = corpus(spark, sf)
    ranked = R.dense_topk(asked(spark, sf, False), chunks, 120, digits=DIGITS)
    rows = ranked.join(chunks.select("chunk_id", "document_id"), "chunk_id")
    return (R.scope_filter(rows, fx.scope(spark, sf), fx.scope_flags(spark, sf))
            .select("query_id", "chunk_id", F.col("rnk").cast("bigint").alias("rnk")))


@query("rt2_ready_filter", fx.sql("chunks", body="""
  SELECT chunk_id, document_id FROM chunks WHERE document_id % 6 <> 1"""))
def _(spark, sf):
    chunks = fx.chunks(spark, sf).select("chunk_id", "document_id")
    documents = chunks.select("document_id").distinct().withColumn(
        "status", F.expr("CASE WHEN document_id % 6 = 1 THEN 'pending' ELSE 'ready' END"))
    return R.ready_filter(chunks, documents)


@query("rt3_candidate_limit", with_ctes(dense_cte(k=100), body="SELECT query_id, chunk_id, rnk FROM dense"))
def _(spark, sf):
    ranked = R.dense_topk(asked(spark, sf, False), corpus(spark, sf), 200, digits=DIGITS)
    return (R.candidate_limit(ranked, R.RERANK_TOP_K)
            .select("query_id", "chunk_id", F.col("rnk").cast("bigint").alias("rnk")))


@query("rt4_rrf_fuse", with_ctes(dense_cte(), sparse_cte(), fused_cte(), body="SELECT * FROM fused"))
def _(spark, sf):
    q, c = asked(spark, sf, False), corpus(spark, sf)
    return R.rrf_fuse(R.dense_topk(q, c, 120, digits=DIGITS), R.sparse_topk(q, c, 120, digits=DIGITS))


@query("rt5_hydrate_hits", with_ctes(
    dense_cte(k=100), fused_cte(sparse="(SELECT * FROM dense WHERE chunk_id % 2 = 0)"), hits_cte(k=10),
    body="SELECT query_id, chunk_id, document_id, score, hit_rank, md5(text) AS digest FROM hits"))
def _(spark, sf):
    q, c = asked(spark, sf, False), corpus(spark, sf)
    dense = R.dense_topk(q, c, 100, digits=DIGITS)
    fused = R.rrf_fuse(dense, dense.filter("chunk_id % 2 = 0"))
    out = R.hydrate_hits(fused, fx.chunks(spark, sf), 10, ["document_id", "text"])
    return out.select("query_id", "chunk_id", "document_id", "score",
                      F.col("hit_rank").cast("bigint").alias("hit_rank"), F.md5("text").alias("digest"))


def search_hits(spark, sf, k=40, scoped=True):
    return R.hybrid_search(asked(spark, sf), corpus(spark, sf), k,
                           scope=fx.scope(spark, sf) if scoped else None, digits=DIGITS)


_HYBRID = (dense_cte(scope=IN_SCOPE), sparse_cte(scope=IN_SCOPE), fused_cte(), hits_cte())
_HIT_COLUMNS = ["query_id", "chunk_id", "document_id", "score", "dense_rank", "sparse_rank", "hit_rank"]


@query("rt6_hybrid_search", with_ctes(*_HYBRID, body=f"""
  SELECT {', '.join(_HIT_COLUMNS)}, length(text) AS n_chars FROM hits"""))
def _(spark, sf):
    return (search_hits(spark, sf).withColumn("n_chars", F.length("text").cast("bigint"))
            .withColumn("hit_rank", F.col("hit_rank").cast("bigint"))
            .select(*_HIT_COLUMNS, "n_chars"))


def rerank_ctes(hits="hits", scored="scored", reranked="reranked", k=10):
    return f"""{scored} AS (
      SELECT h.query_id, h.chunk_id, h.document_id, h.hit_rank,
             n::DOUBLE / greatest(1, m) AS rerank_score
      FROM {hits} h JOIN (
        SELECT h.query_id, h.chunk_id, count(t.token) AS n
        FROM {hits} h LEFT JOIN query_tokens qt ON qt.query_id = h.query_id
             LEFT JOIN tokens t ON t.chunk_id = h.chunk_id AND t.token = qt.token GROUP BY ALL)
        USING (query_id, chunk_id)
      JOIN (SELECT query_id, count(*) AS m FROM query_tokens GROUP BY ALL) USING (query_id)),
    {reranked} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id
        ORDER BY rerank_score DESC, hit_rank) AS rerank_rank FROM {scored}) WHERE rerank_rank <= {k})"""


@query("rt7_rerank", with_ctes(*_HYBRID, rerank_ctes(), body="""
  SELECT query_id, chunk_id, hit_rank, round(rerank_score, 6) AS rerank_score, rerank_rank FROM reranked"""))
def _(spark, sf):
    out = R.rerank(search_hits(spark, sf), fx.queries(spark, sf))
    return out.select("query_id", "chunk_id", F.col("hit_rank").cast("bigint").alias("hit_rank"),
                      F.round("rerank_score", 6).alias("rerank_score"),
                      F.col("rerank_rank").cast("bigint").alias("rerank_rank"))


@query("rt8_dedupe_cap", with_ctes(dense_cte(scope=IN_SCOPE), sparse_cte(scope=IN_SCOPE), fused_cte(), hits_cte(),
  body="""SELECT query_id, chunk_id, hit_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY hit_rank) AS n
    FROM hits) WHERE n <= 2"""))
def _(spark, sf):
    hits = search_hits(spark, sf)
    doubled = hits.unionByName(hits.withColumn("hit_rank", F.col("hit_rank") + 1000))
    return (R.dedupe_cap(doubled, 2)
            .select("query_id", "chunk_id", F.col("hit_rank").cast("bigint").alias("hit_rank")))


_TOPIC_SCOPE = """
  asked_topics AS (SELECT item_id AS query_id, (item_id * 5 + k) % 200 AS topic_id
                   FROM benchmark, (VALUES (0), (50)) t(k) WHERE item_id % 3 <> 0),
  asked_docs AS (SELECT * FROM scope WHERE query_id % 5 <> 0),
  by_topic AS (SELECT DISTINCT query_id, document_id % (SELECT greatest(50, count(*) // 20) FROM documents) AS document_id
               FROM asked_topics JOIN doc_topics USING (topic_id)),
  combined AS (
    SELECT d.query_id, d.document_id FROM asked_docs d WHERE d.query_id % 3 = 0
    UNION SELECT query_id, document_id FROM by_topic WHERE query_id % 4 = 0 OR query_id % 5 = 0
    UNION SELECT d.query_id, d.document_id FROM asked_docs d JOIN by_topic USING (query_id, document_id)
          WHERE d.query_id % 3 <> 0)"""


def _topic_scope(spark, sf):
    bench = fx.table(spark, sf, "benchmark")
    topics = bench.filter("item_id % 3 <> 0").select(
        F.col("item_id").alias("query_id"),
        F.explode(F.expr("transform(array(0, 50), k -> (item_id * 5 + k) % 200)")).alias("topic_id"))
    flags = bench.selectExpr("item_id AS query_id", "item_id % 4 <> 0 AND item_id % 5 <> 0 AS has_documents",
                             "item_id % 3 <> 0 AS has_topics")
    by_doc = fx.doc_topics(spark, sf).selectExpr(f"document_id % {fx.groups(spark, sf)} AS document_id", "topic_id").distinct()
    return R.topic_scope(fx.scope(spark, sf).filter("query_id % 5 <> 0"), topics, by_doc, flags)


@query("rt9_topic_scope", fx.sql("scope", "doc_topics", body=f"WITH {_TOPIC_SCOPE} SELECT * FROM combined"))
def _(spark, sf):
    return _topic_scope(spark, sf)


_BY_TOPIC = """AND (EXISTS (SELECT 1 FROM combined s WHERE s.query_id = q.query_id
                            AND s.document_id = c.document_id)
                    OR (q.query_id % 3 = 0 AND (q.query_id % 4 = 0 OR q.query_id % 5 = 0)))"""


def _direct(spark, sf, scorer):
    """A question with neither documents nor topics is unscoped."""
    q = asked(spark, sf, False).withColumn(
        "unscoped", F.expr("query_id % 3 = 0 AND (query_id % 4 = 0 OR query_id % 5 = 0)"))
    return R.search(q, corpus(spark, sf), _topic_scope(spark, sf), scorer=scorer, digits=DIGITS)


@query("rt10_search", with_ctes(
    _TOPIC_SCOPE, dense_cte(k=100, scope=_BY_TOPIC), sparse_cte(k=100, scope=_BY_TOPIC), fused_cte(),
    hits_cte(k=20), extra=("doc_topics",), body="SELECT query_id, chunk_id, document_id, score, hit_rank FROM hits"))
def _(spark, sf):
    out = _direct(spark, sf, None)
    return out.select("query_id", "chunk_id", "document_id", "score",
                      F.col("hit_rank").cast("bigint").alias("hit_rank"))


@query("rt10_search_reranked", with_ctes(
    _TOPIC_SCOPE, dense_cte(k=100, scope=_BY_TOPIC), sparse_cte(k=100, scope=_BY_TOPIC), fused_cte(),
    hits_cte(k=20), rerank_ctes(k=20), extra=("doc_topics",),
    body="SELECT query_id, chunk_id, document_id, hit_rank, round(rerank_score, 6) AS rerank_score, rerank_rank FROM reranked"))
def _(spark, sf):
    out = _direct(spark, sf, R.overlap_scorer)
    return out.select("query_id", "chunk_id", "document_id", F.col("hit_rank").cast("bigint").alias("hit_rank"),
                      F.round("rerank_score", 6).alias("rerank_score"), F.col("rerank_rank").cast("bigint").alias("rerank_rank"))


def _dead_scope(spark, sf):
    """Every seventh question names only documents that do not exist."""
    return fx.scope(spark, sf).withColumn(
        "document_id", F.expr("CASE WHEN query_id % 7 = 2 THEN -1 - document_id ELSE document_id END"))


_DEAD = IN_SCOPE.replace("AND s.document_id = c.document_id",
                         "AND q.query_id % 7 <> 2 AND s.document_id = c.document_id")


@query("rt11_escalate", with_ctes(
    dense_cte(scope=_DEAD), sparse_cte(scope=_DEAD), fused_cte(), hits_cte(),
    dense_cte("dense_all"), sparse_cte("sparse_all"), fused_cte("fused_all", "dense_all", "sparse_all"),
    hits_cte("hits_all", "fused_all"),
    """hits_wide AS (SELECT * FROM hits_all WHERE query_id IN (SELECT query_id FROM scope)
                  AND query_id NOT IN (SELECT query_id FROM hits))""",
    rerank_ctes(), rerank_ctes("hits_wide", "scored_wide", "reranked_wide"),
    body="""SELECT query_id, chunk_id, hit_rank, rerank_rank, out_of_scope FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rerank_rank) AS n FROM (
        SELECT *, false AS out_of_scope FROM reranked UNION ALL SELECT *, true FROM reranked_wide))
      WHERE n <= CASE WHEN out_of_scope THEN 2 ELSE 4 END"""))
def _(spark, sf):
    """Both searches' hits are reranked before the cap."""
    q, c, s = asked(spark, sf), corpus(spark, sf), _dead_scope(spark, sf)
    hits = R.hybrid_search(q, c, scope=s, digits=DIGITS)
    out = R.escalate(hits, q, s, c, digits=DIGITS, scorer=R.overlap_scorer)
    return out.select("query_id", "chunk_id", F.col("hit_rank").cast("bigint").alias("hit_rank"),
                      F.col("rerank_rank").cast("bigint").alias("rerank_rank"), "out_of_scope")


def _search_sql(name, act, scoped):
    """Hits of the questions of ``act`` (query_id; src: whose words are asked), reranked."""
    inside = "" if not scoped else """AND (a.unscoped OR EXISTS (SELECT 1 FROM scope s WHERE s.query_id = a.query_id
        AND a.query_id % 7 <> 2 AND s.document_id = c.document_id))"""
    ranked = "SELECT query_id, chunk_id, score, rnk FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rnk FROM"
    return [f"""dense_{name} AS ({ranked} (
        SELECT a.query_id, c.chunk_id, round(list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 5) AS score
        FROM {act} a JOIN queries q ON q.query_id = a.src, chunks c
        WHERE c.embedding IS NOT NULL AND c.status = 'ready' {inside})) WHERE rnk <= 100)""",
            f"""sparse_{name} AS ({ranked} (
        SELECT a.query_id, c.chunk_id, coalesce(p.score, 0.0) AS score
        FROM {act} a CROSS JOIN chunks c LEFT JOIN (
          SELECT a.query_id, t.chunk_id, sum(qt.w * t.w) AS score
          FROM {act} a JOIN query_tokens qt ON qt.query_id = a.src JOIN tokens t USING (token) GROUP BY ALL) p
          ON p.query_id = a.query_id AND p.chunk_id = c.chunk_id
        WHERE c.status = 'ready' AND c.chunk_id % 19 > 0 {inside})) WHERE rnk <= 100)""",
            fused_cte(f"fused_{name}", f"dense_{name}", f"sparse_{name}"), hits_cte(f"hits_{name}", f"fused_{name}", 10),
            f"words_{name} AS (SELECT a.query_id, qt.token FROM {act} a JOIN query_tokens qt ON qt.query_id = a.src)",
            rerank_ctes(f"hits_{name}", f"scored_{name}", f"best_{name}").replace("query_tokens", f"words_{name}")]


def _round_sql(n):
    """One round: the scoped search, the widened one where that found nothing, and who goes on."""
    return [*_search_sql(n, f"act{n}", True),
            f"""lost{n} AS (SELECT * FROM act{n} WHERE query_id IN (SELECT query_id FROM scope)
                   AND query_id NOT IN (SELECT query_id FROM hits_{n}))""",
            *_search_sql(f"w{n}", f"lost{n}", False),
            f"""found{n} AS (SELECT *, {n} AS round FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rerank_rank) AS nth FROM (
          SELECT *, false AS wide FROM best_{n} UNION ALL SELECT *, true FROM best_w{n}))
        WHERE nth <= CASE WHEN wide THEN 2 ELSE 4 END)""",
            f"""act{n + 1} AS (SELECT query_id, CASE WHEN stuck THEN src ELSE nsrc END AS src, unscoped OR widen AS unscoped,
                      was_wide OR widen AS widened FROM (
        SELECT *, stuck AND has_scope AND NOT unscoped AND NOT was_wide AS widen FROM (
          SELECT a.*, n.query_id AS nsrc, a.widened OR f.w AS was_wide, trim(n.text) IN ('', o.text) AS stuck,
                 a.query_id IN (SELECT query_id FROM scope) AS has_scope
          FROM act{n} a JOIN (SELECT query_id, bool_or(wide) AS w FROM found{n} GROUP BY 1) f USING (query_id)
               JOIN queries o ON o.query_id = a.src
               JOIN queries n ON n.query_id = a.query_id + CASE (a.query_id + {n}) % 3 WHEN 1 THEN 1 WHEN 2 THEN 0 END))
        WHERE NOT stuck OR widen)"""]


@query("rt12_retry_rounds", with_ctes(
    "act1 AS (SELECT q.query_id, q.query_id AS src, f.unscoped, false AS widened FROM queries q JOIN scope_flags f USING (query_id))",
    *_round_sql(1), *_round_sql(2), *_round_sql(3),
    "every AS (SELECT * FROM found1 UNION ALL SELECT * FROM found2 UNION ALL SELECT * FROM found3)",
    body="""SELECT query_id, round::BIGINT AS round, chunk_id, document_id, rerank_rank,
      query_id IN (SELECT query_id FROM scope) AND NOT EXISTS (SELECT 1 FROM scope s WHERE s.query_id = e.query_id
        AND e.query_id % 7 <> 2 AND s.document_id = e.document_id) AS out_of_scope
    FROM every e JOIN (SELECT query_id, max(round) AS round FROM every GROUP BY 1) USING (query_id, round)"""))
def _(spark, sf):
    """Judgements: a third sufficient; else the next question's text, itself, or blank.
    Every round reranks its hits before the cap."""
    q = asked(spark, sf)
    nxt = asked(spark, sf, False).withColumn("query_id", F.col("query_id") - 1)
    rounds = F.explode(F.array(F.lit(1), F.lit(2)))
    vector = ["text", "embedding", "tokens", "weights"]
    moved = nxt.select("query_id", *vector, rounds.alias("round")).filter("(query_id + round) % 3 = 1")
    same = q.select("query_id", *vector, rounds.alias("round")).filter("(query_id + round) % 3 = 2")
    rewrites = moved.unionByName(same).withColumn("sufficient", F.lit(False))
    out = R.retry_rounds(q, rewrites, _dead_scope(spark, sf), corpus(spark, sf), 10, digits=DIGITS,
                         scorer=R.overlap_scorer)
    return out.select("query_id", "round", "chunk_id", "document_id", "out_of_scope",
                      F.col("rerank_rank").cast("bigint").alias("rerank_rank"))


_FINDINGS_SQL = """
  findings AS (SELECT query_id // 4 AS question_id, query_id % 4 AS subquery, hit_rank, chunk_id, score
               FROM hits)"""


def findings(spark, sf):
    """Four benchmark items act as the sub-queries of one question."""
    return search_hits(spark, sf, 10, scoped=False).selectExpr(
        "query_id div 4 AS question_id", "query_id % 4 AS subquery", "hit_rank", "chunk_id", "document_id",
        "score", "cast(CASE WHEN chunk_id % 2 = 0 THEN 0.5 END AS double) AS rerank_score")


@query("rt13_interleave", with_ctes(dense_cte(k=100), sparse_cte(k=100), fused_cte(), hits_cte(k=10),
                                    _FINDINGS_SQL, body="""
  SELECT question_id, sid, chunk_id, CASE WHEN chunk_id % 2 = 0 THEN 0.5::DOUBLE ELSE score END AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY hit_rank, subquery) AS sid FROM (
      SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY hit_rank, subquery) AS n
      FROM findings) WHERE n = 1) WHERE sid <= 10"""))
def _(spark, sf):
    return R.interleave(findings(spark, sf)).select("question_id", "sid", "chunk_id", "score")


@query("rt14_hydrate_citations", fx.sql("sources", body="""
  SELECT s.message_id, s.sid, s.chunk_id + s.sid % 2 * 1000000000 AS chunk_id, d.n_chars, md5(d.text) AS digest
  FROM sources s LEFT JOIN documents d ON d.doc_id = s.chunk_id + s.sid % 2 * 1000000000"""))
def _(spark, sf):
    cited = fx.sources(spark, sf).selectExpr("message_id", "sid", "chunk_id + sid % 2 * 1000000000 AS chunk_id")
    chunks = fx.table(spark, sf, "documents").selectExpr("doc_id AS chunk_id", "n_chars", "md5(text) AS digest")
    return R.hydrate_citations(cited, chunks, ["n_chars", "digest"])
