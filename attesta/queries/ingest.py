"""Source, ledger and catalog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import catalog as C
from attesta.operators import chunks as K
from attesta.queries import fixtures as fx
from attesta.queries.registry import query
from attesta.sources import files as S
from attesta.sources import ledger as L
from attesta.sources import segments as G

_KIND = """CASE doc_id % 9 WHEN 0 THEN 'pdf' WHEN 1 THEN 'office' WHEN 2 THEN 'hwp' WHEN 3 THEN 'text'
  WHEN 4 THEN 'image' WHEN 5 THEN 'audio' WHEN 6 THEN 'video'
  WHEN 8 THEN CASE WHEN doc_id % 18 = 8 THEN 'image' END END"""


def classified(spark, sf):
    return S.classify_source(fx.files(spark, sf))


@query("io1_classify_source", fx.sql("files", body=f"""
  SELECT doc_id AS file_id, filename, {_KIND} AS source_kind,
         CASE WHEN {_KIND} IS NULL THEN 'unsupported file type' END AS reason
  FROM documents JOIN files ON file_id = doc_id"""))
def _(spark, sf):
    ok, bad = S.split_rejected(classified(spark, sf))
    cols = ["file_id", "filename", "source_kind", "reason"]
    return ok.withColumn("reason", F.lit(None).cast("string")).select(cols).unionByName(bad.select(cols))


@query("io2_is_media", f"""SELECT doc_id AS file_id, ({_KIND}) IN ('audio', 'video') AS is_media
                           FROM documents WHERE {_KIND} IS NOT NULL""")
def _(spark, sf):
    ok, _bad = S.split_rejected(classified(spark, sf))
    return ok.select("file_id", S.is_media("source_kind").alias("is_media"))


@query("io3_size_filter", fx.sql("files", body="""
  SELECT file_id, size_bytes <= 2097 AS accepted, CASE WHEN size_bytes > 2097 THEN 'too large' END AS reason
  FROM files"""))
def _(spark, sf):
    fits, large = S.size_filter(fx.files(spark, sf), 0.002)
    return (fits.select("file_id", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason"))
            .unionByName(large.select("file_id", F.lit(False).alias("accepted"), "reason")))


@query("io4_dedupe_by_hash", fx.sql("files", body="""
  WITH existing AS (SELECT sha256(content) AS sha, min(file_id) + 1000000 AS known FROM files
                    WHERE file_id % 10 = 0 GROUP BY 1),
  first AS (SELECT sha256(content) AS sha, min(file_id) AS first_id FROM files GROUP BY 1)
  SELECT file_id, coalesce(known, first_id) AS document_id, known IS NULL AND file_id = first_id AS is_new
  FROM files JOIN first ON first.sha = sha256(content) LEFT JOIN existing ON existing.sha = first.sha"""))
def _(spark, sf):
    hashed = S.with_hash(fx.files(spark, sf)).select("file_id", "sha256", "arrival")
    existing = (hashed.filter("file_id % 10 = 0").groupBy("sha256")
                .agg((F.min("file_id") + 1000000).alias("document_id")))
    return S.dedupe_by_hash(hashed, existing).select("file_id", "document_id", "is_new")


@query("io5_shard_key", fx.sql("files", body="""
  SELECT file_id, 'originals/' || s[1:2] || '/' || s[3:4] || '/' || s || '.bin' AS key
  FROM (SELECT file_id, sha256(content) AS s FROM files)"""))
def _(spark, sf):
    return S.with_hash(fx.files(spark, sf)).select(
        "file_id", S.shard_key("originals", "sha256", ".bin").alias("key"))


def transcripts(spark, sf):
    seg = fx.segments(spark, sf).withColumn("text", F.expr(
        "CASE WHEN reading_order % 5 = 4 OR document_id % 10 = 7 THEN '  ' ELSE concat(' ', text) END"))
    rows = F.sort_array(F.collect_list(F.struct(
        "reading_order", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "text")))
    return seg.groupBy("document_id").agg(F.to_json(F.struct(F.transform(
        rows, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["text"].alias("text")))
        .alias("segments"))).alias("json"))


@query("io6_read_segments", fx.sql("segments", body="""
  SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY reading_order) - 1 AS reading_order,
         trim(text, E' \\t\\r\\n') AS text, trunc(start_ms / 1000.0::DOUBLE * 1000)::BIGINT AS start_ms,
         trunc(end_ms / 1000.0::DOUBLE * 1000)::BIGINT AS end_ms, NULL AS error
  FROM segments WHERE reading_order % 5 <> 4 AND document_id % 10 <> 7
  UNION ALL
  SELECT DISTINCT document_id, NULL, NULL, NULL, NULL, 'transcription produced no speech segments'
  FROM segments WHERE document_id % 10 = 7"""))
def _(spark, sf):
    segments, failed = G.read_segments(transcripts(spark, sf))
    return (segments.drop("kind").withColumn("error", F.lit(None).cast("string"))
            .unionByName(failed, allowMissingColumns=True))


@query("io7_replace_by_key", fx.sql("lines", body="""
  SELECT document_id, line_no, md5(text) AS digest FROM lines WHERE document_id % 4 <> 1
  UNION ALL SELECT doc_id, n_chars, md5(text) FROM documents WHERE doc_id % 4 = 1"""))
def _(spark, sf):
    stored = fx.lines(spark, sf).select("document_id", "line_no", F.md5("text").alias("digest"))
    new = (fx.table(spark, sf, "documents").filter("doc_id % 4 = 1")
           .selectExpr("doc_id AS document_id", "n_chars AS line_no", "md5(text) AS digest"))
    return L.replace_by_key(stored, new, ["document_id"])


@query("io8_delete_documents", fx.sql("lines", "spans", "doc_topics", body="""
  SELECT 'documents' AS tbl, doc_id AS document_id, count(*) AS n FROM documents WHERE doc_id % 3 > 0 GROUP BY ALL
  UNION ALL SELECT 'elements', document_id, count(*) FROM lines WHERE document_id % 3 > 0 GROUP BY ALL
  UNION ALL SELECT 'chunks', doc_id, count(*) FROM documents WHERE doc_id % 3 > 0 GROUP BY ALL
  UNION ALL SELECT 'spans', chunk_id, count(*) FROM spans WHERE chunk_id % 3 > 0 GROUP BY ALL
  UNION ALL SELECT 'document_topics', document_id, count(*) FROM doc_topics WHERE document_id % 3 > 0 GROUP BY ALL"""))
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"))
    tables = {"documents": docs, "elements": fx.lines(spark, sf),
              "chunks": docs.select("document_id", F.col("document_id").alias("chunk_id")),
              "spans": fx.spans(spark, sf), "document_topics": fx.doc_topics(spark, sf)}
    left = L.delete_documents(tables, docs.filter("document_id % 3 = 0"))
    counts = [df.groupBy(F.lit(name).alias("tbl"),
                         F.col("chunk_id" if name == "spans" else "document_id").alias("document_id"))
              .agg(F.count("*").alias("n")) for name, df in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("io9_outstanding_stages", fx.sql("jobs", body="""
  SELECT d.doc_id AS document_id, s.stage, s.ord::BIGINT AS ord,
         s.ord = min(s.ord) OVER (PARTITION BY d.doc_id) AS is_next
  FROM documents d CROSS JOIN (VALUES ('convert', 1), ('extract', 2), ('chunk', 3), ('embed', 4),
       ('categorize', 5)) s(stage, ord)
  LEFT JOIN jobs j ON j.document_id = d.doc_id AND j.stage = s.stage AND j.status = 'done'
  WHERE j.stage IS NULL"""))
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"))
    return L.outstanding_stages(docs, fx.jobs(spark, sf))


@query("io10_record_stage", fx.sql("jobs", body="""
  WITH old AS (SELECT document_id, stage, status, document_id % 3 + 1 AS attempts,
                      CASE WHEN status = 'failed' THEN 'old error' END AS error, 10::BIGINT AS started_at,
                      20::BIGINT AS finished_at FROM jobs),
  new AS (SELECT doc_id AS document_id, stage, CASE WHEN doc_id % 6 = 0 THEN 'new error' END AS error,
                 100 + doc_id AS started_at, 200 + doc_id AS finished_at
          FROM documents, (VALUES ('embed'), ('categorize')) s(stage) WHERE doc_id % 2 = 0)
  SELECT coalesce(n.document_id, o.document_id) AS document_id, coalesce(n.stage, o.stage) AS stage,
         CASE WHEN n.stage IS NULL THEN o.status WHEN n.error IS NULL THEN 'done' ELSE 'failed' END AS status,
         coalesce(o.attempts, 0) + CASE WHEN n.stage IS NULL THEN 0 ELSE 1 END AS attempts,
         CASE WHEN n.stage IS NULL THEN o.error ELSE n.error END AS error,
         CASE WHEN n.stage IS NULL THEN o.started_at ELSE n.started_at END AS started_at,
         CASE WHEN n.stage IS NULL THEN o.finished_at ELSE n.finished_at END AS finished_at
  FROM old o FULL OUTER JOIN new n ON n.document_id = o.document_id AND n.stage = o.stage"""))
def _(spark, sf):
    old = fx.jobs(spark, sf).selectExpr(
        "document_id", "stage", "status", "document_id % 3 + 1 AS attempts",
        "CASE WHEN status = 'failed' THEN 'old error' END AS error", "10L AS started_at", "20L AS finished_at")
    new = (fx.table(spark, sf, "documents").filter("doc_id % 2 = 0")
           .selectExpr("doc_id AS document_id", "explode(array('embed', 'categorize')) AS stage",
                       "CASE WHEN doc_id % 6 = 0 THEN 'new error' END AS error",
                       "100 + doc_id AS started_at", "200 + doc_id AS finished_at"))
    return L.record_stage(old, new)


@query("io10_failed_chunking", """
  SELECT doc_id AS document_id, CASE WHEN bad THEN 'failed' ELSE 'done' END AS status, 1::BIGINT AS attempts,
         CASE WHEN bad THEN 'no chunks produced (document appears to contain no text)' END AS error,
         CASE WHEN bad THEN 'chunk' ELSE 'embed' END AS next_stage
  FROM (SELECT doc_id, doc_id % 10 IN (4, 7) OR coalesce(trim(text, E' \\t\\r\\n'), '') = '' AS bad FROM documents)""")
def _(spark, sf):
    """Some documents give only a blank chunk and some none: their chunking has failed."""
    docs = fx.table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text")
    chunks = docs.filter("document_id % 10 <> 7").withColumn(
        "text", F.expr("CASE WHEN document_id % 10 = 4 THEN ' \\n' ELSE text END"))
    time = F.lit(None).cast("bigint")
    earlier = docs.select("document_id", F.explode(F.array(F.lit("convert"), F.lit("extract"))).alias("stage")).select(
        "document_id", "stage", F.lit("done").alias("status"), F.lit(1).cast("bigint").alias("attempts"),
        F.lit(None).cast("string").alias("error"), time.alias("started_at"), time.alias("finished_at"))
    results = K.chunk_outcomes(docs, chunks).withColumns({"started_at": time, "finished_at": time})
    jobs = L.record_stage(earlier, results)
    after = L.outstanding_stages(docs, jobs).filter("is_next").select("document_id", F.col("stage").alias("next_stage"))
    return (jobs.filter("stage = 'chunk'").select("document_id", "status", "attempts", "error").join(after, "document_id"))


_CATALOG_SQL = """
  catalog AS (SELECT doc_id AS document_id, 'File_' || (doc_id % 97) || '.pdf' AS filename,
                     CASE doc_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'ready' END AS status,
                     (doc_id * 7919) % 1009 AS created_at,
                     CASE WHEN doc_id % 3 > 0 THEN 'about ' || source || ' in ' || lang END AS summary
              FROM documents)"""


def catalog(spark, sf):
    return fx.table(spark, sf, "documents").selectExpr(
        "doc_id AS document_id", "concat('File_', doc_id % 97, '.pdf') AS filename",
        "CASE doc_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'pending' ELSE 'ready' END AS status",
        "(doc_id * 7919) % 1009 AS created_at",
        "CASE WHEN doc_id % 3 > 0 THEN concat('about ', source, ' in ', lang) END AS summary")


@query("io11_latest_by_name", f"""WITH {_CATALOG_SQL}
  SELECT filename, document_id, created_at FROM (
    SELECT *, row_number() OVER (PARTITION BY filename ORDER BY created_at DESC, document_id DESC) AS rn
    FROM catalog WHERE status = 'ready') WHERE rn = 1""")
def _(spark, sf):
    return S.latest_by_name(catalog(spark, sf))


@query("io12_relabel_scanned", fx.sql("lines", body="""
  SELECT doc_id AS document_id, CASE WHEN doc_id % 3 = 0 THEN 'office' WHEN no_text THEN 'scanned' ELSE 'pdf' END
         AS source_kind
  FROM documents LEFT JOIN (SELECT document_id, bool_and((document_id + page_no) % 3 <> 0) AS no_text
                            FROM lines GROUP BY 1) ON document_id = doc_id"""))
def _(spark, sf):
    docs = fx.table(spark, sf, "documents").selectExpr(
        "doc_id AS document_id", "CASE WHEN doc_id % 3 = 0 THEN 'office' ELSE 'pdf' END AS source_kind")
    pages = (fx.lines(spark, sf).select("document_id", "page_no").distinct()
             .withColumn("has_text_layer", F.expr("(document_id + page_no) % 3 = 0")))
    return S.relabel_scanned(docs, pages)


# ------------------------------------------------------------------------- catalog

@query("ca1_list_documents", fx.sql("doc_topics", body=f"""WITH {_CATALOG_SQL}
  SELECT document_id, filename, created_at FROM catalog
  WHERE status = 'ready' AND filename ILIKE '%LE__%'
    AND document_id IN (SELECT document_id FROM doc_topics WHERE topic_id = 17)
  ORDER BY created_at DESC, document_id DESC LIMIT 200 OFFSET 1"""))
def _(spark, sf):
    topics = fx.doc_topics(spark, sf)
    return (C.list_documents(catalog(spark, sf), topics, topic_id=17, status="ready", q="LE__", offset=1)
            .select("document_id", "filename", "created_at"))


@query("ca2_filter_documents", fx.sql("doc_topics", body=f"""WITH {_CATALOG_SQL}
  SELECT document_id, filename, summary FROM catalog
  WHERE (contains(lower(filename), 'src1') OR contains(lower(coalesce(summary, '')), 'src1'))"""))
def _(spark, sf):
    return (C.filter_documents(catalog(spark, sf), text=" SRC1 ")
            .select("document_id", "filename", "summary"))


_CHANNEL_DOCS_SQL = """
  channel_docs AS (SELECT DISTINCT conv_id AS channel_id, (conv_id * 3 + turn)
                     % (SELECT greatest(50, count(*) // 20) FROM documents) AS document_id
                   FROM conversations WHERE conv_id % 9 > 0)"""


def channel_docs(spark, sf):
    return fx.table(spark, sf, "conversations").filter("conv_id % 9 > 0").selectExpr(
        "conv_id AS channel_id", f"(conv_id * 3 + turn) % {fx.groups(spark, sf)} AS document_id").distinct()


@query("ca3_list_channels", fx.sql("channels", "messages", body=f"""WITH {_CHANNEL_DOCS_SQL}
  SELECT c.channel_id, c.active_leaf_id AS updated_at, coalesce(m.n, 0) AS message_count,
         coalesce(d.n, 0) AS document_count
  FROM channels c LEFT JOIN (SELECT channel_id, count(*) n FROM messages GROUP BY 1) m USING (channel_id)
  LEFT JOIN (SELECT channel_id, count(*) n FROM channel_docs GROUP BY 1) d USING (channel_id)
  WHERE NOT archived"""))
def _(spark, sf):
    out = C.list_channels(fx.channels(spark, sf), fx.messages(spark, sf), channel_docs(spark, sf))
    return out.select("channel_id", F.col("active_leaf_id").alias("updated_at"), "message_count", "document_count")


_DOCUMENTS = "(SELECT greatest(50, count(*) // 20) FROM documents)"
_ADDS = "(turn * 11 + conv_id) % ({n} + 10)"


@query("ca4_update_scope", f"""WITH {_CHANNEL_DOCS_SQL},
  adds AS (SELECT DISTINCT conv_id AS channel_id, {_ADDS.format(n=_DOCUMENTS)} AS document_id FROM conversations),
  removes AS (SELECT channel_id, document_id FROM channel_docs WHERE document_id % 4 = 0
              UNION SELECT channel_id, document_id FROM adds WHERE document_id % 6 = 0)
  SELECT channel_id, document_id, 'scope' AS kind FROM (
    SELECT * FROM channel_docs UNION SELECT * FROM adds WHERE document_id < {_DOCUMENTS}
    EXCEPT SELECT * FROM removes)
  UNION ALL SELECT channel_id, document_id, 'rejected' FROM adds WHERE document_id >= {_DOCUMENTS}""")
def _(spark, sf):
    current = channel_docs(spark, sf)
    adds = fx.table(spark, sf, "conversations").selectExpr(
        "conv_id AS channel_id", f"{_ADDS.format(n=fx.groups(spark, sf))} AS document_id").distinct()
    removes = current.filter("document_id % 4 = 0").union(adds.filter("document_id % 6 = 0")).distinct()
    known = fx.table(spark, sf, "documents").selectExpr(f"doc_id % {fx.groups(spark, sf)} AS document_id").distinct()
    scope, rejected = C.update_scope(current, adds, removes, known)
    return (scope.withColumn("kind", F.lit("scope"))
            .unionByName(rejected.withColumn("kind", F.lit("rejected"))))


@query("ca5_channel_scope", fx.sql("channels", body=f"""WITH {_CHANNEL_DOCS_SQL}
  SELECT d.* FROM channel_docs d JOIN channels c USING (channel_id) WHERE NOT archived"""))
def _(spark, sf):
    return C.channel_scope(channel_docs(spark, sf), fx.channels(spark, sf).filter("NOT archived"))
