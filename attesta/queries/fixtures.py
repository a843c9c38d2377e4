"""Input tables the queries run on, derived from the driver tables.

Every fixture exists twice: as a DataFrame and as SQL for the checking engine. Both
cover the whole source table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.plans.scan import by_position, running

# --------------------------------------------------------------------- SQL side

_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "files": ((), """
        SELECT doc_id AS file_id,
               'file_' || doc_id || CASE doc_id % 9 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx'
                 WHEN 2 THEN '.HWP' WHEN 3 THEN '.txt' WHEN 4 THEN '.png' WHEN 5 THEN '.m4a'
                 WHEN 6 THEN '.mp4' WHEN 7 THEN '.bin' ELSE '' END AS filename,
               CASE doc_id % 18 WHEN 8 THEN 'image/svg' WHEN 17 THEN 'application/zip' END AS mime,
               CAST(strlen(text) AS BIGINT) AS size_bytes, text AS content, doc_id AS arrival
        FROM documents"""),
    "lines": ((), """
        SELECT document_id, pos // 40 + 1 AS page_no, pos // 3 AS block_no, pos AS line_no, text,
               CASE WHEN length(text) <= 30 AND pos % 4 = 0 THEN 18.0 WHEN pos % 5 = 0 THEN 12.0
                    ELSE 11.0 END::DOUBLE AS font_size,
               72.0::DOUBLE AS x0, (72 + 16 * (pos % 40))::DOUBLE AS y0,
               (72 + 4 * length(text))::DOUBLE AS x1, (84 + 16 * (pos % 40))::DOUBLE AS y1
        FROM (SELECT doc_id AS document_id, unnest(range(len(parts)))::BIGINT AS pos,
                     unnest(parts) AS text
              FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""),
    "elements": (("lines",), """
        SELECT document_id, line_no AS reading_order, page_no,
               CASE WHEN line_no % 17 = 11 THEN 'table' WHEN font_size = 18 THEN 'heading'
                    ELSE 'paragraph' END AS kind,
               CASE WHEN line_no % 17 <> 11 AND font_size = 18 AND length(text) % 4 > 0
                    THEN length(text) % 4 END::BIGINT AS level,
               text, x0, y0, x1, y1
        FROM lines WHERE regexp_matches(text, '[^ \\t\\r\\n]')"""),
    "words": (("lines",), """
        SELECT document_id, page_no, line_no, word_no, word,
               (72 + 20 * word_no)::DOUBLE AS x0,
               (72 + 16 * (line_no % 40) + word_no % 3)::DOUBLE AS y0,
               (90 + 20 * word_no)::DOUBLE AS x1,
               (84 + 16 * (line_no % 40) + word_no % 3)::DOUBLE AS y1,
               ((document_id + 13 * word_no) % 100) / 100.0::DOUBLE AS conf
        FROM (SELECT document_id, page_no, line_no, unnest(range(len(ws)))::BIGINT AS word_no,
                     unnest(ws) AS word
              FROM (SELECT document_id, page_no, line_no, string_split(text, ' ') AS ws FROM lines))
        WHERE word <> ''"""),
    "segments": ((), """
        SELECT conv_id AS document_id, turn AS reading_order, text,
               e - 60 * length(text) AS start_ms, e AS end_ms
        FROM (SELECT *, (60 * sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS e
              FROM conversations)"""),
    "chunks": ((), """
        SELECT d.doc_id AS chunk_id, d.doc_id % (SELECT greatest(50, count(*) // 20) FROM documents) AS document_id,
               d.doc_id // (SELECT greatest(50, count(*) // 20) FROM documents) AS ord, d.text,
               e.embedding,
               CASE WHEN d.doc_id % 17 = 0 THEN 'failed' ELSE 'ready' END AS status
        FROM documents d LEFT JOIN embeddings e
          ON e.vec_id = d.doc_id % (SELECT count(*) FROM embeddings) AND d.doc_id % 13 <> 0"""),
    "tokens": ((), """
        SELECT chunk_id, token, count(*)::DOUBLE AS w
        FROM (SELECT doc_id AS chunk_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS token
              FROM documents)
        WHERE length(token) >= 4 GROUP BY ALL"""),
    "queries": ((), """
        SELECT b.item_id AS query_id, b.text, e.embedding
        FROM benchmark b JOIN embeddings e ON e.vec_id = (b.item_id * 7) % (SELECT count(*) FROM embeddings)"""),
    "query_tokens": ((), """
        SELECT query_id, token, count(*)::DOUBLE AS w
        FROM (SELECT item_id AS query_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS token
              FROM benchmark)
        WHERE length(token) >= 4 GROUP BY ALL"""),
    "scope": ((), """
        SELECT item_id AS query_id, document_id
        FROM benchmark, (SELECT DISTINCT doc_id % (SELECT greatest(50, count(*) // 20) FROM documents) AS document_id FROM documents)
        WHERE (item_id + document_id) % 5 = 0 AND item_id % 4 <> 0"""),
    "scope_flags": ((), """
        SELECT item_id AS query_id, item_id % 8 = 0 AS unscoped FROM benchmark"""),
    "topics": ((), """
        SELECT vec_id AS id, 'topic ' || (vec_id % 150) AS name, embedding,
               (vec_id * 37) % 23 AS doc_count
        FROM embeddings"""),
    "doc_topics": ((), """
        SELECT DISTINCT doc_id AS document_id, (doc_id * 7 + k) % 200 AS topic_id
        FROM documents, (VALUES (0), (3), (11)) t(k)"""),
    "cells": ((), """
        SELECT table_id, r, c, text FROM (
          SELECT l_orderkey AS table_id,
                 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
                     l_suppkey, l_extendedprice, l_quantity) AS r,
                 unnest([0, 1, 2])::BIGINT AS c,
                 unnest(['part ' || l_partkey, CAST(floor(l_quantity)::BIGINT AS VARCHAR),
                         CAST(floor(l_extendedprice)::BIGINT AS VARCHAR) || ' won']) AS text
          FROM lineitem)
        UNION ALL
        SELECT table_id, 0::BIGINT, unnest([0, 1, 2])::BIGINT, unnest(['', 'quantity', 'price'])
        FROM (SELECT DISTINCT l_orderkey AS table_id FROM lineitem)"""),
    "messages": ((), """
        SELECT conv_id AS channel_id, conv_id * 1000 + turn AS id,
               CASE WHEN turn = 0 THEN NULL WHEN turn % 4 = 3 THEN conv_id * 1000 + turn - 3
                    ELSE conv_id * 1000 + turn - 1 END AS parent_id,
               role, text AS content, turn AS seq
        FROM conversations"""),
    "channels": ((), """
        SELECT conv_id AS channel_id, max(conv_id * 1000 + turn) AS active_leaf_id,
               conv_id % 5 = 0 AS archived
        FROM conversations GROUP BY conv_id"""),
    "answers": ((), """
        SELECT conv_id * 1000 + turn AS message_id,
               replace(replace(text, '. ', '[S' || (conv_id % 5 + 1) || ']. '), chr(10),
                       '[S' || (turn * 3 % 9) || ']' || chr(10))
                 || '[S' || (turn % 7) || '][S' || (conv_id % 5 + 1) || '].' AS raw
        FROM conversations WHERE role = 'assistant'"""),
    "sources": ((), """
        SELECT m.message_id, s.sid, d.doc_id AS chunk_id, d.doc_id % (SELECT greatest(50, count(*) // 20) FROM documents) AS document_id,
               'file_' || (d.doc_id % (SELECT greatest(50, count(*) // 20) FROM documents)) || '.pdf' AS filename, d.text,
               CASE WHEN d.doc_id % 3 > 0 THEN 'Part ' || (d.doc_id % 3) || ' > Clause ' || s.sid END
                 AS heading_path,
               CASE WHEN d.doc_id % 4 > 0 THEN d.doc_id % 4 END AS page_from,
               CASE WHEN d.doc_id % 4 > 0 THEN d.doc_id % 4 + d.doc_id % 2 END AS page_to,
               CASE WHEN d.doc_id % 4 = 0 AND s.sid < 5 THEN d.doc_id * 61007 END AS t_start_ms,
               s.sid % 2 = 0 AS is_table
        FROM (SELECT conv_id, turn, conv_id * 1000 + turn AS message_id FROM conversations
              WHERE role = 'assistant') m,
             (SELECT unnest(range(1, 6))::BIGINT AS sid) s
        JOIN documents d
          ON d.doc_id = (m.conv_id * 7 + m.turn * 3 + s.sid * 11) % (SELECT count(*) FROM documents)"""),
    "jobs": ((), """
        SELECT doc_id AS document_id, stage, ord,
               CASE WHEN (doc_id + ord) % 6 = 0 THEN 'failed' ELSE 'done' END AS status
        FROM documents, (VALUES ('convert', 1), ('extract', 2), ('chunk', 3), ('embed', 4)) s(stage, ord)
        WHERE ord <= doc_id % 5"""),
    "beats": ((), "SELECT event_type AS channel, user_id, ts FROM events"),
    "spans": (("lines",), """
        SELECT document_id AS chunk_id, line_no AS pos,
               (sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY line_no)
                 - length(text) - 1)::BIGINT AS text_start,
               (sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY line_no) - 1)::BIGINT
                 AS text_end,
               page_no, x0, y0, x1, y1
        FROM lines"""),
    "picks": ((), """
        SELECT doc_id AS chunk_id, doc_id % 50 + CASE WHEN doc_id % 10 = 0 THEN 100000 ELSE 0 END AS s,
               doc_id % 50 + CASE WHEN doc_id % 10 = 0 THEN 100000 ELSE 0 END + 200 AS e
        FROM documents"""),
}


def sql(*names: str, body: str) -> str:
    """``body`` preceded by the common table expressions it uses."""
    done: list[str] = []

    def visit(name: str) -> None:
        for dep in _SQL[name][0]:
            visit(dep)
        if name not in done:
            done.append(name)

    for n in names:
        visit(n)
    head = ",\n".join(f"{n} AS ({_SQL[n][1]})" for n in done)
    body = body.strip()
    for start in ("WITH RECURSIVE", "WITH"):
        if body.startswith(start):
            return f"{start} {head},\n{body[len(start):]}"
    return f"WITH {head}\n{body}"


# ------------------------------------------------------------------- Spark side


def vectors(spark: SparkSession, sf: str) -> int:
    """How many vectors there are; their ids run from 0."""
    return spark.read.parquet(f"{sf}/embeddings.parquet").count()


def groups(spark: SparkSession, sf: str) -> int:
    """Into how many documents the rows of ``documents`` are put, as chunks of them; it grows
    with the table."""
    return max(50, spark.read.parquet(f"{sf}/documents.parquet").count() // 20)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df, "doc_id") if name == "documents" else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash a scan over all cores when its files give fewer tasks than that (one small
    row group). A table of cluster size has many splits and is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def files(spark, sf):
    return files_of(table(spark, sf, "documents"))


def files_of(documents):
    return documents.selectExpr(
        "doc_id AS file_id",
        """concat('file_', doc_id, CASE doc_id % 9 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx'
             WHEN 2 THEN '.HWP' WHEN 3 THEN '.txt' WHEN 4 THEN '.png' WHEN 5 THEN '.m4a'
             WHEN 6 THEN '.mp4' WHEN 7 THEN '.bin' ELSE '' END) AS filename""",
        "CASE doc_id % 18 WHEN 8 THEN 'image/svg' WHEN 17 THEN 'application/zip' END AS mime",
        "cast(octet_length(text) AS bigint) AS size_bytes", "text AS content", "doc_id AS arrival")


def lines(spark, sf):
    parts = table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    return parts.selectExpr(
        "document_id", "cast(pos div 40 + 1 AS bigint) AS page_no", "cast(pos div 3 AS bigint) AS block_no",
        "cast(pos AS bigint) AS line_no", "text",
        """CASE WHEN length(text) <= 30 AND pos % 4 = 0 THEN 18.0D WHEN pos % 5 = 0 THEN 12.0D
                ELSE 11.0D END AS font_size""",
        "72.0D AS x0", "cast(72 + 16 * (pos % 40) AS double) AS y0",
        "cast(72 + 4 * length(text) AS double) AS x1", "cast(84 + 16 * (pos % 40) AS double) AS y1")


def elements(spark, sf):
    return lines(spark, sf).filter(r"text rlike '[^ \\t\\r\\n]'").selectExpr(
        "document_id", "line_no AS reading_order", "page_no",
        """CASE WHEN line_no % 17 = 11 THEN 'table' WHEN font_size = 18 THEN 'heading'
                ELSE 'paragraph' END AS kind""",
        """cast(CASE WHEN line_no % 17 <> 11 AND font_size = 18 AND length(text) % 4 > 0
                THEN length(text) % 4 END AS bigint) AS level""",
        "text", "x0", "y0", "x1", "y1")


def words(spark, sf):
    return (lines(spark, sf)
            .select("document_id", "page_no", "line_no",
                    F.posexplode(F.split("text", " ", -1)).alias("word_no", "word"))
            .filter("word <> ''")
            .selectExpr("document_id", "page_no", "line_no", "cast(word_no AS bigint) AS word_no", "word",
                        "cast(72 + 20 * word_no AS double) AS x0",
                        "cast(72 + 16 * (line_no % 40) + word_no % 3 AS double) AS y0",
                        "cast(90 + 20 * word_no AS double) AS x1",
                        "cast(84 + 16 * (line_no % 40) + word_no % 3 AS double) AS y1",
                        "cast((document_id + 13 * word_no) % 100 AS double) / 100 AS conf"))


def segments(spark, sf):
    conv = table(spark, sf, "conversations")
    summed = running(conv, "conv_id", ["turn"], by_position("turn"),
                     {"chars": ("sum", F.length("text").cast("bigint"))})
    return summed.selectExpr("conv_id AS document_id", "turn AS reading_order", "text",
                             "60 * (chars - length(text)) AS start_ms", "60 * chars AS end_ms")


def chunks(spark, sf):
    docs, emb, n = table(spark, sf, "documents"), table(spark, sf, "embeddings"), groups(spark, sf)
    return (docs.join(emb, (emb.vec_id == docs.doc_id % vectors(spark, sf)) & (docs.doc_id % 13 != 0), "left")
            .selectExpr("doc_id AS chunk_id", f"doc_id % {n} AS document_id",
                        f"doc_id div {n} AS ord", "text", "embedding",
                        "CASE WHEN doc_id % 17 = 0 THEN 'failed' ELSE 'ready' END AS status"))


def _tokens(df, key):
    return (df.select(key, F.explode(F.split(F.lower("text"), "[^a-z]+", -1)).alias("token"))
            .filter("length(token) >= 4")
            .groupBy(key, "token").agg(F.count("*").cast("double").alias("w")))


def tokens(spark, sf):
    return _tokens(table(spark, sf, "documents").withColumnRenamed("doc_id", "chunk_id"), "chunk_id")


def query_tokens(spark, sf):
    return _tokens(table(spark, sf, "benchmark").withColumnRenamed("item_id", "query_id"), "query_id")


def token_lists(df, key):
    """Sparse vectors as parallel arrays built inside the row, without a shuffle."""
    found = F.filter(F.split(F.lower("text"), "[^a-z]+", -1), lambda t: F.length(t) >= 4)
    return (df.withColumn("tokens", found)
            .withColumn("weights", F.transform("tokens", lambda t: F.lit(1.0))))


def queries(spark, sf):
    b, e = table(spark, sf, "benchmark"), table(spark, sf, "embeddings")
    return (b.join(e, e.vec_id == (b.item_id * 7) % vectors(spark, sf))
            .select(F.col("item_id").alias("query_id"), "text", "embedding"))


def scope(spark, sf):
    """Documents each question may use: those congruent with it modulo five."""
    asked = table(spark, sf, "benchmark").filter("item_id % 4 <> 0").selectExpr(
        "item_id AS query_id", "pmod(-item_id, 5) AS residue")
    docs = table(spark, sf, "documents").selectExpr(f"doc_id % {groups(spark, sf)} AS document_id").distinct()
    return (asked.join(docs.withColumn("residue", F.expr("document_id % 5")), "residue")
            .select("query_id", "document_id"))


def scope_flags(spark, sf):
    return table(spark, sf, "benchmark").selectExpr("item_id AS query_id", "item_id % 8 = 0 AS unscoped")


def topics(spark, sf):
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id AS id", "concat('topic ', vec_id % 150) AS name", "embedding",
        "(vec_id * 37) % 23 AS doc_count")


def doc_topics(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.explode(F.array_distinct(F.expr(
            "transform(array(0, 3, 11), k -> (doc_id * 7 + k) % 200)"))).alias("topic_id"))


def cells(spark, sf):
    """A table's header comes out beside its first row, so that one shuffle by table is all."""
    numbered = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "table_id").selectExpr(
        "table_id",
        """cast(row_number() OVER (PARTITION BY table_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice,
             l_quantity) AS bigint) AS r""",
        """array(concat('part ', l_partkey), cast(cast(floor(l_quantity) AS bigint) AS string),
                 concat(cast(floor(l_extendedprice) AS bigint), ' won')) AS texts""")
    rows = numbered.selectExpr("table_id", """inline(IF(r = 1,
        array(struct(0L AS r, array('', 'quantity', 'price') AS texts), struct(r, texts)), array(struct(r, texts))))""")
    return rows.select("table_id", "r", F.posexplode("texts").alias("c", "text")).withColumn("c", F.col("c").cast("bigint"))


def messages(spark, sf):
    return table(spark, sf, "conversations").selectExpr(
        "conv_id AS channel_id", "conv_id * 1000 + turn AS id",
        """CASE WHEN turn = 0 THEN NULL WHEN turn % 4 = 3 THEN conv_id * 1000 + turn - 3
                ELSE conv_id * 1000 + turn - 1 END AS parent_id""",
        "role", "text AS content", "turn AS seq")


def channels(spark, sf):
    return (table(spark, sf, "conversations").groupBy("conv_id")
            .agg(F.max(F.expr("conv_id * 1000 + turn")).alias("active_leaf_id"))
            .selectExpr("conv_id AS channel_id", "active_leaf_id", "conv_id % 5 = 0 AS archived"))


def _assistant(spark, sf):
    return table(spark, sf, "conversations").filter("role = 'assistant'")


def answers(spark, sf):
    return answers_of(_assistant(spark, sf))


def answers_of(assistant):
    return assistant.selectExpr(
        "conv_id * 1000 + turn AS message_id",
        r"""concat(replace(replace(text, '. ', concat('[S', conv_id % 5 + 1, ']. ')), '\n',
                           concat('[S', turn * 3 % 9, ']\n')),
                   '[S', turn % 7, '][S', conv_id % 5 + 1, '].') AS raw""")


def sources(spark, sf):
    docs = table(spark, sf, "documents")
    total, n = docs.agg(F.count("*")).scalar(), groups(spark, sf)
    offered = (_assistant(spark, sf)
               .select(F.expr("conv_id * 1000 + turn").alias("message_id"), "conv_id", "turn",
                       F.explode(F.sequence(F.lit(1), F.lit(5))).alias("sid"))
               .select("message_id", F.col("sid").cast("bigint").alias("sid"),
                       ((F.col("conv_id") * 7 + F.col("turn") * 3 + F.col("sid") * 11) % total)
                       .alias("doc_id")))
    return offered.join(docs, "doc_id").selectExpr(
        "message_id", "sid", "doc_id AS chunk_id", f"doc_id % {n} AS document_id",
        f"concat('file_', doc_id % {n}, '.pdf') AS filename", "text",
        "CASE WHEN doc_id % 3 > 0 THEN concat('Part ', doc_id % 3, ' > Clause ', sid) END AS heading_path",
        "CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 END AS page_from",
        "CASE WHEN doc_id % 4 > 0 THEN doc_id % 4 + doc_id % 2 END AS page_to",
        "CASE WHEN doc_id % 4 = 0 AND sid < 5 THEN doc_id * 61007 END AS t_start_ms",
        "sid % 2 = 0 AS is_table")


def jobs(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.posexplode(F.array(*[F.lit(s) for s in ("convert", "extract", "chunk", "embed")]))
        .alias("i", "stage")).selectExpr(
        "document_id", "stage", "i + 1 AS ord",
        "CASE WHEN (document_id + i + 1) % 6 = 0 THEN 'failed' ELSE 'done' END AS status",
    ).filter("ord <= document_id % 5")


def beats(spark, sf):
    return table(spark, sf, "events").selectExpr("event_type AS channel", "user_id", "ts")


def spans(spark, sf, *more):
    summed = running(lines(spark, sf), "document_id", ["line_no"], by_position("line_no"),
                     {"upto": ("sum", (F.length("text") + 1).cast("bigint"))})
    return summed.selectExpr("document_id AS chunk_id", "line_no AS pos",
                             "upto - length(text) - 1 AS text_start", "upto - 1 AS text_end",
                             "page_no", "x0", "y0", "x1", "y1", *more)


def picks(spark, sf):
    at = "doc_id % 50 + CASE WHEN doc_id % 10 = 0 THEN 100000 ELSE 0 END"
    return table(spark, sf, "documents").selectExpr("doc_id AS chunk_id", f"{at} AS s", f"{at} + 200 AS e")


#: windows of recordings, segment by segment, after WITH RECURSIVE
WINDOWS_SQL = """
  seg AS (SELECT *, trim(text, E' \\t\\r\\n') AS t, row_number() OVER (PARTITION BY document_id ORDER BY reading_order) AS i
          FROM segments WHERE trim(text, E' \\t\\r\\n') <> ''),
  walk AS (SELECT document_id, i, 0::BIGINT AS ord, start_ms AS opened, regexp_matches(t, '([.!?…]|다|요)$') AS closed
           FROM seg WHERE i = 1
           UNION ALL
           SELECT s.document_id, s.i, CASE WHEN new THEN w.ord + 1 ELSE w.ord END,
                  CASE WHEN new THEN s.start_ms ELSE w.opened END, regexp_matches(s.t, '([.!?…]|다|요)$')
           FROM walk w JOIN seg s ON s.document_id = w.document_id AND s.i = w.i + 1,
           LATERAL (SELECT s.end_ms - w.opened > 45000 AND (w.closed OR s.end_ms - w.opened > 72000) AS new)),
  placed AS (SELECT document_id, ord, row_number() OVER w - 1 AS pos, t, start_ms, end_ms,
                    sum(length(t) + 1) OVER w - length(t) - 1 AS a
             FROM walk JOIN seg USING (document_id, i) WINDOW w AS (PARTITION BY document_id, ord ORDER BY i))"""
