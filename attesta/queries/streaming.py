"""Streaming queries, run over the tables as bounded streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.queries import fixtures as fx
from attesta.queries.citations import _PARSED
from attesta.queries.registry import query
from attesta.queries.topics import _GREEDY, _TOPICS_SQL, MERGE, aliases, bridge, topics
from attesta.streaming import ingest as I
from attesta.streaming import live as L
from attesta.streaming import markers as M
from attesta.streaming import turns as U
from attesta.streaming.runtime import drain, work_dir


def stream_of(spark, sf, name):
    """A table as a stream of its files: one file, or a folder of parts. The path is a pattern,
    since a stream's plain path has to be a folder."""
    schema = fx.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf}/{name}[.]parquet")


def deltas(answers, sources):
    """Answers cut into pieces of 1, 2, 3, 5, 7 or 50 characters."""
    size = F.expr("element_at(array(1, 2, 3, 5, 7, 50), cast(message_id % 6 + 1 AS int))")
    offered = sources.groupBy("message_id").agg(F.collect_set(F.col("sid").cast("int")).alias("offered"))
    pieces = answers.join(offered, "message_id").withColumn("__n", size).withColumn(
        "__last", F.expr("(length(raw) - 1) div __n"))
    return pieces.select("message_id", "raw", "offered", "__n", "__last",
                         F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__last"))).alias("seq")).select(
        "message_id", "seq", F.expr("substr(raw, cast(seq * __n + 1 AS int), __n)").alias("delta"),
        (F.col("seq") == F.col("__last")).alias("final"), "offered")


@query("st1_stream_markers", fx.sql("answers", "sources", body=f"""WITH {_PARSED},
  n AS (SELECT message_id, count(*) AS n_cited FROM idx GROUP BY 1),
  r AS (SELECT message_id, count(*) AS n_rejected FROM rejected GROUP BY 1)
  SELECT message_id, body, coalesce(n_cited, 0) AS n_cited, coalesce(n_rejected, 0) AS n_rejected
  FROM parsed LEFT JOIN n USING (message_id) LEFT JOIN r USING (message_id)"""))
def _(spark, sf):
    assistant = stream_of(spark, sf, "conversations").filter("role = 'assistant'")
    raw = fx.answers_of(assistant)
    out = drain(M.stream_markers(deltas(raw, fx.sources(spark, sf)), idle_ms=0), "markers")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "text"))), lambda r: r["text"]), "")
    return out.groupBy("message_id").agg(
        body.alias("body"), F.sum(F.size("cited")).alias("n_cited"), F.sum(F.size("rejected")).alias("n_rejected"))


def turn_events(spark, sf):
    """A turn per assistant message: a step, its lines as tokens, citations, perhaps a
    revision after the third line, and the end."""
    m = fx.table(spark, sf, "conversations").filter("role = 'assistant'").selectExpr(
        "conv_id * 1000 + turn AS message_id", "split(text, '\\n', -1) AS parts")
    step = m.selectExpr("message_id", "0L AS seq", "'step' AS event",
                        "to_json(named_struct('ord', 1, 'node', 'plan', 'label', concat('l', message_id))) AS data")
    token = m.select("message_id", F.posexplode("parts").alias("i", "t")).selectExpr(
        "message_id", "10L + i * 2 AS seq", "'token' AS event", "to_json(named_struct('text', t)) AS data")
    cite = m.selectExpr("message_id", "11L AS seq", "'citation' AS event",
                        "to_json(named_struct('idx', 1, 'sid', message_id % 5)) AS data")
    revision = m.filter("message_id % 3 = 0").selectExpr(
        "message_id", "15L AS seq", "'revision' AS event",
        """to_json(named_struct('text', concat('revised ', message_id), 'citations',
             array(named_struct('idx', 2, 'sid', 9)))) AS data""")
    done = m.selectExpr(
        "message_id", "100000L AS seq", "CASE WHEN message_id % 7 = 0 THEN 'error' ELSE 'done' END AS event",
        """CASE WHEN message_id % 7 = 0 THEN to_json(named_struct('message', 'lost'))
           ELSE to_json(named_struct('rejected', array(message_id % 4))) END AS data""")
    return step.unionByName(token).unionByName(cite).unionByName(revision).unionByName(done)


_TURNS = """
  m AS (SELECT conv_id * 1000 + turn AS message_id, string_split(text, chr(10)) AS parts FROM conversations
        WHERE role = 'assistant'),
  turns AS (SELECT message_id,
      CASE WHEN message_id % 3 = 0 THEN 'revised ' || message_id || array_to_string(parts[4:], '')
           ELSE array_to_string(parts, '') END AS content,
      CASE WHEN message_id % 7 = 0 THEN 'failed' ELSE 'complete' END AS status,
      CASE WHEN message_id % 7 = 0 THEN 'lost' END AS error,
      CASE WHEN message_id % 7 = 0 THEN '' ELSE (message_id % 4)::VARCHAR END AS rejected,
      CASE WHEN message_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS n_citations FROM m)"""


@query("st2_fold_turn", f"WITH {_TURNS} SELECT * FROM turns")
def _(spark, sf):
    messages, cited, _steps = U.fold_turn(turn_events(spark, sf))
    n = cited.groupBy("message_id").agg(F.count("*").alias("n_citations"))
    return (messages.withColumn("rejected", F.array_join(F.col("rejected").cast("array<string>"), ","))
            .join(n, "message_id"))


def numbered_events(m):
    """The events of ``turn_events``, numbered from 0, from assistant messages (also a stream)."""
    event = lambda name, data: f"named_struct('event', '{name}', 'data', to_json({data}))"
    end = (f"IF(message_id % 7 = 0, {event('error', "named_struct('message', 'lost')")}, "
           f"{event('done', "named_struct('rejected', array(message_id % 4), 'run_id', concat('run ', message_id))")})")
    revision = event("revision", "named_struct('text', concat('revised ', message_id), 'citations', "
                                 "array(named_struct('idx', 2, 'sid', 9)))")
    none = "cast(array() AS array<struct<event:string,data:string>>)"
    events = f"""concat(array({event('step', "named_struct('ord', 1, 'node', 'plan', 'label', concat('l', message_id))")}),
        flatten(transform(parts, (t, i) -> concat(array({event('token', "named_struct('text', t)")}),
          IF(i = 0, array({event('citation', "named_struct('idx', 1, 'sid', message_id % 5)")}), {none}),
          IF(message_id % 3 = 0 AND i = least(2, size(parts) - 1), array({revision}), {none})))), array({end}))"""
    return m.filter("role = 'assistant'").selectExpr(
        "conv_id * 1000 + turn AS message_id", "split(text, '\\n', -1) AS parts").selectExpr(
        "message_id", f"posexplode({events}) AS (seq, e)").selectExpr(
        "message_id", "cast(seq AS bigint) AS seq", "e.event AS event", "e.data AS data")


@query("st2_stream_turns", f"""WITH {_TURNS}
  SELECT message_id, content, status, error, rejected, n_citations,
         CASE WHEN status = 'complete' THEN 'run ' || message_id END AS run_id, 1::BIGINT AS n_steps FROM turns""")
def _(spark, sf):
    folder = work_dir(spark, "turns")
    rows = U.stream_turns(numbered_events(stream_of(spark, sf, "conversations")), 0, 0)
    U.persist_turns(rows, f"{folder}/tables", f"{folder}/state").awaitTermination()
    read = lambda name: spark.read.parquet(f"{folder}/tables/{name}")
    count = lambda name, as_: read(name).groupBy("message_id").agg(F.count("*").alias(as_))
    return (read("messages").drop("batch").withColumn("rejected", F.array_join(F.col("rejected").cast("array<string>"), ","))
            .join(count("citations", "n_citations"), "message_id").join(count("steps", "n_steps"), "message_id")
            .join(read("runs").select("message_id", "run_id"), "message_id", "left"))


def _progress(events):
    return events.selectExpr("user_id % 500 AS document_id", "cast(ts AS timestamp) AS ts", "event_type AS status",
                             "event_id AS done", "event_id + 10 AS total")


@query("st3_document_progress", """
  SELECT user_id % 500 AS document_id, arg_max(event_type, ts) AS status, arg_max(event_id, ts) AS done,
         arg_max(event_id + 10, ts) AS total FROM events GROUP BY 1""")
def _(spark, sf):
    return L.document_progress(_progress(fx.table(spark, sf, "events"))).drop("ts")


@query("st3_stream_progress", """
  SELECT user_id % 500 AS document_id, arg_max(event_type, ts) AS status, arg_max(event_id, ts) AS done,
         arg_max(event_id + 10, ts) AS total FROM events GROUP BY 1""")
def _(spark, sf):
    """The last that the stream said of each document."""
    events = _progress(stream_of(spark, sf, "events"))
    said = drain(L.stream_progress(events), "progress")
    last = said.groupBy("document_id").agg(F.max_by(F.struct("status", "done", "total"), F.struct("ms", "done")).alias("l"))
    return last.select("document_id", "l.status", "l.done", "l.total")


def _beats(spark, sf):
    return fx.beats(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))


@query("st4_viewers", fx.sql("beats", body="""
  SELECT channel, user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_beat FROM beats GROUP BY 1, 2
  HAVING max(ts) > (SELECT max(ts) FROM beats) - INTERVAL 1 DAY"""))
def _(spark, sf):
    beats = _beats(spark, sf)
    now = F.lit(beats.agg(F.max("ts")).first()[0])
    return L.viewers(beats, now, "1 day").withColumn("last_beat", F.date_format("last_beat", "yyyy-MM-dd HH:mm:ss"))


@query("st4_sessions", fx.sql("beats", body="""
  WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 DAY THEN 0 ELSE 1 END AS opens FROM beats
             WINDOW w AS (PARTITION BY channel, user_id ORDER BY ts)),
  s AS (SELECT *, sum(opens) OVER (PARTITION BY channel, user_id ORDER BY ts) AS n FROM f)
  SELECT channel, user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS beats FROM s
  GROUP BY channel, user_id, n"""))
def _(spark, sf):
    return (L.sessions(_beats(spark, sf), "1 day").drop("end")
            .withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")))


@query("st4_stream_presence", fx.sql("beats", body="""
  WITH f AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 DAY THEN 0 ELSE 1 END AS opens FROM beats
             WINDOW w AS (PARTITION BY channel, user_id ORDER BY ts)),
  s AS (SELECT *, sum(opens) OVER (PARTITION BY channel, user_id ORDER BY ts) AS n FROM f),
  stay AS (SELECT channel, user_id, min(ts) AS a, max(ts) + INTERVAL 1 DAY AS b FROM s GROUP BY channel, user_id, n)
  SELECT channel, user_id, 'joined' AS event, epoch_us(a) // 1000 AS ms FROM stay
  UNION ALL SELECT channel, user_id, 'left', epoch_us(b) // 1000 FROM stay WHERE b < (SELECT max(ts) FROM beats)"""))
def _(spark, sf):
    beats = stream_of(spark, sf, "events").selectExpr("event_type AS channel", "user_id", "cast(ts AS timestamp) AS ts")
    return drain(L.stream_presence(beats, 86_400_000), "presence")


@query("st5_route_events", """
  SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'documents' ELSE 'channel:' || (user_id % 9) END AS key,
         event_type AS event, '{"id":' || event_id || '}' AS data FROM events
  WHERE event_id % 10 <> 3 AND (user_id % 3 = 0 OR user_id % 9 IN (1, 4))""")
def _(spark, sf):
    messages = fx.table(spark, sf, "events").selectExpr(
        "event_id", "CASE WHEN user_id % 3 = 0 THEN 'documents' ELSE concat('channel:', user_id % 9) END AS key",
        """CASE WHEN event_id % 10 = 3 THEN '{"event": "cut' ELSE
           concat('{"event": "', event_type, '", "data": {"id":', event_id, '}}') END AS value""")
    return L.route_events(messages, ["documents", "channel:1", "channel:4"])


@query("st6_incremental_ingest", fx.sql("files", body="""
  WITH ok AS (SELECT *, sha256(content) AS sha FROM files WHERE file_id % 9 <> 7
              AND (file_id % 9 <> 8 OR file_id % 18 = 8) AND size_bytes <= 10485)
  SELECT min(file_id) AS document_id, sha AS sha256, 'pending' AS status FROM ok GROUP BY sha"""))
def _(spark, sf):
    files = fx.files_of(stream_of(spark, sf, "documents"))
    folder = work_dir(spark, "ingest")
    I.incremental_ingest(files, f"{folder}/catalog", f"{folder}/state", 0.01).awaitTermination()
    return I.read_catalog(spark, f"{folder}/catalog").select("document_id", "sha256", "status")


@query("st7_taxonomy_sweep", fx.sql("topics", "doc_topics", body=f"""WITH RECURSIVE {_TOPICS_SQL}, {_GREEDY}
  SELECT id, coalesce(keep, merged_into_id) AS merged_into_id FROM tp LEFT JOIN plan ON dropped = id"""))
def _(spark, sf):
    folder = work_dir(spark, "sweep")
    I.taxonomy_sweep(stream_of(spark, sf, "embeddings"),
                     lambda: (topics(spark, sf), bridge(spark, sf), aliases(spark, sf)),
                     f"{folder}/tables", f"{folder}/state", MERGE).awaitTermination()
    return spark.read.parquet(f"{folder}/tables/version=0/topics").select("id", "merged_into_id")
