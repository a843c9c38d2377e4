"""Sentence, citation and geometry queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import sentences as TX
from attesta.functions.text import strip_cite_tokens
from attesta.operators import chunks as CH
from attesta.operators import citations as C
from attesta.operators import resolve as R
from attesta.plans import lineage
from attesta.queries import fixtures as fx
from attesta.queries.registry import query

# ----------------------------------------------------------------------- sentences


def _docs(spark, sf):
    return fx.table(spark, sf, "documents").selectExpr("doc_id AS document_id", "text")


# Boundaries are cut with the terminal mark inside the separator, since the checking
# engine has no look-behind; the walk then decides one boundary per step.
SENTENCE_WALK = """
  marks AS (SELECT doc_id, string_split_regex(text, '[.!?…]["''”’)\\]]*\\s+|\\n+') AS parts,
                   regexp_extract_all(text, '[.!?…]["''”’)\\]]*\\s+|\\n+') AS seps, text FROM {base}),
  cuts AS (SELECT doc_id, i, sum(length(part) + length(sep)) OVER w AS resume,
                  sum(length(part) + length(sep)) OVER w - length(sep)
                    + CASE WHEN regexp_matches(sep, '^[.!?…]') THEN 1 ELSE 0 END AS stop
           FROM (SELECT doc_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS part,
                        coalesce(unnest(seps), '') AS sep FROM marks)
           WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  walk AS (SELECT doc_id, 0::BIGINT AS i, 0::HUGEINT AS start, NULL::HUGEINT AS s, NULL::HUGEINT AS e FROM marks
           UNION ALL
           SELECT w.doc_id, c.i, CASE WHEN hard THEN c.resume ELSE w.start END,
                  CASE WHEN hard THEN w.start END, CASE WHEN hard THEN c.stop END
           FROM walk w JOIN cuts c ON c.doc_id = w.doc_id AND c.i = w.i + 1
           JOIN marks m ON m.doc_id = w.doc_id,
           LATERAL (SELECT substr(m.text, (w.start + 1)::BIGINT, (c.stop - w.start)::BIGINT) AS piece),
           LATERAL (SELECT regexp_extract(piece, '(?s)^(.*)[.!?…][^.!?…]*$', 1) AS head,
                           regexp_extract(piece, '([.!?…])[^.!?…]*$', 1) AS mark),
           LATERAL (SELECT c.stop = length(m.text) OR mark <> '.' OR NOT regexp_matches(head,
                '((^|\\s|\\()([A-Za-z]{1,3}|No|Fig|Tbl|vs|etc|cf|e\\.g|i\\.e|Mr|Ms|Mrs|Dr|Prof|approx)|\\d)$') AS hard)),
  stretches AS (SELECT doc_id, i, s, e, length(trim(substr(text, (s + 1)::BIGINT, (e - s)::BIGINT), E' \\t\\r\\n')) AS n
             FROM walk JOIN marks USING (doc_id) WHERE s IS NOT NULL),
  grouped AS (SELECT *, sum(CASE WHEN n >= 2 OR first THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g
              FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1 AS first FROM stretches WHERE n > 0)),
  sentences AS (SELECT doc_id AS document_id, min(s)::BIGINT AS start, max(e)::BIGINT AS "end",
                       substr(any_value(text), min(s)::BIGINT + 1, (max(e) - min(s))::BIGINT) AS sentence
                FROM grouped JOIN marks USING (doc_id) GROUP BY doc_id, g)"""


def sentence_walk(base: str) -> str:
    """``sentences`` of the rows (doc_id, text) of ``base``."""
    return SENTENCE_WALK.replace("{base}", base)


_SENTENCES = sentence_walk("documents")


@query("tx1_split_sentences", f"WITH RECURSIVE {_SENTENCES} SELECT * FROM sentences")
def _(spark, sf):
    return TX.split_sentences(_docs(spark, sf))


@query("tx2_split", f"""WITH RECURSIVE {_SENTENCES}
  SELECT document_id, trim(sentence, E' \\t\\r\\n') AS sentence FROM sentences""")
def _(spark, sf):
    return TX.split_trimmed(_docs(spark, sf)).select("document_id", "sentence")


@query("tx3_sentence_at", f"""WITH RECURSIVE {_SENTENCES},
  middle AS (SELECT doc_id AS document_id, length(text) // 2 AS p FROM documents),
  hit AS (SELECT document_id, min(start) AS start FROM sentences JOIN middle USING (document_id)
          WHERE start <= p AND p <= "end" GROUP BY 1)
  SELECT m.document_id, s.start::INTEGER AS start, s."end"::INTEGER AS "end", s.sentence AS text
  FROM middle m LEFT JOIN hit USING (document_id)
  LEFT JOIN sentences s ON s.document_id = hit.document_id AND s.start = hit.start""")
def _(spark, sf):
    docs = _docs(spark, sf).withColumn("at", F.expr("length(text) div 2"))
    found = docs.select("document_id", TX.sentence_at("text", F.col("at")).alias("s"))
    return found.select("document_id", "s.start", "s.end", "s.text")


# ------------------------------------------------------------------------- markers

_PARSED = """
  toks AS (SELECT message_id, unnest(range(1, len(t) + 1)) AS i, unnest(t)::BIGINT AS sid
           FROM (SELECT message_id, regexp_extract_all(raw, '\\[S(\\d{1,3})\\]', 1) AS t FROM answers)),
  known AS (SELECT t.* FROM toks t SEMI JOIN sources s ON s.message_id = t.message_id AND s.sid = t.sid),
  idx AS (SELECT message_id, sid, row_number() OVER (PARTITION BY message_id ORDER BY min(i)) AS idx
          FROM known GROUP BY 1, 2),
  rejected AS (SELECT message_id, row_number() OVER (PARTITION BY message_id ORDER BY i) - 1 AS ord, sid
               FROM toks t ANTI JOIN sources s ON s.message_id = t.message_id AND s.sid = t.sid),
  pieces AS (SELECT message_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS piece
             FROM (SELECT message_id, string_split_regex(raw, '\\[S\\d{1,3}\\]') AS p FROM answers)),
  parsed AS (SELECT p.message_id, string_agg(piece || coalesce('[[cite:' || x.idx || ']]', ''), '' ORDER BY p.i)
                    AS body
             FROM pieces p LEFT JOIN toks t ON t.message_id = p.message_id AND t.i = p.i
                  LEFT JOIN idx x ON x.message_id = t.message_id AND x.sid = t.sid GROUP BY 1)"""


def parsed(spark, sf):
    return C.parse_markers(fx.answers(spark, sf), fx.sources(spark, sf))


def with_parsed(body, *names, extra=""):
    return fx.sql("answers", "sources", *names, body=f"WITH {_PARSED}{extra} {body}")


@query("ct1_parse_markers", with_parsed("""
  SELECT message_id, body, coalesce(c.cited, '') AS cited FROM parsed LEFT JOIN (
    SELECT message_id, string_agg(sid, ',' ORDER BY idx) AS cited FROM idx GROUP BY 1) c USING (message_id)"""))
def _(spark, sf):
    return parsed(spark, sf).select("message_id", "body", F.array_join("cited", ",").alias("cited"))


@query("ct1_citations", with_parsed("SELECT message_id, idx, sid FROM idx"))
def _(spark, sf):
    return C.citations_of(parsed(spark, sf))


@query("ct2_rejected_markers", with_parsed(
    "SELECT message_id, ord, sid, 'unknown_source_id' AS reason FROM rejected"))
def _(spark, sf):
    return C.rejected_markers(parsed(spark, sf))


@query("ct3_strip_cite_tokens", with_parsed("""
  SELECT p.message_id, string_agg(piece, '' ORDER BY i) AS clean FROM pieces p GROUP BY 1"""))
def _(spark, sf):
    loose = F.regexp_replace("body", r"\[\[cite:1\]\]", "[[ Cite : S1x ]]")
    return parsed(spark, sf).select("message_id", strip_cite_tokens(loose).alias("clean"))


@query("ct4_uncited_sentences", with_parsed("""
  SELECT message_id, ord, sentence FROM (
    SELECT message_id, unnest(range(len(p))) AS ord, trim(unnest(p), E' \\t\\r\\n') AS sentence FROM (
      SELECT message_id, string_split_regex(
               regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), '\\x01|\\n+') AS p FROM parsed))
  WHERE length(sentence) >= 12 AND NOT regexp_matches(sentence, '^(#|\\||```|- |\\* |>)')
    AND NOT sentence LIKE '%?' AND NOT regexp_matches(sentence, '\\[\\[cite:\\d{1,3}\\]\\]')"""))
def _(spark, sf):
    return C.uncited_sentences(parsed(spark, sf))


@query("ct5_claim_for", fx.sql("answers", "sources", body=f"""WITH RECURSIVE {_PARSED},
  {sentence_walk("(SELECT message_id AS doc_id, body AS text FROM parsed)")},
  places AS (SELECT message_id, idx, instr(body, '[[cite:' || idx || ']]') - 1 AS p, body FROM idx JOIN parsed USING (message_id)),
  found AS (SELECT message_id, p.idx, any_value(body) AS body, arg_min(sentence, start) AS sentence FROM places p
            LEFT JOIN sentences s ON s.document_id = p.message_id AND start <= p AND p <= "end" GROUP BY 1, 2)
  SELECT message_id, idx, coalesce(nullif(trim(regexp_replace(coalesce(sentence, body),
           '\\[\\[\\s*cite\\s*:[^\\]]{{0,16}}\\]\\]', '', 'gi'), E' \\t\\r\\n'), ''), body) AS claim FROM found"""))
def _(spark, sf):
    p = parsed(spark, sf)
    return C.claim_for(C.citations_of(p), p).select("message_id", "idx", "claim")


# ------------------------------------------------------------------------ geometry

def cited(spark, sf):
    """Every offered source cited once, with a claim vector."""
    s = fx.sources(spark, sf)
    e = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return (s.join(e, e.vec_id == (s.message_id * 13 + s.sid) % fx.vectors(spark, sf))
            .withColumnRenamed("sid", "idx").drop("vec_id"))


def chunk_sentences(spark, sf):
    """Lines act as the sentences of a chunk."""
    lines = fx.spans(spark, sf, "text")
    e = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
    return (lines.join(e, e.vec_id == (lines.chunk_id * 31 + lines.pos * 7) % fx.vectors(spark, sf))
            .select("chunk_id", F.col("text_start").alias("s"), F.col("text_end").alias("e"),
                    F.col("text").alias("sentence"), "embedding"))


_ALIGNED = """
  cited AS MATERIALIZED (SELECT s.*, s.sid AS idx, e.embedding FROM sources s
            JOIN embeddings e ON e.vec_id = (s.message_id * 13 + s.sid) % (SELECT count(*) FROM embeddings)),
  sent AS MATERIALIZED (SELECT sp.chunk_id, sp.text_start AS s, sp.text_end AS e, l.text AS sentence, em.embedding
           FROM (SELECT * FROM spans WHERE chunk_id IN (SELECT chunk_id FROM cited)) sp
           JOIN lines l ON l.document_id = sp.chunk_id AND l.line_no = sp.pos
           JOIN embeddings em ON em.vec_id = (sp.chunk_id * 31 + sp.pos * 7) % (SELECT count(*) FROM embeddings)),
  aligned AS MATERIALIZED (SELECT message_id, idx, chunk_id, s, e, sentence, similarity FROM (
    SELECT *, row_number() OVER (PARTITION BY message_id, idx ORDER BY similarity DESC, s) AS rn FROM (
      SELECT c.message_id, c.idx, c.chunk_id, t.s, t.e, t.sentence,
             round(list_cosine_similarity(c.embedding::DOUBLE[], t.embedding::DOUBLE[]), 5) AS similarity
      FROM cited c JOIN sent t USING (chunk_id)))
    WHERE rn = 1 OR (rn <= 3 AND similarity >= 0.2))"""


def aligned(spark, sf):
    return R.align_sentences(cited(spark, sf), chunk_sentences(spark, sf), threshold=0.2, digits=5)


@query("ct6_align_sentences", fx.sql("sources", "spans", body=f"""WITH {_ALIGNED}
  SELECT message_id, idx, s, e, sentence, similarity FROM aligned"""))
def _(spark, sf):
    return aligned(spark, sf)


_SPANS_FOR = """
  hits AS (SELECT s.*, p.s AS ps, bool_or(s.text_start < p.e AND s.text_end > p.s) OVER w AS any_hit,
                  s.text_start < p.e AND s.text_end > p.s AS hit
           FROM spans s JOIN picks p USING (chunk_id) WINDOW w AS (PARTITION BY s.chunk_id)),
  kept AS (SELECT * FROM hits WHERE hit OR NOT any_hit)"""


def _picked(spark, sf):
    p = fx.picks(spark, sf)
    cites = p.selectExpr("chunk_id AS message_id", "1L AS idx", "chunk_id")
    picks = p.selectExpr("chunk_id AS message_id", "1L AS idx", "s", "e")
    return R.spans_for(cites, picks, fx.spans(spark, sf))


@query("ct7_spans_for", fx.sql("spans", "picks", body=f"""WITH {_SPANS_FOR}
  SELECT chunk_id, pos, text_start, text_end, page_no FROM kept"""))
def _(spark, sf):
    return _picked(spark, sf).select("chunk_id", "pos", "text_start", "text_end", "page_no")


@query("ct8_merge_same_line", fx.sql("words", body="""
  SELECT document_id AS message_id, (line_no % 40)::BIGINT AS idx, page_no, min(x0) AS x0, min(y0) AS y0,
         max(x1) AS x1, max(y1) AS y1
  FROM words GROUP BY document_id, line_no, page_no"""))
def _(spark, sf):
    """Word boxes of a line (heights 12, tops within 2) merge into one rectangle."""
    words = fx.words(spark, sf).selectExpr("document_id AS message_id", "line_no % 40 AS idx", "page_no",
                                           "x0", "y0", "x1", "y1")
    return R.merge_same_line(words)


@query("ct9_time_range", fx.sql("segments", body=f"""WITH RECURSIVE {fx.WINDOWS_SQL},
  whole AS (SELECT document_id, ord, max(a + length(t)) AS n FROM placed GROUP BY 1, 2),
  hit AS (SELECT p.* FROM placed p JOIN whole w USING (document_id, ord)
          WHERE (document_id + ord) % 7 = 3 OR (a < n // 2 + 1 AND a + length(t) > n // 3))
  SELECT document_id AS message_id, ord AS idx, min(start_ms) AS t_start_ms, max(end_ms) AS t_end_ms FROM hit GROUP BY 1, 2"""))
def _(spark, sf):
    """Each window of a recording is cited for the middle of its text, or as a whole."""
    windows = lineage.cut(CH.transcript_windows(fx.segments(spark, sf)))
    chunk = lambda df: df.withColumn("chunk_id", F.struct("document_id", "ord"))
    cites = chunk(CH.window_chunks(windows)).withColumns({"message_id": F.col("document_id"), "idx": F.col("ord")})
    n = F.length("text")
    picks = cites.filter("(document_id + ord) % 7 <> 3").select(
        "message_id", "idx", F.floor(n / 3).alias("s"), (F.floor(n / 2) + 1).alias("e"))
    spans = chunk(CH.window_spans(windows)).select("chunk_id", "pos", "text_start", "text_end", "t_start_ms", "t_end_ms")
    return R.time_range(R.spans_for(cites.select("message_id", "idx", "chunk_id"), picks, spans))


_SNIPPET = """
  said AS (SELECT message_id, idx, string_agg(trim(sentence, E' \\t\\r\\n'), ' ' ORDER BY s) AS t
           FROM aligned {where} GROUP BY 1, 2),
  snips AS (SELECT c.message_id, c.idx,
                   CASE WHEN length(x) > 400 THEN rtrim(x[1:400], E' \\t\\r\\n') || ' …' ELSE x END AS snippet
            FROM (SELECT c.message_id, c.idx, coalesce(t, trim(c.text, E' \\t\\r\\n')) AS x
                  FROM cited c LEFT JOIN said USING (message_id, idx)) c)"""


@query("ct10_snippet", fx.sql("sources", "spans", body=f"""WITH {_ALIGNED},
  {_SNIPPET.format(where='WHERE idx <> 3')} SELECT * FROM snips"""))
def _(spark, sf):
    return (R.snippet(cited(spark, sf), aligned(spark, sf).filter("idx <> 3"))
            .select("message_id", "idx", "snippet"))


_RESOLVED = _SNIPPET.format(where="") + """,
  hit AS (SELECT a.message_id, a.idx, sp.pos, sp.page_no FROM aligned a JOIN spans sp
          ON sp.chunk_id = a.chunk_id AND sp.text_start < a.e AND sp.text_end > a.s GROUP BY ALL),
  every AS (SELECT c.message_id, c.idx, sp.pos, sp.page_no FROM cited c JOIN spans sp USING (chunk_id)
            WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.message_id = c.message_id AND h.idx = c.idx)),
  geo AS (SELECT message_id, idx, min(page_no) AS page_no, count(*) AS n_rects
          FROM (SELECT * FROM hit UNION ALL SELECT * FROM every) GROUP BY 1, 2)"""


@query("ct11_resolve_citations", fx.sql("sources", "spans", body=f"""WITH {_ALIGNED}, {_RESOLVED}
  SELECT c.message_id, c.idx, c.chunk_id, n.snippet, coalesce(g.page_no, c.page_from) AS page_no, g.n_rects,
         c.t_start_ms
  FROM cited c JOIN snips n USING (message_id, idx) LEFT JOIN geo g USING (message_id, idx)"""))
def _(spark, sf):
    cites = cited(spark, sf).withColumn("t_end_ms", F.lit(None).cast("bigint"))
    spans = (fx.spans(spark, sf).withColumn("t_start_ms", F.lit(None).cast("bigint"))
             .withColumn("t_end_ms", F.lit(None).cast("bigint")))
    out, rects = R.resolve_citations(cites, chunk_sentences(spark, sf), spans, threshold=0.2, digits=5)
    counts = rects.groupBy("message_id", "idx").agg(F.count("*").alias("n_rects"))
    return (out.join(counts, ["message_id", "idx"], "left")
            .select("message_id", "idx", "chunk_id", "snippet", "page_no", "n_rects", "t_start_ms"))


# ------------------------------------------------------------------------- display

_LOCATOR = """concat_ws(' · ', filename,
    CASE WHEN page_from IS NOT NULL THEN CASE WHEN page_to = page_from THEN 'p.' || page_from
                                              ELSE 'pp.' || page_from || '-' || page_to END
         WHEN t_start_ms IS NOT NULL THEN
           CASE WHEN t_start_ms // 3600000 > 0 THEN format('{:d}:{:02d}:{:02d}', t_start_ms // 3600000,
                  t_start_ms // 60000 % 60, t_start_ms // 1000 % 60)
                ELSE format('{:d}:{:02d}', t_start_ms // 60000, t_start_ms // 1000 % 60) END END,
    heading_path)"""


@query("ct12_locator", fx.sql("sources", body=f"SELECT message_id, sid, {_LOCATOR} AS label FROM sources"))
def _(spark, sf):
    return fx.sources(spark, sf).select("message_id", "sid", C.locator().alias("label"))


@query("ct13_context_block", fx.sql("sources", body=f"""
  SELECT message_id, string_agg('[S' || sid || '] (' || {_LOCATOR} || ')' || chr(10) ||
           CASE WHEN length(t) > 2400 THEN rtrim(t[1:2400], E' \\t\\r\\n') || ' …' ELSE t END,
           chr(10) || chr(10) ORDER BY sid) AS context
  FROM (SELECT *, trim(text, E' \\t\\r\\n') AS t FROM sources) GROUP BY 1"""))
def _(spark, sf):
    return C.context_block(fx.sources(spark, sf))


_FIXED = """
  cites AS (SELECT message_id, list(sid ORDER BY idx) AS cited FROM idx GROUP BY 1),
  heads AS (SELECT p.message_id, body, trim(string_split(body, chr(10))[1], E' \\t\\r\\n') AS sentence,
                   coalesce(c.cited, []) AS cited, p.message_id % 4 AS kind
            FROM parsed p LEFT JOIN cites c USING (message_id)),
  numbered AS (SELECT *, coalesce(nullif(list_position(cited, 2), 0), len(cited) + 1) AS i2,
                 coalesce(nullif(list_position(cited, 4), 0),
                          len(cited) + 1 + CASE WHEN list_contains(cited, 2) THEN 0 ELSE 1 END) AS i4
               FROM heads),
  fixed AS (SELECT message_id, CASE
      WHEN sentence = '' OR kind IN (2, 3) THEN body
      ELSE substr(body, 1, instr(body, sentence) - 1) || 'A corrected claim.' ||
           CASE WHEN kind = 0 THEN '[[cite:' || i2 || ']][[cite:' || i4 || ']]' ELSE '' END ||
           substr(body, instr(body, sentence) + length(sentence)) END AS text,
      CASE WHEN sentence = '' OR kind IN (2, 3) THEN 0 ELSE 1 END::BIGINT AS fixed,
      CASE WHEN sentence <> '' AND kind = 0 THEN
        (CASE WHEN list_contains(cited, 2) THEN 0 ELSE 1 END
         + CASE WHEN list_contains(cited, 4) THEN 0 ELSE 1 END) ELSE 0 END::BIGINT AS n_new FROM numbered)"""


@query("ct14_apply_fixes", with_parsed("SELECT * FROM fixed", extra="," + _FIXED))
def _(spark, sf):
    p = parsed(spark, sf)
    first = F.expr("split(body, '\\n', -1)[0]")
    one = p.select("message_id", F.lit(0).alias("ord"), first.alias("sentence"),
                   F.expr("CASE message_id % 4 WHEN 1 THEN 'hedge' WHEN 2 THEN 'keep' ELSE 'cite' END").alias("action"),
                   F.lit(" A corrected claim. ").alias("replacement"),
                   F.expr("CASE WHEN message_id % 4 = 3 THEN array(77) ELSE array(2, 99, 4) END").alias("source_ids"))
    two = p.select("message_id", F.lit(1).alias("ord"), F.lit("never written").alias("sentence"),
                   F.lit("hedge").alias("action"), F.lit("x").alias("replacement"),
                   F.expr("array(1)").alias("source_ids"))
    out = C.apply_fixes(p, one.unionByName(two), fx.sources(spark, sf))
    return out.select("message_id", "text", "fixed", F.size("new_cited").cast("bigint").alias("n_new"))


@query("ct15_segments_in_citation", fx.sql("segments", body="""
  WITH c AS (SELECT document_id, reading_order AS idx, start_ms + 3000 AS a, end_ms + 20000 AS b FROM segments)
  SELECT c.document_id, c.idx, s.reading_order FROM c JOIN segments s USING (document_id)
  WHERE s.start_ms < b AND CASE WHEN s.reading_order % 3 = 0 THEN s.start_ms ELSE s.end_ms END > a"""))
def _(spark, sf):
    s = fx.segments(spark, sf)
    cites = s.selectExpr("document_id", "reading_order AS idx", "start_ms + 3000 AS t_start_ms",
                         "end_ms + 20000 AS t_end_ms")
    s = s.withColumn("end_ms", F.expr("CASE WHEN reading_order % 3 > 0 THEN end_ms END"))
    return C.segments_in_citation(cites, s).select("document_id", "idx", "reading_order")


@query("ct16_messages_with_citations", fx.sql("messages", "sources", body="""
  SELECT m.id, m.role, coalesce(c.list, '') AS citations FROM messages m LEFT JOIN (
    SELECT message_id, string_agg(sid || ':doc ' || document_id, ',' ORDER BY sid) AS list FROM sources GROUP BY 1) c ON c.message_id = m.id"""))
def _(spark, sf):
    cites = fx.sources(spark, sf).selectExpr("message_id", "sid AS idx", "document_id", "chunk_id",
                                             "page_from AS page_no", "left(text, 10) AS snippet")
    docs = (fx.table(spark, sf, "documents").selectExpr(f"doc_id % {fx.groups(spark, sf)} AS document_id").distinct()
            .withColumn("filename", F.expr("concat('doc ', document_id)")))
    out = C.messages_with_citations(fx.messages(spark, sf), cites, docs)
    flat = F.array_join(F.transform("citations", lambda c: F.concat(c["idx"], F.lit(":"), c["filename"])), ",")
    return out.select("id", "role", F.coalesce(flat, F.lit("")).alias("citations"))
