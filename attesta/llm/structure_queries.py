"""op11, op12 and op13: fingerprints, importance resampling and the conversation trie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.llm.merkle import compared_with_next
from attesta.llm.registry import query
from attesta.llm.resample import resample
from attesta.llm.scratch import table
from attesta.llm.sql import CRC_STEPS, LOWER, crc_of
from attesta.llm.trie import grafted, numbered_turns, prefix_trie


@query("op11_document_fingerprints")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_with_next(table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH {CRC_STEPS}, doc AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), goal AS (
  SELECT unnest(regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS f FROM benchmark
), member AS (
  SELECT doc_id, unnest(w) AS f FROM doc
), bucket AS (
  SELECT f, {crc_of("f")} % 10000 AS b FROM (SELECT f FROM member UNION SELECT f FROM goal), crc_step
), s AS (
  SELECT b, count(*) AS n FROM member JOIN bucket USING (f) GROUP BY b
), t AS (
  SELECT b, count(*) AS n FROM goal JOIN bucket USING (f) GROUP BY b
), gain AS (
  SELECT b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)
           / ((s.n + 1.0::DOUBLE) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)))) AS BIGINT) AS g
  FROM s LEFT JOIN t USING (b)
), weight AS (
  SELECT doc_id, CAST(floor(sum(g) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS weight
  FROM member JOIN bucket USING (f) JOIN gain USING (b) GROUP BY doc_id
), scored AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT)
           + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM doc LEFT JOIN weight USING (doc_id)
), drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN rank <= 10 * (SELECT count(*) FROM drawn) // 100 THEN rank END AS rank
FROM scored LEFT JOIN drawn USING (doc_id)
"""


@query("op12_importance_resampling", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_features", "weight", "score", "rank")


OP13_SQL = rf"""
WITH {CRC_STEPS}, turned AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos
  FROM conversations
), conv AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {crc_of("CAST(conv_id AS VARCHAR)")} % 4 AS h,
         (SELECT count(*) FROM turned t WHERE t.conv_id = c.conv_id) AS n
  FROM (SELECT DISTINCT conv_id FROM conversations) c, crc_step
), lead AS (
  SELECT c.*, least(c.h, coalesce(b.n, 0)) AS lead FROM conv c LEFT JOIN conv b ON b.conv_id = c.base
), rebuilt AS (
  SELECT c.conv_id, t.pos AS d, t.role, t.text FROM lead c JOIN turned t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, t.pos - c.h + c.lead, t.role, t.text FROM lead c JOIN turned t ON t.conv_id = c.conv_id AND t.pos > c.h
), prefix AS (
  SELECT conv_id, d, list([role, text]) OVER (PARTITION BY conv_id ORDER BY d) AS k, text FROM rebuilt
  UNION ALL SELECT conv_id, 0, [], '' FROM conv
), member AS (
  SELECT p.*, min(conv_id) OVER (PARTITION BY d, k) AS rep, count(*) OVER (PARTITION BY d, k) AS n_convs,
         (SELECT max(q.d) FROM prefix q WHERE q.conv_id = p.conv_id) AS len
  FROM prefix p
), node AS (
  SELECT m.rep AS conv_id, m.d, m.n_convs, u.rep AS parent_conv_id,
         (m.n_convs - 1) * CASE WHEN m.d = 0 THEN 0 ELSE len(regexp_extract_all(m.text, '[^\x20\x09-\x0D]+')) END AS saved
  FROM member m LEFT JOIN member u ON u.conv_id = m.conv_id AND u.d = m.d - 1 WHERE m.conv_id = m.rep
), child AS (
  SELECT parent_conv_id AS conv_id, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY 1, 2
), under AS (
  SELECT a.rep AS conv_id, a.d, sum(x.saved) AS saved_tokens, count(*) FILTER (c.n IS NULL) AS n_leaves
  FROM node x LEFT JOIN child c ON c.conv_id = x.conv_id AND c.d = x.d
       JOIN member a ON a.conv_id = x.conv_id AND a.d <= x.d
  GROUP BY 1, 2
), done AS (
  SELECT rep AS conv_id, d, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM member WHERE d = len GROUP BY 1, 2
)
SELECT n.conv_id, n.d AS depth, n.parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, u.n_leaves,
       CAST(u.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM node n JOIN under u ON u.conv_id = n.conv_id AND u.d = n.d LEFT JOIN child c ON c.conv_id = n.conv_id AND c.d = n.d
     LEFT JOIN done e ON e.conv_id = n.conv_id AND e.d = n.d
"""


@query("op13_conversation_trie", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*grafted(numbered_turns(table(spark, sf_dir, "conversations"))))
