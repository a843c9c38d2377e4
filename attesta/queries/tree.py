"""Conversation tree queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import tree as T
from attesta.queries import fixtures as fx
from attesta.queries.registry import query

_UP = """up AS (
    SELECT id AS target, id, parent_id, 0 AS hops FROM messages
    UNION ALL SELECT up.target, m.id, m.parent_id, up.hops + 1 FROM up JOIN messages m ON m.id = up.parent_id),
  chain AS (SELECT target, id, (max(hops) OVER (PARTITION BY target) - hops)::BIGINT AS depth FROM up)"""

_PATH = "path AS (SELECT c.channel_id, k.id, k.depth FROM channels c JOIN chain k ON k.target = c.active_leaf_id)"


@query("mt1_ancestors", fx.sql("messages", body=f"WITH RECURSIVE {_UP} SELECT target, id, depth FROM chain"))
def _(spark, sf):
    m = fx.messages(spark, sf)
    return T.ancestors(m, m.select(F.col("id").alias("target")))


@query("mt2_active_path", fx.sql("messages", "channels", body=f"""WITH RECURSIVE {_UP}, {_PATH}
  SELECT channel_id, id, depth FROM path WHERE channel_id % 6 > 0"""))
def _(spark, sf):
    channels = fx.channels(spark, sf).withColumn(
        "active_leaf_id", F.expr("CASE WHEN channel_id % 6 > 0 THEN active_leaf_id END"))
    return T.active_path(fx.messages(spark, sf), channels)


@query("mt3_history", fx.sql("messages", "channels", body=f"""WITH RECURSIVE {_UP}, {_PATH},
  recent AS (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY depth DESC) AS back FROM path)
  SELECT r.channel_id, r.depth, m.role,
         CASE WHEN m.role = 'assistant' THEN m.content
              WHEN n.n_name IS NULL THEN m.content ELSE '[' || n.n_name || '] ' || m.content END AS content
  FROM recent r JOIN messages m USING (id)
  LEFT JOIN nation n ON n.n_nationkey = m.channel_id % 40
  WHERE back <= 3 AND m.role IN ('user', 'assistant')"""))
def _(spark, sf):
    m = (fx.messages(spark, sf).withColumn("author_id", F.expr("channel_id % 40"))
         .withColumn("content", F.expr("CASE WHEN role = 'assistant' THEN concat('[[cite:1]]', content, '[[ CITE : S2 ]]') ELSE content END")))
    users = fx.table(spark, sf, "nation").selectExpr("cast(n_nationkey AS bigint) AS id", "n_name AS name")
    return T.history(m, fx.channels(spark, sf), users, 3)


_SIBLINGS = """sib AS (SELECT id, row_number() OVER w - 1 AS sibling_index,
    count(*) OVER (PARTITION BY channel_id, parent_id, role) AS sibling_count
  FROM messages WINDOW w AS (PARTITION BY channel_id, parent_id, role ORDER BY seq, id))"""


@query("mt4_sibling_info", fx.sql("messages", body=f"WITH {_SIBLINGS} SELECT * FROM sib"))
def _(spark, sf):
    return T.sibling_info(fx.messages(spark, sf))


def rooted(spark, sf):
    return fx.messages(spark, sf).withColumn(
        "branch_root_id", F.expr("CASE WHEN seq > 1 THEN channel_id * 1000 END"))


_ROOT = """CASE WHEN EXISTS (SELECT 1 FROM messages c WHERE c.parent_id = {p}) THEN {p}
  WHEN ({p}) % 1000 > 1 THEN ({p}) - ({p}) % 1000 ELSE {p} END"""


@query("mt5_branch_root", fx.sql("messages", body=f"""
  SELECT id AS parent_id, {_ROOT.format(p='m.id')} AS branch_root_id FROM messages m"""))
def _(spark, sf):
    m = rooted(spark, sf)
    return T.branch_root(m, m.select(F.col("id").alias("parent_id")))


_LEAF = """oldest AS (SELECT parent_id, arg_min(id, seq) AS child FROM messages
                      WHERE parent_id IS NOT NULL GROUP BY 1),
  down AS (SELECT id, id AS here, 0 AS hops FROM messages
           UNION ALL SELECT d.id, o.child, d.hops + 1 FROM down d JOIN oldest o ON o.parent_id = d.here),
  leaf AS (SELECT id, arg_max(here, hops) AS leaf_id FROM down GROUP BY 1)"""


@query("mt6_leaf_of", fx.sql("messages", body=f"WITH RECURSIVE {_LEAF} SELECT * FROM leaf"))
def _(spark, sf):
    return T.leaf_of(fx.messages(spark, sf))


@query("mt7_descendants_count", fx.sql("messages", body=f"""WITH RECURSIVE {_UP}
  SELECT id, count(*) - 1 AS descendants FROM up GROUP BY id"""))
def _(spark, sf):
    return T.descendants_count(fx.messages(spark, sf))


@query("mt8_branches", fx.sql("messages", "channels", body=f"""WITH RECURSIVE {_UP}, {_PATH}, {_SIBLINGS}
  SELECT m.channel_id, m.parent_id, m.role, m.id, sibling_index, sibling_count, m.content[1:120] AS preview,
         m.id IN (SELECT id FROM path) AS is_active
  FROM messages m JOIN sib USING (id)"""))
def _(spark, sf):
    return T.branches(fx.messages(spark, sf), fx.channels(spark, sf))


@query("mt9_set_leaf", fx.sql("messages", body=f"""WITH RECURSIVE {_LEAF}
  SELECT m.channel_id, m.id AS message_id, CASE WHEN m.seq % 2 = 0 THEN 'switch' ELSE 'revert' END AS action,
         CASE WHEN m.seq % 2 = 0 THEN leaf_id ELSE m.id END AS active_leaf_id
  FROM messages m JOIN leaf USING (id) WHERE m.seq % 3 <> 2"""))
def _(spark, sf):
    m = fx.messages(spark, sf)
    requests = m.selectExpr("CASE WHEN seq % 3 = 2 THEN channel_id + 1 ELSE channel_id END AS channel_id",
                            "id AS message_id", "CASE WHEN seq % 2 = 0 THEN 'switch' ELSE 'revert' END AS action")
    return T.set_leaf(m, requests)


@query("mt10_append_turns", fx.sql("messages", "channels", body=f"""
  WITH turns AS (SELECT channel_id, CASE WHEN channel_id % 3 = 0 THEN channel_id * 1000 ELSE active_leaf_id END AS p
                 FROM channels),
  rooted AS (SELECT *, {_ROOT.format(p='p')} AS root FROM turns)
  SELECT channel_id, channel_id + 5000000 AS id, p AS parent_id, root AS branch_root_id, 'user' AS role,
         'next question ' || channel_id AS content, 'complete' AS status FROM rooted
  UNION ALL
  SELECT channel_id, channel_id + 6000000, channel_id + 5000000, root, 'assistant', '', 'queued' FROM rooted"""))
def _(spark, sf):
    channels = fx.channels(spark, sf)
    turns = channels.selectExpr("channel_id", "CASE WHEN channel_id % 3 = 0 THEN channel_id * 1000 END AS parent_id",
                                "concat('  next question ', channel_id, ' ') AS content",
                                "channel_id + 5000000 AS user_id", "channel_id + 6000000 AS assistant_id")
    return T.append_turns(rooted(spark, sf), channels, turns)
