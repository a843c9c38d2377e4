"""Conversations as trees.

``messages``: channel_id, id, parent_id, role, content, seq (creation order, ids break
ties). Walks use pointer jumping over all channels at once; sibling numbering is
block-wise, since all first messages of a channel are siblings of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import strip, strip_cite_tokens
from attesta.plans.jumps import ends, follow, subtree_sizes
from attesta.plans.scan import by_position, running
from attesta.plans.topk import top_k

HISTORY_LIMIT = 12   # fixed values
PREVIEW_CHARS = 120


def _parents(messages: DataFrame) -> DataFrame:
    return messages.select(F.col("id").alias("node"), F.col("parent_id").alias("nxt"))


def ancestors(messages: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, id, depth): the chain from the root (depth 0) to each target."""
    walk = follow(targets.select(F.col("target").alias("origin")).distinct(), _parents(messages))
    longest = walk.groupBy("origin").agg(F.max("hops").alias("__far"))
    return walk.join(longest, "origin").select(
        F.col("origin").alias("target"), F.col("node").alias("id"),
        (F.col("__far") - F.col("hops")).alias("depth"))


def active_path(messages: DataFrame, channels: DataFrame) -> DataFrame:
    """(channel_id, id, depth) of each channel's live branch; none without a leaf."""
    leaves = channels.filter("active_leaf_id IS NOT NULL").select("channel_id", "active_leaf_id")
    chain = ancestors(messages, leaves.select(F.col("active_leaf_id").alias("target")))
    return (chain.join(leaves, F.col("target") == F.col("active_leaf_id"))
            .select("channel_id", "id", "depth"))


def history(messages: DataFrame, channels: DataFrame, users: DataFrame, limit: int = HISTORY_LIMIT) -> DataFrame:
    """The last turns of each live branch as model input.

    Assistant text loses its citation tokens, user text gains the author's name;
    other roles go, after the limit. ``messages`` also needs ``author_id``.
    """
    recent = top_k(active_path(messages, channels), ["channel_id"], [F.desc("depth")], limit, rank="__back")
    named = (recent.join(messages.select("id", "role", "content", "author_id"), "id")
             .join(users.select(F.col("id").alias("author_id"), F.col("name").alias("__name")), "author_id", "left"))
    prefixed = F.when(F.col("__name").isNull(), F.col("content")).otherwise(
        F.concat(F.lit("["), F.col("__name"), F.lit("] "), F.col("content")))
    return (named.filter(F.col("role").isin("assistant", "user"))
            .select("channel_id", "depth", "role",
                    F.when(F.col("role") == "assistant", strip_cite_tokens("content"))
                    .otherwise(prefixed).alias("content")))


def sibling_info(messages: DataFrame) -> DataFrame:
    """(id, sibling_index, sibling_count) among same channel, parent and role."""
    keys = ["channel_id", "parent_id", "role"]
    numbered = running(messages.select(*keys, "id", "seq"), keys, ["seq", "id"], by_position("seq"),
                       {"n": ("sum", F.lit(1).cast("bigint"))}, null_keys=True)
    counts = messages.groupBy(*keys).agg(F.count("*").alias("sibling_count"))
    c = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], "sibling_count")
    same = [numbered[k].eqNullSafe(c[f"__{k}"]) for k in keys]
    return (numbered.join(c, same[0] & same[1] & same[2])
            .select("id", (F.col("n") - 1).alias("sibling_index"), "sibling_count"))


def branch_root(messages: DataFrame, parents: DataFrame) -> DataFrame:
    """The branch a new child of each ``parent_id`` would belong to.

    ``messages`` has ``branch_root_id``. A parent that already has a child starts a
    new branch under its own id.
    """
    info = messages.select(F.col("id").alias("parent_id"), "branch_root_id")
    with_child = messages.filter("parent_id IS NOT NULL").select("parent_id").distinct().withColumn(
        "__has", F.lit(True))
    return (parents.join(info.withColumn("__known", F.lit(True)), "parent_id", "left")
            .join(with_child, "parent_id", "left")
            .withColumn("branch_root_id", F.when(
                F.col("__known"), F.when(F.col("__has"), F.col("parent_id"))
                .otherwise(F.coalesce("branch_root_id", "parent_id"))))
            .drop("__known", "__has"))


def leaf_of(messages: DataFrame) -> DataFrame:
    """(id, leaf_id): the leaf reached from every message by oldest children."""
    oldest = messages.filter("parent_id IS NOT NULL").groupBy("parent_id").agg(
        F.min_by("id", F.struct("seq", "id")).alias("nxt"))
    links = (messages.select(F.col("id").alias("node"))
             .join(oldest, F.col("node") == F.col("parent_id"), "left").select("node", "nxt"))
    return ends(links).select(F.col("node").alias("id"), F.col("end").alias("leaf_id"))


def descendants_count(messages: DataFrame) -> DataFrame:
    """(id, descendants) of every message, itself excluded."""
    return subtree_sizes(_parents(messages)).select(F.col("node").alias("id"), F.col("below").alias("descendants"))


def branches(messages: DataFrame, channels: DataFrame) -> DataFrame:
    """Every message with its place among its siblings, a preview, and whether it is
    on the live branch. Filter by (channel, parent, role) for one switcher."""
    live = active_path(messages, channels).select("id").distinct().withColumn("__on", F.lit(True))
    return (messages.join(sibling_info(messages), "id").join(live, "id", "left")
            .select("channel_id", "parent_id", "role", "id", "sibling_index", "sibling_count",
                    F.substring(F.coalesce("content", F.lit("")), 1, PREVIEW_CHARS).alias("preview"),
                    F.coalesce("__on", F.lit(False)).alias("is_active")))


def set_leaf(messages: DataFrame, requests: DataFrame) -> DataFrame:
    """New live leaf per request (channel_id, message_id, action).

    ``revert`` makes the message the leaf, ``switch`` follows it down to one. A
    message of another channel is ignored.
    """
    valid = requests.join(messages.select("channel_id", F.col("id").alias("message_id")),
                          ["channel_id", "message_id"], "left_semi")
    return (valid.join(leaf_of(messages).withColumnRenamed("id", "message_id"), "message_id")
            .select("channel_id", "message_id", "action",
                    F.when(F.col("action") == "switch", F.col("leaf_id"))
                    .otherwise(F.col("message_id")).alias("active_leaf_id")))


def append_turns(messages: DataFrame, channels: DataFrame, turns: DataFrame) -> DataFrame:
    """The user row and the empty assistant row of each new question.

    ``turns``: channel_id, parent_id (null: the live leaf), content, user_id,
    assistant_id. ``messages`` has ``branch_root_id``.
    """
    placed = (turns.join(channels.select("channel_id", "active_leaf_id"), "channel_id")
              .withColumn("parent_id", F.coalesce("parent_id", "active_leaf_id")).drop("active_leaf_id"))
    roots = branch_root(messages, placed.select("parent_id").filter("parent_id IS NOT NULL").distinct())
    rooted = placed.join(roots, "parent_id", "left")
    user = rooted.select("channel_id", F.col("user_id").alias("id"), "parent_id", "branch_root_id",
                         F.lit("user").alias("role"), strip("content").alias("content"),
                         F.lit("complete").alias("status"))
    reply = rooted.select("channel_id", F.col("assistant_id").alias("id"), F.col("user_id").alias("parent_id"),
                          F.coalesce("branch_root_id", "user_id").alias("branch_root_id"),
                          F.lit("assistant").alias("role"), F.lit("").alias("content"),
                          F.lit("queued").alias("status"))
    return user.unionByName(reply)
