"""The prefix trie of conversations: one node per distinct sequence of first turns.

A turn's digest is taken together with its place, and a prefix is named by the sums of its
turns' digests (eight sums of 32 bits each). Sums can be taken in blocks, so a conversation
of any length is no single task's work, and equal sequences have equal sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.contraction import subtree_totals
from attesta.llm.hot import join_groups
from attesta.llm.scratch import stored
from attesta.plans.scan import by_position, number_rows, running

PARTS = 8


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, words): each conversation's turns from 1 in order of ``turn``,
    null first; equal turn numbers follow the digest. Texts are read once and not shuffled."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.sha2(F.encode(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        F.monotonically_increasing_id().alias("__place"))
    order = ["conv_id", F.asc_nulls_first("turn"), "digest", "__place"]
    placed = stored(turns.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn("__at", F.monotonically_increasing_id()), "turns")
    return number_rows(placed, "conv_id", ["__at"], F.shiftright("__at", 33), "pos").select(
        "conv_id", "pos", "digest", "words")


def grafted(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Numbered turns of rebuilt conversations, and (conv_id, length) of all of them, turnless
    ones too: conversation c takes the first h turns of conversation c - c % ``every`` in
    place of its own first h, where h is the CRC-32 of its decimal id modulo ``most``."""
    turns = stored(turns, "numbered")
    sizes = stored(turns.groupBy("conv_id").agg(F.max("pos").alias("n")), "sizes")
    base = F.col("conv_id") - F.col("conv_id") % every
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")) % most).cast("long")
    of_base = sizes.select(F.col("conv_id").alias("__b"), F.col("n").alias("__n"))
    plan = sizes.withColumns({"base": base, "h": h}).join(of_base, F.col("base") == F.col("__b"), "left")
    plan = stored(plan.select(
        "conv_id", "base", "h", "n", F.least("h", F.coalesce("__n", F.lit(0).cast("long"))).alias("lead")), "grafts")
    heads = turns.where((F.col("conv_id") == base) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    taken = plan.where("h > 0").select("conv_id", "base", "h").join(heads, "base").where("pos <= h").select(
        "conv_id", "pos", "digest", "words")
    # one conversation may hold a third of all turns: its row of the plan is repeated for salted keys
    keyed = turns.withColumn("__key", F.col("conv_id").cast("string"))
    facts = plan.select(F.col("conv_id").cast("string").alias("__key"), "h", "lead", "n")
    own = join_groups(keyed, "__key", facts, "n", F.xxhash64("pos")).where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "digest", "words")
    lengths = plan.select("conv_id", (F.col("lead") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    return taken.unionByName(own), lengths


def _name(depth: Column, sums: list[Column]) -> Column:
    return F.substring(F.sha2(F.concat_ws(",", *[c.cast("string") for c in (depth, *sums)]).cast("binary"), 256), 1, 40)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, words, key, parent_key) for every conversation and depth from 1."""
    own = F.sha2(F.concat_ws(":", F.col("pos").cast("string"), "digest").cast("binary"), 256)
    parts = [F.conv(F.substring("__h", 8 * i + 1, 8), 16, 10).cast("long").alias(f"__p{i}") for i in range(PARTS)]
    split = stored(turns.withColumn("__h", own).select("conv_id", "pos", "words", *parts), "rebuilt")
    summed = running(split, "conv_id", ["pos"], by_position("pos"),
                     {f"__s{i}": ("sum", F.col(f"__p{i}")) for i in range(PARTS)})
    here = [F.col(f"__s{i}") for i in range(PARTS)]
    before = [F.col(f"__s{i}") - F.col(f"__p{i}") for i in range(PARTS)]
    return summed.select("conv_id", F.col("pos").alias("depth"), "words", _name(F.col("pos"), here).alias("key"),
                         _name(F.col("pos") - 1, before).alias("parent_key"))


def end_hashes(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the ascending, comma-joined ids (key, conv_id) of each key.

    Ids are sorted over ranges and joined in runs of at most 4,096; one task then feeds a
    key's runs to the hash in order, holding one batch of runs at a time."""
    at = stored(ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
                .withColumn("__at", F.monotonically_increasing_id()), "ends")
    runs = (at.groupBy("key", F.shiftright("__at", 12).alias("run"))
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys, found = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != now:
                    if state:
                        keys.append(now)
                        found.append(state.hexdigest())
                    now, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], names=["key", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    return (runs.repartition(F.col("key")).sortWithinPartitions("key", "run").select("key", "ids")
            .mapInArrow(digest, "key string, ends_sha256 string"))


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node of the trie of conversations, from numbered turns (conv_id, pos,
    digest, words) and their (conv_id, length), which also names conversations without turns.

    conv_id is the smallest member, parent_conv_id the parent's (null at the root); n_convs
    counts members, n_children and n_leaves children and childless nodes of the subtree,
    saved_tokens sums (n_convs - 1) times the words of the last text over the subtree, and
    ends_sha256 hashes the ids of conversations that end here. Without conversations there
    are no nodes. All columns but the hash are longs.
    """
    zero = F.lit(0).cast("long")
    at = stored(prefixes(turns), "prefixes")
    root_key = _name(zero, [zero] * PARTS)
    root = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        root_key.alias("key"), F.lit(None).cast("string").alias("parent_key"), "conv_id", zero.alias("depth"), "n_convs",
        zero.alias("words"))
    found = at.groupBy("key").agg(
        F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
        F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"))
    named = stored(found.unionByName(root).withColumn("id", F.monotonically_increasing_id()), "named")
    kids = named.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("__of")).agg(
        F.count(F.lit(1)).alias("n_children"))
    nodes = stored(named.join(kids, F.col("key") == F.col("__of"), "left").drop("__of")
                   .withColumn("n_children", F.coalesce("n_children", zero)), "nodes")
    # many nodes may have one parent, so such parents are met over salted keys
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("id").alias("parent"),
                           F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("__weight"))
    linked = stored(join_groups(nodes, "parent_key", parents, "__weight", F.xxhash64("id")).withColumns({
        "n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}), "linked")
    totals = subtree_totals(linked, ["n_leaves", "saved_tokens"])
    ends = (at.join(lengths.select("conv_id", F.col("length").alias("depth")), ["conv_id", "depth"]).select("key", "conv_id")
            .unionByName(lengths.where("length = 0").select(root_key.alias("key"), "conv_id")))
    return (linked.drop("n_leaves", "saved_tokens").join(totals, "id").join(end_hashes(ends), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
