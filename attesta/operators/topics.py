"""The emergent topic taxonomy.

``topics``: id, name, slug, embedding, doc_count, merged_into_id, created_by;
``document_topics``: document_id, topic_id, confidence, source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import SAMPLE_MARK, slugify, strip
from attesta.operators.graphs import greedy_vector_leaders
from attesta.operators.search import nearest, similar_pairs
from attesta.plans.lineage import cut
from attesta.plans.scan import by_position, running
from attesta.plans.topk import first_per_key

# Fixed values.
HEAD_CHARS = 6000
SAMPLE_CHARS = 2000
MERGE_THRESHOLD = 0.85
SUGGEST_THRESHOLD = 0.70
MAX_TOPICS, MAX_ENTITIES, MAX_QUESTIONS = 4, 10, 3
LABELS = ("struct<topics:array<string>,summary:string,key_entities:array<string>,"
          "suggested_questions:array<string>>")


def live(topics: DataFrame) -> DataFrame:
    return topics.filter("merged_into_id IS NULL")


def document_view(chunks: DataFrame) -> DataFrame:
    """(document_id, view): the opening of a document and a spread of samples.

    Only chunks that start inside the opening, or within the gap behind it, and the few
    sampled ones are gathered, so a document of any length contributes a bounded group.
    """
    gap = 2
    placed = running(chunks.select("document_id", "ord", "text"), ["document_id"], ["ord"], by_position("ord"),
                     {"__n": ("sum", F.lit(1).cast("bigint")),
                      "__end": ("sum", (F.length("text") + gap).cast("bigint"))})
    total = chunks.groupBy("document_id").agg(F.count("*").alias("__all"))
    i, start = F.col("__n") - 1, F.col("__end") - F.length("text") - gap
    step = F.greatest(F.lit(1), F.floor(F.col("__all") / 4))
    rows = (placed.join(total, "document_id")
            .withColumn("__head", start < HEAD_CHARS + gap)
            .withColumn("__pick", (F.col("__all") > 4) & (i >= step) & (i % step == 0))
            .filter("__head OR __pick"))
    both = rows.groupBy("document_id").agg(
        F.sort_array(F.collect_list(F.struct("__n", "__head", "__pick", "text"))).alias("__c"),
        F.first("__all").alias("__all"))
    joined = lambda flag: F.array_join(F.transform(
        F.filter("__c", lambda c: c[flag]), lambda c: c["text"]), "\n\n")
    head = F.substring(joined("__head"), 1, HEAD_CHARS)
    sample = F.substring(joined("__pick"), 1, SAMPLE_CHARS)
    return both.select("document_id", F.when(F.col("__all") > 4, F.concat(head, F.lit(SAMPLE_MARK), sample))
                       .otherwise(head).alias("view"))


def clean_labels(rows: DataFrame, column: str = "raw") -> DataFrame:
    """Topics, summary, entities and questions from a model's JSON; blanks dropped, lists cut."""
    p = F.from_json(column, LABELS)
    tidy = lambda name, n: F.slice(F.filter(
        F.transform(F.coalesce(F.col("__p")[name], F.array().cast("array<string>")), strip),
        lambda t: t.isNotNull() & (t != "")), 1, n).alias(name)
    return (rows.withColumn("__p", p)
            .select(*[c for c in rows.columns if c != column], tidy("topics", MAX_TOPICS),
                    strip(F.coalesce("__p.summary", F.lit(""))).alias("summary"),
                    tidy("key_entities", MAX_ENTITIES), tidy("suggested_questions", MAX_QUESTIONS)))


def resolve_topics(proposals: DataFrame, topics: DataFrame, threshold: float = MERGE_THRESHOLD,
                   batch: int = 1024) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(assignments, new topics, aliases).

    ``proposals``: id (bigint, the order of arrival), document_id, pos (0-based place in
    its document), name, embedding. A proposal takes the nearest live topic at or above
    the threshold, counting topics created by earlier proposals; otherwise it founds
    one. New topics are named ``-(proposal id) - 1`` until stored.
    """
    proposals = cut(proposals.select("id", "document_id", "pos", "name", "embedding"))
    old = live(topics).filter("embedding IS NOT NULL").select("id", "embedding")
    # equal vectors have the same nearest topic, so one of them is compared
    alike = cut(proposals.filter("embedding IS NOT NULL").groupBy("embedding").agg(F.min("id").alias("left_id")))
    known = nearest(alike, old.withColumnRenamed("id", "right_id")).drop("rnk").toDF("left_id", "known", "known_sim")
    known = alike.join(known.filter(F.col("known_sim") >= threshold), "left_id")
    known = cut(proposals.select("id", "embedding").join(known, "embedding").select("id", "known", "known_sim"))
    fresh = proposals.join(known.select("id"), "id", "left_anti").select("id", F.col("id").alias("ord"), "embedding")
    leaders = cut(greedy_vector_leaders(fresh, threshold, batch).filter("kept").select("id"))
    founded = proposals.join(leaders, "id", "left_semi")
    newest = nearest(proposals.withColumnRenamed("id", "left_id"),
                     founded.select(F.col("id").alias("right_id"), "embedding"), earlier=True)
    newest = newest.drop("rnk").toDF("id", "new", "new_sim").filter(F.col("new_sim") >= threshold)
    joined = (proposals.drop("embedding").join(known, "id", "left").join(newest, "id", "left")
              .join(leaders.withColumn("__lead", F.lit(True)), "id", "left"))
    use_new = F.col("__lead").isNotNull() | F.col("known").isNull() | (F.col("new_sim") > F.col("known_sim"))
    own = -F.when(F.col("__lead"), F.col("id")).otherwise(F.col("new")) - 1
    placed = cut(joined.select("id", "document_id", "pos", "name",
                               F.when(use_new, own).otherwise(F.col("known")).alias("topic_id"),
                               F.coalesce("__lead", F.lit(False)).alias("founds")))
    assignments = first_per_key(placed.select("document_id", "topic_id", "pos"), ["document_id", "topic_id"], ["pos"])

    slugs = placed.filter("founds").withColumn("base", slugify("name"))
    taken = topics.select(F.col("slug").alias("base")).distinct().withColumn("__taken", F.lit(True))
    first = slugs.groupBy("base").agg(F.min("id").alias("__first"))
    new = (slugs.join(first, "base").join(taken, "base", "left")
           .withColumn("slug", F.when(F.col("__taken") | (F.col("id") > F.col("__first")),
                                      F.concat_ws("-", "base", (F.col("pos") + 1).cast("string")))
                       .otherwise(F.col("base")))
           .join(proposals.select("id", "embedding"), "id")
           .select("topic_id", "name", "slug", "embedding", F.lit("agent").alias("created_by")))
    names = topics.select(F.col("id").alias("topic_id"), F.col("name").alias("topic_name")).unionByName(
        new.select("topic_id", F.col("name").alias("topic_name")))
    aliases = (placed.filter("NOT founds").join(names, "topic_id")
               .filter(strip("name") != strip("topic_name"))
               .select("topic_id", F.col("name").alias("alias")).distinct())
    return assignments, new, aliases


def add_aliases(aliases: DataFrame, additions: DataFrame, topics: DataFrame) -> DataFrame:
    """Alias table after adding (topic_id, alias), leaving out the topic's own name."""
    named = additions.join(topics.select(F.col("id").alias("topic_id"), "name"), "topic_id")
    new = named.filter(strip("alias") != strip("name")).select("topic_id", "alias").distinct()
    return aliases.select("topic_id", "alias").unionByName(
        new.join(aliases, ["topic_id", "alias"], "left_anti"))


def attach_topics(document_topics: DataFrame, additions: DataFrame, topics: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bridge, topics) after inserting absent (document_id, topic_id) rows."""
    keys = ["document_id", "topic_id"]
    new = additions.select(*keys).distinct().join(document_topics, keys, "left_anti")
    rows = new.select(*keys, F.lit(None).cast("double").alias("confidence"), F.lit("agent").alias("source"))
    gained = new.groupBy(F.col("topic_id").alias("id")).agg(F.count("*").alias("__n"))
    counted = (topics.join(gained, "id", "left")
               .withColumn("doc_count", F.coalesce("doc_count", F.lit(0)) + F.coalesce("__n", F.lit(0))).drop("__n"))
    return document_topics.select(*keys, "confidence", "source").unionByName(rows), counted


def merge_plan(topics: DataFrame, threshold: float = MERGE_THRESHOLD, batch: int = 1024) -> DataFrame:
    """(keep, drop, similarity): larger topics absorb the later near-duplicates.

    A threshold of 0 means the default.
    """
    nodes = live(topics).filter("embedding IS NOT NULL").select(
        "id", (-F.coalesce("doc_count", F.lit(0))).alias("ord"), "embedding")
    leaders = greedy_vector_leaders(nodes, threshold or MERGE_THRESHOLD, batch)
    return leaders.filter("NOT kept").select(F.col("keeper").alias("keep"), F.col("id").alias("drop"), "similarity")


def merge_candidates(topics: DataFrame, low: float = SUGGEST_THRESHOLD, high: float = MERGE_THRESHOLD) -> DataFrame:
    """(keep, drop, similarity): pairs worth a look, the topic with more documents kept."""
    nodes = live(topics).filter("embedding IS NOT NULL")
    pairs = similar_pairs(nodes.withColumn("weight", F.coalesce("doc_count", F.lit(0))), low, high)
    first = F.col("a_weight") >= F.col("b_weight")
    return pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("keep"),
                        F.when(first, F.col("b")).otherwise(F.col("a")).alias("drop"),
                        F.round("similarity", 4).alias("similarity"))


def merge_topics(document_topics: DataFrame, pairs: DataFrame, source: str | None = None) -> DataFrame:
    """Bridge table with the rows of ``drop`` moved to ``keep``.

    A row the kept topic already had wins over a moved one. An explicit merge marks
    what it moves, e.g. ``source='user'``.
    """
    moved = document_topics.join(pairs.select(F.col("drop").alias("topic_id"), "keep"), "topic_id", "left")
    by = F.col("source") if source is None else F.when(F.col("keep").isNotNull(), source).otherwise(F.col("source"))
    rows = moved.select("document_id", F.coalesce("keep", "topic_id").alias("topic_id"), "confidence",
                        by.alias("source"), F.when(F.col("keep").isNotNull(), F.col("topic_id")).otherwise(-1)
                        .alias("__from"))
    return first_per_key(rows, ["document_id", "topic_id"], ["__from"]).drop("__from")


def mark_merged(topics: DataFrame, pairs: DataFrame) -> DataFrame:
    return (topics.join(pairs.select(F.col("drop").alias("id"), "keep"), "id", "left")
            .withColumn("merged_into_id", F.coalesce("keep", "merged_into_id")).drop("keep"))


def recount(topics: DataFrame, document_topics: DataFrame) -> DataFrame:
    """``doc_count`` from the bridge; 0 when absent."""
    n = document_topics.groupBy(F.col("topic_id").alias("id")).agg(F.count("*").alias("__n"))
    return (topics.join(n, "id", "left")
            .withColumn("doc_count", F.coalesce("__n", F.lit(0))).drop("__n"))


def merge_similar_topics(topics: DataFrame, document_topics: DataFrame, aliases: DataFrame,
                         threshold: float = MERGE_THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(topics, bridge, aliases) after one sweep."""
    pairs = cut(merge_plan(topics, threshold))
    bridge = merge_topics(document_topics, pairs)
    names = topics.select(F.col("id").alias("drop"), F.col("name").alias("alias"))
    extra = pairs.join(names, "drop").select(F.col("keep").alias("topic_id"), "alias")
    return (recount(mark_merged(topics, pairs), bridge), bridge, add_aliases(aliases, extra, topics))


def list_topics(topics: DataFrame, document_topics: DataFrame) -> DataFrame:
    """Live topics with their counts; show them by count descending, then name."""
    return recount(live(topics), document_topics).select("id", "name", "doc_count")


def aliases_of(aliases: DataFrame, topics: DataFrame) -> DataFrame:
    """Aliases of the given topics."""
    return aliases.join(topics.select(F.col("id").alias("topic_id")), "topic_id", "left_semi")


def rename_topics(topics: DataFrame, aliases: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topics, aliases) after (id, new_name) renames; the old name stays as an alias."""
    hit = topics.join(renames, "id", "left")
    renamed = F.col("new_name").isNotNull()
    changed = hit.filter(renamed & (F.col("name") != F.col("new_name"))).select(
        F.col("id").alias("topic_id"), F.col("name").alias("alias"))
    name = strip("new_name")
    out = (hit.withColumn("slug", F.when(renamed, slugify(name)).otherwise(F.col("slug")))
           .withColumn("created_by", F.when(renamed, "user").otherwise(F.col("created_by")))
           .withColumn("name", F.when(renamed, name).otherwise(F.col("name"))).drop("new_name"))
    return out, aliases.select("topic_id", "alias").unionByName(changed)


def topics_by_document(topics: DataFrame, document_topics: DataFrame) -> DataFrame:
    """(document_id, topics): live topics by name; a document carries only a few."""
    rows = document_topics.join(live(topics).select(F.col("id").alias("topic_id"), "name"), "topic_id")
    return rows.groupBy("document_id").agg(
        F.sort_array(F.collect_list(F.struct("name", "topic_id"))).alias("topics"))
