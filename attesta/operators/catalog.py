"""Document and channel listings and their scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_documents(documents: DataFrame, doc_topics: DataFrame | None = None, *, topic_id: int | None = None,
                   status: str | None = None, q: str | None = None, limit: int = 200,
                   offset: int = 0) -> DataFrame:
    """One page of documents, newest first, ties by id.

    Spark keeps the best ``offset + limit`` rows per task, so no full sort runs.
    """
    out = documents
    if topic_id is not None:
        out = out.join(doc_topics.filter(F.col("topic_id") == topic_id), "document_id", "left_semi")
    if status:
        out = out.filter(F.col("status") == status)
    if q:
        out = out.filter(F.col("filename").ilike(f"%{q}%"))
    return out.orderBy(F.desc("created_at"), F.desc("document_id")).offset(offset).limit(limit)


def filter_documents(documents: DataFrame, doc_topics: DataFrame | None = None, *, text: str = "",
                     topic_id: int | None = None) -> DataFrame:
    """Substring of filename or summary, ignoring case, within a topic."""
    out = documents
    if topic_id is not None:
        out = out.join(doc_topics.filter(F.col("topic_id") == topic_id), "document_id", "left_semi")
    needle = text.strip().lower()
    if needle:
        out = out.filter(F.lower("filename").contains(needle)
                         | F.lower(F.coalesce("summary", F.lit(""))).contains(needle))
    return out


def list_channels(channels: DataFrame, messages: DataFrame, channel_documents: DataFrame) -> DataFrame:
    """Unarchived channels with message and document counts.

    Counting uses no order; sort the result by ``updated_at`` descending to show it.
    """
    said = messages.groupBy("channel_id").agg(F.count("*").alias("message_count"))
    docs = channel_documents.groupBy("channel_id").agg(F.count("*").alias("document_count"))
    zero = F.lit(0).cast("bigint")
    return (channels.filter("NOT archived").join(said, "channel_id", "left").join(docs, "channel_id", "left")
            .withColumn("message_count", F.coalesce("message_count", zero))
            .withColumn("document_count", F.coalesce("document_count", zero)))


def update_scope(current: DataFrame, adds: DataFrame, removes: DataFrame,
                 documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new scope, rejected additions). Additions apply first, so a removal wins."""
    keys = ["channel_id", "document_id"]
    known = adds.join(documents.select("document_id"), "document_id", "left_semi")
    unknown = adds.join(documents.select("document_id"), "document_id", "left_anti")
    merged = current.select(*keys).unionByName(known.select(*keys)).distinct()
    return merged.join(removes.select(*keys), keys, "left_anti"), unknown.select(*keys)


def channel_scope(channel_documents: DataFrame, channels: DataFrame) -> DataFrame:
    """Documents of the given channels."""
    return (channel_documents.join(channels.select("channel_id"), "channel_id", "left_semi")
            .select("channel_id", "document_id"))
