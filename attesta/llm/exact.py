"""Exact duplicates, found by skew-safe combining."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.hot import join_groups
from attesta.llm.scratch import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """Text with A-Z lower-cased and nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32,
                     digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """All rows and columns of ``docs`` with keep_id, group_size and kept.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal
    texts the row with the largest id stays.

    Three steps, each of which groups by the full text and not by its digest alone: the
    partial aggregate before the first shuffle leaves one row per text, salt and input
    task; the first shuffle merges these by digest, text and salt, so a text that fills a
    third of the table is spread over ``salts`` tasks; the second combines the at most
    ``salts`` winners of each text. Rows then meet their group by digest. That is exact for
    every digest that only one text has; digests that several texts share (never seen with
    SHA-256, but tested with a weak one) are settled by comparing the texts once more.

    Null ids lose against any id; a group without ids has keep_id null. Rows that repeat
    the winning id (or are all without one) are the same row several times over and are
    all marked kept. Columns of ``docs`` named like the three results are replaced; names
    beginning with two underscores are reserved.
    """
    docs = docs.drop("keep_id", "group_size", "kept")
    base = docs.withColumns({"__text": normalised(F.col(text_col)),
                             "__salt": F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts))})
    base = base.withColumn("__digest", digest(F.col("__text")).cast("string"))
    salted = (base.groupBy("__digest", "__text", "__salt")
              .agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    texts = (salted.repartition(F.col("__digest")).groupBy("__digest", "__text")
             .agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")))
    # one row per digest; where texts collide, how many there are is all that is used
    groups = stored(texts.groupBy("__digest").agg(F.max("keep_id").alias("keep_id"),
                                                  F.sum("group_size").alias("group_size"),
                                                  F.count(F.lit(1)).alias("__texts")), "digests")
    spread = F.xxhash64(F.col(id_col))
    met = join_groups(base, "__digest", groups, "group_size", spread)
    clashes = groups.where("__texts > 1").select(F.col("__digest").alias("__clash"))
    if not clashes.isEmpty():
        own = texts.select(F.col("__digest").alias("__clash"), F.col("__text").alias("__content"),
                           F.col("keep_id").alias("__keep"), F.col("group_size").alias("__size"))
        own = own.join(clashes, "__clash", "left_semi")
        mixed = met.where("__texts > 1").join(
            own, (F.col("__digest") == F.col("__clash")) & (F.col("__text") == F.col("__content")))
        mixed = mixed.withColumns({"keep_id": F.col("__keep"), "group_size": F.col("__size")})
        met = met.where("__texts = 1").unionByName(mixed.select(met.columns))
    return (met.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))
            .select(*docs.columns, "keep_id", "group_size", "kept"))
