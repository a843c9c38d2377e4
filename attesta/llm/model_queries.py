"""op1, op5 and op8: operators that learn from labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import langid, toxicity, urls
from attesta.llm.registry import query
from attesta.llm.scratch import table


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def toxic_labels(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from."""
    return labels.select("doc_id", "toxic").where(~held_out(F.col("doc_id")))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, toxic_labels(table(spark, sf_dir, "labels")))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query("op8_url_filter")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    # the rules' own verdicts are the labels that the trees learn from
    _, verdict = urls.rule_of(URL_RULES, urls.host(F.col("url")), urls.path(F.col("url")))
    model = urls.fit(pages.select("url", (verdict == "block").cast("double").alias("label")))
    return urls.judge(pages, model, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "block_score")
