"""Plans, gold sets and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions.text import strip

MAX_SUBQUERIES = 4  # fixed value

GOLD = ("id string, question string, document_filenames array<string>, expect_answer_contains array<string>, "
        "expect_citation struct<filename:string,page_in:array<bigint>,text_contains:string>, "
        "expect_no_citations boolean, max_rejected bigint")


def read_gold_cases(spark: SparkSession, path: str) -> DataFrame:
    """Gold cases from JSON lines; every field but id and question may be missing."""
    return spark.read.schema(GOLD).json(path)


def clean_plans(plans: DataFrame) -> DataFrame:
    """Plans (question, intent, subqueries) with blank sub-queries gone and at most four;
    a question without any searches for itself unless it is small talk."""
    none = F.array().cast("array<string>")
    kept = F.filter(F.transform(F.coalesce("subqueries", none), strip), lambda s: s.isNotNull() & (s != ""))
    intent = F.coalesce("intent", F.lit("doc_qa"))
    return (plans.withColumn("subqueries", kept).withColumn("intent", intent)
            .withColumn("subqueries", F.slice(F.when(
                (F.size("subqueries") == 0) & (F.col("intent") != "chitchat"), F.array("question"))
                .otherwise(F.col("subqueries")), 1, MAX_SUBQUERIES)))


def score_cases(gold: DataFrame, results: DataFrame, citations: DataFrame) -> DataFrame:
    """(id, passed, reasons).

    ``results``: id, answer (cleaned), rejected (count); ``citations``: id, filename,
    page_no, snippet. A page range is tried before a text; neither means any citation
    of the file. Citations only meet their own case, and only a count and a flag per
    case come back.
    """
    want = F.col("expect_citation")
    fits = (F.when(want["page_in"].isNotNull(), F.col("page_no").between(want["page_in"][0], want["page_in"][1]))
            .when(want["text_contains"].isNotNull(),
                  F.contains(F.coalesce("snippet", F.lit("")), want["text_contains"])).otherwise(True))
    seen = (citations.join(gold.select("id", "expect_citation"), "id").groupBy("id").agg(
        F.count("*").alias("__n"),
        F.bool_or(F.coalesce((F.col("filename") == want["filename"]) & fits, F.lit(False))).alias("__match")))
    row = gold.join(results, "id").join(seen, "id", "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    none = F.array().cast("array<string>")
    missing = F.transform(F.filter(F.coalesce("expect_answer_contains", none),
                                   lambda s: ~F.contains(F.coalesce("answer", F.lit("")), s)),
                          lambda s: F.concat(F.lit("answer missing '"), s, F.lit("'")))
    no_cites = F.coalesce("expect_no_citations", F.lit(False))
    other = F.array_compact(F.array(
        F.when(no_cites & (F.col("__n") > 0),
               F.concat(F.lit("expected no citations, got "), F.col("__n").cast("string"))),
        F.when(~no_cites & want.isNotNull() & ~F.coalesce("__match", F.lit(False)), F.lit("no citation matched")),
        F.when(F.col("rejected") > F.coalesce("max_rejected", F.lit(0)),
               F.concat(F.lit("rejected citations "), F.col("rejected").cast("string"), F.lit(" > max "),
                        F.coalesce("max_rejected", F.lit(0)).cast("string")))))
    reasons = F.concat(missing, other)
    return row.select("id", (F.size(reasons) == 0).alias("passed"), reasons.alias("reasons"))


def missing_gold_documents(gold: DataFrame, documents: DataFrame) -> DataFrame:
    """Filenames the gold set needs that no ready document has."""
    needed = gold.select(F.explode("document_filenames").alias("filename")).distinct()
    return needed.join(documents.filter("status = 'ready'").select("filename"), "filename", "left_anti")


def pass_rate(scores: DataFrame) -> DataFrame:
    """One row: passed, total."""
    return scores.agg(F.coalesce(F.sum(F.col("passed").cast("bigint")), F.lit(0)).alias("passed"),
                      F.count("*").alias("total"))
