"""Hybrid retrieval over a whole table of questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from attesta.functions.text import strip
from attesta.operators.search import score_topk
from attesta.plans.joins import small_side
from attesta.plans.lineage import cut
from attesta.plans.topk import top_k

# Fixed values.
RRF_K = 60
RETRIEVE_TOP_K = 40
SEARCH_TOP_K = 20
RERANK_TOP_K = 10
MIN_CANDIDATES = 100
MAX_PER_DOCUMENT = 4
MAX_PER_DOCUMENT_WIDENED = 2
MAX_ROUNDS = 3


def candidate_count(k: int) -> int:
    return max(3 * k, MIN_CANDIDATES)


def candidate_limit(ranked: DataFrame, k: int, rank: str = "rnk") -> DataFrame:
    """Keep what one branch may contribute to the fusion of ``k`` results."""
    return ranked.filter(F.col(rank) <= candidate_count(k))


def scope_filter(rows: DataFrame, scope: DataFrame, flags: DataFrame) -> DataFrame:
    """Rows a question may see. A question flagged ``unscoped`` sees all of them;
    any other sees only its listed documents, and none if it lists none."""
    open_rows = rows.join(flags.filter("unscoped").select("query_id"), "query_id", "left_semi")
    closed = rows.join(flags.filter("unscoped").select("query_id"), "query_id", "left_anti")
    return open_rows.unionByName(closed.join(scope, ["query_id", "document_id"], "left_semi"))


def ready_filter(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of documents whose status is ready."""
    ready = documents.filter("status = 'ready'").select("document_id")
    return chunks.join(ready, "document_id", "left_semi")


def dense_topk(questions: DataFrame, chunks: DataFrame, k: int, **options) -> DataFrame:
    return score_topk(chunks, questions, k, dense=True, sparse=False, **options).drop("branch")


def sparse_topk(questions: DataFrame, chunks: DataFrame, k: int, **options) -> DataFrame:
    return score_topk(chunks, questions, k, dense=False, sparse=True, **options).drop("branch")


def rrf_fuse(dense: DataFrame, sparse: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, chunk_id, rnk)."""
    null = F.lit(None).cast("bigint")
    rank = F.col("rnk").cast("bigint")
    both = (dense.select("query_id", "chunk_id", rank.alias("dense_rank"), null.alias("sparse_rank"))
            .unionByName(sparse.select("query_id", "chunk_id", null.alias("dense_rank"),
                                       rank.alias("sparse_rank"))))
    part = 1.0 / (F.lit(k) + F.coalesce("dense_rank", "sparse_rank"))
    return (both.withColumn("part", part).groupBy("query_id", "chunk_id")
            .agg(F.round(F.sum("part"), 9).alias("score"),
                 F.max("dense_rank").alias("dense_rank"), F.max("sparse_rank").alias("sparse_rank")))


def hydrate_hits(fused: DataFrame, chunks: DataFrame, k: int, columns: list[str]) -> DataFrame:
    """Cut the fused ids to k per question first, then fetch the wide columns."""
    best = top_k(fused, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k, rank="hit_rank")
    return small_side(best).join(chunks.select("chunk_id", *columns), "chunk_id")


def hybrid_search(questions: DataFrame, chunks: DataFrame, k: int = RETRIEVE_TOP_K, *,
                  scope: DataFrame | None = None, columns: tuple[str, ...] = ("document_id", "text"),
                  digits: int | None = None) -> DataFrame:
    """Both branches in one pass over ``chunks``, fused, hydrated and cut to k.

    ``chunks`` holds only what may be found (see ``ready_filter``). With ``scope``
    the question table needs an ``unscoped`` column.
    """
    ranked = cut(score_topk(chunks, questions, candidate_count(k), dense=True, sparse=True,
                            scope=scope, digits=digits))
    fused = rrf_fuse(ranked.filter("branch = 'dense'"), ranked.filter("branch = 'sparse'"))
    return hydrate_hits(fused, chunks, k, list(columns))


# ------------------------------------------------------------------------ rerank

#: scorer: (question text, passages) -> scores
Scorer = Callable[[str, list[str]], list[float]]


def overlap_scorer(question: str, passages: list[str]) -> list[float]:
    """Stand-in for a cross-encoder: share of the question's words in the passage."""
    import re

    def words(text: str) -> set[str]:
        return {w for w in re.split(r"[^a-z]+", text.lower()) if len(w) >= 4}

    asked = words(question)
    return [len(asked & words(p)) / max(1, len(asked)) for p in passages]


def rerank(hits: DataFrame, questions: DataFrame, scorer: Scorer = overlap_scorer,
           k: int = RERANK_TOP_K) -> DataFrame:
    """Score (question, passage) pairs and keep the best k per question.

    A question whose scoring fails keeps its fused order and null scores, and says why in
    ``rerank_error``.
    """
    pairs = hits.join(questions.select("query_id", F.col("text").alias("__question")), "query_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores = pd.Series(float("nan"), index=frame.index)
            errors = pd.Series(None, index=frame.index, dtype=object)
            for _, part in frame.groupby("query_id", sort=False):
                try:
                    scores.loc[part.index] = scorer(part["__question"].iloc[0], part["text"].tolist())
                except Exception as error:  # noqa: BLE001 - a failed scorer only loses the reordering
                    errors.loc[part.index] = f"{type(error).__name__}: {error}"
            yield frame.drop(columns="__question").assign(rerank_score=scores, rerank_error=errors)

    out = T.StructType([*hits.select("query_id", *[c for c in hits.columns if c != "query_id"]).schema.fields,
                        T.StructField("rerank_score", T.DoubleType()), T.StructField("rerank_error", T.StringType())])
    scored = pairs.mapInPandas(run, out)
    scored = scored.withColumn("rerank_score", F.nanvl("rerank_score", F.lit(None).cast("double")))
    failed = F.max(F.col("rerank_score").isNull()).over(W.partitionBy("query_id"))
    scored = scored.withColumn("rerank_score", F.when(~failed, F.col("rerank_score")))
    return top_k(scored, ["query_id"],
                 [F.desc_nulls_last("rerank_score"), F.asc("hit_rank")], k, rank="rerank_rank")


def search(questions: DataFrame, chunks: DataFrame, scope: DataFrame | None = None, k: int = SEARCH_TOP_K, *,
           scorer: Scorer | None = None, digits: int | None = None,
           columns: tuple[str, ...] = ("document_id", "text")) -> DataFrame:
    """Direct search, without rounds or caps: the k hits of every question, in the order of
    ``hit_rank``, or with ``scorer`` reranked and in the order of ``rerank_rank``.

    ``scope`` comes from ``topic_scope`` or lists documents; ``questions`` then say by
    ``unscoped`` who sees everything. ``columns`` needs the text for a scorer.
    """
    hits = hybrid_search(questions, chunks, k, scope=scope, columns=columns, digits=digits)
    return hits if scorer is None else rerank(hits, questions, scorer, k)


def dedupe_cap(hits: DataFrame, max_per_document: int | None = None, *,
               order: str = "hit_rank", keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """First occurrence of each chunk, then at most n chunks per document, in order."""
    once = W.partitionBy(*keys, "chunk_id").orderBy(order)
    out = hits.withColumn("__n", F.row_number().over(once)).filter("__n = 1").drop("__n")
    if max_per_document is None:
        return out
    per_document = W.partitionBy(*keys, "document_id").orderBy(order)
    return (out.withColumn("__n", F.row_number().over(per_document))
            .filter(F.col("__n") <= max_per_document).drop("__n"))


def topic_scope(asked_documents: DataFrame, asked_topics: DataFrame, doc_topics: DataFrame,
                flags: DataFrame) -> DataFrame:
    """Scope rows from explicit documents and topics.

    ``flags`` has (query_id, has_documents, has_topics). Both given: intersection,
    also when the document list is empty; one given: that one.
    """
    by_topic = asked_topics.join(doc_topics, "topic_id").select("query_id", "document_id").distinct()
    only = lambda cond: flags.filter(cond).select("query_id")
    both = (asked_documents.join(only("has_documents AND has_topics"), "query_id", "left_semi")
            .join(by_topic, ["query_id", "document_id"], "left_semi"))
    docs = asked_documents.join(only("has_documents AND NOT has_topics"), "query_id", "left_semi")
    topics = by_topic.join(only("NOT has_documents AND has_topics"), "query_id", "left_semi")
    return both.unionByName(docs).unionByName(topics).select("query_id", "document_id").distinct()


def escalate(hits: DataFrame, questions: DataFrame, scope: DataFrame, chunks: DataFrame,
             k: int = RETRIEVE_TOP_K, *, digits: int | None = None,
             columns: tuple[str, ...] = ("document_id", "text"), scorer: Scorer | None = None) -> DataFrame:
    """Questions whose non-empty scope found nothing search the whole corpus.

    Their hits are flagged and capped lower per document. A question with an empty
    scope never widens. With ``scorer`` both searches' hits are reranked before the cap,
    cut to ``RERANK_TOP_K`` and capped in that order (``rerank_rank``); ``columns`` then
    needs the text.
    """
    empty = (questions.join(scope.select("query_id").distinct(), "query_id", "left_semi")
             .join(hits.select("query_id").distinct(), "query_id", "left_anti"))
    wide = hybrid_search(empty, chunks, k, digits=digits, columns=columns)
    order = "hit_rank"
    if scorer is not None:
        hits, wide = cut(rerank(hits, questions, scorer)), cut(rerank(wide, empty, scorer))
        order = "rerank_rank"
    kept = dedupe_cap(hits, MAX_PER_DOCUMENT, order=order).withColumn("out_of_scope", F.lit(False))
    return kept.unionByName(dedupe_cap(wide, MAX_PER_DOCUMENT_WIDENED, order=order)
                            .withColumn("out_of_scope", F.lit(True)))


def retry_rounds(questions: DataFrame, rewrites: DataFrame, scope: DataFrame, chunks: DataFrame,
                 k: int = RETRIEVE_TOP_K, max_rounds: int = MAX_ROUNDS, *,
                 digits: int | None = None, scorer: Scorer | None = None) -> DataFrame:
    """Search, judge, rewrite, search again: all questions advance together.

    ``questions``: query_id, text, embedding, tokens, weights, unscoped.
    ``rewrites``: (query_id, round, sufficient, text, embedding, tokens, weights), the
    judgement of that round and the query proposed for the next. Keeps the last round
    that found something and flags hits by actual scope membership. With ``scorer`` every
    round reranks its hits with the question as then worded, see ``escalate``.
    """
    vector = ["text", "embedding", "tokens", "weights"]
    listed = scope.select("query_id").distinct()
    active = questions.select("query_id", *vector, "unscoped", F.lit(False).alias("widened"))
    found: DataFrame | None = None
    for number in range(1, max_rounds + 1):
        hits = hybrid_search(active, chunks, k, scope=scope, digits=digits)
        hits = cut(escalate(hits, active, scope, chunks, k, digits=digits, scorer=scorer))
        tagged = hits.withColumn("round", F.lit(number).cast("bigint"))
        found = tagged if found is None else found.unionByName(tagged)
        if number == max_rounds:
            break
        wide_now = hits.filter("out_of_scope").select("query_id").distinct().withColumn("__w", F.lit(True))
        judged = (active.join(hits.select("query_id").distinct(), "query_id", "left_semi")
                  .join(wide_now, "query_id", "left")
                  .withColumn("widened", F.col("widened") | F.coalesce("__w", F.lit(False))).drop("__w")
                  .join(listed.withColumn("has_scope", F.lit(True)), "query_id", "left"))
        said = (rewrites.filter((F.col("round") == number) & ~F.col("sufficient"))
                .select("query_id", *[F.col(c).alias(f"next_{c}") for c in vector]))
        again = judged.join(said, "query_id")
        proposed = strip("next_text")
        stuck = (F.coalesce(proposed, F.lit("")) == "") | (proposed == F.col("text"))
        widen = stuck & F.col("has_scope") & ~F.col("unscoped") & ~F.col("widened")
        active = cut(again.filter(~stuck | widen).select(
            "query_id", *[F.when(stuck, F.col(c)).otherwise(F.col(f"next_{c}")).alias(c) for c in vector],
            (F.col("unscoped") | widen).alias("unscoped"), (F.col("widened") | widen).alias("widened")))
        if active.isEmpty():
            break
    last = found.groupBy("query_id").agg(F.max("round").alias("round"))
    inside = scope.select("query_id", "document_id").distinct().withColumn("__in", F.lit(True))
    return (found.drop("out_of_scope").join(last, ["query_id", "round"], "left_semi")
            .join(inside, ["query_id", "document_id"], "left")
            .join(listed.withColumn("__has", F.lit(True)), "query_id", "left")
            .withColumn("out_of_scope", F.coalesce("__has", F.lit(False)) & F.col("__in").isNull())
            .drop("__in", "__has"))


def interleave(findings: DataFrame, limit: int = RERANK_TOP_K) -> DataFrame:
    """Merge the hit lists of a question's sub-queries round-robin and number them.

    ``findings``: question_id, subquery, hit_rank, chunk_id, score, rerank_score, ....
    Taking turns equals ordering each chunk by its best (rank, sub-query).
    """
    once = W.partitionBy("question_id", "chunk_id").orderBy("hit_rank", "subquery")
    first = findings.withColumn("__n", F.row_number().over(once)).filter("__n = 1").drop("__n")
    numbered = top_k(first, ["question_id"], ["hit_rank", "subquery"], limit, rank="sid")
    return (numbered.withColumn("sid", F.col("sid").cast("bigint"))
            .withColumn("score", F.coalesce("rerank_score", "score")).drop("rerank_score"))


def hydrate_citations(citations: DataFrame, chunks: DataFrame, columns: list[str]) -> DataFrame:
    """Fill cited chunks' columns; an unknown chunk keeps nulls.

    Only the cited chunks are fetched before the outer join, so the chunk table is
    scanned in place when the citations are few.
    """
    asked = small_side(citations.select("chunk_id").distinct())
    found = chunks.select("chunk_id", *columns).join(asked, "chunk_id", "left_semi")
    return citations.join(found, "chunk_id", "left")
