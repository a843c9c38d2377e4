"""A training-corpus pipeline of five stages over the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import toxicity
from attesta.llm.binpack import pack
from attesta.llm.fmindex import remove_leaks
from attesta.llm.jaccard import near_duplicates
from attesta.llm.linededup import drop_common_lines
from attesta.llm.model_queries import toxic_labels
from attesta.llm.queries import ORACLES, QUERIES
from attesta.llm.scratch import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

TOXIC = 0.3
END, SEQUENCE = 2, 1024
KEPT = ["doc_id", "text"]


def held(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all other columns in one struct: a stage's own columns, whatever
    they are called, then meet none of the documents'."""
    rest = [c for c in docs.columns if c not in KEPT]
    return docs.select(*KEPT, F.struct(*rest, F.lit(None).cast("int").alias("__none")).alias("__row"))


def freed(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, with the text as it now is. n_chars counts it, where
    there is such a column; null texts keep what they have."""
    out = found.select(*[F.col(c) if c in KEPT else F.col("__row").getField(c).alias(c) for c in docs.columns])
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``TOXIC``. Null texts are scored as empty ones;
    equal texts have equal scores, so repeated rows stay or go together; no documents, or
    none with a label, give a score of 0 and all stay."""
    model = toxicity.fit(docs, toxic_labels(table(spark, sf_dir, "labels")))
    return freed(toxicity.score(held(docs), model).where(F.col("score") < TOXIC), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that ten documents or more have in common. Documents with
    the same lines count once: which of the copies stays is decided by the next stage. Null
    stays null; a text all of whose lines are common stays as an empty one."""
    return freed(drop_common_lines(held(docs), least=10, copies_once=True), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of documents linked by a Jaccard similarity of 0.8 or more on
    5-word shingles, the one with the smallest id, or every row of it that repeats that id
    and text; documents without words, null texts among them, and rows without an id that
    are linked with nothing all stay."""
    found = near_duplicates(docs, width=5, percent=80)
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    own = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (own == F.col("__hash")), "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of phrases of the benchmark. Null and empty texts stay
    as they are; an empty benchmark changes nothing."""
    return freed(remove_leaks(held(docs), table(spark, sf_dir, "benchmark"), window=10), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces, their token ids, and their places in sequences. Null and empty
    texts make one piece of one token; repeated rows are packed as often as they come."""
    import public_tokenizers  # only this stage needs its files

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), END, SEQUENCE)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack_sequences),
]

#: the first stage learns a model and the last runs a tokenizer: SQL can express neither
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> tuple[dict, dict]:
    """The queries of the corpus operators and the pipeline, and their SQL."""
    return {**QUERIES, "pipeline": run}, {**ORACLES, **({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})}
