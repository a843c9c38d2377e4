"""Stage ledger and keyed table replacement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STAGES = ["convert", "extract", "chunk", "embed", "categorize"]  # fixed values, in order


def outstanding_stages(documents: DataFrame, jobs: DataFrame, force: bool = False) -> DataFrame:
    """Stages still to run per document, with ``is_next`` on the first.

    A failed stage is outstanding and, being earlier, blocks the later ones.
    """
    all_stages = documents.select("document_id", F.posexplode(
        F.array(*[F.lit(s) for s in STAGES])).alias("__i", "stage"))
    todo = all_stages.withColumn("ord", (F.col("__i") + 1).cast("bigint")).drop("__i")
    if not force:
        done = jobs.filter("status = 'done'").select("document_id", "stage")
        todo = todo.join(done, ["document_id", "stage"], "left_anti")
    first = todo.groupBy("document_id").agg(F.min("ord").alias("__first"))
    return (todo.join(first, "document_id")
            .select("document_id", "stage", "ord", (F.col("ord") == F.col("__first")).alias("is_next")))


def record_stage(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Ledger after the given runs: one more attempt, new status, error and times.

    ``jobs``: document_id, stage, status, attempts, error, started_at, finished_at;
    ``results``: document_id, stage, error, started_at, finished_at (one per stage).
    """
    old, new = jobs.alias("o"), results.alias("n")
    ran = F.col("n.document_id").isNotNull()
    pick = lambda c: F.when(ran, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    status = F.when(ran, F.when(F.col("n.error").isNull(), "done").otherwise("failed"))
    return (old.join(new, (F.col("o.document_id") == F.col("n.document_id"))
                     & (F.col("o.stage") == F.col("n.stage")), "full_outer")
            .select(F.coalesce("n.document_id", "o.document_id").alias("document_id"),
                    F.coalesce("n.stage", "o.stage").alias("stage"),
                    F.coalesce(status, F.col("o.status")).alias("status"),
                    (F.coalesce("o.attempts", F.lit(0)) + ran.cast("int")).cast("bigint").alias("attempts"),
                    pick("error"), pick("started_at"), pick("finished_at")))


def replace_by_key(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Delete the rows of every key present in ``new``, then insert ``new``."""
    return target.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def write_replacing(new: DataFrame, path: str, key: str, shards: int) -> None:
    """Replace by key in a sharded table: only shards holding a replaced key are
    rewritten, by dynamic partition overwrite, so a retry gives the same table."""
    spark = new.sparkSession
    shard = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")
    new = new.withColumn("__shard", shard)
    probe = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = probe.getFileSystem(spark._jsc.hadoopConfiguration()).exists(probe)
    if exists:
        stored = T.StructType([*new.schema.fields])
        touched = new.select("__shard").distinct()
        old = spark.read.schema(stored).parquet(path).join(touched, "__shard", "left_semi")
        from attesta.plans.lineage import cut
        new = cut(replace_by_key(old, new, [key]))  # read fully before overwriting
    (new.repartition("__shard").write.mode("overwrite").partitionBy("__shard")
     .option("partitionOverwriteMode", "dynamic").parquet(path))


# Every table that depends on a document: how its rows reach the document id.
DEPENDENTS = {"pages": "document_id", "elements": "document_id", "chunks": "document_id",
              "document_topics": "document_id", "channel_documents": "document_id",
              "citations": "document_id", "ingest_jobs": "document_id"}


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Delete documents and everything that hangs on them.

    ``tables`` may hold documents, any of ``DEPENDENTS``, and spans (through chunks).
    """
    gone = ids.select("document_id").distinct()
    out = {}
    for name, df in tables.items():
        if name == "spans":
            dead = tables["chunks"].join(gone, "document_id", "left_semi").select("chunk_id")
            out[name] = df.join(dead, "chunk_id", "left_anti")
        elif name == "documents" or name in DEPENDENTS:
            out[name] = df.join(gone, DEPENDENTS.get(name, "document_id"), "left_anti")
        else:
            out[name] = df
    return out
