"""Intermediate tables in the storage that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Without that setting a temporary folder serves a local master; on a cluster it is an
    error, since no other machine could read such a folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        folder = getattr(spark.sparkContext, "_llm_scratch", None) or tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext._llm_scratch = folder
        return f"file://{folder}"
    raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a table of its own and read back: computed once, and whatever an
    executor loses later is read again instead of being computed again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
