"""What every streaming query here needs."""

from __future__ import annotations

import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

from attesta.plans.lineage import ensure_checkpoint_dir

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State variables and timers need the RocksDB store."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(key, "") or ""):
        spark.conf.set(key, ROCKSDB)


def carry_code(module_name: str) -> None:
    """Pickle a module's classes by value: the process that sets up state variables
    does not see the files sent to the workers."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint location."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now and read back what it wrote."""
    spark = stream.sparkSession
    folder = work_dir(spark, name)
    query = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out")
             .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
