"""Session defaults for local runs; a cluster brings its own configuration."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str = "local[8]", shuffle_partitions: int = 8,
              driver_memory: str = "12g", **extra: str) -> SparkSession:
    builder = (SparkSession.builder.master(master).appName("attesta")
               .config("spark.driver.memory", driver_memory)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions)))
    for key, value in {**LOCAL_DEFAULTS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run in tasks are found by module name there, and a worker need not
    share the driver's import path.
    """
    sc = spark.sparkContext
    if getattr(sc, "_attesta_shipped", False):
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="attesta-")) / "attesta"), "zip",
                                  package.parent, package.name)
    sc.addPyFile(archive)
    sc._attesta_shipped = True
