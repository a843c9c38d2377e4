"""Files arriving, and the periodic clean-up of topics."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from attesta.operators.topics import MERGE_THRESHOLD, merge_similar_topics
from attesta.plans.lineage import cut
from attesta.sources.files import classify_source, size_filter, split_rejected, with_hash
from attesta.sources.ledger import outstanding_stages
from attesta.streaming.runtime import carry_code, use_rocksdb

CATALOG = ("file_id bigint, filename string, source_kind string, size_bytes bigint, sha256 string, "
           "document_id bigint, status string, batch bigint")


REFUSED = ["file_id", "filename", "mime", "size_bytes", "arrival", "reason"]


def _listed(spark, pattern: str) -> list[str]:
    p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return [f.getPath().toString() for f in found or ()]


def _base(spark, path: str) -> int:
    """The last batch that a finished compaction has taken in, or -1."""
    done = _listed(spark, f"{path}/base-*/_SUCCESS")
    return max((int(f.split("/base-")[-1].split("/")[0]) for f in done), default=-1)


def read_catalog(spark, path: str) -> DataFrame:
    """The newest compacted base and the batches since."""
    parts, base = [], _base(spark, path)
    if base >= 0:
        parts.append(spark.read.schema(CATALOG).parquet(f"{path}/base-{base}"))
    if _listed(spark, f"{path}/batch=*"):
        later = spark.read.schema(CATALOG).option("basePath", path).parquet(f"{path}/batch=*")
        parts.append(later.filter(F.col("batch") > base))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], CATALOG)


def compact_catalog(spark, path: str, files: int = 1) -> None:
    """Write all rows up to the last batch but one, which may still be run again, as a new
    base of ``files`` files. Readers use it once it is complete; older bases and the
    folders of its batches may then be removed."""
    batches = sorted(int(f.split("batch=")[-1]) for f in _listed(spark, f"{path}/batch=*"))
    if len(batches) > 1 and batches[-2] > _base(spark, path):
        whole = read_catalog(spark, path).filter(F.col("batch") <= batches[-2])
        whole.repartition(files).write.mode("overwrite").parquet(f"{path}/base-{batches[-2]}")


def rejects_path(catalog_path: str) -> str:
    """Where the files are listed that a stream did not take."""
    return f"{catalog_path.rstrip('/')}-rejects"


class FirstFile(StatefulProcessor):
    """The document of one content hash: the first file that brings it."""

    def init(self, handle) -> None:
        self.owner = handle.getValueState("owner", "document_id long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.owner.exists():
            for _ in rows:
                pass
            return
        first = pd.concat([f.nsmallest(1, ["arrival", "file_id"]) for f in rows if len(f)]).nsmallest(1, ["arrival", "file_id"])
        self.owner.update((int(first["file_id"].iloc[0]),))
        yield first[["file_id", "filename", "source_kind", "size_bytes", "sha256"]]

    def close(self) -> None:
        pass


def new_documents(files: DataFrame) -> DataFrame:
    """Files of a stream whose content no earlier file had (file_id, filename, source_kind,
    size_bytes, sha256). ``files``: these and arrival.

    The owner of a hash is looked up in the state store, so what a batch reads follows the
    batch and not the catalog; of equal files in a batch the first by (arrival, file_id) wins.
    """
    use_rocksdb(files.sparkSession)
    carry_code(__name__)
    narrow = files.select("file_id", "filename", "source_kind", "size_bytes", "sha256", "arrival")
    return narrow.groupBy("sha256").transformWithStateInPandas(
        FirstFile(), "file_id long, filename string, source_kind string, size_bytes long, sha256 string", "append", "None")


def incremental_ingest(files: DataFrame, catalog_path: str, checkpoint: str, max_mb: float = 512,
                       **trigger) -> StreamingQuery:
    """Classify, limit, hash and de-duplicate files as they arrive.

    ``files`` (streaming): file_id, filename, mime, size_bytes, content, arrival. New
    documents of a batch go to its partition of the catalog, files of an unsupported kind or
    beyond ``max_mb`` with the reason to that of ``rejects_path(catalog_path)``; a batch that
    is run again finds the state it began with and overwrites its own rows.
    """
    fits, large = size_filter(files, max_mb)
    accepted, unknown = split_rejected(classify_source(fits))
    new = new_documents(with_hash(accepted)).select(
        F.struct("file_id", "filename", "source_kind", "size_bytes", "sha256").alias("new"))
    refused = large.select(REFUSED).unionByName(unknown.select(REFUSED)).select(F.struct(*REFUSED).alias("refused"))

    def write(rows: DataFrame, batch: int) -> None:
        rows.persist()
        number = F.lit(batch).cast("bigint").alias("batch")
        out = {catalog_path: rows.filter("new IS NOT NULL").select(
                   "new.*", F.col("new.file_id").alias("document_id"), F.lit("pending").alias("status"), number),
               rejects_path(catalog_path): rows.filter("refused IS NOT NULL").select("refused.*", number)}
        for path, table in out.items():
            (table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path))
        rows.unpersist()

    return (new.unionByName(refused, allowMissingColumns=True).writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def next_stages(catalog: DataFrame, jobs: DataFrame) -> DataFrame:
    """The stage each catalogued document waits for."""
    return outstanding_stages(catalog.select("document_id"), jobs).filter("is_next")


def sweep_batch(read: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], target: str,
                threshold: float = MERGE_THRESHOLD) -> Callable[[DataFrame, int], None]:
    """Body of a ``foreachBatch``: merge near-duplicate topics into a new version.

    ``read`` gives topics, bridge and aliases. A version is one folder per batch, so a
    replay overwrites its own.
    """

    def run(_tick: DataFrame, batch: int) -> None:
        topics, bridge, aliases = merge_similar_topics(*read(), threshold)
        for name, df in (("topics", cut(topics)), ("document_topics", bridge), ("topic_aliases", aliases)):
            df.write.mode("overwrite").parquet(f"{target}/version={batch}/{name}")

    return run


def taxonomy_sweep(ticks: DataFrame, read, target: str, checkpoint: str, threshold: float = MERGE_THRESHOLD,
                   **trigger) -> StreamingQuery:
    """Run the merge at every tick of a stream, e.g. ``processingTime='1 hour'``."""
    return (ticks.writeStream.foreachBatch(sweep_batch(read, target, threshold))
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
