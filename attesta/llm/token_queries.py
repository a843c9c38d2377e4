"""op2 and op7: packing and record files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm.binpack import pack
from attesta.llm.records import read_records, write_records
from attesta.llm.registry import query
from attesta.llm.scratch import new_path, table

END = 2


def tokenizer(name: str) -> str:
    """The path of a public tokenizer's file; only these queries need them."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), END, 1024)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query("op7_token_records")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_records(table(spark, sf_dir, "documents"), new_path(spark, "records"),
                          tokenizer("word_bpe_49k.json"), END)
    return read_records(index).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
