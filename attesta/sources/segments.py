"""Transcripts as tables of timed segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import strip

TRANSCRIPT = "struct<segments:array<struct<start:double,end:double,text:string>>>"


def read_segments(transcripts: DataFrame, column: str = "json") -> tuple[DataFrame, DataFrame]:
    """(segments, failed): one transcript per row in, one segment per row out.

    Blank segments are dropped before numbering; seconds become whole milliseconds.
    A transcript with no segment left is a failure.
    """
    parsed = transcripts.withColumn("__t", F.from_json(column, TRANSCRIPT))
    kept = F.filter(F.coalesce("__t.segments", F.array().cast("array<struct<start:double,end:double,text:string>>")),
                    lambda s: F.coalesce(strip(s["text"]), F.lit("")) != "")
    parsed = parsed.withColumn("__s", kept)
    ms = lambda c: F.col(c) * 1000
    segments = (parsed.select("document_id", F.posexplode("__s").alias("pos", "seg"))
                .select("document_id", F.col("pos").cast("bigint").alias("reading_order"),
                        F.lit("transcript").alias("kind"), strip(F.col("seg.text")).alias("text"),
                        ms("seg.start").cast("bigint").alias("start_ms"),
                        ms("seg.end").cast("bigint").alias("end_ms")))
    failed = (parsed.filter(F.size("__s") == 0)
              .select("document_id", F.lit("transcription produced no speech segments").alias("error")))
    return segments, failed


def transcript(elements: DataFrame) -> DataFrame:
    """Segments of every transcript, in reading order."""
    return (elements.filter("kind = 'transcript'")
            .select("document_id", "reading_order", "text", "start_ms", "end_ms"))
