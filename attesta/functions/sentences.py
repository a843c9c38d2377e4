"""Sentence boundaries with offsets into the original text."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions.memory import by_steps
from attesta.functions.text import strip

# What ends a sentence, and what a full stop does not end.
TERMINALS = ".!?…"
_EDGE = re.compile(r"""(?<=[.!?…])["'”’)\]]*\s+|\n+""")
_ABBREVIATED = re.compile(
    r"(?:^|\s|\()(?:[A-Za-z]{1,3}|No|Fig|Tbl|vs|etc|cf|e\.g|i\.e|Mr|Ms|Mrs|Dr|Prof|approx)$")
_NUMBERED = re.compile(r"\d$")
MIN_CHARS = 2

SENTENCES = T.ArrayType(T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("text", T.StringType())]))


def _ends_sentence(head: str) -> bool:
    """Whether the last terminal mark in ``head`` really closes a sentence."""
    at = max(head.rfind(mark) for mark in TERMINALS)
    if at < 0 or head[at] != ".":
        return True
    before = head[max(0, at - 12):at]  # longer than any abbreviation
    return not (_ABBREVIATED.search(before) or _NUMBERED.search(before))


def sentence_offsets(text: str | None) -> list[tuple[int, int]]:
    """(start, end) of every sentence; fragments join the sentence before them."""
    found: list[tuple[int, int]] = []
    if not text:
        return found
    begin = 0
    edges = [(m.start(), m.end()) for m in _EDGE.finditer(text)]
    for stop, resume in [*edges, (len(text), len(text))]:
        last = stop == len(text) and resume == stop
        if not last and not _ends_sentence(text[begin:stop]):
            continue
        size = len(text[begin:stop].strip())
        if size:
            if size < MIN_CHARS and found:
                found[-1] = (found[-1][0], stop)
            else:
                found.append((begin, stop))
        begin = resume
    return found


ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))


def cut_text(text: str | None) -> list[tuple[int, int, str]]:
    return [(a, b, text[a:b]) for a, b in sentence_offsets(text)]


@F.arrow_udf(SENTENCES)
def _sentences(text: pa.Array) -> pa.Array:
    return by_steps(cut_text, ARROW, text)


def sentences(text: Column | str) -> Column:
    """Array of (start, end, text)."""
    return _sentences(F.col(text) if isinstance(text, str) else text)


def split_sentences(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per sentence: (..., start, end, sentence)."""
    rest = [c for c in df.columns if c != text]
    return (df.select(*rest, F.explode(sentences(text)).alias("__s"))
            .select(*rest, F.col("__s.start").cast("bigint").alias("start"),
                    F.col("__s.end").cast("bigint").alias("end"), F.col("__s.text").alias("sentence")))


def split_trimmed(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per sentence, trimmed."""
    return (split_sentences(df, text).withColumn("sentence", strip("sentence"))
            .filter("sentence <> ''"))


def sentence_at(text: Column | str, position: Column) -> Column:
    """The first sentence reaching from at or before ``position`` to at or after it.

    ``position`` is looked at once per sentence, so give a column, not an expression.
    """
    covering = F.filter(sentences(text), lambda s: (s["start"] <= position) & (position <= s["end"]))
    return F.get(covering, F.lit(0))
