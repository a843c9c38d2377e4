"""From a citation to the sentences, rectangles and times that support it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions.text import clip, strip
from attesta.functions.vectors import cosine
from attesta.plans.fold import annotate_sorted, islands
from attesta.plans.joins import small_side
from attesta.plans.lineage import cut
from attesta.plans.topk import top_k

# Fixed values.
MAX_SENTENCES = 3
MIN_SIMILARITY = 0.55
SNIPPET_CHARS = 400
SAME_LINE = 0.6

GROUP_RECTS = 20_000  # rectangles of a citation on a page that one task takes as they are
CLAIM_ROWS = 20_000  # claims carry a vector each, so fewer of them are small

CITE = ["message_id", "idx"]


def align_sentences(claims: DataFrame, sentences: DataFrame, n: int = MAX_SENTENCES,
                    threshold: float = MIN_SIMILARITY, digits: int | None = None) -> DataFrame:
    """Sentences of the cited chunk that match the claim: (message_id, idx, s, e,
    sentence, similarity).

    The best n at or above the threshold, or else the single best; the earlier one
    wins a tie. ``claims``: message_id, idx, chunk_id, embedding; ``sentences``:
    chunk_id, s, e, sentence, embedding.
    """
    other = sentences.select("chunk_id", "s", "e", "sentence", F.col("embedding").alias("__v"))
    sim = cosine("embedding", "__v")
    pairs = (small_side(claims.select(*CITE, "chunk_id", "embedding"), CLAIM_ROWS).join(other, "chunk_id")
             .withColumn("similarity", sim if digits is None else F.round(sim, digits))
             .select(*CITE, "s", "e", "sentence", "similarity"))
    best = top_k(pairs, CITE, [F.desc("similarity"), F.asc("s")], n, rank="__rn", salt_on=["s"])
    return best.filter((F.col("similarity") >= threshold) | (F.col("__rn") == 1)).drop("__rn")


def spans_for(citations: DataFrame, picks: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans of the cited chunk that overlap a picked range; all of them if none does.

    ``citations``: message_id, idx, chunk_id; ``picks``: message_id, idx, s, e (a few
    per citation); ``spans``: chunk_id, text_start, text_end, .... The chunk's spans are
    joined once per citation and whether any hit is a map-side combined aggregate.
    """
    few = picks.groupBy(*CITE).agg(F.collect_list(F.struct("s", "e")).alias("__picks"))
    asked = small_side(citations.select(*CITE, "chunk_id").join(few, CITE, "left"))
    hit = F.exists(F.coalesce("__picks", F.array().cast("array<struct<s:bigint,e:bigint>>")),
                   lambda p: (F.col("text_start") < p["e"]) & (F.col("text_end") > p["s"]))
    pairs = asked.join(spans, "chunk_id").withColumn("__hit", hit).drop("__picks")
    found = pairs.filter("__hit").select(*CITE).distinct().withColumn("__any", F.lit(True))
    return (pairs.join(found, CITE, "left").filter(F.col("__hit") | F.col("__any").isNull())
            .drop("__hit", "__any"))


class _Lines:
    """Numbers rectangles by the line of text they continue."""

    def __init__(self) -> None:
        self.number, self.top, self.bottom = -1, 0.0, 0.0

    def rows(self, tops: list[float], bottoms: list[float]) -> list[int]:
        found = []
        for y0, y1 in zip(tops, bottoms):
            low = min(self.bottom - self.top, y1 - y0)
            if self.number >= 0 and low > 0 and (
                    min(self.bottom, y1) - max(self.top, y0)) / low > SAME_LINE:
                self.top, self.bottom = min(self.top, y0), max(self.bottom, y1)
            else:
                self.number, self.top, self.bottom = self.number + 1, y0, y1
            found.append(self.number)
        return found


def merge_same_line(rects: DataFrame, keys: list[str] | None = None, block: int = GROUP_RECTS) -> DataFrame:
    """Join rectangles that lie on one line of text: (keys, page_no, x0, y0, x1, y1).

    A citation's rectangles on a page stream through the running box of the current line.
    Groups of more than ``block`` are cut into islands of vertically touching rectangles
    first, which spread over tasks; only inside one does the order matter.
    """
    keys = [*(keys or CITE), "page_no"]
    order = ["y0", "x0", "x1", "y1"]
    slim = rects.select(*keys, *order)
    large = cut(slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > block).select(*keys))
    if large.isEmpty():
        return _lines(slim, keys, keys)
    cutup = islands(slim.join(large, keys, "left_semi"), keys, "y0", "y1")
    return _lines(slim.join(large, keys, "left_anti"), keys, keys).unionByName(_lines(cutup, [*keys, "island"], keys))


def _lines(rects: DataFrame, groups: list[str], keys: list[str]) -> DataFrame:
    placed = annotate_sorted(rects, groups, ["y0", "x0", "x1", "y1"], ["y0", "y1"], _Lines, "line")
    return placed.groupBy(*groups, "line").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"),
        F.max("y1").alias("y1")).select(*keys, "x0", "y0", "x1", "y1")


def _times(start: str, end: str) -> list[Column]:
    timed = F.col("t_start_ms").isNotNull() & F.col("t_end_ms").isNotNull()
    return [F.min(F.when(timed, F.col("t_start_ms"))).alias(start), F.max(F.when(timed, F.col("t_end_ms"))).alias(end)]


def time_range(hits: DataFrame) -> DataFrame:
    """(message_id, idx, t_start_ms, t_end_ms) over spans that have both times."""
    return hits.groupBy(*CITE).agg(*_times("t_start_ms", "t_end_ms"))


def snippet(citations: DataFrame, picks: DataFrame) -> DataFrame:
    """Add ``snippet``: the picked sentences in reading order, else the chunk text."""
    said = picks.groupBy(*CITE).agg(F.sort_array(F.collect_list(F.struct("s", "sentence"))).alias("__said"))
    text = F.array_join(F.transform("__said", lambda p: strip(p["sentence"])), " ")
    # the chunk's text is cut before the join: texts are long, and many citations share one
    return (citations.withColumn("__else", clip(strip("text"), SNIPPET_CHARS)).join(said, CITE, "left")
            .withColumn("snippet", F.coalesce(clip(text, SNIPPET_CHARS), "__else")).drop("__said", "__else"))


def resolve_citations(citations: DataFrame, sentences: DataFrame, spans: DataFrame, *,
                      threshold: float = MIN_SIMILARITY, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(citations with snippet, page and times; rectangles).

    ``citations``: message_id, idx, chunk_id, text, page_from, t_start_ms, t_end_ms and
    the claim's ``embedding``; ``spans`` carry boxes or times.
    """
    picks = cut(align_sentences(citations, sentences, threshold=threshold, digits=digits))
    hits = cut(spans_for(citations, picks, spans))
    boxed = hits.filter("page_no IS NOT NULL AND x0 IS NOT NULL")
    rects = merge_same_line(boxed)
    # page and times of a citation are one aggregate over its spans
    has_box = F.col("page_no").isNotNull() & F.col("x0").isNotNull()
    found = hits.groupBy(*CITE).agg(F.min(F.when(has_box, F.col("page_no"))).alias("page_no"), *_times("__a", "__b"))
    out = (snippet(citations, picks).join(found, CITE, "left")
           .withColumn("page_no", F.coalesce("page_no", "page_from"))
           .withColumn("t_start_ms", F.coalesce("__a", "t_start_ms"))
           .withColumn("t_end_ms", F.coalesce("__b", "t_end_ms"))
           .drop("__a", "__b", "text", "embedding"))
    return out, rects
