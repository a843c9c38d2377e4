"""Cutting documents into chunks that know where their text came from.

The rule is sequential: where a chunk starts depends on where the one before ended.
Only the lengths and kinds of elements decide it, so a small kernel walks arrays of
numbers while all text stays in the JVM. A document of ordinary size is one array. A
larger one is cut into blocks of ``BLOCK`` elements, each with enough neighbours to be
walked alone from every state it can be entered in; pointer jumping then finds the
states really entered, and all blocks are walked at once.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions.memory import by_steps
from attesta.functions.sentences import sentence_offsets
from attesta.functions.text import is_blank, strip, token_estimate
from attesta.plans.fold import fold_sorted
from attesta.plans.jumps import reachable
from attesta.plans.lineage import cut
from attesta.plans.scan import by_position, number_rows, running

# Fixed values.
TARGET_TOKENS = 512
OVERLAP_TOKENS = 64
CHARS_PER_TOKEN = 2
WINDOW_S = 45
WINDOW_SLACK = 1.6
CLOSING = (".", "!", "?", "…", "다", "요")
DEFAULT_LEVEL = 3
NO_CHUNKS = "no chunks produced (document appears to contain no text)"

BLOCK = 4096
SPAN_BAND = 4096
TEXT, HEADING, TABLE, PIECE, NEXT_PIECE = range(5)


# -------------------------------------------------------------------- heading path

def heading_path(elements: DataFrame) -> DataFrame:
    """Add ``heading_path``, the titles an element stands under.

    For each level that occurs the last heading so far counts only if it came after the
    last heading of every shallower level.
    """
    level = heading_level()
    last = {f"__h{i}": ("max", F.when((F.col("kind") == "heading") & (level == n),
                                      F.struct("reading_order", strip("text").alias("title"))))
            for i, n in enumerate(levels_in(elements.filter("kind = 'heading'"), level))}
    if not last:
        return elements.withColumn("heading_path", F.lit(None).cast("string"))
    out = running(elements, ["document_id"], ["reading_order"], by_position("reading_order"), last)
    return out.withColumn("heading_path", _path([F.col(n) for n in last], "reading_order")).drop(*last)


def heading_level() -> Column:
    """A heading's level; none or 0 counts as ``DEFAULT_LEVEL``."""
    return F.coalesce(F.nullif("level", F.lit(0)), F.lit(DEFAULT_LEVEL)).cast("int")


def levels_in(headings: DataFrame, level: Column) -> list[int]:
    """The levels that occur, shallowest first; as many as an outline is deep."""
    return sorted(r[0] for r in headings.select(level).distinct().collect())


def _path(lasts: list[Column], at: str) -> Column:
    """Joined titles of the headings not cancelled by a later shallower one."""
    parts, shallow = [], F.lit(-1).cast("bigint")
    for head in lasts:
        parts.append(F.when(head[at] > shallow, head["title"]))
        shallow = F.greatest(shallow, head[at])
    joined = F.concat_ws(" > ", *parts)
    return F.when(F.coalesce(*lasts).isNotNull(), joined)


# ------------------------------------------------------------------ oversize pieces

def pack_sentences(text: str, limit: int) -> list[tuple[int, int]]:
    """Cut at sentence ends so that pieces stay within ``limit`` where they can.

    A piece reaches to the last sentence end within ``limit`` of its start, and holds one
    sentence at least.
    """
    starts, ends = zip(*sentence_offsets(text) or [(0, len(text))], strict=True)
    pieces, first = [], 0
    while first < len(starts):
        after = max(bisect_right(ends, starts[first] + limit), first + 1)
        pieces.append((starts[first], ends[after - 1]))
        first = after
    return pieces


def split_oversize(elements: DataFrame, limit: int) -> DataFrame:
    """Replace each too long text element by its pieces.

    Adds ``code``, ``cut_start``, ``cut_end`` and ``piece``; only too long texts visit
    Python.
    """
    ranges = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()),
                                       T.StructField("t", T.StringType())]))

    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("t", pa.string())]))

    @F.arrow_udf(ranges)
    def pieces(text: pa.Array) -> pa.Array:
        return by_steps(lambda s: [(a, b, s[a:b]) for a, b in pack_sentences(s, limit)], kind, text)

    plain = ~F.col("kind").isin("heading", "table")
    long = plain & (F.length("text") > limit)
    whole = elements.filter(~long).select(
        "*", F.when(F.col("kind") == "heading", HEADING).when(F.col("kind") == "table", TABLE)
        .otherwise(TEXT).alias("code"),
        F.lit(0).alias("cut_start"), F.length("text").alias("cut_end"), F.lit(0).alias("piece"))
    # the text itself is left behind before its pieces are dealt out
    cutup = (elements.filter(long).withColumn("text", pieces("text")).select("*", F.posexplode("text").alias("piece", "__r"))
             .withColumn("code", F.when(F.col("piece") == 0, PIECE).otherwise(NEXT_PIECE))
             .withColumn("cut_start", F.col("__r.a")).withColumn("cut_end", F.col("__r.b"))
             .withColumn("text", F.col("__r.t")).drop("__r"))
    return whole.unionByName(cutup)


# ------------------------------------------------------------------------- walking

class _Packer:
    """Next-chunk rule over arrays. A state is (first carried element, next element)."""

    def __init__(self, code: np.ndarray, size: np.ndarray, limit: int, overlap: int) -> None:
        self.code, self.n = code, len(code)
        self.sum = np.concatenate([[0], np.cumsum(size)])
        stops = np.flatnonzero(code != TEXT)
        self.stop = np.append(stops, self.n)[np.searchsorted(stops, np.arange(self.n + 1), side="right")]
        self.limit, self.overlap = limit, overlap

    def tail(self, end: int) -> int:
        return int(np.searchsorted(self.sum, self.sum[end] - self.overlap, side="right")) - 1

    def step(self, first: int, nxt: int) -> tuple[int, int, int]:
        """(end of the chunk, then the next state)."""
        if self.code[nxt] >= TABLE:
            return nxt + 1, nxt + 1, nxt + 1
        full = int(np.searchsorted(self.sum, self.sum[first] + self.limit, side="right")) - 1
        end = min(max(full, nxt + 1), int(self.stop[nxt]))
        carry = end
        if end < self.n and self.code[end] in (TEXT, PIECE) and end - first > 1 and self.overlap > 0:
            at = self.tail(end)
            carry = at if at > first else end
        return end, carry, end


def _walker(limit: int, overlap: int, compat: bool):
    out = T.ArrayType(T.StructType([
        T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()),
        T.StructField("heads", T.ArrayType(T.IntegerType()))]))

    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("heads", pa.list_(pa.int32()))]))

    @F.arrow_udf(out)
    def walk(code: pa.Array, size: pa.Array, level: pa.Array, own: pa.Array, entry: pa.Array, heads: pa.Array) -> pa.Array:
        return by_steps(lambda c, s, lv, o, e, h: _chunks_of(np.asarray(c), np.asarray(s), lv, o, e, h, limit, overlap, compat),
                        kind, code, size, level, own, entry, heads)

    return walk


def _chunks_of(code, size, level, own, entry, heads, limit, overlap, compat):
    """Chunks (a, b, heading stack) whose first new element is in ``own``.

    ``entry`` is (1 when a tail is carried, position of the next element); ``heads`` are
    the levels of the headings open where the block begins, named -1, -2, ... in the
    stacks. Headings before the block itself are among those.
    """
    packer = _Packer(code, size, limit, overlap)
    stack = [(int(lv), -1 - i) for i, lv in enumerate(heads)]
    seen, hi = int(own[0]), int(own[1])
    nxt = int(entry[1])
    first = packer.tail(nxt) if entry[0] else nxt
    found = []
    while nxt < min(hi, packer.n):
        for i in range(seen, nxt + 1):
            if code[i] == HEADING:
                stack = [h for h in stack if h[0] < level[i]]
                stack.append((int(level[i]), i))
        seen = nxt + 1
        open_heads = [i for _, i in stack]
        start = first if code[nxt] < TABLE else nxt
        end, first, nxt = packer.step(start, nxt)
        found.append((start, end, open_heads))
        if nxt < packer.n and code[nxt] == PIECE:
            if compat and first < nxt:
                found.append((first, nxt, open_heads))
            first = nxt
    return found


def _exits(limit: int, overlap: int):
    out = T.ArrayType(T.StructType([T.StructField("state", T.LongType()), T.StructField("nxt", T.LongType())]))

    @F.pandas_udf(out)
    def exits(code: pd.Series, size: pd.Series, own: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([_exit_map(np.asarray(c), np.asarray(s), o, int(b), limit, overlap)
                          for c, s, o, b in zip(code, size, own, base)])

    return exits


def _exit_map(code, size, own, base, limit, overlap):
    """Where the walk leaves the block, for each state it can be entered in.

    A state is coded 2 * index + (1 when a tail is carried)."""
    packer = _Packer(code, size, limit, overlap)
    lo, hi = int(own[0]), min(int(own[1]), packer.n)
    leave: dict[int, int | None] = {}
    for e in range(hi - 1, lo - 1, -1):
        for carried in (0, 1):
            first = e
            if carried:
                if e == 0 or code[e] != TEXT:
                    continue
                first = max(0, packer.tail(e))
            _, first, nxt = packer.step(first, e)
            key = 2 * nxt + (1 if first < nxt and nxt < packer.n and code[nxt] == TEXT else 0)
            if nxt >= packer.n:
                leave[2 * e + carried] = None
            elif nxt >= hi:
                leave[2 * e + carried] = key
            else:
                leave[2 * e + carried] = leave[key]
    return [(2 * base + k, None if v is None else 2 * base + v) for k, v in leave.items()
            if k < 2 * (lo + limit + 2)]


def chunk_elements(elements: DataFrame, target: int = TARGET_TOKENS, overlap: int = OVERLAP_TOKENS, *,
                   compat: bool = False, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(chunks, members).

    ``elements``: document_id, reading_order, page_no, kind, level, text. Chunks have
    document_id, ord, text, heading_path, page_from, page_to, is_table, table_order (the
    reading order of a table's element) and token_count. Members tell which range
    [cut_start, cut_end) of which element stands at which offset of a chunk, and whether
    the element was too long and is only there in part. With
    ``compat`` the overlap alone is repeated as a chunk before an oversize element.
    """
    limit, carry = target * CHARS_PER_TOKEN, overlap * CHARS_PER_TOKEN
    ahead, behind = limit + 2, carry + 2
    block = max(block, ahead)
    parts = split_oversize(elements.filter("text <> '' OR kind IN ('heading', 'table')"), limit)
    row = F.struct("reading_order", "piece", "code", F.length("text").alias("size"), "text", "page_no",
                   heading_level().alias("level"), "cut_start", "cut_end")
    # two pieces in a row exceed the limit, which bounds their number without cutting
    weight = F.when(F.col("kind").isin("heading", "table"), 1).otherwise(1 + F.floor(2 * F.length("text") / limit))
    large_ids = (elements.groupBy("document_id").agg(F.sum(weight).alias("__n")).filter(F.col("__n") > block)
                 .select("document_id"))
    any_large = not large_ids.isEmpty()

    small = (parts.join(large_ids, "document_id", "left_anti").groupBy("document_id")
             .agg(F.sort_array(F.collect_list(row)).alias("el")))
    none = F.array().cast("array<struct<level:int,title:string>>")
    small = small.select("document_id", F.lit(0).cast("bigint").alias("block"), "el",
                         F.array(F.lit(0), F.size("el")).alias("own"),
                         F.array(F.lit(0), F.lit(0)).alias("entry"), none.alias("open"))
    walk = _walker(limit, carry, compat)
    columns = ["document_id", "block", "el", "own", "entry", "open"]
    grouped = small.select(*columns)
    if any_large:
        large = _large_blocks(parts.join(large_ids, "document_id", "left_semi"), row, limit, carry,
                              block, ahead, behind)
        grouped = grouped.unionByName(large.select(*columns))

    pick = lambda name: F.transform("el", lambda e: e[name])
    ranged = grouped.withColumn("__r", walk(pick("code"), pick("size"), pick("level"), "own", "entry",
                                            F.transform("open", lambda h: h["level"])))
    before = W.partitionBy("document_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    if any_large:
        starts = (ranged.select("document_id", "block", F.size("__r").cast("bigint").alias("__k"))
                  .withColumn("__from", F.coalesce(F.sum("__k").over(before), F.lit(0)))
                  .filter("block > 0").drop("__k"))
        ranged = ranged.join(starts, ["document_id", "block"], "left")
    else:
        ranged = ranged.withColumn("__from", F.lit(None).cast("bigint"))
    cells = ranged.select("document_id", "__from", "open", F.posexplode("__r").alias("__p", "r"), "el")
    mine = F.slice("el", F.col("r.a") + 1, F.col("r.b") - F.col("r.a"))
    cells = cells.select(
        "document_id", (F.coalesce("__from", F.lit(0)) + F.col("__p")).cast("bigint").alias("ord"),
        mine.alias("part"),
        F.transform("r.heads", lambda i: F.when(i >= 0, strip(F.get("el", i)["text"]))
                    .otherwise(F.get("open", -i - 1)["title"])).alias("heads"))
    pages = F.filter(F.transform("part", lambda e: e["page_no"]), lambda p: p.isNotNull() & (p != 0))
    text = F.array_join(F.transform("part", lambda e: e["text"]), "\n")
    chunks = cells.select(
        "document_id", "ord", text.alias("text"),
        F.when(F.size("heads") > 0, F.array_join("heads", " > ")).alias("heading_path"),
        F.array_min(pages).alias("page_from"), F.array_max(pages).alias("page_to"),
        (F.get("part", F.lit(0))["code"] == TABLE).alias("is_table"),
        F.when(F.get("part", F.lit(0))["code"] == TABLE, F.get("part", F.lit(0))["reading_order"]).alias("table_order"))
    chunks = chunks.withColumn("token_count", token_estimate("text"))
    at = cells.select("document_id", "ord", "part", F.posexplode("part").alias("__i", "e"))
    length = F.aggregate(F.slice("part", 1, F.col("__i")), F.lit(0), lambda acc, e: acc + e["size"] + 1)
    members = at.select("document_id", "ord", F.col("e.reading_order").alias("reading_order"),
                        F.col("e.page_no").alias("page_no"), F.col("e.cut_start").cast("bigint").alias("cut_start"),
                        F.col("e.cut_end").cast("bigint").alias("cut_end"), length.cast("bigint").alias("offset"),
                        (F.col("e.code") >= PIECE).alias("is_piece"))
    return drop_blank_chunks(chunks), members


def _large_blocks(parts, row, limit, carry, block, ahead, behind) -> DataFrame:
    """Blocks of large documents with their neighbours, entry states and open headings."""
    numbered = number_rows(parts, ["document_id"], ["reading_order", "piece"], by_position("reading_order"), "__n")
    numbered = cut(numbered.withColumn("__i", F.col("__n") - 1).drop("__n")
                   .withColumn("__b", F.floor(F.col("__i") / block)))
    within = F.col("__i") % block
    homes = F.array_compact(F.array(
        F.col("__b"), F.when((within < ahead) & (F.col("__b") > 0), F.col("__b") - 1),
        F.when(within >= block - behind, F.col("__b") + 1)))
    spread = numbered.withColumn("block", F.explode(homes))
    last = numbered.groupBy("document_id").agg(F.max("__b").alias("__last"))
    gathered = (spread.groupBy("document_id", "block")
                .agg(F.sort_array(F.collect_list(F.struct("__i", row.alias("e")))).alias("__a"))
                .join(last, "document_id").filter(F.col("block") <= F.col("__last")))
    base = F.get("__a", F.lit(0))["__i"]
    own = F.array((F.col("block") * block - base).cast("int"), ((F.col("block") + 1) * block - base).cast("int"))
    gathered = gathered.select("document_id", "block", base.alias("base"), own.alias("own"),
                               F.transform("__a", lambda x: x["e"]).alias("el"))
    pick = lambda name: F.transform("el", lambda e: e[name])
    links = (gathered.select("document_id", F.explode(_exits(limit, carry)(pick("code"), pick("size"), "own", "base"))
                             .alias("x")))
    node = lambda c: F.struct("document_id", F.col(c).alias("s"))
    links = links.select(node("x.state").alias("node"),
                         F.when(F.col("x.nxt").isNotNull(), node("x.nxt")).alias("nxt"))
    starts = last.select(F.struct("document_id", F.lit(0).cast("bigint").alias("s")).alias("node"))
    entered = reachable(starts, links).select("node.document_id", F.col("node.s").alias("__s"))
    entered = entered.withColumn("block", F.floor(F.col("__s") / 2 / block))

    level = heading_level()
    headings = numbered.filter(F.col("code") == HEADING)
    levels = levels_in(headings, level) or [DEFAULT_LEVEL]
    heads = headings.groupBy("document_id", F.col("__b").alias("block")).agg(
        *[F.max(F.when(level == n, F.struct("__i", F.lit(n).alias("level"), strip("text").alias("title"))))
          .alias(f"__h{i}") for i, n in enumerate(levels)])
    opened = gathered.select("document_id", "block").join(heads, ["document_id", "block"], "left")
    prior = W.partitionBy("document_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    opened = opened.select("document_id", "block", *[F.max(f"__h{i}").over(prior).alias(f"__h{i}") for i in range(len(levels))])
    kept, shallow = [], F.lit(-1).cast("bigint")
    for i in range(len(levels)):
        h = F.col(f"__h{i}")
        kept.append(F.when(h["__i"] > shallow, F.struct(h["level"].alias("level"), h["title"].alias("title"))))
        shallow = F.greatest(shallow, h["__i"])
    opened = opened.select("document_id", "block", F.array_compact(F.array(*kept)).alias("open"))

    placed = gathered.join(entered, ["document_id", "block"]).join(opened, ["document_id", "block"])
    at = (F.floor(F.col("__s") / 2) - F.col("base")).cast("int")
    return placed.select("document_id", "block", "el", "own",
                         F.array((F.col("__s") % 2).cast("int"), at).alias("entry"), "open")


def chunk_outcomes(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(document_id, stage, error) of every document's chunking, for ``record_stage``: a
    document that gave no chunk with text has failed, which holds up its later stages."""
    got = drop_blank_chunks(chunks).select("document_id").distinct().withColumn("__got", F.lit(True))
    return documents.select("document_id").join(got, "document_id", "left").select(
        "document_id", F.lit("chunk").alias("stage"), F.when(F.col("__got").isNull(), NO_CHUNKS).alias("error"))


def drop_blank_chunks(chunks: DataFrame) -> DataFrame:
    """Drop chunks without text; ``ord`` keeps its gaps."""
    return chunks.filter(~is_blank("text"))


def rebase_spans(members: DataFrame, spans: DataFrame, elements: DataFrame) -> DataFrame:
    """Spans of every chunk: (document_id, ord, text_start, text_end, page_no, box).

    Spans move to the chunk's offsets; those of a split element are clipped to the
    member's range first. A member left without spans becomes one span if its element
    has a box.
    """
    keys = ["document_id", "reading_order"]
    box = ["x0", "y0", "x1", "y1"]
    own = spans.select(*keys, F.col("text_start").alias("__s"), F.col("text_end").alias("__e"), "page_no", *box)
    m = members.drop("page_no")
    whole = (m.filter("NOT is_piece").join(own, keys)
             .withColumns({"text_start": F.col("__s") + F.col("offset"), "text_end": F.col("__e") + F.col("offset")}))
    # pieces and spans of one element meet by stretches of its text, and a pair counts in
    # the stretch where both have begun: no element, however long, is one key
    band = lambda at: F.floor(at / SPAN_BAND)
    bands = lambda a, b: F.explode(F.sequence(band(a), band(F.greatest(a, b - 1)))).alias("__band")
    pieces = m.filter("is_piece").select("*", bands(F.col("cut_start"), F.col("cut_end")))
    spread = own.join(m.filter("is_piece").select(*keys).distinct(), keys, "left_semi").select(
        "*", bands(F.col("__s"), F.col("__e")))
    touching = (F.col("__e") > F.col("cut_start")) & (F.col("__s") < F.col("cut_end"))
    once = F.col("__band") == F.greatest(band(F.col("cut_start")), band(F.col("__s")))
    low = F.greatest(F.lit(0), F.col("__s") - F.col("cut_start"))
    high = F.least(F.col("cut_end"), F.col("__e")) - F.col("cut_start")
    clipped = (pieces.join(spread, [*keys, "__band"]).filter(touching & once).drop("__band")
               .withColumns({"text_start": low + F.col("offset"), "text_end": high + F.col("offset")}))
    lined = whole.unionByName(clipped)
    bare = m.join(lined.select("document_id", "ord", "reading_order").distinct(),
                  ["document_id", "ord", "reading_order"], "left_anti")
    boxed = (bare.join(elements.filter("x0 IS NOT NULL").select(*keys, "page_no", *box), keys)
             .withColumn("text_start", F.col("offset"))
             .withColumn("text_end", F.col("offset") + F.col("cut_end") - F.col("cut_start")))
    out = ["document_id", "ord", "text_start", "text_end", "page_no", *box]
    return lined.select(out).unionByName(boxed.select(out))


def page_range(members: DataFrame) -> DataFrame:
    """(document_id, ord, page_from, page_to) over real page numbers."""
    page = F.when(F.col("page_no") != 0, F.col("page_no"))
    return members.groupBy("document_id", "ord").agg(F.min(page).alias("page_from"), F.max(page).alias("page_to"))


def link_table_element(chunks: DataFrame, elements: DataFrame) -> DataFrame:
    """Add ``element_id`` of the table a chunk shows; null for other chunks."""
    ids = elements.select("document_id", F.col("reading_order").alias("table_order"), F.col("id").alias("element_id"))
    return chunks.join(ids, ["document_id", "table_order"], "left")


def elements_from_table(rows: DataFrame) -> DataFrame:
    """Chunker input rebuilt from stored elements; their only span is their box."""
    box = F.struct(F.lit(0).cast("bigint").alias("text_start"), F.length(F.coalesce("text", F.lit("")))
                   .cast("bigint").alias("text_end"), "page_no", "x0", "y0", "x1", "y1")
    return (rows.withColumn("text", F.coalesce("text", F.lit("")))
            .withColumn("spans", F.when(F.col("x0").isNotNull(), F.array(box)).otherwise(F.array()))
            .withColumn("page_no", F.coalesce("page_no", F.lit(0))))


def segments_from_elements(rows: DataFrame) -> DataFrame:
    """Transcript segments rebuilt from stored elements; missing times are 0."""
    return rows.select("document_id", "reading_order", F.coalesce("text", F.lit("")).alias("text"),
                       F.coalesce("start_ms", F.lit(0)).cast("bigint").alias("start_ms"),
                       F.coalesce("end_ms", F.lit(0)).cast("bigint").alias("end_ms"))


# --------------------------------------------------------------------- transcripts

def _opens(start: int, end: int, closed: bool, window: float) -> bool:
    """Whether a segment ending at ``end`` opens a new window after one from ``start``."""
    return end - start > window and (closed or end - start > window * WINDOW_SLACK)


class _Windows:
    """Streams a recording's segments and tells which window each belongs to."""

    def __init__(self, window: float) -> None:
        self.window, self.start, self.closed, self.head = window, None, False, None

    def row(self, values):
        order, start, end, closed = values
        if self.start is None or _opens(self.start, end, self.closed, self.window):
            self.start, self.head = start, order
        self.closed = closed
        yield order, self.head

    def end(self):
        return ()


def _window_starts(start, end, closed, window, hi, entry=0):
    """Array positions where windows open, from a known one on, up to ``hi``."""
    found, at = [entry], entry
    for i in range(entry + 1, hi):
        if _opens(start[at], end[i], closed[i - 1], window):
            found.append(i)
            at = i
    return found


def chunk_transcript(segments: DataFrame, window_s: float = WINDOW_S, block: int = BLOCK) -> DataFrame:
    """Windows of a transcript: (document_id, ord, text, t_start_ms, t_end_ms, n_segments)."""
    return window_chunks(transcript_windows(segments, window_s, block))


def window_chunks(windows: DataFrame) -> DataFrame:
    """The chunk of each window: its segments' texts, joined by a space."""
    return windows.select("document_id", "ord", F.array_join(F.transform("el", lambda e: e["text"]), " ").alias("text"),
                          F.get("el", F.lit(0))["start_ms"].alias("t_start_ms"),
                          F.element_at("el", -1)["end_ms"].alias("t_end_ms"),
                          F.size("el").cast("bigint").alias("n_segments"))


@F.pandas_udf(T.ArrayType(T.LongType()))
def _begins(lengths: pd.Series) -> pd.Series:
    """Where each text begins when texts of these lengths are joined by one character."""
    return lengths.map(lambda n: np.concatenate([[0], np.cumsum(np.asarray(n, dtype=np.int64) + 1)[:-1]]))


def window_spans(windows: DataFrame) -> DataFrame:
    """(document_id, ord, pos, text_start, text_end, t_start_ms, t_end_ms): where each segment
    stands in the text of its window's chunk and when it is spoken. ``pos`` counts from 0."""
    lengths = F.transform("el", lambda e: F.length(e["text"]))
    rows = windows.select("document_id", "ord", F.posexplode(F.arrays_zip(
        _begins(lengths).alias("a"), lengths.alias("n"), F.transform("el", lambda e: e["start_ms"]).alias("t0"),
        F.transform("el", lambda e: e["end_ms"]).alias("t1"))).alias("pos", "e"))
    return rows.select("document_id", "ord", F.col("pos").cast("bigint").alias("pos"), F.col("e.a").alias("text_start"),
                       (F.col("e.a") + F.col("e.n")).alias("text_end"), F.col("e.t0").alias("t_start_ms"),
                       F.col("e.t1").alias("t_end_ms"))


def transcript_windows(segments: DataFrame, window_s: float = WINDOW_S, block: int = BLOCK) -> DataFrame:
    """(document_id, ord, el): the segments of each window in order, with times and stripped
    texts; segments without text are left out. Both chunks and their timed spans come from it.

    A window closes after ``window_s`` at a sentence end, or at 1.6 times that anyway.
    Ordinary recordings are walked as one array of times. Longer ones are walked in
    blocks whose entry points pointer jumping finds; see ``_long_recordings``.
    """
    window = window_s * 1000
    slim = (segments.withColumn("text", strip(F.coalesce("text", F.lit("")))).filter("text <> ''"))
    ends = F.lit(False)
    for mark in CLOSING:
        ends = ends | F.endswith("text", F.lit(mark))
    slim = slim.select("document_id", "reading_order", "start_ms", "end_ms", ends.alias("closed"), "text")
    large = (slim.groupBy("document_id").agg(F.count("*").alias("__n")).filter(F.col("__n") > block)
             .select("document_id"))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def walk(start: pd.Series, end: pd.Series, closed: pd.Series) -> pd.Series:
        return pd.Series([_window_starts(s, e, c, window, len(s)) for s, e, c in zip(start, end, closed)])

    row = F.struct("reading_order", "start_ms", "end_ms", "closed", "text")
    whole = (slim.join(large, "document_id", "left_anti").groupBy("document_id")
             .agg(F.sort_array(F.collect_list(row)).alias("el")))
    pick = lambda name: F.transform("el", lambda e: e[name])
    cutup = whole.withColumn("__w", walk(pick("start_ms"), pick("end_ms"), pick("closed")))
    cells = cutup.select("document_id", "el", "__w", F.posexplode("__w").alias("ord", "a"))
    until = F.coalesce(F.get("__w", F.col("ord") + 1), F.size("el"))
    kept = lambda el: F.transform(el, lambda e: F.struct(e["start_ms"].alias("start_ms"), e["end_ms"].alias("end_ms"), e["text"].alias("text")))
    out = cells.select("document_id", F.col("ord").cast("bigint").alias("ord"),
                       kept(F.slice("el", F.col("a") + 1, until - F.col("a"))).alias("el"))
    if large.isEmpty():
        return out
    long = _long_recordings(slim.join(large, "document_id", "left_semi"), window, block)
    return out.unionByName(long.withColumn("el", kept("el")))


def _long_recordings(slim: DataFrame, window: float, block: int) -> DataFrame:
    """Windows (document_id, ord, el) of recordings too long for one array.

    Each block carries the block after it, so every window opened in it can be
    followed to its end; links lead from a segment that may open the first window of
    a block to the first window opened in the next. Recordings so dense that a window
    could outgrow a block (more segments in 72 seconds than that) stream through one
    state instead, a stretch between silences at a time.
    """
    longest = window * WINDOW_SLACK
    slim = cut(number_rows(slim, ["document_id"], ["reading_order"], by_position("reading_order"), "__n")
               .withColumn("__i", F.col("__n") - 1).drop("__n"))
    crowd = (slim.groupBy("document_id", F.floor(F.col("start_ms") / longest).alias("__t"))
             .agg(F.count("*").alias("__c")).groupBy("document_id").agg(F.max("__c").alias("__c")))
    disorder = running(slim.select("document_id", "__i", "start_ms", "end_ms"), ["document_id"], ["__i"],
                       by_position("__i"), {"__m": ("max", F.greatest("start_ms", "end_ms"))}, inclusive=False)
    mixed = disorder.filter((F.col("end_ms") < F.col("__m")) | (F.col("end_ms") < F.col("start_ms")))
    dense = (crowd.filter(F.col("__c") * 3 > block).select("document_id")
             .union(mixed.select("document_id")).distinct())
    blocked = slim.join(dense, "document_id", "left_anti").withColumn("__b", F.floor(F.col("__i") / block))
    spread = blocked.withColumn("block", F.explode(F.array_compact(F.array(
        F.col("__b"), F.when(F.col("__b") > 0, F.col("__b") - 1)))))
    arrays = spread.groupBy("document_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("__i", "start_ms", "end_ms", "closed"))).alias("el"))
    own = F.least(F.lit(block).cast("bigint"), F.size("el")).cast("int")
    pick = lambda name: F.transform("el", lambda e: e[name])

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def exits(start: pd.Series, end: pd.Series, closed: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([_window_exits(np.asarray(s), np.asarray(e), np.asarray(c), window, int(o))
                          for s, e, c, o in zip(start, end, closed, own)])

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def walk(start: pd.Series, end: pd.Series, closed: pd.Series, own: pd.Series, entry: pd.Series) -> pd.Series:
        return pd.Series([_window_starts(s, e, c, window, int(o), int(at))
                          for s, e, c, o, at in zip(start, end, closed, own, entry)])

    first = F.col("block") * block
    node = lambda i: F.struct("document_id", i.cast("bigint").alias("i"))
    links = (arrays.select("document_id", "block", F.explode(exits(
        pick("start_ms"), pick("end_ms"), pick("closed"), own)).alias("x"))
        .select(node(first + F.col("x")[0]).alias("node"), node(first + F.col("x")[1]).alias("nxt")))
    starts = blocked.filter("__i = 0").select(node(F.col("__i")).alias("node"))
    entered = reachable(starts, links).select(F.col("node.document_id").alias("document_id"),
                                              F.col("node.i").alias("__at"))
    entered = entered.withColumn("block", F.floor(F.col("__at") / block))
    opened = arrays.join(entered, ["document_id", "block"]).select(
        "document_id", F.explode(F.transform(
            walk(pick("start_ms"), pick("end_ms"), pick("closed"), own, (F.col("__at") - first).cast("int")),
            lambda a: (a + first).cast("bigint"))).alias("__i")).withColumn("__head", F.lit(True))
    heads = blocked.join(opened, ["document_id", "__i"], "left")
    heads = running(heads, ["document_id"], ["__i"], by_position("__i"),
                    {"head": ("max", F.when(F.col("__head"), F.col("__i")))}).drop("__head", "__b")

    rest = slim.join(dense, "document_id", "left_semi")
    stepped = running(rest, ["document_id"], ["__i"], by_position("__i"),
                      {"__m": ("max", F.col("start_ms"))}, inclusive=False)
    # an open window starts no later than any segment so far: such a gap always closes it
    fresh = F.col("__m").isNull() | (F.col("end_ms") - F.col("__m") > longest)
    stretched = running(stepped, ["document_id"], ["__i"], by_position("__i"),
                        {"__stretch": ("sum", fresh.cast("bigint"))})
    streamed = fold_sorted(stretched, ["document_id", "__stretch"], ["__i"],
                           ["__i", "start_ms", "end_ms", "closed"], lambda: _Windows(window),
                           "__i bigint, head bigint").drop("__stretch")
    heads = heads.unionByName(rest.join(streamed, ["document_id", "__i"]).select(heads.columns))
    rows = heads.groupBy("document_id", "head").agg(
        F.sort_array(F.collect_list(F.struct("__i", "start_ms", "end_ms", "text"))).alias("el"))
    rows = number_rows(rows, ["document_id"], ["head"], by_position("head"), "__n")
    return rows.select("document_id", (F.col("__n") - 1).alias("ord"), "el")


def _window_exits(start, end, closed, window, own):
    """(segment of the block, first window opened after the block) for every segment."""
    n = len(start)
    leave = [-1] * own
    found = []
    for at in range(own - 1, -1, -1):
        span = end[at + 1:] - start[at]
        opens = np.flatnonzero((span > window) & (closed[at:n - 1] | (span > window * WINDOW_SLACK)))
        nxt = at + 1 + int(opens[0]) if len(opens) else -1
        leave[at] = nxt if nxt >= own or nxt < 0 else leave[nxt]
        if leave[at] >= 0:
            found.append((at, leave[at]))
    return found
