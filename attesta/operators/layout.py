"""Layout reconstruction from tables of text lines, words and cells.

Boxes are (x0, y0, x1, y1) in points, origin top-left. Pages are keyed by
(document_id, page_no).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.functions.text import is_blank, lstrip, round_tenths, rstrip, strip
from attesta.operators.graphs import greedy_leaders
from attesta.plans.fold import islands, together
from attesta.plans.lineage import cut
from attesta.plans.quantile import exact_median
from attesta.plans.scan import by_position, number_rows, previous_row, running

# Fixed values.
MIN_PAGE_CHARS = 16
HEADING_RATIO = 1.15
HEADING_CHARS = 120
INSIDE = 0.6
OCR_DPI = 200
OCR_CONFIDENCE = 0.25
SAME_ROW = 0.5
CLAUSE = r"(?U)^\s*제\s*\d+\s*조\s*[\(（]"

PAGE = ["document_id", "page_no"]
BLOCK = [*PAGE, "block_no"]
LINE = [*BLOCK, "par_no", "line_no"]
BOX = ["x0", "y0", "x1", "y1"]
BAND = 64.0
PAGE_ROWS = 20_000  # fragments of a page that one task takes as they are
PACK = 64           # fragments that travel as one row


# --------------------------------------------------------------------------- pages

def page_route(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Add ``route``: text, ocr or blank.

    ``pages`` has ``has_visual``. A page's text is its lines joined by newlines and
    trimmed; the blank lines inside count, those at the ends do not.
    """
    full = lines.filter(~is_blank("text"))
    lead = F.length("text") - F.length(lstrip("text"))
    trail = F.length("text") - F.length(rstrip("text"))
    ends = full.groupBy(*PAGE).agg(
        F.min("line_no").alias("__first"), F.max("line_no").alias("__last"),
        (F.min_by(lead, "line_no") + F.max_by(trail, "line_no")).alias("__cut"))
    size = (lines.join(ends, PAGE).filter(F.col("line_no").between(F.col("__first"), F.col("__last")))
            .groupBy(*PAGE).agg((F.sum(F.length("text") + 1) - 1 - F.first("__cut")).alias("__chars")))
    text = F.coalesce("__chars", F.lit(0)) >= MIN_PAGE_CHARS
    return (pages.join(size, PAGE, "left")
            .withColumn("route", F.when(text, "text").when(F.col("has_visual"), "ocr").otherwise("blank"))
            .drop("__chars"))


def body_font_size(lines: DataFrame, chars: Column | None = None) -> DataFrame:
    """(page, body_size): the size most characters of the page are set in.

    The size seen first wins a tie; a page without text has 0. ``chars`` is what a line counts
    instead of its own text; then lines of 0 have a size too, which a page without text takes.
    """
    size = round_tenths(F.col("font_size").cast("double"))
    if chars is None:
        chars = F.length(strip("text"))
        size = F.when(chars > 0, size)
    weights = (lines.groupBy(*PAGE, size.alias("__size"))
               .agg(F.sum(chars).alias("__w"), F.min("line_no").alias("__first")))
    best = weights.groupBy(*PAGE).agg(F.max_by("__size", F.when(
        F.col("__size").isNotNull(), F.struct("__w", (-F.col("__first")).alias("f")))).alias("body_size"))
    return best.withColumn("body_size", F.coalesce("body_size", F.lit(0.0)))


# -------------------------------------------------------------------------- blocks

def bbox_union(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest box around each group."""
    return boxes.groupBy(*keys).agg(*union_box())


def union_box() -> list[Column]:
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def _kept(lines: DataFrame, blank_lines: bool) -> DataFrame:
    return lines if blank_lines else lines.filter(~is_blank("text"))


def block_spans(lines: DataFrame, blank_lines: bool = False) -> DataFrame:
    """Where each line lands in its block's text; blank ones only with ``blank_lines``."""
    upto = running(_kept(lines, blank_lines), BLOCK, ["line_no"], by_position("line_no"),
                   {"__upto": ("sum", (F.length("text") + 1).cast("bigint"))})
    return (upto.withColumn("text_end", F.col("__upto") - 1)
            .withColumn("text_start", F.col("text_end") - F.length("text")).drop("__upto"))


def assemble_blocks(lines: DataFrame, blank_lines: bool = False) -> DataFrame:
    """One row per block: its lines joined by newlines, box, largest size; blank lines only with ``blank_lines``."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"])
    return _kept(lines, blank_lines).groupBy(*BLOCK).agg(
        F.array_join(texts, "\n").alias("text"), F.count("*").alias("n_lines"),
        F.min("line_no").alias("pos"), F.max("font_size").alias("max_size"), *union_box())


def is_heading(text: Column, size: Column, body: Column) -> Column:
    """A short block of one or two lines set clearly larger than the body."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (body > 0) & (size >= body * HEADING_RATIO) & (F.length(text) <= HEADING_CHARS) & (newlines <= 1)


def heading_level(size: Column, body: Column) -> Column:
    ratio = size / body
    return (F.when(body <= 0, 2).when(ratio >= 1.6, 1).when(ratio >= 1.35, 2).otherwise(3)).cast("bigint")


def classify_blocks(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """Add ``kind`` (heading / paragraph) and the heading ``level``."""
    heading = is_heading(F.col("text"), F.col("max_size"), F.col("body_size"))
    return (blocks.join(sizes, PAGE).withColumn("kind", F.when(heading, "heading").otherwise("paragraph"))
            .withColumn("level", F.when(heading, heading_level(F.col("max_size"), F.col("body_size")))))


def reading_order(elements: DataFrame) -> DataFrame:
    """Number a document's elements from 0: pages with text first, then OCR pages;
    on a page its tables first. ``elements``: document_id, page_no, is_ocr, is_table, pos."""
    group = (F.col("is_ocr").cast("bigint") * F.lit(1 << 30) + F.col("page_no")) * 2 + (
        ~F.col("is_table")).cast("bigint")
    block = group * F.lit(1 << 20) + by_position("pos")
    out = number_rows(elements.withColumn("__g", group), ["document_id"], ["__g", "pos"], block, "__n")
    return out.withColumn("reading_order", F.col("__n") - 1).drop("__g", "__n")


def outline(elements: DataFrame) -> DataFrame:
    """Headings of each document, numbered in reading order."""
    heads = elements.filter("kind = 'heading'").select("document_id", "reading_order", "page_no", "level", "text")
    return number_rows(heads, ["document_id"], ["reading_order"], by_position("reading_order"), "position")


# -------------------------------------------------------------------------- tables

def plausible_tables(cells: DataFrame, min_rows: int = 2, min_cols: int = 2, min_fill: float = 0.6) -> DataFrame:
    """Ids of candidate tables (table_id, r, c, text) that look like tables."""
    rows = cells.groupBy("table_id", "r").agg(
        F.count("*").alias("width"), F.sum((~is_blank("text")).cast("bigint")).alias("filled"))
    shape = rows.groupBy("table_id").agg(
        F.count("*").alias("n_rows"), F.max("width").alias("n_cols"), F.count_distinct("width").alias("widths"),
        F.sum("width").alias("total"), F.sum("filled").alias("filled"))
    return shape.filter((F.col("n_rows") >= min_rows) & (F.col("n_cols") >= min_cols) & (F.col("widths") <= 2)
                        & (F.col("filled") / F.col("total") >= min_fill)).select("table_id", "n_rows", "n_cols")


def mostly_inside(inner: str, outer: str, threshold: float = INSIDE) -> Column:
    """Whether box ``inner.*`` lies in box ``outer.*`` by at least that share of its area."""
    i, o = (lambda c: F.col(f"{inner}{c}")), (lambda c: F.col(f"{outer}{c}"))
    w = F.least(i("x1"), o("x1")) - F.greatest(i("x0"), o("x0"))
    h = F.least(i("y1"), o("y1")) - F.greatest(i("y0"), o("y0"))
    area = (i("x1") - i("x0")) * (i("y1") - i("y0"))
    return (w > 0) & (h > 0) & (area > 0) & (w * h / area >= threshold)


def _banded(boxes: DataFrame) -> DataFrame:
    """One row per horizontal band a box touches. A box mostly inside another has its
    vertical middle in it, so joining the middle's band to these misses nothing."""
    return boxes.withColumn("__band", F.explode(F.sequence(
        F.floor(F.col("y0") / BAND), F.floor(F.col("y1") / BAND))))


def _middle() -> Column:
    return F.floor((F.col("y0") + F.col("y1")) / 2 / BAND)


def _prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*[c if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def drop_blocks_in_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """Blocks not mostly inside a table of their page."""
    outer = _prefixed(_banded(tables.select(*PAGE, *BOX)), "t_", [*PAGE, "__band"])
    inner = blocks.withColumn("__band", _middle())
    cond = ([inner[k] == outer[k] for k in (*PAGE, "__band")])
    return (inner.join(outer, cond[0] & cond[1] & cond[2] & mostly_inside("", "t_"), "left_anti").drop("__band"))


def _overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b) where box a (left) and box b (right) of a page lie mostly in each other."""
    keep = [*PAGE, "__band"]
    found = None
    for inner, outer, i, o in ((left, right, "a_", "b_"), (right, left, "b_", "a_")):
        pairs = (_prefixed(inner.withColumn("__band", _middle()), i, keep)
                 .join(_prefixed(_banded(outer), o, keep), keep).filter(mostly_inside(i, o))
                 .select(F.col("a_id").alias("a"), F.col("b_id").alias("b")))
        found = pairs if found is None else found.union(pairs)
    return found.distinct()


def add_borderless_tables(accepted: DataFrame, candidates: DataFrame, plausible: DataFrame) -> DataFrame:
    """Candidates to add: (id, page, box), plausible, not overlapping an accepted table
    or an earlier added candidate.

    Both inputs: document_id, page_no, id, box; ids are unique and give the order.
    Equal boxes keep only the first before pairs are formed: whatever keeps or drops
    the first drops the rest.
    """
    cols = [*PAGE, "id", *BOX]
    free = candidates.select(*cols).join(plausible.select(F.col("table_id").alias("id")), "id", "left_semi")
    first = free.groupBy(*PAGE, *BOX).agg(F.min("id").alias("id")).select(*cols)
    blocked = _overlaps(first, accepted.select(*cols)).select(F.col("a").alias("id"))
    first = first.join(blocked, "id", "left_anti")
    edges = _overlaps(first, first).filter("a <> b")
    kept = greedy_leaders(first.select("id", F.col("id").alias("ord")), edges).filter("kept")
    return candidates.join(kept.select("id"), "id", "left_semi")


def table_cells(tables: DataFrame) -> DataFrame:
    """(table_id, n_rows, n_cols, r, c, text, x0..y1) from ``grid`` and ``boxes``.

    ``grid`` is array<array<string>>; ``boxes`` array<array<array<double>>> or null.
    """
    width = F.array_max(F.transform("grid", F.size))
    rows = tables.select("table_id", F.size("grid").cast("bigint").alias("n_rows"),
                         width.cast("bigint").alias("n_cols"), "boxes", F.posexplode("grid").alias("r", "__row"))
    cells = rows.select("table_id", "n_rows", "n_cols", "boxes", "r", F.posexplode("__row").alias("c", "__t"))
    box = F.get(F.get("boxes", F.col("r")), F.col("c"))
    return cells.select("table_id", "n_rows", "n_cols", F.col("r").cast("bigint").alias("r"),
                        F.col("c").cast("bigint").alias("c"), strip(F.coalesce("__t", F.lit(""))).alias("text"),
                        *[F.get(box, F.lit(i)).alias(n) for i, n in enumerate(BOX)])


def table_markdown(grid: Column) -> Column:
    """Markdown of a grid: short rows padded, the first row as header."""
    clean = lambda c: F.replace(F.when(_neat(c), c).otherwise(strip(F.coalesce(c, F.lit("")))), F.lit("\n"), F.lit(" "))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    padded = lambda r, width: line(F.concat(F.transform(r, clean), F.array_repeat(F.lit(""), width - F.size(r))))
    rule = lambda width: line(F.array_repeat(F.lit("---"), width))
    headed = lambda row, width: F.concat(F.coalesce(F.concat(row, F.lit("\n")), F.lit("")), rule(width))
    text = lambda width: F.array_join(F.transform(grid, lambda r, i: F.when(
        i == 0, headed(padded(r, width), width)).otherwise(padded(r, width))), "\n")
    # an array of one, so that the width is worked out once for all rows
    widths = F.array(F.array_max(F.transform(grid, F.size)))
    return F.when(F.size(grid) > 0, F.transform(widths, text)[0]).otherwise("")


def _neat(text: Column) -> Column:
    """Whether both ends are visible ASCII, so that there is nothing to strip."""
    return F.ascii(text).between(33, 126) & F.ascii(F.right(text, F.lit(1))).between(33, 126)


# ----------------------------------------------------------------------------- OCR

def ocr_scale_filter(fragments: DataFrame, dpi: int = OCR_DPI, min_confidence: float = OCR_CONFIDENCE) -> DataFrame:
    """Confident, non-blank fragments with pixel boxes turned into points."""
    kept = fragments.filter((F.col("conf") >= min_confidence) & ~is_blank("text"))
    return kept.withColumns({c: F.col(c) * F.lit(72.0 / dpi) for c in BOX})


def words_to_lines(rows: DataFrame) -> DataFrame:
    """Lines from word rows in tab-separated form: (document_id, row_no, tsv).

    Columns are level, page, block, par, line, word, left, top, width, height, conf,
    text; short rows and empty words are skipped. Neighbouring words of a line are joined before
    the shuffle, so what travels is about the text.
    """
    # out of a generator, so that each row is split once and not again for the filter
    f = F.col("__f")
    split = rows.select("document_id", "row_no", F.explode(F.array(F.split("tsv", "\t", -1))).alias("__f"))
    said = split.filter(F.get(f, F.lit(11)).isNotNull() & ~strip(F.get(f, F.lit(11))).isin("", "-1"))
    left, top, wide, high, conf = (F.get(f, F.lit(i)).cast("double") for i in range(6, 11))
    flat = said.select(
        "document_id", *[F.get(f, F.lit(i)).cast("bigint").alias(n) for i, n in enumerate(LINE[1:], 1)], "row_no",
        F.get(f, F.lit(11)).alias("text"), left.alias("x0"), top.alias("y0"), (left + wide).alias("x1"),
        (top + high).alias("y1"), (conf / 100).alias("conf"))
    stretch = lambda a, n: F.coalesce(F.sequence(a, a + n - 1), F.array(F.lit(None).cast("bigint")))
    numbered = lambda p: F.zip_with(F.flatten(F.zip_with(p["starts"], p["lengths"], stretch)),
                                    F.split(p["text"], "\t", -1), lambda r, t: F.struct(r.alias("row_no"), t.alias("text")))
    parts = F.col("__parts")
    mixed = F.sort_array(F.flatten(F.transform(parts, numbered)))
    text = (F.when(F.size(parts) == 1, F.replace(parts[0]["text"], F.lit("\t"), F.lit(" ")))
            .otherwise(F.array_join(F.transform(mixed, lambda w: w["text"]), " ")))
    return (_line_runs(flat).groupBy(*LINE).agg(
        F.collect_list(F.struct("starts", "lengths", "text")).alias("__parts"), *union_box(),
        (F.sum("conf") / F.nullif(F.sum("n"), F.lit(0))).alias("conf"), F.min(F.col("starts")[0]).alias("first_row"))
        .select(*LINE, text.alias("text"), *BOX, "conf", "first_row"))


def _line_runs(words: DataFrame) -> DataFrame:
    """Words that follow each other in a batch and belong to one line, as one row: their texts
    joined by tabs, which no word contains, their numbers as stretches (start, length), their
    box, and ``conf`` summed over ``n``. Rows with nulls or NaN stay alone, as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.num_rows
            value = {c: np.asarray(pc.fill_null(batch.column(c).cast(pa.float64()), np.nan)) for c in (*BOX, "conf")}
            known = np.asarray(pc.is_valid(batch.column("row_no")))
            row = np.asarray(pc.fill_null(batch.column("row_no"), 0))
            odd = ~known | np.logical_or.reduce([np.isnan(v) for v in value.values()])
            new = odd.copy()
            new[0] = True
            new[1:] |= odd[:-1] | (row[1:] <= row[:-1])
            for k in LINE:
                c = batch.column(k)
                new[1:] |= np.asarray(pc.fill_null(pc.not_equal(c[1:], c[:-1]), True))
            jumps = new.copy()
            jumps[1:] |= row[1:] - 1 != row[:-1]
            begin, at = np.flatnonzero(new), np.flatnonzero(jumps)
            ends = pa.array(np.append(begin, size).astype(np.int32))
            stretches = pa.array(np.append(np.searchsorted(at, begin), len(at)).astype(np.int32))
            starts = batch.column("row_no").take(pa.array(at))
            lengths = pa.array(np.diff(np.append(at, size)).astype(np.int32))
            text = pc.binary_join(pa.ListArray.from_arrays(ends, batch.column("text")), "\t")
            alone = batch.take(pa.array(begin))
            boxes = []
            for c in (*BOX, "conf"):
                fold = np.add if c == "conf" else np.minimum if c.endswith("0") else np.maximum
                whole = fold.reduceat(value[c], begin)
                boxes.append(pc.if_else(pa.array(odd[begin]), alone.column(c), pa.array(whole)))
            n = np.diff(np.append(begin, size)) - np.asarray(pc.is_null(alone.column("conf")))
            yield pa.RecordBatch.from_arrays(
                [*(alone.column(k) for k in LINE), pa.ListArray.from_arrays(stretches, starts),
                 pa.ListArray.from_arrays(stretches, lengths), text, *boxes, pa.array(n.astype(np.int64))],
                names=[*LINE, "starts", "lengths", "text", *BOX, "conf", "n"])

    slim = words.withColumn("row_no", F.col("row_no").cast("bigint"))
    more = "starts array<bigint>, lengths array<int>, text string, x0 double, y0 double, x1 double, y1 double, conf double, n bigint"
    return slim.mapInArrow(run, T.StructType([*slim.select(*LINE).schema.fields, *T._parse_datatype_string(more).fields]))


class _Rows:
    """Numbers each fragment with the first visual row it overlaps."""

    def __init__(self) -> None:
        self.open: list[list[float]] = []  # number, top, bottom
        self.made = 0

    def rows(self, tops: list[float], bottoms: list[float]) -> list[int]:
        found = []
        for y0, y1 in zip(tops, bottoms):
            # rows that end above this fragment can take no later one either
            self.open = [r for r in self.open if r[2] > y0]
            for r in self.open:
                low = min(r[2] - r[1], y1 - y0)
                if low > 0 and (min(r[2], y1) - max(r[1], y0)) / low > SAME_ROW:
                    r[1], r[2] = min(r[1], y0), max(r[2], y1)
                    found.append(r[0])
                    break
            else:
                self.open.append([self.made, y0, y1])
                found.append(self.made)
                self.made += 1
        return found


def _reach(key: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The largest end among the earlier rows of a row's key; -inf for its first."""
    order = np.argsort(end, kind="stable")
    rank = np.empty(len(end), np.int64)
    rank[order] = np.arange(len(end))
    highest = np.maximum.accumulate(rank + key * len(end)) - key * len(end)
    out = np.full(len(end), -np.inf)
    same = key[1:] == key[:-1]
    out[1:][same] = end[order][highest[:-1][same]]
    return out


def _visual_rows(first: np.ndarray, y0: np.ndarray, y1: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The visual row of each fragment, numbered through. ``first`` marks where a stretch
    begins that touches nothing before it.

    Most stretches are one row: every fragment overlaps enough with the box of those before
    it, which is checked for all at once. Only the others are gone through one by one."""
    starts = np.flatnonzero(first)
    size = np.diff(np.append(starts, len(first)))
    top = np.repeat(y0[starts], size)
    low = np.minimum(reach - top, y1 - y0)
    with np.errstate(invalid="ignore", divide="ignore"):
        fits = first | ((low > 0) & ((np.minimum(reach, y1) - np.maximum(top, y0)) / low > SAME_ROW))
    one = np.logical_and.reduceat(fits, starts)
    made, own = np.ones(len(starts), np.int64), np.zeros(len(first), np.int64)
    for i in np.flatnonzero(~one):
        a, z = starts[i], starts[i] + size[i]
        own[a:z] = _Rows().rows(y0[a:z].tolist(), y1[a:z].tolist())
        made[i] = own[a:z].max() + 1
    return own + np.repeat(np.cumsum(made) - made, size)


def _lines_of(part: pa.RecordBatch, keys: list[str], row: np.ndarray) -> pa.RecordBatch:
    """The finished line of each row: texts from left to right, box and mean confidence."""
    value = {c: np.asarray(part.column(c), dtype=np.float64) for c in BOX}
    order = np.lexsort((value["y0"], value["x0"], row))
    r, x, y = row[order], value["x0"][order], value["y0"][order]
    tied = np.flatnonzero((r[1:] == r[:-1]) & (x[1:] == x[:-1]) & (y[1:] == y[:-1]))
    if len(tied):  # of fragments in one place the lesser text comes first
        raw = part.column("text").take(pa.array(order)).to_pylist()
        for run in np.split(tied, np.flatnonzero(np.diff(tied) > 1) + 1):
            a, z = run[0], run[-1] + 2
            order[a:z] = order[a:z][sorted(range(z - a), key=lambda i: raw[a + i] or "")]
    begin = np.flatnonzero(np.diff(r, prepend=-1))
    said = part.column("__said").take(pa.array(order))
    full = np.asarray(pc.fill_null(pc.not_equal(said, ""), False))
    at = np.append(np.concatenate([[0], np.cumsum(full)])[begin], full.sum()).astype(np.int32)
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(at), said.filter(pa.array(full))), " ")
    known = np.asarray(pc.is_valid(part.column("conf")))[order]
    conf = np.asarray(pc.fill_null(part.column("conf"), 0.0), dtype=np.float64)[order]
    n = np.add.reduceat(known, begin, dtype=np.int64)
    mean = np.divide(np.add.reduceat(conf, begin), n, where=n > 0, out=np.zeros(len(begin)))
    head = part.take(pa.array(order[begin]))
    box = [np.minimum.reduceat(value[c][order], begin) for c in BOX[:2]] + [np.maximum.reduceat(value[c][order], begin) for c in BOX[2:]]
    return pa.RecordBatch.from_arrays([*(head.column(k) for k in keys), text, *map(pa.array, box), pa.array(mean, mask=n == 0)],
                                      names=[*keys, "text", *BOX, "conf"])


def merge_visual_lines(fragments: DataFrame, block: int = PAGE_ROWS) -> DataFrame:
    """Join the fragments of one visual line: (page, text, box, conf).

    Which row takes a fragment depends on order, but only among fragments that touch
    vertically. A page's fragments are shuffled to one task, many to a row, sorted there, and leave
    it as finished lines. Pages of more than ``block``
    fragments are cut into such stretches first, which then spread over tasks.
    """
    slim = fragments.select(*PAGE, "text", *[F.col(c).cast("double").alias(c) for c in (*BOX, "conf")])
    slim = slim.withColumn("__said", F.when(~_neat(F.col("text")), strip("text")))  # null where it is the text
    large = slim.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > block).select(*PAGE)
    large = cut(large)
    if large.isEmpty():
        return _merged(slim, PAGE)
    few = slim.join(large, PAGE, "left_anti")
    cutup = islands(slim.join(large, PAGE, "left_semi"), PAGE, "y0", "y1")
    return _merged(few, PAGE).unionByName(_merged(cutup, [*PAGE, "island"]).drop("island"))


def _key_starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Whether a row's key differs from that of the row before."""
    new = np.zeros(batch.num_rows, bool)
    new[:1] = True
    for k in keys:
        c = batch.column(k)
        new[1:] |= np.asarray(pc.fill_null(pc.not_equal(c[1:], c[:-1]), True))
    return new


def _packs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Up to ``PACK`` fragments of a key that follow each other as one row of arrays, so that the
    shuffle and the sort by key handle few rows."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            starts = np.flatnonzero(_key_starts(batch, keys))
            size = np.diff(np.append(starts, batch.num_rows))
            begin = np.flatnonzero((np.arange(batch.num_rows) - np.repeat(starts, size)) % PACK == 0)
            ends = pa.array(np.append(begin, batch.num_rows).astype(np.int32))
            head = batch.select(keys).take(pa.array(begin))
            yield pa.RecordBatch.from_arrays([*head.columns, *(pa.ListArray.from_arrays(ends, batch.column(c)) for c in columns)],
                                             names=[*keys, *columns])

    columns = [c for c in rows.columns if c not in keys]
    return rows.select(*keys, *columns).mapInArrow(pack, T.StructType(
        [*rows.select(*keys).schema.fields, *(T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in columns)]))


def _unpacked(batch: pa.RecordBatch, keys: list[str]) -> pa.RecordBatch:
    columns = {c: batch.column(c).flatten() for c in batch.schema.names if c not in keys}
    size = np.asarray(pc.list_value_length(batch.column("text")))
    head = batch.select(keys).take(pa.array(np.repeat(np.arange(batch.num_rows), size)))
    columns["__said"] = pc.coalesce(columns["__said"], columns["text"])
    return pa.RecordBatch.from_arrays([*head.columns, *columns.values()], names=[*keys, *columns])


def _merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chain(batches, [None]):
            if batch is not None:
                if not batch.num_rows:
                    continue
                batch = _unpacked(batch, keys)
                held = batch if held is None else pa.concat_batches([held, batch])
            if held is None:
                return
            new = _key_starts(held, keys)
            # the last key may go on in the next batch
            done = len(new) if batch is None else int(np.flatnonzero(new)[-1])
            if done:
                key = np.cumsum(new[:done])
                box = {c: np.asarray(held.column(c), dtype=np.float64)[:done] for c in BOX}
                order = np.lexsort((box["x1"], box["y1"], box["x0"], box["y0"], key))
                y0, y1 = box["y0"][order], box["y1"][order]
                reach = _reach(key, y1)
                first = new[:done] | (y0 >= reach)
                yield _lines_of(held.take(pa.array(order)), keys, _visual_rows(first, y0, y1, reach))
            held = held.slice(done)

    out = T.StructType([*rows.select(*keys, "text", *BOX).schema.fields, T.StructField("conf", T.DoubleType())])
    return _packs(rows, keys).transform(together, keys).sortWithinPartitions(*keys).mapInArrow(run, out)


def ocr_heading(text: Column, height: Column, body: Column, n_lines: Column | int = 1) -> Column:
    """One short line that is taller than the body or opens with a clause marker."""
    n = F.lit(n_lines) if isinstance(n_lines, int) else n_lines
    return (n == 1) & (F.length(text) <= HEADING_CHARS) & (
        ((body > 0) & (height >= body * HEADING_RATIO)) | text.rlike(CLAUSE))


def median_height(lines: DataFrame) -> DataFrame:
    """(page, body_height): the median line height."""
    return exact_median(lines.withColumn("__h", F.col("y1") - F.col("y0")), PAGE, "__h", "body_height")


def group_lines(lines: DataFrame, heights: DataFrame) -> DataFrame:
    """Add ``block_no``: a new block at and after a heading, at a vertical gap, or at a
    shift of the indent. ``lines``: page, line_no (order), text, box."""
    heights = cut(heights)  # a number per page, used by each of the scans below
    rows = (lines.join(heights, PAGE, "left").withColumn("body_height", F.coalesce("body_height", F.lit(0.0)))
            .withColumn("__head", ocr_heading(F.col("text"), F.col("y1") - F.col("y0"), F.col("body_height"))))
    rows = previous_row(rows, PAGE, ["line_no"], by_position("line_no"),
                        F.struct("__head", "x0", "y1"), "__prev")
    gap = F.col("y0") - F.col("__prev.y1")
    shift = F.abs(F.col("x0") - F.col("__prev.x0"))
    opens = (F.col("__prev").isNull() | F.col("__head") | F.col("__prev.__head")
             | (gap > F.greatest(F.col("body_height") * 0.9, F.lit(4.0))) | (shift > F.col("body_height") * 6))
    return running(rows, PAGE, ["line_no"], by_position("line_no"),
                   {"block_no": ("sum", opens.cast("bigint"))}).drop("__head", "__prev", "body_height")


# ------------------------------------------------------------------ layout model

def flip_origin(left: Column, top: Column, right: Column, bottom: Column, bottom_left: Column,
                page_height: Column) -> list[Column]:
    """Box with a top-left origin; without a page height only the order is fixed."""
    flip = bottom_left & page_height.isNotNull() & (page_height != 0)
    low, high = F.least(top, bottom), F.greatest(top, bottom)
    return [left.alias("x0"), F.when(flip, page_height - high).otherwise(low).alias("y0"),
            right.alias("x1"), F.when(flip, page_height - low).otherwise(high).alias("y1")]


def map_label(label: Column) -> Column:
    """Element kind of a layout label, by the first part that matches."""
    text = F.lower(F.coalesce(label, F.lit("")))
    has = lambda *parts: F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(text, p))
    return (F.when(has("title", "header", "section"), "heading").when(has("table"), "table")
            .when(has("caption"), "caption").when(has("list"), "list_item").otherwise("paragraph"))
