"""Merkle fingerprints of documents: pieces, paragraphs, sections, root.

A paragraph is a line with its break; a section is a run of paragraphs that ends where a
paragraph's own hash says so, which keeps sections in step after an edit. Leaves are pieces
of paragraphs, cut at sentence ends. Every node's hash is that of its children's hashes, so
equal roots mean equal texts, and a comparison goes down only where hashes differ.

A fingerprint is a string: the root's 32 hex digits and, section by section (``/``) and
paragraph by paragraph (``,``), each leaf's hash (8 characters) and length in code points.
The hashes of paragraphs and sections follow from it and are not repeated.
"""

from __future__ import annotations

import re
from base64 import b85encode
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b, sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from attesta.llm.scratch import stored

PARAGRAPH = re.compile(r"[^\n]*\n|[^\n]+")
#: at least 64 code points, then up to the end of a sentence, with its white space
PIECE = re.compile(r".{64}[^.!?]{0,192}[.!?]*\s*|.+", re.DOTALL)
WORD = re.compile(r"\S+\s*|\s+")
SECTION = 8
LEAF = 8


def _hash(data: bytes, size: int = 8) -> bytes:
    return blake2b(data, digest_size=size).digest()


@dataclass
class Node:
    """A node with the place and number of its code points; leaves have no children."""
    hash: bytes
    start: int
    size: int
    children: list[Node] = field(default_factory=list)


def _parent(children: list[Node], start: int, size: int = 8) -> Node:
    return Node(_hash(b"".join(c.hash for c in children), size), start, sum(c.size for c in children), children)


#: base 85 has no comma, slash or full stop, but has the semicolon, which ends the root here
_SAFE = bytes.maketrans(b";", b":")


def _leaf_hash(text: str) -> bytes:
    """Six bytes, as eight characters without the separators of a fingerprint."""
    return b85encode(_hash(text.encode(), 6)).translate(_SAFE)


def _pieces(paragraph: str, opening: bool) -> Iterator[str]:
    """Leaves of a paragraph. The first piece of a text is cut again after 1, 2, 4, 8 ... words,
    as short texts have no other."""
    for m in PIECE.finditer(paragraph):
        if not opening:
            yield m[0]
            continue
        opening, words, n = False, WORD.findall(m[0]), 1
        while words:
            yield "".join(words[:n])
            words, n = words[n:], 2 * n


def tree(text: str | None) -> Node:
    """The tree of a whole text; null counts as empty and has a root without sections."""
    sections: list[Node] = []
    paragraphs: list[Node] = []
    at = 0
    for m in PARAGRAPH.finditer(text or ""):
        leaves, start = [], at
        for piece in _pieces(m[0], not at):
            leaves.append(Node(_leaf_hash(piece), at, len(piece)))
            at += len(piece)
        paragraphs.append(_parent(leaves, start))
        if paragraphs[-1].hash[0] % SECTION == 0:
            sections.append(_parent(paragraphs, paragraphs[0].start))
            paragraphs = []
    if paragraphs:
        sections.append(_parent(paragraphs, paragraphs[0].start))
    root = _parent(sections, 0, 16)
    # the root vouches for the text itself, not only for six bytes of each leaf
    root.hash = _hash(root.hash + _hash((text or "").encode(), 32), 16)
    return root


def written(root: Node) -> str:
    body = "/".join(",".join("".join(f"{leaf.hash.decode()}{leaf.size}." for leaf in p.children) for p in s.children)
                    for s in root.children)
    return f"{root.hash.hex()};{body}"


LEAVES = re.compile(r"(.{8})(\d+)\.", re.DOTALL)


def read(fingerprint: str) -> Node:
    """The tree of a fingerprint."""
    head, _, body = fingerprint.partition(";")
    sections, at = [], 0
    for s in body.split("/") if body else []:
        paragraphs, first = [], at
        for p in s.split(","):
            leaves, start = [], at
            for m in LEAVES.finditer(p):
                leaves.append(Node(m[1].encode(), at, int(m[2])))
                at += leaves[-1].size
            paragraphs.append(_parent(leaves, start))
        sections.append(_parent(paragraphs, first))
    root = _parent(sections, 0, 16)
    root.hash = bytes.fromhex(head)
    return root


def differing(a: list[Node], b: list[Node]) -> tuple[list[Node], list[Node]]:
    """Leaves below nodes that the other side lacks. Nodes of one level with equal hashes are
    paired in order and not looked into; what is left is compared one level further down."""
    while a and b:
        pool: dict[bytes, list[int]] = defaultdict(list)
        for i, node in enumerate(b):
            pool[node.hash].append(i)
        paired, keep_a = set(), []
        taken: dict[bytes, int] = defaultdict(int)
        for node in a:
            n = taken[node.hash]
            if n < len(pool.get(node.hash, ())):
                paired.add(pool[node.hash][n])
                taken[node.hash] += 1
            else:
                keep_a.append(node)
        keep_b = [node for i, node in enumerate(b) if i not in paired]
        if not any(n.children for n in keep_a) and not any(n.children for n in keep_b):
            return keep_a, keep_b
        a, b = [c for n in keep_a for c in n.children], [c for n in keep_b for c in n.children]
    return _leaves(a), _leaves(b)


def _leaves(nodes: list[Node]) -> list[Node]:
    while any(n.children for n in nodes):
        nodes = [c for n in nodes for c in n.children]
    return nodes


def likeness(a: Node, b: Node) -> float:
    """1 for equal roots; else the share of code points in branches that both have, counting
    one more on each side for the roots that differ, so never 1."""
    if a.hash == b.hash:
        return 1.0
    only_a, only_b = differing(a.children, b.children)
    common = a.size + b.size - sum(n.size for n in only_a) - sum(n.size for n in only_b)
    return common / (a.size + b.size + 2)


def spans(leaves: list[Node]) -> list[tuple[int, int]]:
    """(start, end) of runs of leaves."""
    out: list[tuple[int, int]] = []
    for leaf in sorted(leaves, key=lambda n: n.start):
        if out and out[-1][1] == leaf.start:
            out[-1] = out[-1][0], leaf.start + leaf.size
        elif leaf.size:
            out.append((leaf.start, leaf.start + leaf.size))
    return out


@F.pandas_udf(T.StringType())
def fingerprint(text: pd.Series) -> pd.Series:
    """A text's fingerprint; null counts as empty."""
    return text.map(lambda t: written(tree(t)))


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(T.StructType([T.StructField("equal", T.BooleanType()), T.StructField("likeness", T.DoubleType()),
                            T.StructField("gone", _SPANS), T.StructField("added", _SPANS)]))
def compared(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """Two columns of fingerprints: whether the texts are equal, how alike, and which code
    points of the old and of the new text lie in branches that differ. A null fingerprint
    counts as that of an empty text."""
    rows = []
    for x, y in zip(old, new):
        a, b = (read(v) if v is not None else tree("") for v in (x, y))
        same = a.hash == b.hash
        gone, added = ([], []) if same else differing(a.children, b.children)
        rows.append((same, likeness(a, b), [{"start": s, "end": e} for s, e in spans(gone)],
                     [{"start": s, "end": e} for s, e in spans(added)]))
    return pd.DataFrame(rows, columns=["equal", "likeness", "gone", "added"])


def edited(text: str, after: str) -> str:
    """The last half of a text (rounded down) replaced by the beginning of the next one."""
    half = len(text) // 2
    return text[:len(text) - half] + after[:half]


NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
TYPES = [pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]


def _facts(text: str, own: Node, after: str, following: Node) -> tuple:
    changed = edited(text, after)
    other = tree(changed)
    return (len(text), sha256(changed.encode()).hexdigest(), written(own), written(other), likeness(own, other),
            likeness(own, following))


RANGES = 8192


def _bounds(docs: DataFrame, id_col: str, ranges: int) -> list[int]:
    """At most ``ranges`` - 1 ids that cut the table into ranges of about equal row counts."""
    if ranges < 2:
        return []
    cuts = docs.select(F.col(id_col).cast("long").alias("id")).agg(
        F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0]
    return sorted(set(cuts or []))


def _range_of(id_: Column, hash_: Column, bounds: list[int]) -> Column:
    """The number of bounds up to the id, by binary search; rows without an id come before
    all others, in 64 ranges by hash."""
    steps = len(bounds).bit_length()
    found = F.lit(0)
    if steps:
        padded = F.lit(bounds + [2**63 - 1] * ((1 << steps) - 1 - len(bounds)))
        found = F.aggregate(F.lit([1 << i for i in reversed(range(steps))]), found, lambda n, step: F.when(
            F.element_at(padded, n + step) <= id_, n + step).otherwise(n))
    return F.when(id_.isNull(), F.shiftright(hash_, 58).cast("int") - 32).otherwise(found)


def compared_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       ranges: int | None = None) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of
    every row: its text against its edited text (see ``edited``) and against the next text.

    The next row is that with the next id, and after the last row the first. A null text is
    empty; rows without an id come first and, like rows that repeat an id, are ordered by a
    hash of their texts; a single row is its own next; an empty table gives no rows. Other
    columns, whatever their names, are not read.

    Texts are shuffled once, into ranges of ids (four per shuffle partition, at most 8,192),
    and stream through their task in order, two at a time. The first text of each range goes
    along with the range before it.
    """
    spark = docs.sparkSession
    if ranges is None:
        ranges = min(RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind = dict(docs.select(id_col).dtypes)[id_col]
    id_, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__own"), id_.alias("__id"), text.alias("__text"), F.xxhash64(text).alias("__hash"))
    rows = rows.withColumn("__range", _range_of(F.col("__id"), F.col("__hash"), _bounds(docs, id_col, ranges)))
    # one row per range: at most RANGES + 64, so it may be broadcast and ordered in one task
    lowest = rows.groupBy("__range").agg(F.min(F.struct("__id", "__hash")).alias("__first"))
    before = Window.orderBy("__range")
    lowest = lowest.select("__first.*", F.coalesce(
        F.lag("__range").over(before), F.max("__range").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ).alias("__of"))
    lowest = F.broadcast(lowest.withColumnsRenamed({"__id": "__i", "__hash": "__h"}))
    tails = (rows.join(lowest, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h")))
             .dropDuplicates(["__of"]).select("__own", "__id", "__text", "__hash", F.col("__of").alias("__range"), F.lit(True).alias("__tail")))
    tails = stored(tails, "firsts")
    order = ["__range", "__tail", F.asc_nulls_first("__id"), "__hash"]
    sorted_rows = (rows.withColumn("__tail", F.lit(False)).unionByName(tails).repartition(F.col("__range"))
                   .sortWithinPartitions(*order).select("__own", "__text", "__tail"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            owns, facts = [], []
            for own, text, tail in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                now = (own, text.as_py())
                now += (tree(now[1]),)
                if held:
                    owns.append(held[0])
                    facts.append(_facts(held[1], held[2], now[1], now[2]))
                held = None if tail else now
            columns = list(zip(*facts)) if facts else [()] * len(TYPES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(owns, batch.schema.field(0).type), *(pa.array(c, t) for c, t in zip(columns, TYPES))], names=["id", *NAMES])

    schema = ", ".join(["id " + kind, *(f"{n} {t}" for n, t in zip(NAMES, ["long", *["string"] * 3, *["double"] * 2]))])
    return sorted_rows.mapInArrow(walk, schema).withColumnRenamed("id", id_col)
