"""FM-indexes over the words of training shards, and benchmark decontamination with them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attesta.llm import kernels as K
from attesta.llm.scratch import stored

#: bytes of benchmark texts that are broadcast at a time
BLOCK_BYTES = 8 << 20
#: every so manieth position of the text is kept in the index
SAMPLE = 8
#: pattern and range pairs taken together in a backward search
SEARCHES = 1 << 16


class Wavelet:
    """Ranks in a sequence of symbols: one bit vector per bit of a symbol, highest first,
    after each of which the symbols with 0 go before those with 1."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b & 1).astype(bool)
            ones = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((b, ones, len(bit) - int(ones[-1])))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol[i] occurs before place at[i]."""
        start = np.zeros_like(at)
        for b, ones, zeros in self.levels:
            set_ = (symbol >> b & 1).astype(bool)
            at = np.where(set_, zeros + ones[at], at - ones[at])
            start = np.where(set_, zeros + ones[start], start - ones[start])
        return at - start


class FMIndex:
    """Counts and positions of phrases in a text of symbols 0 to ``top``, where 0 separates
    and no phrase crosses a 0."""

    def __init__(self, text: np.ndarray, top: int):
        n = len(text)
        self.first = np.searchsorted(np.sort(text), np.arange(top + 2))
        # order of suffixes by doubling; every separator is a symbol of its own, so that
        # suffixes differ at the next separator at the latest
        breaks = np.flatnonzero(text == 0)
        rank = text.astype(np.int64) + len(breaks)
        rank[breaks] = np.arange(len(breaks))
        width = 1
        while True:
            order = np.argsort(rank, kind="stable")
            new = np.ones(n, bool)
            new[1:] = rank[order][1:] != rank[order][:-1]
            dense = np.empty(n, np.int64)
            dense[order] = np.cumsum(new) - 1
            if new.all():
                break
            after = np.zeros(n, np.int64)
            after[:-width] = dense[width:] + 1
            rank = dense * (n + 1) + after
            width *= 2
        self.last = text[order - 1]
        self.tree = Wavelet(self.last, max(1, int(top).bit_length()))
        # sampled positions, and the first symbol after each separator: a walk never meets one
        kept = (order % SAMPLE == 0) | (self.last == 0)
        self.sampled = kept
        self.positions = order[kept]
        self.samples = np.zeros(n + 1, np.int64)
        np.cumsum(kept, out=self.samples[1:])

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of every phrase, from its last symbol to its first."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), len(self.last), np.int64)
        alive = np.arange(len(phrases))
        for step in range(phrases.shape[1]):
            alive = alive[step < lengths[alive]]
            if not len(alive):
                break
            symbol = phrases[alive, lengths[alive] - 1 - step]
            lo[alive] = self.first[symbol] + self.tree.rank(symbol, lo[alive])
            hi[alive] = self.first[symbol] + self.tree.rank(symbol, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
        return lo, hi

    def locate(self, at: np.ndarray) -> np.ndarray:
        """The text positions of suffixes, by walking back to a sampled one."""
        out, todo, steps = np.empty(len(at), np.int64), np.arange(len(at)), 0
        at = at.copy()
        while len(todo):
            known = self.sampled[at[todo]]
            done = todo[known]
            out[done] = self.positions[self.samples[at[done]]] + steps
            todo = todo[~known]
            symbol = self.last[at[todo]]
            at[todo] = self.first[symbol] + self.tree.rank(symbol, at[todo])
            steps += 1
        return out


class Phrases:
    """The distinct windows of a block of benchmark items, as symbols of its vocabulary."""

    def __init__(self, ids: list, texts: list[str | None], window: int):
        data, at = K.texts(pa.array(texts, pa.string()))
        starts, ends, first = K.words(data, at, K.ALNUM)
        hashes = K.span_hashes(K.LOWER[data], starts, ends)
        self.vocabulary = np.unique(hashes)
        symbols = np.searchsorted(self.vocabulary, hashes) + 1
        owners: dict[tuple, list] = {}
        for i, name in enumerate(ids):
            own = symbols[first[i]:first[i + 1]]
            for j in range(max(0, len(own) - window) + 1 if len(own) else 0):
                users = owners.setdefault(tuple(own[j:j + window].tolist()), [])
                if name not in users[-1:]:
                    users.append(name)
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.symbols = np.zeros((len(owners), window), np.int64)
        for i, w in enumerate(owners):
            self.symbols[i, :len(w)] = w
        self.owners = list(owners.values())

    def hits(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """Words of the shard (starts, ends, first per row), which of them are hit, and the
        (row, item) pairs that occur."""
        starts, ends, first = K.words(data, at, K.ALNUM)
        hit, pairs = np.zeros(len(starts), bool), set()
        if not len(self.lengths) or not len(starts):
            return starts, ends, first, hit, pairs
        hashes = K.span_hashes(K.LOWER[data], starts, ends)
        slot = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[slot] == hashes
        # stretches of words of one row that are all in the vocabulary; shorter ones than the
        # shortest phrase can't hold one and are left out of the index
        row = K.row_of(first)
        opens = known.copy()
        opens[1:] &= ~known[:-1] | (row[1:] != row[:-1])
        head = np.flatnonzero(opens)
        closes = known.copy()
        closes[:-1] &= ~known[1:] | (row[1:] != row[:-1])
        size = np.flatnonzero(closes) + 1 - head
        head, size = head[size >= self.lengths.min()], size[size >= self.lengths.min()]
        if not len(head):
            return starts, ends, first, hit, pairs
        base = np.concatenate([[0], np.cumsum(size + 1)])
        place = np.full(base[-1] + 1, -1, np.int64)  # of each symbol of the text, its word
        inner = np.ones(base[-1] + 1, bool)
        inner[base] = False
        place[inner] = np.repeat(head - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        text = np.where(inner, slot[place] + 1, 0)
        index = FMIndex(text, len(self.vocabulary))
        mark = np.zeros(len(starts) + 1, np.int64)
        for lo in range(0, len(self.lengths), SEARCHES):
            a, b = index.search(self.symbols[lo:lo + SEARCHES], self.lengths[lo:lo + SEARCHES])
            found = np.flatnonzero(a < b)
            many = (b - a)[found]
            if not len(found):
                continue
            of = np.repeat(found, many)
            suffix = np.repeat(a[found] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
            word = place[index.locate(suffix)]
            np.add.at(mark, word, 1)
            np.add.at(mark, word + self.lengths[lo + of], -1)
            for r, w in set(zip(row[word].tolist(), (lo + of).tolist(), strict=True)):
                pairs.update((r, item) for item in self.owners[w])
        hit = np.cumsum(mark[:-1]) > 0
        return starts, ends, first, hit, pairs


FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])


CLEANED = T.StructType([*FOUND.fields, T.StructField("kept", T.StringType())])


def _without(data: bytes, spans: list[dict]) -> str:
    """A text without byte ranges, which begin and end between characters."""
    at, kept = 0, []
    for cut in spans:
        kept.append(data[at:cut["start"]])
        at = cut["end"]
    return b"".join([*kept, data[at:]]).decode("utf-8")


def _search(phrases: Phrases, clean: bool = False):
    """A column function: texts and spans found before, to FOUND with these joined in, and
    if ``clean`` with the text without its spans, where it has any. Each shard of an Arrow
    batch has an index of its own."""
    kinds = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    @F.arrow_udf(CLEANED if clean else FOUND)
    def search(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for text, old_spans, old_items in parts:
            out, row = [], 0
            for data, at in K.chunks(text):
                starts, ends, first, hit, pairs = phrases.hits(data, at)
                items: dict[int, set] = {}
                for r, item in pairs:
                    items.setdefault(r, set()).add(str(item))
                for i in range(len(at) - 1):
                    lo, hi = first[i], first[i + 1]
                    own = hit[lo:hi].copy()
                    named = items.get(i, set())
                    if old_spans[row].is_valid:
                        for span in old_spans[row].as_py():
                            own |= (starts[lo:hi] - at[i] >= span["start"]) & (ends[lo:hi] - at[i] <= span["end"])
                        named |= set(old_items[row].as_py())
                    row += 1
                    edge = np.diff(np.concatenate([[0], own.astype(np.int8), [0]]))
                    opened, closed = np.flatnonzero(edge == 1) + lo, np.flatnonzero(edge == -1) - 1 + lo
                    out.append({"n_words": int(hi - lo), "n_hit": int(own.sum()), "items": sorted(named),
                                "spans": [{"start": int(starts[a] - at[i]), "end": int(ends[b] - at[i])}
                                          for a, b in zip(opened, closed, strict=True)]})
                    if clean:
                        spans = out[-1]["spans"]
                        out[-1]["kept"] = _without(data[at[i]:at[i + 1]].tobytes(), spans) if spans else None
            fields = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(kinds))]
            yield pa.array(out, pa.struct([*fields, *([("kept", pa.string())] if clean else [])]))

    return search


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text",
               item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` with n_words, n_hit, items (ids as strings, sorted)
    and spans (byte ranges of merged hits, in UTF-8).

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. A
    phrase is ``window`` consecutive words of an item, or the whole of a shorter one; every
    word inside any occurrence of a phrase is hit. Null texts have no words; items without
    words or with null text have no phrase; an item with a null id is not named. An empty
    benchmark hits nothing. Columns with the names of the results are replaced.

    Tasks index the shards they read, 4 MB of text or one longer document at a time: an
    FM-index over the stretches of words that occur in the benchmark at all. All phrases are
    searched backwards together. Texts are not shuffled. The benchmark goes out in blocks of
    ``block_bytes``; each further block is another pass, which adds to the spans found.
    """
    docs = docs.drop("n_words", "n_hit", "items", "spans")
    found = _found(docs, benchmark, window, text_col, item_col, item_text, block_bytes, False)
    return found.select(*docs.columns, *(F.col(f"__found.{c}").alias(c) for c in FOUND.names))


def _found(docs: DataFrame, benchmark: DataFrame, window: int, text_col: str, item_col: str, item_text: str,
           block_bytes: int, clean: bool) -> DataFrame:
    named = benchmark.select(F.col(item_col).alias("id"), F.col(item_text).alias("text")).where("text IS NOT NULL")
    size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    at = F.pmod(F.xxhash64("id", "text"), F.lit(blocks))
    found = docs.withColumn("__found", F.lit(None).cast(FOUND))
    for block in range(blocks):
        items = named.where(at == block).collect()
        last = block + 1 == blocks
        search = _search(Phrases([r["id"] for r in items], [r["text"] for r in items], window), clean and last)
        found = found.withColumn("__found", search(F.col(text_col), F.col("__found.spans"), F.col("__found.items")))
        if not last:
            found = stored(found, "leaks")
    return found


def remove_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with the spans of ``find_leaks`` taken out of the text; other texts as they are.
    Texts visit Python once, for search and cut alike."""
    found = _found(docs, benchmark, window, text_col, item_col, item_text, block_bytes, True)
    return found.withColumn(text_col, F.coalesce(F.col("__found.kept"), F.col(text_col))).select(*docs.columns)
