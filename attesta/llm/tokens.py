"""Token ids of whole texts by a public tokenizer's file."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from attesta.llm.kernels import chunks

#: bytes of text encoded together, pieces remembered, and code points of words of letters
CHUNK, MEMO, LATIN = 4 << 20, 400_000, "İ"

_VISIBLE, _LETTER, _MARK = (np.zeros(256, bool) for _ in range(3))
_VISIBLE[0x21:0x7F] = _LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_MARK[list(b".,;:!?")] = True
#: bytes that may follow a space at a cut: not white space, nor what such a character begins with
_SOLID = np.ones(256, bool)
_SOLID[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = False


def cut_places(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where texts are cut into pieces, all beginnings of texts and the end included.

    Cuts are before a space that something visible follows, between an ASCII letter and a
    mark of punctuation, and around a line feed between visible ASCII characters.
    """
    edge = np.zeros(len(data) + 1, bool)
    edge[:-2] |= (data[:-1] == 0x20) & _SOLID[data[1:]]
    edge[1:-1] |= _LETTER[data[:-1]] & _MARK[data[1:]]
    breaks = np.flatnonzero((data[1:-1] == 0x0A) & _VISIBLE[data[:-2]] & _VISIBLE[data[2:]]) + 1
    edge[breaks] = edge[breaks + 1] = edge[at] = True
    return np.flatnonzero(edge)


class Encoder:
    """Ids of texts, as the tokenizer gives them without special tokens added.

    Both kinds of tokenizer used here split at every cut (see ``cut_places``) before any
    merge is applied, so the ids of a text are those of its pieces in turn. Pieces of a chunk
    of texts are numbered in one pass over their bytes; only new ones are encoded, words of
    Latin letters by the tokenizer's model alone, and all ids are then gathered at once from
    one flat array. Texts that name a special token are encoded whole. Null and empty texts
    have no ids but the end id, if there is one.
    """

    def __init__(self, path: str, end_id: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = np.array([] if end_id is None else [end_id], np.uint32)
        self.known: dict[str, int] = {}
        self.flat, self.begin = array("I"), array("q", [0])
        self.letters = False
        self.visible = self._byte_letters()
        self.lower = self.tokenizer.normalizer is not None and self.tokenizer.normalizer.normalize_str("A") == "a"
        self.letters = self._knows_letters()

    def _keep(self, pieces: list[str]) -> None:
        """Drop what these pieces don't use from the memo."""
        used = [p for p in pieces if p in self.known]
        at = np.array([self.known[p] for p in used], np.int64)
        begin = np.frombuffer(self.begin, np.int64)
        sizes = (begin[1:] - begin[:-1])[at] if len(at) else at
        upto = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        flat = np.frombuffer(self.flat, np.uint32)[np.repeat(begin[at] - upto[:-1], sizes) + np.arange(upto[-1])]
        self.known = dict(zip(used, range(len(used))))
        self.flat, self.begin = array("I", flat.tobytes()), array("q", upto.tobytes())

    def _byte_letters(self) -> dict[int, str]:
        """The characters by which byte-level vocabularies name bytes: themselves where they
        are printable in Latin-1, and those from 256 on for the others in turn."""
        named = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        return {**{b: chr(b) for b in named}, **{b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(named)))}}

    def _words(self, pieces: list[str]) -> Iterator[list[int]]:
        """The ids of words of letters, with or without a space before them."""
        tokenize, space = self.tokenizer.model.tokenize, "" if self.lower else self.visible[0x20]
        for p in pieces:
            if self.lower:
                p = p.lower()
            if not p.isascii():
                p = p.encode().decode("latin-1").translate(self.visible).replace(self.visible[0x20], " ")
            yield [t.id for t in tokenize(space + p[1:] if p[0] == " " else p)]

    def _knows_letters(self) -> bool:
        """Whether words of Latin letters reach the model as ``_word`` hands them over."""
        alone = [w for c in range(0x41, ord(LATIN)) if chr(c).isalpha() for w in (chr(c), f" {chr(c)}", f" a{chr(c)}Z")]
        return list(self._words(alone)) == [x.ids for x in self.tokenizer.encode_batch_fast(alone, add_special_tokens=False)]

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """The numbers of distinct pieces; new ones are encoded."""
        if len(self.known) > MEMO:
            self._keep(pieces)
        numbers = list(map(self.known.get, pieces))
        new = [p for p, n in zip(pieces, numbers) if n is None]
        if not new:
            return np.array(numbers, np.int64)
        plain = [self.letters and (p[1:] if p[:1] == " " else p).isalpha() and (p.isascii() or max(p) < LATIN) for p in new]
        others = [p for p, w in zip(new, plain) if not w]
        ids = iter(self.tokenizer.encode_batch_fast(others, add_special_tokens=False))
        words = self._words([p for p, w in zip(new, plain) if w])
        flat, at = self.flat, len(self.flat)
        for w in plain:
            own = next(words) if w else next(ids).ids
            flat.extend(own)
            at += len(own)
            self.begin.append(at)
        first = len(self.known)
        self.known.update(zip(new, range(first, first + len(new))))
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def _encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, cuts = len(at) - 1, cut_places(data, at)
        cut = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
        coded = cut.dictionary_encode()
        piece = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        begin = np.frombuffer(self.begin, np.int64)
        sizes = (begin[1:] - begin[:-1])[piece]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        own = upto[np.searchsorted(cuts, at)]
        ids = np.frombuffer(self.flat, np.uint32)[np.repeat(begin[piece] - upto[:-1], sizes) + np.arange(upto[-1])]
        if not len(self.end):
            return ids, own
        offsets = own + np.arange(rows + 1)
        out = np.full(offsets[-1], self.end[0], np.uint32)
        ends = np.zeros(len(out), bool)
        ends[offsets[1:] - 1] = True
        out[~ends] = ids
        return out, offsets

    def ids(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per run of rows their ids, one after the other, and the rows' offsets in these."""
        for data, at in chunks(column, CHUNK):
            whole = data.tobytes()
            if not any(s in whole for s in self.special):
                yield self._encode(data, at)
                continue
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                if any(s in whole[lo:hi] for s in self.special):
                    ids = self.tokenizer.encode(whole[lo:hi].decode(), add_special_tokens=False).ids
                    found = np.concatenate([np.array(ids, np.uint32), self.end])
                    yield found, np.array([0, len(found)])
                else:
                    yield self._encode(data[lo:hi], np.array([0, hi - lo]))

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        for ids, at in self.ids(pa.array(list(texts), pa.string())):
            data = ids.astype("<u4").tobytes()
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                yield data[4 * lo:4 * hi]


_OWN: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None = None) -> Encoder:
    """This process's encoder. Its memo stays for the worker's next tasks, whose texts have
    most of their words in common with those before."""
    if (path, end_id) not in _OWN:
        _OWN.clear()
        _OWN[path, end_id] = Encoder(path, end_id)
    return _OWN[path, end_id]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    """Batches in smaller pieces, so that few texts are encoded at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
