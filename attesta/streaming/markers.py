"""Citation markers in a stream of text pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from attesta.streaming.runtime import carry_code, use_rocksdb

# Fixed values.
MARKER = re.compile(r"\[S(\d{1,3})\]")
UNFINISHED = re.compile(r"\[S?\d{0,3}$")
LONGEST_UNFINISHED = 5

OUTPUT = "message_id long, seq long, text string, cited array<int>, rejected array<int>"


#: an answer that falls silent for so long is flushed and forgotten
IDLE_MS = 600_000


def settle(text: str, final: bool) -> tuple[str, str]:
    """(text that is decided, tail that may still become a marker)."""
    if final:
        return text, ""
    tail = UNFINISHED.search(text[-LONGEST_UNFINISHED:])
    at = len(text) - len(tail.group()) if tail else len(text)
    return text[:at], text[at:]


def rewrite(text: str, offered: set[int], index: dict[int, int]) -> tuple[str, list[int], list[int]]:
    """(text with citation tokens, newly cited, rejected); extends ``index``."""
    fresh: list[int] = []
    unknown: list[int] = []

    def token(match: re.Match) -> str:
        sid = int(match.group(1))
        if sid not in offered:
            unknown.append(sid)
            return ""
        if sid not in index:
            index[sid] = len(index) + 1
            fresh.append(sid)
        return f"[[cite:{index[sid]}]]"

    return MARKER.sub(token, text), fresh, unknown


class MarkerProcessor(StatefulProcessor):
    """One answer: the undecided tail, the citation numbers, and pieces come too early.

    Pieces are numbered from 0 without gaps and processed in that order whichever
    micro-batch brings them. A turn that falls silent is flushed as if it had ended.
    """

    def __init__(self, idle_ms: int = IDLE_MS) -> None:
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState(
            "state", "next long, held string, cited array<int>, offered array<int>, waiting long")
        self.early = handle.getMapState("early", "seq long", "delta string, final boolean")

    def _load(self):
        if not self.state.exists():
            return 0, "", [], [], 0
        nxt, held, cited, offered, waiting = self.state.get()
        return int(nxt), held, list(cited), list(offered), int(waiting)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        nxt, held, cited, offered, waiting = self._load()
        here: dict[int, tuple[str, bool]] = {}
        for frame in rows:
            if len(frame) and not offered:
                offered = [int(s) for s in frame["offered"].iloc[0]]
            here.update((s, (d, f)) for s, d, f in zip(
                frame["seq"].tolist(), frame["delta"].tolist(), frame["final"].tolist()) if s >= nxt)
        yield from self._advance(key, nxt, held, cited, offered, waiting, here, flush=False)
        if self.idle_ms and self.state.exists():
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, *self._load(), {}, flush=True)

    def _advance(self, key, nxt, held, cited, offered, waiting, here, flush):
        """Work through the pieces that are next in turn; the stored early ones join
        those of this batch, and what still has to wait goes back to the store."""
        index = {sid: i for i, sid in enumerate(cited, 1)}
        known, done, out = set(offered), False, []
        if waiting:
            for (seq,), piece in list(self.early.iterator()):
                here.setdefault(int(seq), (piece[0], bool(piece[1])))
        while not done and nxt in here:
            delta, done = here.pop(nxt)
            ready, held = settle(held + delta, done)
            out.append((int(key[0]), nxt, *rewrite(ready, known, index)))
            nxt += 1
        if flush and not done:
            tail = held + "".join(here[seq][0] for seq in sorted(here))
            out.append((int(key[0]), nxt, *rewrite(tail, known, index)))
            done = True
        if waiting:
            self.early.clear()
        if done:
            self.state.clear()
        else:
            for seq, piece in here.items():
                self.early.updateValue((seq,), piece)
            self.state.update((nxt, held, list(index), offered, len(here)))
        if out:
            yield pd.DataFrame(out, columns=["message_id", "seq", "text", "cited", "rejected"])

    def close(self) -> None:
        pass


def stream_markers(deltas: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """Rewritten text of every piece as soon as it is decided.

    ``deltas`` (streaming): message_id, seq, delta, final, offered (the source numbers
    given to that answer). Concatenating ``text`` by ``seq`` gives exactly what parsing
    the whole answer gives, however it was cut.
    """
    use_rocksdb(deltas.sparkSession)
    carry_code(__name__)
    return deltas.groupBy("message_id").transformWithStateInPandas(
        MarkerProcessor(idle_ms), OUTPUT, "append", "ProcessingTime" if idle_ms else "None")
