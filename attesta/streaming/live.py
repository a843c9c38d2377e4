"""Progress, presence and event routing, on tables and on streams.

State of a stream is bounded by who is there: a viewer or document that has been silent for
its time to live is dropped by an event-time timer, which for viewers says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from attesta.streaming.runtime import carry_code, use_rocksdb

PRESENCE_TTL = "30 seconds"  # fixed value
PRESENCE_TTL_MS = 30_000     # the same
PRESENCE_GROUPS = 256        # keys that hold the viewers of a stream
PROGRESS_TTL_MS = 86_400_000
ENVELOPE = "event string, data string"


def document_progress(events: DataFrame) -> DataFrame:
    """Latest status and progress per document; in a stream use update mode.

    ``events``: document_id, ts, status, done, total. ``max_by`` combines map-side.
    """
    return events.groupBy("document_id").agg(
        F.max_by(F.struct("status", "done", "total"), F.struct("ts", "done")).alias("__l"),
        F.max("ts").alias("ts")).select("document_id", "ts", "__l.status", "__l.done", "__l.total")


def sessions(beats: DataFrame, ttl: str = PRESENCE_TTL, lateness: str | None = None) -> DataFrame:
    """Stays of a viewer in a channel: beats closer than ``ttl`` belong together.

    Give ``lateness`` on a stream to bound its state.
    """
    if lateness is not None:
        beats = beats.withWatermark("ts", lateness)
    stay = F.session_window("ts", ttl)
    return (beats.groupBy("channel", "user_id", stay.alias("stay")).agg(F.count("*").alias("beats"))
            .select("channel", "user_id", F.col("stay.start").alias("start"), F.col("stay.end").alias("end"), "beats"))


def viewers(beats: DataFrame, now: Column, ttl: str = PRESENCE_TTL) -> DataFrame:
    """Who is watching at ``now``: last beat within ``ttl``."""
    last = beats.groupBy("channel", "user_id").agg(F.max("ts").alias("last_beat"))
    return last.filter(F.col("last_beat") > now - F.expr(f"INTERVAL {ttl}"))


def route_events(messages: DataFrame, keys: list[str]) -> DataFrame:
    """Well-formed events of the subscribed keys; malformed payloads are dropped.

    ``messages``: key, value (JSON text with ``event`` and ``data``).
    """
    valid = messages.filter(F.col("key").isin(keys)).withColumn("__v", F.try_parse_json("value"))
    return (valid.filter("__v IS NOT NULL")
            .select(*[c for c in messages.columns if c != "value"],
                    F.get_json_object("value", "$.event").alias("event"),
                    F.get_json_object("value", "$.data").alias("data")))


def channel_key(channel: Column) -> Column:
    return F.concat(F.lit("channel:"), channel.cast("string"))


class _Expiring(StatefulProcessor):
    """A key's state with one event-time timer, moved on whenever the key is heard of."""

    def __init__(self, ttl_ms: int) -> None:
        self.ttl_ms = ttl_ms

    def keep_until(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def _stays(found: pd.DataFrame, ttl_ms: int) -> pd.DataFrame:
    """Joins the (channel, user_id, start, end, held) of a viewer that are closer than the time
    to live; sorted by viewer and time. Spans may overlap and come in any order."""
    by = found.sort_values(["channel", "user_id", "start"], kind="stable", ignore_index=True)
    first = ~by.duplicated(["channel", "user_id"]).to_numpy()
    reach = by.groupby(np.cumsum(first))["end"].cummax().to_numpy()
    start = by["start"].to_numpy()
    opens = first.copy()
    opens[1:] |= start[1:] - reach[:-1] >= ttl_ms
    at = np.flatnonzero(opens)
    end = np.maximum.reduceat(by["end"].to_numpy(), at)
    held = np.logical_or.reduceat(by["held"].to_numpy(), at)
    return by.iloc[at].assign(end=end, held=held).reset_index(drop=True)


class PresenceProcessor(_Expiring):
    """A group of viewers: the last beat of everyone who is there, as one value, and one timer
    for the first of them to be missed."""

    HELD = pa.schema([("channel", pa.string()), ("user_id", pa.int64()), ("end", pa.int64())])

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("viewers", "timer long, held binary")

    def load(self) -> tuple[int | None, pd.DataFrame | None]:
        if not self.state.exists():
            return None, None
        timer, held = self.state.get()
        return timer, pa.ipc.read_record_batch(pa.py_buffer(bytes(held)), self.HELD).to_pandas()

    def keep(self, timer: int | None, there: pd.DataFrame) -> None:
        """An earlier timer is left as it is: when it is due, the next one is set."""
        due = int(there["end"].min()) + self.ttl_ms
        if timer is None or due < timer:
            self.handle.registerTimer(due)
            timer = due
        held = pa.RecordBatch.from_pandas(there, self.HELD, preserve_index=False)
        self.state.update((timer, held.serialize().to_pybytes()))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        timer, there = self.load()
        found = [] if there is None else [there.assign(start=there["end"], held=True)]
        for frame in rows:  # beats become stays at once, and stays are joined before they pile up
            beats = pd.DataFrame({"channel": frame["channel"], "user_id": frame["user_id"], "start": frame["ms"],
                                  "end": frame["ms"], "held": False})
            found.append(_stays(beats, self.ttl_ms))
            if len(found) > 64:
                found = [_stays(pd.concat(found, ignore_index=True), self.ttl_ms)]
        stays = _stays(pd.concat(found, ignore_index=True), self.ttl_ms)
        last = ~stays.duplicated(["channel", "user_id"], keep="last")
        self.keep(timer, stays[last])
        yield pd.concat([self._left(stays[~last]), self._said(stays[~stays["held"]], "joined", "start")], ignore_index=True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, there = self.load()
        if there is None:
            yield pd.DataFrame([], columns=["channel", "user_id", "event", "ms"])
            return
        gone = there["end"] + self.ttl_ms < timerValues.getCurrentWatermarkInMs()
        if gone.all():
            self.state.clear()
        else:
            self.keep(None, there[~gone])
        yield self._left(there[gone])

    def _left(self, stays: pd.DataFrame) -> pd.DataFrame:
        return self._said(stays.assign(gone=stays["end"] + self.ttl_ms), "left", "gone")

    @staticmethod
    def _said(stays: pd.DataFrame, event: str, at: str) -> pd.DataFrame:
        return stays[["channel", "user_id", at]].rename(columns={at: "ms"}).assign(event=event)[["channel", "user_id", "event", "ms"]]


def stream_presence(beats: DataFrame, ttl_ms: int = PRESENCE_TTL_MS, lateness: str = "0 seconds",
                    groups: int = PRESENCE_GROUPS) -> DataFrame:
    """(channel, user_id, event, ms) with event ``joined`` or ``left``, from a stream of beats
    (channel, user_id, ts).

    A viewer has left ``ttl_ms`` after the last beat, as soon as the watermark passes that
    time; from then on the stream holds nothing about them. Viewers share the state of
    ``groups`` keys, so that calls to the store don't grow with them; a checkpoint belongs to
    one number of groups.
    """
    use_rocksdb(beats.sparkSession)
    carry_code(__name__)
    group = F.pmod(F.xxhash64("channel", "user_id"), F.lit(groups)).alias("__group")
    timed = beats.select("channel", "user_id", "ts", F.unix_millis("ts").alias("ms"), group).withWatermark("ts", lateness)
    return timed.groupBy("__group").transformWithStateInPandas(
        PresenceProcessor(ttl_ms), "channel string, user_id long, event string, ms long", "append", "EventTime")


class ProgressProcessor(_Expiring):
    """The latest news of one document."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("latest", "ms long, done long, status string, total long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.state.get()) if self.state.exists() else None
        best = held
        for frame in rows:
            for row in frame[["ms", "done", "status", "total"]].itertuples(index=False, name=None):
                if best is None or row[:2] > best[:2]:
                    best = row
        if best != held:
            ms, done, status, total = best
            self.state.update((int(ms), int(done), status, int(total)))
            self.keep_until(int(ms) + self.ttl_ms)
            yield pd.DataFrame([(int(key[0]), int(ms), status, int(done), int(total))],
                               columns=["document_id", "ms", "status", "done", "total"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame([], columns=["document_id", "ms", "status", "done", "total"])


def stream_progress(events: DataFrame, ttl_ms: int = PROGRESS_TTL_MS, lateness: str = "1 minute") -> DataFrame:
    """(document_id, ms, status, done, total) whenever a document's latest news changes.

    ``events`` (streaming): document_id, ts, status, done, total. Later news win, among equal
    times the larger ``done``; repeated and older events say nothing. A document is forgotten
    once the watermark is ``ttl_ms`` past its latest news.
    """
    use_rocksdb(events.sparkSession)
    carry_code(__name__)
    timed = events.select("document_id", "ts", F.unix_millis("ts").alias("ms"), "status", "done", "total")
    return timed.withWatermark("ts", lateness).groupBy("document_id").transformWithStateInPandas(
        ProgressProcessor(ttl_ms), "document_id long, ms long, status string, done long, total long", "append", "EventTime")
