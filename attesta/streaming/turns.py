"""Folding the event stream of an answer into the stored message."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from attesta.streaming.runtime import carry_code, use_rocksdb

DATA = ("struct<text:string,idx:bigint,sid:bigint,citations:array<struct<idx:bigint,sid:bigint>>,"
        "node:string,label:string,ord:bigint,rejected:array<bigint>,message:string>")


def parse_events(events: DataFrame) -> DataFrame:
    """(message_id, seq, event, d) from (message_id, seq, event, data)."""
    return events.select("message_id", "seq", "event", F.from_json("data", DATA).alias("d"))


def fold_turn(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(messages, citations, steps).

    A revision with a text replaces everything said before it; tokens after it follow on. The
    last ``done`` gives the rejected markers, an ``error`` fails the turn.
    """
    e = parse_events(events)
    cutoff = (e.filter("event = 'revision' AND d.text IS NOT NULL").groupBy("message_id")
              .agg(F.max("seq").alias("__from"), F.max_by("d.text", "seq").alias("__base")))
    words = (e.filter("event = 'token'").join(cutoff.select("message_id", "__from"), "message_id", "left")
             .filter(F.col("__from").isNull() | (F.col("seq") > F.col("__from"))))
    said = words.groupBy("message_id").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("seq", F.coalesce("d.text", F.lit("")).alias("t")))),
        lambda r: r["t"]), "").alias("__said"))
    ends = e.groupBy("message_id").agg(
        F.max_by("d.rejected", F.when(F.col("event") == "done", F.col("seq"))).alias("rejected"),
        F.max_by("d.message", F.when(F.col("event") == "error", F.col("seq"))).alias("error"),
        F.bool_or(F.col("event") == "error").alias("__failed"))
    messages = (ends.join(cutoff, "message_id", "left").join(said, "message_id", "left")
                .select("message_id", F.concat(F.coalesce("__base", F.lit("")), F.coalesce("__said", F.lit("")))
                        .alias("content"),
                        F.when(F.col("__failed"), "failed").otherwise("complete").alias("status"),
                        "error", F.coalesce("rejected", F.array().cast("array<bigint>")).alias("rejected")))
    cited = e.filter("event = 'citation'").select("message_id", "d.idx", "d.sid")
    added = (e.filter("event = 'revision'").select("message_id", F.explode("d.citations").alias("c"))
             .select("message_id", "c.idx", "c.sid"))
    steps = e.filter("event = 'step'").select("message_id", "d.ord", "d.node", "d.label")
    return messages, cited.unionByName(added), steps


OUTPUT = ("message_id long, kind string, ord long, content string, status string, error string, run_id string, "
          "rejected array<bigint>, idx long, sid long, node string, label string")
COLUMNS = [field.split()[0] for field in OUTPUT.split(", ")]

IDLE_MS = 600_000     # a turn that falls silent for so long is given up
KEEP_MS = 3_600_000   # a finished turn is remembered for so long, so that replays are known


class TurnProcessor(StatefulProcessor):
    """One turn. Events are numbered from 0 without gaps and take effect in that order,
    whichever micro-batch brings them; early ones wait in a map, repeats are dropped. The
    first ``done`` or ``error`` ends the turn and leaves a tombstone until its timer."""

    def __init__(self, idle_ms: int, keep_ms: int) -> None:
        self.idle_ms, self.keep_ms = idle_ms, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "next long, content string, waiting long, ended boolean")
        self.early = handle.getMapState("early", "seq long", "event string, data string")

    def _load(self) -> tuple[int, str, int, bool]:
        if not self.state.exists():
            return 0, "", 0, False
        nxt, content, waiting, ended = self.state.get()
        return int(nxt), content, int(waiting), bool(ended)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        nxt, content, waiting, ended = self._load()
        here = {}
        for frame in rows:
            if not ended:
                here.update((s, (e, d)) for s, e, d in zip(frame["seq"].tolist(), frame["event"].tolist(), frame["data"].tolist())
                            if s >= nxt)
        if not ended:
            if waiting:
                for (seq,), event in list(self.early.iterator()):
                    here.setdefault(int(seq), tuple(event))
            out, nxt, content, ended = self._advance(int(key[0]), here, nxt, content)
            if waiting:
                self.early.clear()
            if not ended:
                for seq, event in here.items():
                    self.early.updateValue((seq,), event)
            self.state.update((nxt, "" if ended else content, 0 if ended else len(here), ended))
            if out:
                yield pd.DataFrame(out, columns=COLUMNS)
        wait = self.keep_ms if ended else self.idle_ms
        if wait:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        nxt, content, waiting, ended = self._load()
        if not ended:
            # what has come is stored in its order, over the gaps, and the turn has failed
            left = sorted((int(seq), tuple(event)) for (seq,), event in list(self.early.iterator())) if waiting else []
            packed = {nxt + i: event for i, (_, event) in enumerate(left)}
            out, nxt, content, ended = self._advance(int(key[0]), packed, nxt, content)
            if not ended:
                out.append(_row(int(key[0]), "message", content=content, status="failed", error="interrupted", rejected=[]))
            self.early.clear()
            self.state.update((nxt, "", 0, True))
            if self.keep_ms:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
            yield pd.DataFrame(out, columns=COLUMNS)
        else:
            self.state.clear()

    @staticmethod
    def _advance(key: int, here: dict, nxt: int, content: str):
        """Rows of the events that are next in turn, which leave ``here``."""
        out, ended = [], False
        while not ended and nxt in here:
            event, data = here.pop(nxt)
            nxt += 1
            d = _fields(data)
            if event == "token":
                content += d.get("text") or ""
            elif event == "citation":
                out.append(_row(key, "citation", ord=nxt - 1, idx=d.get("idx"), sid=d.get("sid")))
            elif event == "revision":
                content = d["text"] if d.get("text") is not None else content
                out += [_row(key, "citation", ord=nxt - 1, idx=c.get("idx"), sid=c.get("sid")) for c in d.get("citations") or []]
            elif event == "step":
                out.append(_row(key, "step", ord=d.get("ord"), node=d.get("node"), label=d.get("label")))
            elif event in ("done", "error"):
                failed, ended = event == "error", True
                out.append(_row(key, "message", content=content, status="failed" if failed else "complete",
                                error=d.get("message") if failed else None, run_id=d.get("run_id"),
                                rejected=[] if failed else d.get("rejected") or []))
        return out, nxt, content, ended

    def close(self) -> None:
        pass


def _fields(data: str | None) -> dict:
    try:
        found = json.loads(data or "{}")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _row(key: int, kind: str, **values) -> tuple:
    return tuple({"message_id": key, "kind": kind, **values}.get(c) for c in COLUMNS)


def stream_turns(events: DataFrame, idle_ms: int = IDLE_MS, keep_ms: int = KEEP_MS) -> DataFrame:
    """Rows of turns as they happen: citations and steps when it is their turn, the message
    when it ends. ``events`` (streaming): message_id, seq, event, data.

    Concatenated over all batches it is what ``fold_turn`` gives for the whole, whatever the
    order of arrival and however often events are repeated. An unfinished turn that is idle
    for ``idle_ms`` fails with what it has. 0 switches a timer off.
    """
    use_rocksdb(events.sparkSession)
    carry_code(__name__)
    return (events.select("message_id", "seq", "event", "data").groupBy("message_id").transformWithStateInPandas(
        TurnProcessor(idle_ms, keep_ms), OUTPUT, "append", "ProcessingTime" if idle_ms or keep_ms else "None"))


def turn_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables that rows of turns belong to: messages, runs (of turns that name one),
    citations and steps."""
    message = rows.filter("kind = 'message'")
    return {
        "messages": message.select("message_id", "content", "status", "error", "rejected"),
        "runs": message.filter("run_id IS NOT NULL").select(
            "run_id", "message_id", "status", "error", F.when(F.size("rejected") > 0, F.col("rejected")).alias("rejected")),
        "citations": rows.filter("kind = 'citation'").select("message_id", "idx", "sid"),
        "steps": rows.filter("kind = 'step'").select("message_id", "ord", "node", "label")}


def persist_turns(rows: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write the tables of a stream of turns below ``target``. A batch owns one partition of
    each table, so a batch that is run again overwrites its own rows."""
    def write(batch_rows: DataFrame, batch: int) -> None:
        batch_rows.persist()
        for name, table in turn_tables(batch_rows).items():
            (table.withColumn("batch", F.lit(batch).cast("bigint")).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{target}/{name}"))
        batch_rows.unpersist()

    return (rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
