"""Streams give what the batch operators give, however the input is cut."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from attesta.operators import citations as C
from attesta.streaming import ingest as I
from attesta.streaming import live as L
from attesta.streaming import markers as M
from attesta.streaming import turns as U
from attesta.streaming.runtime import drain

TEXT = "가나다[S2] 라마바[S1]. 사아자[S99] 차카타[S3]! arr[S] [S[S1] 끝[S"
DELTA = "message_id long, seq long, delta string, final boolean, offered array<int>"


def plain_stream(pieces, offered):
    held, index, shown, cited, rejected = "", {}, [], [], []
    for i, piece in enumerate(pieces):
        ready, held = M.settle(held + piece, i == len(pieces) - 1)
        text, new, bad = M.rewrite(ready, offered, index)
        shown.append(text)
        cited += new
        rejected += bad
    return shown, cited, rejected


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 6, 7, 11, 50])
def test_any_cut_gives_the_same_text(size):
    whole = plain_stream([TEXT], {1, 2, 3})
    parts = plain_stream([TEXT[i:i + size] for i in range(0, len(TEXT), size)], {1, 2, 3})
    assert ("".join(parts[0]), *parts[1:]) == ("".join(whole[0]), *whole[1:])
    assert whole[0][0] == "가나다[[cite:1]] 라마바[[cite:2]]. 사아자 차카타[[cite:3]]! arr[S] [S[[cite:2]] 끝[S"


def test_a_marker_is_never_shown_half_and_cited_when_it_closes():
    shown, cited, _ = plain_stream(["지급조건은 ", "30일", "[S", "1", "]", " 이다."], {1})
    assert shown == ["지급조건은 ", "30일", "", "", "[[cite:1]]", " 이다."] and cited == [1]


def test_stream_over_many_batches_in_wrong_order_equals_the_batch_parse(spark, tmp_path):
    rng = random.Random(2)
    texts = {m: "".join(rng.choices(["[S1]", "[S2]", "[S77]", "[S", "1]", "가 ", "x", "[["], k=25)) for m in range(6)}
    rows = []
    for m, text in texts.items():
        cuts = sorted(rng.sample(range(1, len(text)), 8))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]
        rows += [(m, i, p, i == len(parts) - 1, [1, 2]) for i, p in enumerate(parts)]
    rng.shuffle(rows)
    for n in range(4):
        spark.createDataFrame(rows[n::4], DELTA).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = (spark.readStream.schema(DELTA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
              .parquet(str(tmp_path / "in")))
    out = drain(M.stream_markers(stream, idle_ms=0), "test-markers")
    got = {}
    for r in out.orderBy("message_id", "seq").collect():
        body, cited, rejected = got.get(r.message_id, ("", [], []))
        got[r.message_id] = (body + r.text, cited + r.cited, rejected + r.rejected)
    parsed = C.parse_markers(spark.createDataFrame(list(texts.items()), "message_id long, raw string"),
                             spark.createDataFrame([(m, s) for m in texts for s in (1, 2)], "message_id long, sid long"))
    assert got == {r.message_id: (r.body, r.cited, r.rejected) for r in parsed.collect()}


EVENTS = [(1, 0, "token", '{"text": "가"}'), (1, 1, "citation", '{"idx": 1, "sid": 4}'), (1, 2, "token", '{"text": "나"}'),
          (1, 3, "revision", '{"text": "다", "citations": [{"idx": 2, "sid": 5}]}'), (1, 4, "token", '{"text": "라"}'),
          (1, 5, "done", '{"rejected": [9], "run_id": "r1"}'), (2, 0, "step", '{"ord": 1, "node": "plan", "label": "p"}'),
          (2, 1, "token", '{"text": "x"}'), (2, 2, "error", '{"message": "lost"}'), (3, 0, "token", '{"text": "unfinished"}'),
          (4, 0, "token", "not json"), (4, 1, "revision", "{}"), (4, 2, "done", None)]
EVENT = "message_id long, seq long, event string, data string"


@pytest.mark.parametrize("seed", range(2))
def test_turns_fold_alike_in_batch_and_stream(spark, tmp_path, seed):
    df = spark.createDataFrame(EVENTS, EVENT)
    messages, cited, steps = U.fold_turn(df)
    batch = {r.message_id: (r.content, r.status, r.error, r.rejected) for r in messages.collect()}
    assert batch == {1: ("다라", "complete", None, [9]), 2: ("x", "failed", "lost", []),
                     3: ("unfinished", "complete", None, []), 4: ("", "complete", None, [])}
    # any order, and every third event once more in a later batch
    rng = random.Random(seed)
    rows = EVENTS + EVENTS[::3]
    rng.shuffle(rows)
    for n in range(5):
        spark.createDataFrame(rows[n::5], EVENT).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = (spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
              .parquet(str(tmp_path / "in")))
    U.persist_turns(U.stream_turns(stream, 0, 0), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name)).drop("batch")
    got = {r.message_id: (r.content, r.status, r.error, r.rejected) for r in read("messages").collect()}
    assert got == {m: t for m, t in batch.items() if m != 3} and read("messages").count() == 3
    assert sorted(map(tuple, read("citations").collect())) == sorted(map(tuple, cited.collect()))
    assert sorted(map(tuple, read("steps").collect())) == sorted(map(tuple, steps.collect()))
    assert [tuple(r) for r in read("runs").collect()] == [("r1", 1, "complete", None, [9])]


class _Store:
    """The state variables of one key, kept in dictionaries."""

    def __init__(self):
        self.value, self.map, self.timers = None, {}, []

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, key, value):
        return _Map(self.map)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        return iter(list(self.timers))

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


class _Map:
    def __init__(self, held):
        self.held = held

    def iterator(self):
        return iter(list(self.held.items()))

    def updateValue(self, key, value):
        self.held[key] = value

    def clear(self):
        self.held.clear()


class _Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def test_an_idle_turn_fails_once_and_its_tombstone_goes():
    store, turn = _Store(), U.TurnProcessor(100, 1000)
    turn.init(store)
    frame = lambda *rows: iter([pd.DataFrame(rows, columns=["seq", "event", "data"])])
    feed = lambda at, *rows: list(turn.handleInputRows((7,), frame(*rows), _Clock(at)))
    assert feed(0, (0, "token", '{"text": "a"}'), (3, "citation", '{"idx": 1, "sid": 2}')) == []
    assert store.timers == [100] and len(store.map) == 1
    (out,) = turn.handleExpiredTimer(key=(7,), timerValues=_Clock(120), expiredTimerInfo=None)
    assert out[["kind", "content", "status", "error", "sid"]].astype(object).where(out.notna(), None).values.tolist() == [
        ["citation", None, None, None, 2], ["message", "a", "failed", "interrupted", None]]
    assert feed(200, (1, "token", '{"text": "late"}')) == [] and not store.map
    assert store.timers[-1] == 1200
    assert list(turn.handleExpiredTimer(key=(7,), timerValues=_Clock(1200), expiredTimerInfo=None)) == [] and store.value is None


def test_a_silent_answer_is_flushed_by_its_timer():
    store, answer = _Store(), M.MarkerProcessor(100)
    answer.init(store)
    rows = pd.DataFrame([(0, "a[S1", False, [1]), (2, "c", False, [1])], columns=["seq", "delta", "final", "offered"])
    (out,) = answer.handleInputRows((7,), iter([rows]), _Clock(0))
    assert out["text"].tolist() == ["a"] and store.timers == [100]
    (out,) = answer.handleExpiredTimer(key=(7,), timerValues=_Clock(100), expiredTimerInfo=None)
    assert out["text"].tolist() == ["[S1c"] and store.value is None


class _Watermark:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def test_many_viewers_share_a_value_and_a_timer():
    rng = random.Random(5)
    store, group, updates = _Store(), L.PresenceProcessor(100), []
    group.init(store)
    keep = store.update
    store.update = lambda value: (updates.append(value), keep(value))
    last, want, got, wm = {}, [], [], 0
    for batch in range(6):
        beats = [(rng.choice("ab"), rng.randrange(200), wm + rng.randrange(400)) for _ in range(500)] if batch < 5 else [("a", 0, wm + 5000)]
        frames = [pd.DataFrame(beats[i:i + 90], columns=["channel", "user_id", "ms"]) for i in range(0, len(beats), 90)]
        for f in group.handleInputRows((3,), iter(frames), _Watermark(wm)):
            got += f.itertuples(index=False, name=None)
        for c, u, ms in sorted(beats, key=lambda b: b[2]):
            before = last.get((c, u))
            if before is None or ms - before >= 100:
                want += [] if before is None else [(c, u, "left", before + 100)]
                want.append((c, u, "joined", ms))
            last[c, u] = max(ms, before or 0)
        wm = max(b[2] for b in beats)
        if store.timers and min(store.timers) < wm:
            store.timers.clear()  # as Spark does with what is due
            for f in group.handleExpiredTimer((3,), _Watermark(wm), None):
                got += f.itertuples(index=False, name=None)
        for viewer in [v for v, ms in last.items() if ms + 100 < wm]:
            want.append((*viewer, "left", last.pop(viewer) + 100))
        assert len(store.timers) == 1 and len(updates) <= 2 * (batch + 1)
    assert sorted(got) == sorted(want) and len(want) > 1000
    assert list(last) == [("a", 0)]


def test_sessions_close_after_the_watermark(spark, tmp_path):
    schema = "channel string, user_id long, ts timestamp"
    beats = spark.sql("""SELECT 'c' AS channel, 1L AS user_id, timestamp_seconds(s) AS ts
        FROM VALUES (0), (10), (20), (100), (110), (5000) t(s)""")
    beats.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    out = drain(L.sessions(stream, "30 seconds", lateness="1 minute"), "test-beats")
    assert sorted(r.beats for r in out.collect()) == [2, 3]


def _batches(spark, path, rows, schema):
    """A stream of one file a batch, its name in order of time."""
    for n, part in enumerate(rows):
        spark.createDataFrame(part, "s long, " + schema).withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000)).drop("s").coalesce(1).write.parquet(
            f"{path}/{n}")
    shape = spark.read.parquet(f"{path}/0").schema
    return (spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path)))


def test_viewers_come_and_go_and_state_falls(spark, tmp_path):
    beats = [[(0, "c", 1), (10, "c", 1), (5, "c", 2)], [(25, "c", 1), (26, "d", 1), (24, "c", 1)],
             [(300, "c", 2)], [(310, "c", 2), (301, "c", 3), (400, "c", 3)], [(900, "e", 9)]]
    stream = _batches(spark, tmp_path / "in", beats, "channel string, user_id long")
    query = (L.stream_presence(stream, 30_000).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    got = sorted((r.channel, r.user_id, r.ms // 1000 - 1_000_000, r.event) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("c", 1, 0, "joined"), ("c", 1, 55, "left"), ("c", 2, 5, "joined"), ("c", 2, 35, "left"),
                   ("c", 2, 300, "joined"), ("c", 2, 340, "left"), ("c", 3, 301, "joined"), ("c", 3, 331, "left"),
                   ("c", 3, 400, "joined"), ("c", 3, 430, "left"), ("d", 1, 26, "joined"), ("d", 1, 56, "left"),
                   ("e", 9, 900, "joined")]
    held = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert max(held) > held[-1] and held[-1] <= 2  # the last viewer and their timer


def test_progress_keeps_the_latest_and_forgets_quiet_documents(spark, tmp_path):
    news = [[(0, 1, "queued", 0, 9), (5, 1, "busy", 3, 9), (4, 2, "queued", 0, 5)], [(3, 1, "old", 1, 9), (5, 1, "busy", 4, 9)],
            [(5, 1, "busy", 4, 9), (6, 2, "done", 5, 5)], [(9000, 3, "queued", 0, 1)]]
    stream = _batches(spark, tmp_path / "in", news, "document_id long, status string, done long, total long")
    query = (L.stream_progress(stream, 60_000).writeStream.format("parquet").option("path", str(tmp_path / "out"))
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    said = {(r.document_id, r.ms // 1000 - 1_000_000, r.status, r.done) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert said == {(1, 5, "busy", 3), (2, 4, "queued", 0), (1, 5, "busy", 4), (2, 6, "done", 5), (3, 9000, "queued", 0)}
    held = [op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]]
    assert max(held) > held[-1] and held[-1] <= 2


def test_ingest_is_idempotent_over_batches_restarts_and_replays(spark, tmp_path):
    schema = "file_id long, filename string, mime string, size_bytes long, content string, arrival long"
    first = [(1, "a.pdf", None, 3, "aaa", 2), (2, "b.txt", None, 3, "aaa", 1), (3, "c.exe.unknown", None, 1, "z", 3)]
    later = [(4, "d.md", None, 3, "aaa", 0), (5, "e.md", None, 3, "bbb", 5), (6, "f.md", None, 9 << 20, "huge", 6)]
    last = [(7, "g.md", None, 3, "bbb", 7), (8, "h.md", None, 3, "ccc", 8)]
    catalog, state = str(tmp_path / "catalog"), tmp_path / "state"

    def arrive(n, rows):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        files = (spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1)
                 .parquet(str(tmp_path / "in")))
        I.incremental_ingest(files, catalog, str(state), max_mb=1).awaitTermination()
        return [(r.document_id, r.source_kind, r.batch) for r in I.read_catalog(spark, catalog).orderBy("document_id").collect()]

    assert arrive(0, first) == [(2, "text", 0)]
    assert arrive(1, later) == [(2, "text", 0), (5, "text", 1)]
    # the last batch was written but not committed: it runs again, over the state before it
    for name in ("1", ".1.crc"):
        (state / "commits" / name).unlink(missing_ok=True)
    assert arrive(1, None) == [(2, "text", 0), (5, "text", 1)]
    assert arrive(2, last) == [(2, "text", 0), (5, "text", 1), (8, "text", 2)]
    refused = spark.read.parquet(I.rejects_path(catalog)).orderBy("file_id").collect()
    assert [(r.file_id, r.reason, r.batch) for r in refused] == [(3, "unsupported file type", 0), (6, "too large", 1)]
    whole = I.read_catalog(spark, catalog).orderBy("document_id").collect()
    I.compact_catalog(spark, catalog)
    assert I._base(spark, catalog) == 1 and I.read_catalog(spark, catalog).orderBy("document_id").collect() == whole
    I.compact_catalog(spark, catalog)
    assert arrive(3, [(9, "i.md", None, 3, "ccc", 9), (10, "j.md", None, 3, "ddd", 10)])[-1] == (10, "text", 3)
