"""Routing, ledgers and keyed replacement."""

import pytest

from attesta.sources import files as S
from attesta.sources import ledger as L
from attesta.sources.segments import read_segments


@pytest.mark.parametrize("name,mime,kind", [
    ("a.PDF", None, "pdf"), ("보고서.hwpx", None, "hwp"), ("x.tar.docx", None, "office"), ("noext", "audio/mpeg", "audio"),
    ("noext", "application/pdf", "pdf"), ("page.html", None, "text"), ("pic.svg", "", "image"), ("x.zip", None, None),
    (".pdf", None, None), ("a..png", None, "image"), ("x.bin", "text/plain; charset=utf-8", "text")])
def test_classification(spark, name, mime, kind):
    df = spark.createDataFrame([(name, mime)], "filename string, mime string")
    assert S.classify_source(df).first().source_kind == kind


def test_files_are_read_from_a_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_bytes(b"hello")
    row = S.with_hash(S.read_files(spark, str(tmp_path))).first()
    assert (row.filename, row.size_bytes) == ("a.txt", 5)
    assert row.sha256 == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    key = S.read_files(spark, str(tmp_path)).transform(S.with_hash).select(S.shard_key("originals", "sha256", ".txt")).first()[0]
    assert key == f"originals/2c/f2/{row.sha256}.txt"


def test_segments_and_silent_recordings(spark):
    df = spark.createDataFrame([(1, '{"segments":[{"start":0.5,"end":1.25,"text":" 안녕 "},{"start":2,"end":3,"text":" "},'
                                    '{"start":3,"end":4.0015,"text":"끝"}]}'), (2, '{"segments":[]}'), (3, "broken")],
                               "document_id long, json string")
    good, bad = read_segments(df)
    assert [(r.reading_order, r.text, r.start_ms, r.end_ms) for r in good.orderBy("reading_order").collect()] == [
        (0, "안녕", 500, 1250), (1, "끝", 3000, 4001)]
    assert sorted(r.document_id for r in bad.collect()) == [2, 3]


def test_writing_by_key_replaces_only_those_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(r, "k long, v string")
    L.write_replacing(rows((1, "a"), (1, "b"), (2, "c"), (3, "d")), path, "k", 2)
    for _ in range(2):
        L.write_replacing(rows((1, "z"), (4, "n")), path, "k", 2)
    got = sorted((r.k, r.v) for r in spark.read.parquet(path).collect())
    assert got == [(1, "z"), (2, "c"), (3, "d"), (4, "n")]


def test_a_failed_stage_blocks_the_later_ones(spark):
    docs = spark.createDataFrame([(1,), (2,)], "document_id long")
    jobs = spark.createDataFrame([(1, "convert", "done"), (1, "extract", "failed"), (1, "chunk", "done")],
                                 "document_id long, stage string, status string")
    got = L.outstanding_stages(docs, jobs).filter("is_next").collect()
    assert {r.document_id: r.stage for r in got} == {1: "extract", 2: "convert"}
    assert L.outstanding_stages(docs, jobs, force=True).count() == 10
