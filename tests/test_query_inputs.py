"""Queries on small tables that hold what the test data does not."""

import __spark_entry__ as entry
import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from attesta.operators.topics import HEAD_CHARS, document_view
from attesta.queries import fixtures as fx
from attesta.queries import retrieval as R
from attesta.queries.streaming import stream_of
from attesta.streaming.runtime import drain

TALK = [(1, 0, "user", "One. Two."), (1, 1, "assistant", "Three.\nFour."), (1, 2, "user", "Brief."),
        (2, 0, "user", "Five."), (2, 1, "assistant", "Six."), (2, 2, "user", "A longer text than twenty letters.")]


def conversations(rows):
    return pa.table(dict(zip(("conv_id", "turn", "role", "text"), map(list, zip(*rows)))))


def test_a_stream_reads_a_file_and_a_folder_of_parts(spark, tmp_path):
    one, many = tmp_path / "one", tmp_path / "many"
    one.mkdir()
    pq.write_table(conversations(TALK), one / "conversations.parquet")
    (many / "conversations.parquet").mkdir(parents=True)
    for i in (0, 1):
        pq.write_table(conversations(TALK[3 * i:3 * i + 3]), many / "conversations.parquet" / f"part-{i}.parquet")
    for sf in (one, many):
        rows = drain(stream_of(spark, str(sf), "conversations"), "talk").collect()
        assert sorted(map(tuple, rows)) == TALK


def test_a_short_text_is_cut_inside_its_string(spark, tmp_path):
    pq.write_table(conversations(TALK), tmp_path / "conversations.parquet")
    rows = entry.queries()["ev1_lenient_json"](spark, str(tmp_path)).filter("turn = 2").collect()
    assert sorted((r.conv_id, r.answer, r.role, r.quarantined) for r in rows) == [(1, None, "user", False), (2, None, "user", False)]


def test_the_opening_ends_inside_a_gap(spark):
    for over, tail in ((0, "\n\n"), (1, "\n"), (2, "")):
        chunks = spark.createDataFrame([(1, 0, "a" * (HEAD_CHARS - 2 + over)), (1, 1, "b")], "document_id long, ord long, text string")
        assert document_view(chunks).first().view == ("a" * (HEAD_CHARS - 2 + over) + tail)


def test_dead_scopes_name_no_document(spark, tmp_path):
    """Also when there are more than 1,000 documents."""
    pq.write_table(pa.table({"item_id": [1, 2], "text": ["a", "b"]}), tmp_path / "benchmark.parquet")
    pq.write_table(pa.table({"doc_id": range(30_000)}), tmp_path / "documents.parquet")
    scope = R._dead_scope(spark, str(tmp_path))
    known = fx.table(spark, str(tmp_path), "documents").selectExpr(f"doc_id % {fx.groups(spark, str(tmp_path))} AS document_id")
    met = scope.join(known, "document_id", "left_semi").select("query_id").distinct().collect()
    assert scope.filter("query_id = 2").count() == 300 and [r.query_id for r in met] == [1]


def test_every_message_has_its_ancestors(spark, tmp_path):
    pq.write_table(conversations(TALK), tmp_path / "conversations.parquet")
    rows = entry.queries()["mt1_ancestors"](spark, str(tmp_path)).filter("target < 2000").collect()
    assert sorted(map(tuple, rows)) == [(1000, 1000, 0), (1001, 1000, 0), (1001, 1001, 1), (1002, 1000, 0), (1002, 1001, 1), (1002, 1002, 2)]


ODD = ["", " \t\n\n \r\n", None, "\n \nfirst line\n\nlast", "Title\n\nbody text of one line\n\n\n", "a \r\nb\t\r\n\tc d", "\u3000\n\xa0x\xa0\n\x0b",
       "\n\n\n\nhead\n\n\nshort", " ", "one  two \n three\x1c\nfour", "plain text\nof two lines", '"q\\"\n{x}', "\n".join([" " * 5, "w" * 30, ""] * 30)]


@pytest.mark.parametrize("name", ["ly3_block_spans", "ch7_drop_blank_chunks", "ly3_assemble_blocks", "ly2_body_font_size",
                                  "ly4_classify_heading", "ly5_heading_level", "tp3_clean_labels",
                                  "ly9_drop_blocks_in_tables"])
def test_odd_texts_give_what_the_sql_gives(spark, tmp_path, name):
    """Empty texts, blank lines, white space of all kinds, no text."""
    pq.write_table(pa.table({"doc_id": range(len(ODD)), "text": ODD}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"p_partkey": range(900), "p_size": [k * 7 % 50 for k in range(900)]}), tmp_path / "part.parquet")
    got = entry.queries()[name](spark, str(tmp_path))
    with duckdb.connect() as con:
        for table in ("documents", "part"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        want = con.sql(entry.oracle_sql()[name])
        assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall()))
