"""Markers, sentences, claims and fixes, with Korean text."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.functions.sentences import sentence_offsets, split_sentences, split_trimmed
from attesta.functions.text import strip_cite_tokens
from attesta.operators import citations as C

SOURCES = [(1, s) for s in (1, 2, 3)]


def parse(spark, *texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    offered = [(i, s) for i in range(len(texts)) for s in (1, 2, 3)]
    out = C.parse_markers(spark.createDataFrame(rows, "message_id long, raw string"),
                          spark.createDataFrame(offered, "message_id long, sid long"))
    return [(r.body, r.cited, r.rejected) for r in out.orderBy("message_id").collect()]


def test_markers_are_renumbered_reused_and_rejected(spark):
    got = parse(spark, "Ships leave at noon[S3]; crews rest on Monday[S2].", "one[S2] two[S2] three[S1]",
                "an invented fact[S640], a real one[S3]", "both agree[S1][S3]", "list[S], [S12x] and [T1] stay", "cut off [S",
                "left alone [[cite:S2]]", "🚢[S2]🚢[S002]", "wide[S１] and ٣[S٣]", "")
    assert got == [
        ("Ships leave at noon[[cite:1]]; crews rest on Monday[[cite:2]].", [3, 2], []),
        ("one[[cite:1]] two[[cite:1]] three[[cite:2]]", [2, 1], []),
        ("an invented fact, a real one[[cite:1]]", [3], [640]), ("both agree[[cite:1]][[cite:2]]", [1, 3], []),
        ("list[S], [S12x] and [T1] stay", [], []), ("cut off [S", [], []), ("left alone [[cite:S2]]", [], []),
        ("🚢[[cite:1]]🚢[[cite:1]]", [2], []), ("wide[[cite:1]] and ٣[[cite:2]]", [1, 3], []), ("", [], [])]


@pytest.mark.parametrize("text", ["wide[S１] and ٣[S٣] then [S２][S9]", "a[S1]b[S０２]"])
def test_batch_and_stream_read_the_same_markers(spark, text):
    from attesta.streaming.markers import rewrite
    assert [rewrite(text, {1, 2, 3}, {})] == parse(spark, text)


def test_an_answer_without_sources_rejects_everything(spark):
    out = C.parse_markers(spark.createDataFrame([(1, "a[S1]b")], "message_id long, raw string"),
                          spark.createDataFrame([], "message_id long, sid long")).first()
    assert (out.body, out.cited, out.rejected) == ("ab", [], [1])


@pytest.mark.parametrize("text,clean", [
    ("left[[ CITE: 7 ]] mid[[cite:S40]] right[[cite:3]]", "left mid right"),
    ("grid[[2]] and [[cite]] and [[note:1]]", "grid[[2]] and [[cite]] and [[note:1]]")])
def test_tokens_are_stripped_with_their_variants(spark, text, clean):
    assert spark.range(1).select(strip_cite_tokens(F.lit(text))).first()[0] == clean


def test_only_real_uncited_claims_are_flagged(spark):
    body = ("The bridge closes in March[[cite:4]]. Nobody has named the contractor so far. Short one.\n"
            "# Next steps for everyone\n* call the harbour office\nWill the ferry run on Sundays?\n| a | table row |")
    df = spark.createDataFrame([(1, body)], "message_id long, body string")
    assert [r.sentence for r in C.uncited_sentences(df).collect()] == ["Nobody has named the contractor so far."]


def test_claims(spark):
    body = "The ferry runs twice a day[[cite:1]]. Tickets cost nine crowns on weekdays[[cite:2]]."
    answers = spark.createDataFrame([(1, body), (2, "No schedule was found.")], "message_id long, body string")
    asked = spark.createDataFrame([(1, 1), (1, 2), (2, 5)], "message_id long, idx long")
    got = {(r.message_id, r.idx): r.claim for r in C.claim_for(asked, answers).collect()}
    assert got == {(1, 1): "The ferry runs twice a day.", (1, 2): "Tickets cost nine crowns on weekdays.",
                   (2, 5): "No schedule was found."}


def test_locators_and_context(spark):
    rows = [(1, 1, "tides.pdf", "High water is at six.", "Harbour > Tables", 8, 8, None),
            (1, 2, "talk.mp3", "We moved the date.", None, None, None, 7_384_000),
            (2, 1, "atlas.pdf", "m" * 3000, None, 11, 16, None)]
    df = spark.createDataFrame(rows, "message_id long, sid long, filename string, text string, heading_path string, "
                                     "page_from long, page_to long, t_start_ms long")
    got = {r.message_id: r.context for r in C.context_block(df, max_chars=100).collect()}
    assert got[1] == ("[S1] (tides.pdf · p.8 · Harbour > Tables)\nHigh water is at six.\n\n"
                      "[S2] (talk.mp3 · 2:03:04)\nWe moved the date.")
    assert got[2] == "[S1] (atlas.pdf · pp.11-16)\n" + "m" * 100 + " …"


FIX = "message_id long, ord long, sentence string, action string, replacement string, source_ids array<int>"


@pytest.mark.parametrize("raw,fixes,text,new,fixed", [
    ("Fog is rare. Ice is common.", [("Ice is common.", "hedge", "Ice may form.", [])], "Fog is rare. Ice may form.", [], 1),
    ("Fog is rare[S2]. Ice is common.", [(" Ice is common. ", "cite", "Ice comes in May.", [3, 77])],
     "Fog is rare[[cite:1]]. Ice comes in May.[[cite:2]]", [3], 1),
    ("Fog is rare.", [("Fog is rare.", "cite", "Fog is daily.", [77])], "Fog is rare.", [], 0),
    ("Fog is rare.", [("Fog is rare.", "cite", "Fog is daily.", None)], "Fog is rare.", [], 0),
    ("Fog is rare.", [("Fog is rare.", "keep", "Fog.", [1])], "Fog is rare.", [], 0),
    ("Fog is rare.", [("Snow.", "hedge", "Rain.", [])], "Fog is rare.", [], 0),
    ("Fog is rare.", [("Fog is rare.", "hedge", "  ", []), (None, "hedge", "x", [])], "Fog is rare.", [], 0),
    ("Yes. Yes.", [("Yes.", "hedge", "No.", []), ("Yes.", "cite", "Perhaps[S1]", [2]), ("Perhaps", "hedge", "Maybe", [])],
     "No. Maybe[[cite:1]][[cite:2]]", [1, 2], 3),
    ("a[S1] b d", [("b", "cite", "B[S9]", [2]), ("d", "cite", "D", [1, 2])], "a[[cite:1]] B[[cite:2]] D[[cite:1]][[cite:2]]", [2], 2)])
def test_fixes(spark, raw, fixes, text, new, fixed):
    sources = spark.createDataFrame(SOURCES, "message_id long, sid long")
    parsed = C.parse_markers(spark.createDataFrame([(1, raw)], "message_id long, raw string"), sources)
    rows = [(1, i, *fix) for i, fix in enumerate(fixes)]
    out = C.apply_fixes(parsed, spark.createDataFrame(rows, FIX), sources).first()
    assert (out.text, out.new_cited, out.fixed) == (text, new, fixed)


# ----------------------------------------------------------------------- sentences

@pytest.mark.parametrize("text,want", [
    ("Hello there. How are you? Fine!", ["Hello there.", "How are you?", "Fine!"]),
    ("See Fig. 3 and No. 7 for details. Done now.", ["See Fig. 3 and No. 7 for details.", "Done now."]),
    ("조항 3. 지급은 30일 내 한다. 끝이다.", ["조항 3. 지급은 30일 내 한다.", "끝이다."]),
    ('He said "stop." Then left…  Really?', ['He said "stop.', "Then left…", "Really?"]),
    ("첫 줄\n둘째 줄\n\n셋째", ["첫 줄", "둘째 줄", "셋째"]),
    ("문장이다. 1\n다음 문장이다.", ["문장이다. 1", "다음 문장이다."]),
    ("", []), ("  \n ", [])])
def test_sentences(text, want):
    assert [text[a:b] for a, b in sentence_offsets(text)] == want


def test_offsets_slice_the_original_also_outside_the_basic_plane(spark):
    rng = random.Random(5)
    parts = ["가나다. ", "😀 ok! ", "no. 5 ", "x\n", "3.2 ", '"q." ', "…  ", "e.g. this ", "　넓은 칸? "]
    texts = ["".join(rng.choices(parts, k=30)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    rows = split_sentences(df).orderBy("id", "start").collect()
    last = {}
    for r in rows:
        assert texts[r.id][r.start:r.end] == r.sentence and r.sentence.strip()
        assert r.start >= last.get(r.id, 0)
        last[r.id] = r.end
    check = split_sentences(df).join(df, "id").filter(
        "substring(text, cast(start AS int) + 1, cast(end - start AS int)) <> sentence")
    assert check.count() == 0
    assert split_trimmed(df).filter("sentence <> trim(sentence)").count() == 0
