"""Topic resolution and merging, table tools, JSON repair and scoring."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.functions.json_repair import lenient_json, repair
from attesta.functions.text import parse_number, slugify
from attesta.operators import evaluation as E
from attesta.operators import graphs, search
from attesta.operators import tables as TB
from attesta.operators import topics as T

TOPICS = "id long, name string, slug string, embedding array<float>, doc_count long, merged_into_id long, created_by string"


@pytest.mark.parametrize("batch", [2, 1024])
def test_resolving_equals_one_by_one(spark, batch):
    rng = np.random.default_rng(6)
    vec = lambda: rng.standard_normal(3).astype(np.float32)
    old = [(i, f"old {i}", f"old-{i}", vec()) for i in range(4)]
    asked = [(d * 10 + p, d, p, f"Name {d % 5}", vec()) for d in range(20) for p in range(2)]
    unit = lambda v: np.float64(v) / np.linalg.norm(np.float64(v))
    live, slugs, want, made = [(i, unit(v)) for i, _, _, v in old], {s for _, _, s, _ in old}, {}, {}
    for pid, doc, pos, name, v in asked:
        best, where = max((float(u @ unit(v)), -k) for k, (_, u) in enumerate(live))
        if best >= 0.8:
            topic = live[-where][0]
        else:
            topic = -pid - 1
            slug = name.lower().replace(" ", "-")
            made[topic] = f"{slug}-{pos + 1}" if slug in slugs else slug
            slugs.add(slug)
            live.append((topic, unit(v)))
        want.setdefault((doc, topic), pos)
    topics = spark.createDataFrame([(i, n, s, v.tolist(), 0, None, "agent") for i, n, s, v in old], TOPICS)
    proposals = spark.createDataFrame([(i, d, p, n, v.tolist()) for i, d, p, n, v in asked],
                                      "id long, document_id long, pos long, name string, embedding array<float>")
    got, new, _ = T.resolve_topics(proposals, topics, 0.8, batch)
    assert {(r.document_id, r.topic_id): r.pos for r in got.collect()} == want
    assert {r.topic_id: r.slug for r in new.collect()} == made


def test_a_sweep_converges(spark):
    vectors = [[1.0, 0.0], [0.99, 0.1], [0.0, 1.0], [0.1, 0.99]]
    topics = spark.createDataFrame([(i, f"t{i}", f"t{i}", v, i, None, "agent") for i, v in enumerate(vectors)], TOPICS)
    bridge = spark.createDataFrame([(9, 0, None, "agent"), (9, 1, 0.5, "agent"), (8, 2, None, "agent")],
                                   "document_id long, topic_id long, confidence double, source string")
    none = spark.createDataFrame([], "topic_id long, alias string")
    out, moved, names = T.merge_similar_topics(topics, bridge, none, 0.85)
    assert {r.id: (r.merged_into_id, r.doc_count) for r in out.collect()} == {
        0: (1, 0), 1: (None, 1), 2: (3, 0), 3: (None, 1)}
    assert {(r.document_id, r.topic_id, r.confidence) for r in moved.collect()} == {(9, 1, 0.5), (8, 3, None)}
    assert {(r.topic_id, r.alias) for r in names.collect()} == {(1, "t0"), (3, "t2")}
    assert T.merge_plan(out, 0.85).count() == 0


@pytest.mark.parametrize("name,slug", [("계약 / 법무", "계약-법무"), (" A  B--C! ", "a-b-c"), ("!?", "topic"),
                                       ("가", "가"), ("Ünï", "n")])
def test_slugs(spark, name, slug):
    assert spark.range(1).select(slugify(F.lit(name))).first()[0] == slug


def test_document_view(spark):
    texts = [f"{i}" * 900 for i in range(10)]
    df = spark.createDataFrame([(1, i * 2, t) for i, t in enumerate(texts)] + [(2, 0, "short")],
                               "document_id long, ord long, text string")
    got = {r.document_id: r.view for r in T.document_view(df).collect()}
    assert got[2] == "short"
    assert got[1] == "\n\n".join(texts)[:6000] + "\n\n[...]\n\n" + "\n\n".join(texts[i] for i in (2, 4, 6, 8))[:2000]


# --------------------------------------------------------------------------- tables

CELLS = [(3, 0, 0, "site"), (3, 0, 1, "north dock"), (3, 0, 2, "south dock"), (3, 1, 0, "crates"), (3, 1, 1, "75"),
         (3, 1, 2, "18"), (3, 2, 0, "pallets"), (3, 2, 1, "4"), (3, 2, 2, "")]


@pytest.mark.parametrize("request_,want", [
    ((None, None, "crates", "south"), {(1, 2)}), ((2, None, None, None), {(2, 0), (2, 1), (2, 2)}),
    ((None, None, None, "west"), set()), ((None, None, None, None), {c[1:3] for c in CELLS}),
    ((None, 1, "pal", None), {(2, 1)})])
def test_cell_lookup(spark, request_, want):
    cells = spark.createDataFrame(CELLS, "table_id long, r long, c long, text string")
    req = spark.createDataFrame([(1, 3, *request_)], "query_id long, table_id long, row long, col long, "
                                                     "row_header string, col_header string")
    assert {(r.r, r.c) for r in TB.query_table(cells, req).collect()} == want


def test_small_tables_meet_their_requests_in_one_shuffle(spark):
    cells = spark.createDataFrame([(t, r, c, None if r == c == 2 else f"{'head' if r == 0 or c == 0 else 'x'} {r}{c}")
                                   for t, n in ((1, 3), (2, 9)) for r in range(n) for c in range(3)],
                                  "table_id long, r long, c long, text string")
    asked = [(row, col, rh, ch) for row in (None, 1) for col in (None, 2) for rh in (None, "1", "no") for ch in (None, "head 0")]
    req = spark.createDataFrame([(100 * t + i, t, *a) for t in (1, 2, 3) for i, a in enumerate(asked)],
                                "query_id long, table_id long, row long, col long, row_header string, col_header string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    whole = TB.query_table(cells, req)
    want = rows(whole)
    assert len(want) > 100 and rows(TB.query_table(cells, req, block=0)) == want == rows(TB.query_table(cells, req, block=25))
    assert "hashpartitioning(query_id" not in whole._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("text,number", [("about 98,007 crates", 98007.0), ("٣٫ no, ٤٢", 3.0), ("가격 １２３원", 123.0), ("7.25 m", 7.25),
                                         ("none", None), (None, None), ("from -8 up", -8.0), ("1٢.５", 12.5)])
def test_numbers(spark, text, number):
    assert spark.range(1).select(parse_number(F.lit(text))).first()[0] == number


def test_calculations(spark):
    row = spark.sql("SELECT 7D AS a, 16D AS b, 0D AS z")
    names = {n: F.col(n) for n in "abz"}
    assert row.select(TB.calc("a * (b + a) / 4 - b", names)).first()[0] == pytest.approx(24.25)
    assert row.select(TB.calc("-a ** 2 + +b", names)).first()[0] == -33
    assert row.select(TB.calc("a / z", names, on_zero="null")).first()[0] is None
    with pytest.raises(Exception, match="division by zero"):
        row.select(TB.calc("a / z", names)).collect()
    for bad in ("a + q", "max(a, b)", "a.real", "[a]", "a < b", "a if b else z", "a +", "True + a", "a // b", "'x'"):
        with pytest.raises(ValueError):
            TB.calc(bad, names)


# ----------------------------------------------------------------------------- JSON

@pytest.mark.parametrize("raw,want", [
    ("[3, 4]", [3, 4]), ("null", None), ('noise {"ok": true} noise', {"ok": True}),
    ('{"rows": [{"w": 2.5}, {"w": 7', {"rows": [{"w": 2.5}, {"w": 7}]}), ('{"p": {"q": {}, "r": [[], [', {"p": {"q": {}, "r": [[], []]}}),
    ('{"n": -1e3, "m": tr', {"n": -1000.0}), ('{"n": 12.', {"n": 12}), ('{"u": "half a wo', {}), ('{"k": "v", "half ke', {"k": "v"}),
    ('{"k": "v" , , ', {"k": "v"}), ('{"k": [1 2', {"k": [1]}), ('{"braces": "}{][", "z": [null,', {"braces": "}{][", "z": [None]}),
    ('{"tab": "a\\tb\\u00e9", "x"', {"tab": "a\tb\u00e9"}), ('{"b": [}', {"b": []})])
def test_repair(raw, want):
    assert json.loads(repair(raw)) == want


@pytest.mark.parametrize("raw", [None, "", "}", "plain words", '{"a": 1' + "x" * 300])
def test_nothing_to_repair(raw):
    assert repair(raw) is None


def test_repair_looks_back_over_few_places():
    assert repair('{"a": 1 ' + "x" * 198) == '{"a": 1}'
    assert repair('{"a": 1 ' + "x" * 201) is None
    assert repair('{"a": 1 ' + '"long string" ' * 90) == '{"a": 1}'


def test_hopeless_json_is_quarantined(spark):
    df = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": 2,'), (3, "a sentence, no braces"), (4, None)], "id long, raw string")
    good, bad = lenient_json(df, "raw", "struct<a:bigint>")
    assert sorted((r.id, r.parsed.a) for r in good.collect()) == [(1, 1), (2, 2)]
    assert sorted(r.id for r in bad.collect()) == [3, 4]


# ----------------------------------------------------------------------- evaluation

def test_gold_cases_are_read_and_scored(spark, tmp_path):
    cases = [{"id": "load", "question": "How much?", "document_filenames": ["crane.pdf"], "expect_answer_contains": ["3.5 t"],
              "expect_citation": {"filename": "crane.pdf", "page_in": [11, 12]}, "max_rejected": 0},
             {"id": "wind", "question": "?", "document_filenames": ["crane.pdf"], "expect_answer_contains": ["14 m/s"],
              "expect_citation": {"filename": "crane.pdf", "text_contains": "gusts"}},
             {"id": "none", "question": "?", "document_filenames": ["tide.pdf"], "expect_no_citations": True}]
    path = tmp_path / "gold.json"
    path.write_text("\n".join(json.dumps(c, ensure_ascii=False) for c in cases))
    gold = E.read_gold_cases(spark, str(path))
    results = spark.createDataFrame([("load", "At most 3.5 t.", 0), ("wind", "20 m/s", 2), ("none", "Nothing.", 0)],
                                    "id string, answer string, rejected long")
    cites = spark.createDataFrame([("load", "crane.pdf", 9, ""), ("load", "crane.pdf", 12, ""), ("wind", "crane.pdf", 1, "breeze"),
                                   ("none", "tide.pdf", 1, "x")], "id string, filename string, page_no long, snippet string")
    got = {r.id: (r.passed, r.reasons) for r in E.score_cases(gold, results, cites).collect()}
    assert got["load"] == (True, [])
    assert got["wind"] == (False, ["answer missing '14 m/s'", "no citation matched", "rejected citations 2 > max 0"])
    assert got["none"] == (False, ["expected no citations, got 1"])
    docs = spark.createDataFrame([("crane.pdf", "ready"), ("tide.pdf", "failed")], "filename string, status string")
    assert [r.filename for r in E.missing_gold_documents(gold, docs).collect()] == ["tide.pdf"]
    assert tuple(E.pass_rate(E.score_cases(gold, results, cites)).first()) == (1, 3)


def test_vectors_travel_in_few_groups(spark, monkeypatch):
    """A row visits every group, so groups are as large as a task holds; counts come along."""
    ids = spark.range(5000).selectExpr("id", "array_repeat(cast(id AS float), 64) AS embedding")
    assert search.vector_groups(ids) == 1
    monkeypatch.setattr(search, "GROUP_BYTES", 1)
    assert search.vector_groups(ids) == 10
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, 3))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    sims = unit @ unit.T
    rows = [(i, v[i].tolist(), i * 7 % 5, None) for i in range(len(v))]
    topics = spark.createDataFrame(rows, "id long, embedding array<double>, doc_count long, merged_into_id long")
    a, b = np.nonzero(np.triu((sims >= 0.9) & (sims < 0.92), 1))
    want = sorted((int(i), int(j)) if i * 7 % 5 >= j * 7 % 5 else (int(j), int(i)) for i, j in zip(a, b))
    plan = T.merge_candidates(topics, 0.9, 0.92)
    assert sorted((r.keep, r.drop) for r in plan.collect()) == want
    assert "Join" not in plan._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("threshold,covered", [(0.5, 1 / 8), (0.999, 1 / 8), (0.9, 1.0), (0.9, -1.0)])
def test_leaders_are_those_of_a_walk_in_order(spark, monkeypatch, threshold, covered):
    monkeypatch.setattr(graphs, "SETTLED", 8)
    monkeypatch.setattr(graphs, "COVERED", covered)
    v = np.random.default_rng(4).normal(size=(90, 3))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    kept = []
    for i in range(len(v)):
        if not kept or (unit[kept] @ unit[i]).max() < threshold:
            kept.append(i)
    nodes = spark.createDataFrame([(i, i, v[i].tolist()) for i in range(len(v))], "id long, ord long, embedding array<double>")
    out = graphs.greedy_vector_leaders(nodes, threshold, 4)
    assert sorted(r.id for r in out.filter("kept").collect()) == kept
