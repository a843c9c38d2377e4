import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as P
from attesta.llm.queries import QUERIES
from attesta.llm.scratch import stored

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator_and_the_pipeline():
    names = entry.queries()
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(QUERIES) <= set(names) and len(P.STAGES) == 5


def tables(spark, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    docs = [(i, " ".join(word() for _ in range(60))) for i in range(60)]
    for i in range(0, 60, 4):
        docs[i] = (i, docs[i][1] + " vilest dreadful")
    docs += [(100, docs[1][1]), (101, docs[2][1] + " more"), (102, "passage one two three four five six seven eight nine ten end"),
             (103, None), (104, ""), (None, "no id")]
    docs += [(200 + i, f"{' '.join(word() for _ in range(30))}\nShared line here") for i in range(12)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    return dict(docs)


def test_every_stage_does_its_part(spark, tmp_path):
    given = tables(spark, tmp_path)
    sf = str(tmp_path)
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), name)
        assert docs.columns == columns
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(given) - set(seen["toxicity"]) == set(range(0, 60, 4))
    assert seen["line_dedup"][205] == given[205].split("\n")[0] and seen["line_dedup"][103] is None
    assert set(seen["line_dedup"]) - set(seen["near_duplicates"]) == {100, 101}
    assert seen["decontamination"][102] == "passage  end" and seen["decontamination"][1] == given[1]
    packed = P.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == set(seen["decontamination"])
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    assert P.run(spark, sf).count() == packed.count()


def test_a_text_with_many_copies_is_left_once(spark, tmp_path):
    given, sf = tables(spark, tmp_path), str(tmp_path)
    rng = random.Random(9)
    clean = "\n".join(" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(20)) for _ in range(4))
    variants = [clean, clean.upper().replace("\n", " \n")]
    copies = [(1000 + i, variants[i >= 50], "en", "s", len(clean)) for i in range(70)]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = stored(docs.unionByName(spark.createDataFrame(copies, docs.schema)), "with-copies")
    seen = {}
    for name, stage in P.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), name)
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert all(seen["line_dedup"][i] == text for i, text, *_ in copies)
    assert seen["line_dedup"][205] == given[205].split("\n")[0]
    assert [i for i in seen["near_duplicates"] if i and 1000 <= i < 1050] == [1000]
    assert seen["decontamination"][1000] == clean
    packed = P.STAGES[-1][1](spark, docs, sf)
    ids = [r.doc_id for r in packed.collect()]
    assert 1000 in ids and not set(range(1001, 1050)) & set(ids)


CLASHING = ["score", "evidence", "n_lines", "n_dropped", "n_words", "n_hit", "items", "spans", "component_id", "lines", "label"]


def test_columns_of_any_name_keep_their_values(spark, tmp_path):
    tables(spark, tmp_path)
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet").drop("n_chars").withColumns(
        {c: F.concat(F.lit(c), F.coalesce("doc_id", F.lit(-1)).cast("string")) for c in CLASHING})
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), name)
        assert docs.columns == columns
        assert docs.where(" OR ".join(f"NOT ({c} <=> concat('{c}', coalesce(doc_id, -1)))" for c in CLASHING)).isEmpty()


def test_no_documents(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == 0
