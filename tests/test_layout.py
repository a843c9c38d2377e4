"""Order-dependent layout rules against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.operators import layout as L

BOXES = "document_id long, page_no long, id long, x0 double, y0 double, x1 double, y1 double"


def inside(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    area = (a[2] - a[0]) * (a[3] - a[1])
    return w > 0 and h > 0 and area > 0 and w * h / area >= 0.6


def random_boxes(rng, ids, pages=3):
    out = []
    for i in ids:
        x, y = rng.uniform(0, 200), rng.uniform(0, 400)
        out.append((1, rng.randint(1, pages), i, x, y, x + rng.uniform(20, 150), y + rng.uniform(10, 200)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_borderless_tables_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    ruled, found = random_boxes(rng, range(6)), random_boxes(rng, range(100, 160))
    found.append((*found[0][:2], 500, *found[0][3:]))
    plausible = {b[2] for b in found if b[2] % 7}
    want = []
    for b in sorted(found, key=lambda b: b[2]):
        page = [o for o in (*ruled, *want) if o[1] == b[1]]
        if b[2] in plausible and not any(inside(b[3:], o[3:]) or inside(o[3:], b[3:]) for o in page):
            want.append(b)
    got = L.add_borderless_tables(spark.createDataFrame(ruled, BOXES), spark.createDataFrame(found, BOXES),
                                  spark.createDataFrame([(i,) for i in plausible], "table_id long"))
    assert {r.id for r in got.collect()} == {b[2] for b in want}


def plain_rows(frags):
    rows = []
    for f in sorted(frags, key=lambda f: (f[1], f[0], f[3], f[2])):
        for row in rows:
            top, bottom = min(r[1] for r in row), max(r[3] for r in row)
            low = min(bottom - top, f[3] - f[1])
            if low > 0 and (min(bottom, f[3]) - max(top, f[1])) / low > 0.5:
                row.append(f)
                break
        else:
            rows.append([f])
    return sorted((" ".join(r[4] for r in sorted(row, key=lambda r: r[0])), min(r[1] for r in row), max(r[3] for r in row))
                  for row in rows)


@pytest.mark.parametrize("block,batch", [(20_000, 10_000), (50, 10_000), (20_000, 7)])
def test_visual_lines_equal_the_loop(spark, block, batch):
    rng = random.Random(11)
    frags = []
    for i in range(400):
        x, y = rng.uniform(0, 500), rng.uniform(0, 2000)
        frags.append((x, y, x + 20, y + rng.uniform(4, 25), f"w{i}"))
    df = spark.createDataFrame([(1, 1, t, x0, y0, x1, y1, 0.9) for x0, y0, x1, y1, t in frags],
                               "document_id long, page_no long, text string, x0 double, y0 double, x1 double, y1 double, conf double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted((r.text, r.y0, r.y1) for r in L.merge_visual_lines(df, block).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == plain_rows(frags)


def test_visual_lines_of_neat_rows_blanks_and_ties(spark):
    frags = [(1, 1, " b ", 5.0, 0.0, 9.0, 10.0, 0.5), (1, 1, "a", 5.0, 0.0, 9.0, 10.0, None), (1, 1, "  ", 0.0, 1.0, 4.0, 11.0, 0.7),
             (1, 1, "flat", 0.0, 3.0, 4.0, 3.0, 0.1), (1, 1, "next", 1.0, 20.0, 4.0, 30.0, 1.0), (1, 2, "page", 0.0, 5.0, 1.0, 15.0, None),
             (2, 1, None, 0.0, 5.0, 1.0, 15.0, 0.4)]
    df = spark.createDataFrame(frags, "document_id long, page_no long, text string, x0 double, y0 double, x1 double, y1 double, conf double")
    got = sorted((r.document_id, r.page_no, r.text, r.x0, r.y0, r.x1, r.y1, r.conf and round(r.conf, 9)) for r in L.merge_visual_lines(df).collect())
    assert got == [(1, 1, "b a", 0.0, 0.0, 9.0, 11.0, 0.6), (1, 1, "flat", 0.0, 3.0, 4.0, 3.0, 0.1), (1, 1, "next", 1.0, 20.0, 4.0, 30.0, 1.0),
                   (1, 2, "page", 0.0, 5.0, 1.0, 15.0, None), (2, 1, "", 0.0, 5.0, 1.0, 15.0, 0.4)]
    assert L.merge_visual_lines(df.limit(0)).count() == 0


def word_rows(order):
    """Rows of 40 words in 4 lines, with a short row, empty words and a word without confidence."""
    rows = []
    for i in range(40):
        conf = "NaN" if i == 13 else i
        rows.append((1, i, f"5\t1\t0\t0\t{i // 10}\t{i}\t{i * 5}\t{i % 3}\t4\t10\t{conf}\t" + (" " if i % 9 == 4 else f"w{i}")))
    rows += [(1, 40, "5\t1"), (1, 7, "5\t1\t0\t0\t0\t7\t0\t0\t1\t1\t50\tsame"), (1, None, "5\t1\t0\t0\t3\t7\t0\t0\t1\t1\t50\tnone")]
    return random.Random(order).sample(rows, len(rows)) if order else rows


def plain_lines(rows):
    lines = {}
    for _, n, tsv in rows:
        f = tsv.split("\t")
        if len(f) > 11 and f[11].strip():
            lines.setdefault(int(f[4]), []).append((-1 if n is None else n, f[11], float(f[6]), float(f[7]), float(f[8]), float(f[9]), float(f[10])))
    return {k: (" ".join(w[1] for w in sorted(ws)), min(w[2] for w in ws), min(w[3] for w in ws), max(w[2] + w[4] for w in ws),
                max(w[3] + w[5] for w in ws), str(round(sum(w[6] for w in ws) / len(ws) / 100, 9)), min(w[0] for w in ws if w[0] >= 0))
            for k, ws in lines.items()}


@pytest.mark.parametrize("order,batch", [(0, 10_000), (0, 7), (3, 10_000), (4, 7)])
def test_lines_of_word_rows_equal_the_loop(spark, order, batch):
    rows = word_rows(order)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = L.words_to_lines(spark.createDataFrame(rows, "document_id long, row_no long, tsv string").coalesce(1)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.line_no: (r.text, r.x0, r.y0, r.x1, r.y1, str(round(r.conf, 9)), r.first_row) for r in got} == plain_lines(rows)


def test_neighbouring_words_are_one_row_before_the_shuffle(spark):
    words = spark.range(0, 1000, 1, 1).selectExpr(
        "1L document_id", "1L page_no", "0L block_no", "0L par_no", "id div 100 AS line_no", "id AS row_no", "concat('w', id) AS text",
        "1D x0", "2D y0", "3D x1", "4D y1", "0.5D conf")
    runs = L._line_runs(words).collect()
    assert [(r.starts, r.lengths, r.n, r.conf) for r in runs] == [([i], [100], 100, 50.0) for i in range(0, 1000, 100)]


def test_fragments_of_a_page_travel_many_to_a_row(spark):
    frags = spark.range(0, 1000, 1, 1).selectExpr("1L document_id", "id div 500 AS page_no", "concat(' w', id, ' ') AS text", "1D x0")
    packs = L._packs(frags, L.PAGE).collect()
    assert [(r.page_no, len(r.text)) for r in packs] == [(p, n) for p in (0, 1) for n in [64] * 7 + [52]]
    assert [t for r in packs for t in r.text] == [f" w{i} " for i in range(1000)]


@pytest.mark.parametrize("text,height,want", [
    ("제3조 (대금지급 조건)", 10.0, True), (" 제 12 조（해지）", 10.0, True), ("제3항 (대금)", 10.0, False),
    ("Title", 11.5, True), ("Title", 11.0, False), ("제3조 (" + "가" * 130, 10.0, False)])
def test_ocr_headings(spark, text, height, want):
    row = spark.range(1).select(L.ocr_heading(F.lit(text), F.lit(height), F.lit(10.0))).first()
    assert row[0] is want


def test_markdown_pads_short_rows(spark):
    df = spark.sql("SELECT array(array('구분', '금액'), array('선급금'), array(' 잔금\\n합계 ', null, 'x')) grid")
    assert df.select(L.table_markdown(F.col("grid"))).first()[0] == (
        "| 구분 | 금액 |  |\n| --- | --- | --- |\n| 선급금 |  |  |\n| 잔금 합계 |  | x |")


def test_markdown_of_odd_grids(spark):
    df = spark.sql("""SELECT * FROM VALUES (0, array(array('a'), array('\u00a0b ', 'c'), null, array('', null))), (1, array(null, array('x', 'y'))),
        (2, cast(array() AS array<array<string>>)), (3, null), (4, array(cast(array() AS array<string>))) t(id, grid)""")
    got = [r[0] for r in df.orderBy("id").select(L.table_markdown(F.col("grid"))).collect()]
    assert got == ["| a |  |\n| --- | --- |\n| b | c |\n|  |  |", "| --- | --- |\n| x | y |", "", "", "|  |\n|  |"]


def test_grids_take_one_shuffle(spark):
    from attesta.queries.layout import grids
    plan = grids(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_page_text_is_trimmed_only_at_its_ends(spark):
    lines = [(1, 1, 0, "  "), (1, 1, 1, "  abcdefg"), (1, 1, 2, "   "), (1, 1, 3, "hijk "), (1, 2, 0, "abc"), (1, 3, 0, " ")]
    pages = [(1, 1, True), (1, 2, True), (1, 3, False), (1, 4, True)]
    out = L.page_route(spark.createDataFrame(pages, "document_id long, page_no long, has_visual boolean"),
                       spark.createDataFrame(lines, "document_id long, page_no long, line_no long, text string"))
    assert {r.page_no: r.route for r in out.collect()} == {1: "text", 2: "ocr", 3: "blank", 4: "ocr"}


def test_sizes_round_like_their_binary_values(spark):
    import random

    from attesta.functions.text import round_tenths
    rng = random.Random(4)
    sizes = [10.35, 10.25, 10.75, 9.95, 0.0, 12.0, 11.45, 0.05, 0.15, *(rng.randint(0, 4000) / 100 for _ in range(500)),
             *(rng.uniform(0, 99) for _ in range(200))]
    df = spark.createDataFrame([(s,) for s in sizes], "s double")
    assert all(r[1] == round(r[0], 1) for r in df.select("s", round_tenths(F.col("s"))).collect())
