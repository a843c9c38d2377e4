"""The chunk rules against a plain loop, for small and for split documents."""

import random

import pytest
from pyspark.sql import functions as F

from attesta.functions.sentences import sentence_offsets
from attesta.operators import chunks as C
from attesta.plans.lineage import cut

ELEMENTS = "document_id long, reading_order long, page_no long, kind string, level long, text string"


def plain_chunks(elements, limit, overlap):
    """(element orders, text, is_table) of each chunk, one element at a time."""
    out, held, fresh = [], [], False

    def close(carry):
        nonlocal held, fresh
        if held and fresh:
            out.append(([o for o, _ in held], "\n".join(t for _, t in held), False))
        tail = []
        while carry and overlap and len(held) > 1 and sum(len(t) for _, t in tail) < overlap and len(tail) < len(held):
            tail.insert(0, held[-1 - len(tail)])
        held = tail if len(tail) < len(held) else []
        fresh = False

    for order, kind, text in elements:
        if kind == "table":
            close(False)
            held = []
            out.append(([order], text, True))
        elif kind == "heading":
            close(False)
            held, fresh = [(order, text)], True
        elif len(text) > limit:
            close(True)
            held = []
            for a, b in C.pack_sentences(text, limit):
                out.append(([order], text[a:b], False))
        else:
            if held and sum(len(t) for _, t in held) + len(text) > limit:
                close(True)
            held.append((order, text))
            fresh = True
    close(False)
    return out


def random_document(seed, n, regular=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = "paragraph" if regular else rng.choices(["paragraph", "heading", "table"], [20, 1, 1])[0]
        size = 5 if regular else rng.choice([1, 2, 3, 4, 5, 6, 9, 15])
        text = ("ab. " * 12).strip() if kind == "paragraph" and not regular and rng.random() < 0.03 else "x" * size
        rows.append((i, kind, text))
    return rows


@pytest.mark.parametrize("block", [4096, 20])
def test_chunks_equal_the_loop(spark, block):
    docs = {1: random_document(1, 150), 2: random_document(2, 15), 3: random_document(3, 90, regular=True),
            4: random_document(4, 41), 5: random_document(5, 400)}
    rows = [(d, o * 3, 1, k, 1 + o % 3, t) for d, els in docs.items() for o, k, t in els]
    chunks, members = C.chunk_elements(spark.createDataFrame(rows, ELEMENTS), 8, 3, block=block)
    got = {}
    for r in chunks.orderBy("document_id", "ord").collect():
        got.setdefault(r.document_id, []).append((r.ord, r.text, r.is_table))
    inside = {}
    for r in members.orderBy("document_id", "ord", "offset").collect():
        inside.setdefault((r.document_id, r.ord), []).append(r.reading_order // 3)
    for d, els in docs.items():
        want = plain_chunks(els, 16, 6)
        assert [(i, t, b) for i, (_, t, b) in enumerate(want)] == got[d]
        assert [o for o, _, _ in want] == [inside[(d, i)] for i in range(len(want))]


def test_heading_paths_agree_with_the_element_operator(spark):
    for block in (4096, 18):
        rows = [(1, o, 1, k, (None, 0, 1, 2, 3, 4, 5, 6)[(o * 7) % 8], f"h{o}" if k == "heading" else t)
                for o, k, t in random_document(9, 300)]
        df = spark.createDataFrame(rows, ELEMENTS)
        chunks, members = C.chunk_elements(df, 8, 3, block=block)
        first = members.filter("offset = 0").select("document_id", "ord", "reading_order")
        want = C.heading_path(df).select("document_id", "reading_order", F.col("heading_path").alias("want"))
        both = chunks.join(first, ["document_id", "ord"]).join(want, ["document_id", "reading_order"])
        assert both.count() == chunks.count()
        assert both.filter("NOT heading_path <=> want").count() == 0


def stack_paths(headings):
    stack, out = [], []
    for level, title in headings:
        while stack and stack[-1][0] >= level:
            stack.pop()
        stack.append((level, title))
        out.append(" > ".join(t for _, t in stack))
    return out


def test_heading_path_equals_a_stack(spark):
    rng = random.Random(4)
    heads = [(rng.randint(1, 6), f"t{i}") for i in range(200)]
    df = spark.createDataFrame([(1, i, 1, "heading", lv, t) for i, (lv, t) in enumerate(heads)], ELEMENTS)
    got = [r.heading_path for r in C.heading_path(df).orderBy("reading_order").collect()]
    assert got == stack_paths(heads)


def test_overlap_alone_is_repeated_only_on_request(spark):
    texts = ["aaaa", "bbbb", "cccc", "dddd", ("long sentence here. " * 3).strip()]
    df = spark.createDataFrame([(1, i, 1, "paragraph", None, t) for i, t in enumerate(texts)], ELEMENTS)
    plain = [r.text for r in C.chunk_elements(df, 8, 3)[0].orderBy("ord").collect()]
    again = [r.text for r in C.chunk_elements(df, 8, 3, compat=True)[0].orderBy("ord").collect()]
    assert plain[0] == "aaaa\nbbbb\ncccc\ndddd" and "cccc\ndddd" not in plain
    assert again[:2] == ["aaaa\nbbbb\ncccc\ndddd", "cccc\ndddd"] and again[2:] == plain[1:]


def test_spans_reproduce_the_source_text(spark):
    rows = [(1, o, 1, k, 1, t) for o, k, t in random_document(6, 120)]
    df = spark.createDataFrame(rows, ELEMENTS)
    chunks, members = C.chunk_elements(df, 8, 3)
    boxed = df.selectExpr("*", "0D AS x0", "0D AS y0", "1D AS x1", "1D AS y1")
    spans = boxed.selectExpr("document_id", "reading_order", "0L AS text_start", "cast(length(text) AS long) AS text_end",
                             "page_no", "x0", "y0", "x1", "y1")
    out = C.rebase_spans(members, spans, boxed).join(chunks.select("ord", "text"), "ord")
    assert out.filter("text_start < 0 OR text_end > length(text) OR text_start > text_end").count() == 0
    named = members.select("ord", "reading_order", "offset", "cut_start", "cut_end").join(
        df.select("reading_order", F.col("text").alias("src")), "reading_order").join(chunks.select("ord", "text"), "ord")
    wrong = named.filter("substring(src, cast(cut_start AS int) + 1, cast(cut_end - cut_start AS int)) <> "
                         "substring(text, cast(offset AS int) + 1, cast(cut_end - cut_start AS int))")
    assert wrong.count() == 0


def test_page_range_and_unnumbered_pages(spark):
    df = spark.createDataFrame([(1, 0, 3, "paragraph", None, "one"), (1, 1, 0, "paragraph", None, "two"),
                                (1, 2, 5, "paragraph", None, "three")], ELEMENTS)
    chunks, members = C.chunk_elements(df)
    row = chunks.first()
    assert (row.page_from, row.page_to, row.token_count) == (3, 5, 6)
    ranged = C.page_range(members).first()
    assert (ranged.page_from, ranged.page_to) == (3, 5)


def test_blank_chunks_leave_gaps_in_ord(spark):
    df = spark.createDataFrame([(1, 0, 1, "table", None, " "), (1, 1, 1, "paragraph", None, "text")], ELEMENTS)
    assert [r.ord for r in C.chunk_elements(df)[0].collect()] == [1]


def test_pieces_of_one_long_element_take_their_spans(spark):
    """One element with most pieces and spans; spans may be empty, cross stretches or cover all."""
    rng = random.Random(8)
    size = 40_000
    edges = sorted({0, size, 4096, 8192, *rng.sample(range(size), 150)})
    pieces = [(1, i, 0, a, b, 100 * i, True) for i, (a, b) in enumerate(zip(edges, edges[1:]))]
    spans = [(1, 0, a, min(size, a + rng.choice([0, 1, 30, 9000])), i) for i, a in enumerate(rng.sample(range(size), 400))]
    spans += [(1, 0, 0, size, 1000), (1, 5, 3, 9, 1001), (2, 0, 1, 2, 1002)]
    members = pieces + [(1, 900, 5, 0, 50, 7, False), (2, 0, 0, 0, 50, 0, False), (3, 0, 0, 0, 10, 0, True)]
    want = set()
    for doc, ord_, order, a, b, offset, piece in members:
        hits = [(s, e, n) for d, o, s, e, n in spans if (d, o) == (doc, order) and (not piece or (e > a and s < b))]
        want |= {(doc, ord_, (max(0, s - a) if piece else s) + offset, (min(b, e) - a if piece else e) + offset, n) for s, e, n in hits}
    m = spark.createDataFrame([(*x, 1) for x in members], "document_id long, ord long, reading_order long, cut_start long, "
                              "cut_end long, offset long, is_piece boolean, page_no long")
    sp = spark.createDataFrame([(*x, 0.0, 0.0, 0.0, 0.0) for x in spans], "document_id long, reading_order long, text_start long, "
                               "text_end long, page_no long, x0 double, y0 double, x1 double, y1 double")
    none = spark.createDataFrame([], "document_id long, reading_order long, page_no long, x0 double, y0 double, x1 double, y1 double")
    got = [(r.document_id, r.ord, r.text_start, r.text_end, r.page_no) for r in C.rebase_spans(m, sp, none).collect()]
    assert len(got) == len(want) and set(got) == want


# --------------------------------------------------------------------- transcripts

def plain_windows(segments, window):
    out = []
    for order, start, end, text in segments:
        if out and end - out[-1][0][1] > window and (
                out[-1][-1][3].endswith(C.CLOSING) or end - out[-1][0][1] > window * 1.6):
            out.append([])
        if not out:
            out.append([])
        out[-1].append((order, start, end, text))
    return [(" ".join(t for *_, t in w), w[0][1], w[-1][2], len(w)) for w in out]


def recording(seed, n, step, overlap=0):
    rng = random.Random(seed)
    at, rows = 0, []
    for i in range(n):
        end = at + rng.randint(1, step)
        rows.append((i, at, end, rng.choice(["말했다", "그래요", "and then", "so.", "why?"])))
        at = end - rng.randint(0, overlap) + (rng.randint(0, 3 * step) if rng.random() < 0.02 else 0)
    return rows


@pytest.mark.parametrize("block", [4096, 64])
def test_windows_equal_the_loop(spark, block):
    docs = {1: recording(1, 300, 900), 2: recording(2, 20, 900), 3: recording(3, 400, 60),
            4: recording(4, 300, 900, overlap=300)}
    rows = [(d, *r) for d, rs in docs.items() for r in rs] + [(2, 999, 0, 0, "  ")]
    df = spark.createDataFrame(rows, "document_id long, reading_order long, start_ms long, end_ms long, text string")
    windows = cut(C.transcript_windows(df, 4.5, block=block))
    got, texts = {}, {}
    for r in C.window_chunks(windows).orderBy("document_id", "ord").collect():
        got.setdefault(r.document_id, []).append((r.text, r.t_start_ms, r.t_end_ms, r.n_segments))
        texts[r.document_id, r.ord] = r.text
    assert got == {d: plain_windows(rs, 4500) for d, rs in docs.items()}
    spans = C.window_spans(windows).orderBy("document_id", "ord", "pos").collect()
    said = {d: [] for d in docs}
    for r in spans:
        said[r.document_id].append((r.t_start_ms, r.t_end_ms, texts[r.document_id, r.ord][r.text_start:r.text_end]))
    assert said == {d: [x[1:] for x in rs] for d, rs in docs.items()}
    assert [r.pos for r in spans if (r.document_id, r.ord) == (1, 2)] == list(range(got[1][2][3]))


# ------------------------------------------------------------------------ oversize

def test_pieces_stay_within_the_limit_where_sentences_allow():
    text = "첫 문장입니다. 두 번째 문장입니다. A very long sentence that cannot be cut at all. 끝."
    pieces = C.pack_sentences(text, 25)
    assert [p for s in pieces for p in s] == sorted(p for s in pieces for p in s)
    marks = dict(sentence_offsets(text))
    for a, b in pieces:
        assert a in marks and (b - a <= 25 or marks[a] == b)
