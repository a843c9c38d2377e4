import hashlib
import random

import pytest
from pyspark.sql import functions as F

from attesta.llm import merkle
from attesta.llm.merkle import compared, compared_with_next, fingerprint, likeness, read, tree, written


def prose(rng, lines):
    return "\n".join(" ".join("".join(rng.choices("abcdeéß", k=rng.randint(1, 8))) + rng.choice(["", "", "", "."])
                              for _ in range(rng.randint(1, 60))) for _ in range(lines))


def leaves(node):
    return [node] if not node.children else [x for c in node.children for x in leaves(c)]


@pytest.mark.parametrize("text", [None, "", "a", "\n", "\n\n", " ", "x" * 100_000, "one. two! three?\nfour", "é" * 70 + ". b\r\nc",
                                  ". " * 5000, "a,b/c;d.e" * 30])
def test_leaves_cover_the_text_and_fingerprints_read_back(text):
    root = tree(text)
    assert root.size == len(text or "")
    found = [x for s in root.children for x in leaves(s)]
    assert [x.start for x in found] == [sum(y.size for y in found[:i]) for i in range(len(found))]
    again = read(written(root))
    assert written(again) == written(root) and likeness(again, root) == 1.0
    assert [s.hash for s in again.children] == [s.hash for s in root.children]


def test_one_changed_line_is_located():
    rng = random.Random(1)
    lines = prose(rng, 200).split("\n")
    old = "\n".join(lines)
    new = "\n".join([*lines[:120], "an inserted line", *lines[120:]])
    a, b = tree(old), tree(new)
    gone, added = merkle.differing(a.children, b.children)
    at = len("\n".join(lines[:120])) + 1
    assert merkle.spans(gone) == [] and merkle.spans(added) == [(at, at + len("an inserted line\n"))]
    assert 0.98 < likeness(a, b) < 1


def test_likeness_is_bounded_symmetric_and_one_only_for_equal_texts():
    rng = random.Random(2)
    texts = [prose(rng, n) for n in (1, 2, 5, 30)] + ["", "x", "y", "a\nb\n", "b\na\n", "a\n", "a\na\n"]
    for x in texts:
        for y in texts:
            near = likeness(tree(x), tree(y))
            assert near == likeness(tree(y), tree(x)) and 0 <= near <= 1 and (near == 1) == (x == y)
    assert likeness(tree("a\nb\n"), tree("b\na\n")) > 0.3
    assert likeness(tree(texts[3]), tree(texts[2])) < 0.1


def plain(rows):
    """The contract by a loop over rows in order of id."""
    rows = sorted(rows, key=lambda r: r[0])
    out = []
    for (i, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        k = len(text) // 2
        changed = text[:len(text) - k] + after[:k]
        out.append((i, len(text), hashlib.sha256(changed.encode()).hexdigest(), written(tree(text)), written(tree(changed)),
                    likeness(tree(text), tree(changed)), likeness(tree(text), tree(after))))
    return out


@pytest.mark.parametrize("ranges", [None, 1, 5, 300])
def test_rows_against_a_loop(spark, docs_of, odd, ranges):
    rng = random.Random(3)
    rows = [(i * 37 % 1009 + 20, prose(rng, rng.randint(1, 12))) for i in range(200)]
    rows += [(i + 5000, "the same text, again and again.\nand again") for i in range(60)]
    rows += [(i, t) for i, t in odd if i not in (7, None)] + [(2**63 - 1, "last"), (-4, "first")]
    docs = docs_of(rows).repartition(3).withColumns({"fingerprint": F.lit("mine"), "__text": F.lit(1), "id": F.lit("x")})
    got = compared_with_next(docs, ranges=ranges)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)
    assert got.columns == ["doc_id", *merkle.NAMES]


def test_half_an_edit_is_nearer_than_the_next_text(spark, docs_of):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(1, 30))) for i in range(300)]
    got = compared_with_next(docs_of(rows)).collect()
    assert sum(r["near_edited"] > r["near_next"] for r in got) >= 295
    assert sum(r["near_edited"] for r in got) / len(got) > 0.35


def test_no_rows_one_row_repeats_and_null_ids(spark, docs_of):
    assert compared_with_next(docs_of([])).count() == 0
    assert [tuple(r) for r in compared_with_next(docs_of([(3, "alone in the table")])).collect()] == plain([(3, "alone in the table")])
    rows = [(None, f"null {i}") for i in range(40)] + [(1, "x y z")] * 30 + [(1, "other"), (2, None)]
    got = compared_with_next(docs_of(rows), ranges=4).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["fingerprint"]) for r in got) == sorted(
        (i is None, i, written(tree(t))) for i, t in rows)
    assert sum(r["near_next"] == 1.0 for r in got) == 29


def test_columns_of_fingerprints_are_compared(spark):
    df = spark.createDataFrame([("a\nb\n", "a\nb\n"), ("a\nb\n", "a\nc\n"), (None, ""), (None, None)], "old string, new string")
    prints = df.select(fingerprint("old").alias("o"), fingerprint("new").alias("n"))
    got = [r[0] for r in prints.select(compared("o", "n")).collect()]
    assert [r["equal"] for r in got] == [True, False, True, True]
    assert [tuple(x) for x in got[1]["gone"]] == [(2, 4)] == [tuple(x) for x in got[1]["added"]]
