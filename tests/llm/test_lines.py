import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import linededup
from attesta.llm.linededup import drop_common_lines
from attesta.llm.mphf import Index

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACES = " \t\n\x0b\x0c\r"


def plain(rows, least):
    seen = defaultdict(int)
    key = lambda line: line.strip(SPACES).translate(ASCII)
    for _, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            seen[k] += 1
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if not key(line) or seen[key(line)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def compare(docs_of, rows, least):
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in drop_common_lines(docs_of(rows), least).collect()]
    assert sorted(got, key=str) == sorted(plain(rows, least), key=str)


def test_common_lines_go_everywhere(docs_of, odd):
    rng = random.Random(2)
    lines = ["Home | About", "\xa0no ascii space", " padded\t", "PADDED", "", "  ", "a\r", "ÄÖ", "äö", *(f"own {i}" for i in range(30))]
    rows = odd + [(100 + i, "\n".join(rng.choices(lines, k=rng.randint(0, 12)))) for i in range(120)]
    rows += [(900 + i, "same text\nas its copies") for i in range(40)]
    compare(docs_of, rows, 10)
    compare(docs_of, rows, 2)


def test_every_line_may_go(docs_of):
    rows = [(i, "x\nX") for i in range(3)]
    compare(docs_of, rows, 3)
    got = drop_common_lines(docs_of(rows).withColumn("n_lines", F.lit("mine")), 3)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_dropped"]
    assert drop_common_lines(docs_of([]), 3).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_slots_are_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    counts = rng.integers(1, 400, len(keys))
    index = Index.load(Index.build(keys, counts).dump())
    assert sorted(index.slots(keys)) == list(range(len(keys)))
    assert (index.count(keys) == np.minimum(counts, 255)).all()
    others = rng.integers(1 << 63, (1 << 64) - 1, 2000, dtype=np.uint64)
    assert (index.count(others) > 0).mean() < 0.01


@pytest.mark.parametrize("heads", [1, 1000])
def test_the_index_decides(docs_of, monkeypatch, heads):
    asked, held = [], linededup.probe

    def spied(*args):
        out = held(*args)
        asked.append(out.count())
        return out

    monkeypatch.setattr(linededup, "HEADS", heads)
    monkeypatch.setattr(linededup, "probe", spied)
    rows = [(i, f"own {i}\nshared\nby {i % 20}") for i in range(300)]
    compare(docs_of, rows, 16)
    assert asked == ([0, 300] if heads == 1 else [1, 0])
    compare(docs_of, rows, 255)


@pytest.mark.parametrize("least", [0, 256])
def test_counts_beyond_the_index_are_refused(docs_of, least):
    with pytest.raises(ValueError, match="255"):
        drop_common_lines(docs_of([(1, "a")]), least)
