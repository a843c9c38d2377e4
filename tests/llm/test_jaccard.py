import random
import re

import numpy as np
import pyarrow as pa
import pytest

from attesta.llm import jaccard
from attesta.llm.components import components

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingled(text, width):
    w = re.findall(r"[^ \t\n\x0b\x0c\r]+", (text or "").translate(ASCII))
    return {tuple(w[i:i + width]) for i in range(max(len(w) - width, 0) + 1)} if w else set()


def plain(rows, width, percent):
    own = [shingled(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(own):
        for j in range(i):
            if a and own[j] and 100 * len(a & own[j]) >= percent * len(a | own[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [(rows[i][0], len(own[i]), least[find(i)] if own[i] else rows[i][0]) for i in range(len(rows))]


def noisy(rng, words, changes):
    out = list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(out)


def corpus(odd):
    rng = random.Random(9)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = odd + [(1000 + i, noisy(rng, base, rng.randint(0, 7))) for i in range(120)]
    rows += [(2000 + i, " ".join(base[:60] + [f"u{i}-{k}" for k in range(rng.randint(5, 90))])) for i in range(60)]
    rows += [(3000 + i, " ".join(base)) for i in range(30)] + [(4000 + i, "Tiny TEXT" if i % 2 else "tiny  text") for i in range(6)]
    long = [f"v{rng.randrange(3000)}" for _ in range(4000)]
    return rows + [(5000 + i, noisy(rng, long, 40 * i)) for i in range(5)]


@pytest.mark.parametrize("width,percent,limits", [(4, 85, {}), (5, 80, {"SHORT": 3, "FAN": 4}),
                                                  (4, 85, {"UNIT_ROWS": 16, "LEAF": 4, "SHORT": 2, "FAN": 3})])
def test_components_are_those_of_all_pairs(monkeypatch, docs_of, odd, width, percent, limits):
    for name, value in limits.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(odd)
    got = jaccard.near_duplicates(docs_of(rows), width, percent).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(plain(rows, width, percent), key=str)


def test_empty_table(docs_of):
    assert jaccard.near_duplicates(docs_of([])).count() == 0


@pytest.mark.parametrize("rows", [1, 3, 7, 1000])
def test_lists_are_tied_across_batches(monkeypatch, rows):
    monkeypatch.setattr(jaccard, "SHORT", 4)
    monkeypatch.setattr(jaccard, "FAN", 3)
    rng = random.Random(rows)
    lists = {t: sorted((rng.choice([10, 11, 30, 31]), rng.randrange(10 ** 6)) for _ in range(rng.choice([1, 2, 4, 5, 40])))
             for t in range(60)}
    flat = [(t, n, x) for t, own in sorted(lists.items()) for n, x in own]
    table = pa.table({k: [r[i] for r in flat] for i, k in enumerate(("token", "n", "node"))})
    edges = set()
    for batch in jaccard._ties(85)(iter(table.to_batches(max_chunksize=rows))):
        edges |= {(a, b, w) for a, b, w in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
    for own in lists.values():
        for part in ([x for x in own if x[0] < 20], [x for x in own if x[0] > 20]):
            nodes = {x[1] for x in part}
            if 1 < len(part) <= 4:
                assert all((min(a, b), max(a, b), 1) in edges for a in nodes for b in nodes if a != b)
            elif len(part) > 4:
                reach, todo = set(), [part[0][1]]
                while todo:
                    x = todo.pop()
                    reach.add(x)
                    todo += [b if a == x else a for a, b, w in edges if w == 3 and x in (a, b) and (b if a == x else a) not in reach]
                assert nodes <= reach


def test_links_of_a_unit_join_what_is_similar():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
    own = [np.unique(np.concatenate([base[rng.random(200) > d], rng.integers(0, 1 << 63, int(200 * d), dtype=np.uint64)]))
           for d in rng.uniform(0, 0.2, 90)]
    begin = np.concatenate([[0], np.cumsum([len(s) for s in own])])
    links = jaccard.similar(np.concatenate(own), begin, 85)
    label = list(range(90))
    for i, j in links:
        assert 100 * len(np.intersect1d(own[i], own[j])) >= 85 * len(np.union1d(own[i], own[j]))
        label = [label[j] if x == label[i] else x for x in label]
    for i in range(90):
        for j in range(i):
            if 100 * len(np.intersect1d(own[i], own[j])) >= 85 * len(np.union1d(own[i], own[j])):
                assert label[i] == label[j]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 500 + i) for i in range(50)] + [(3, 3), (9, 8), (8, 9)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**{i: 100 for i in range(100, 161)}, 7: 7, **{500 + i: 7 for i in range(50)}, 8: 8, 9: 8}
    assert got == want


def test_components_of_edges_that_differ_by_evaluation(spark):
    """Links of a group come in the order its rows arrive from other machines: any tree over
    the group, and not the same one when they are worked out again."""
    def tree(batches):
        for batch in batches:
            for base in batch.column(0).to_pylist():
                order = random.SystemRandom().sample(range(40), 40)
                pairs = [(base * 100 + order[i], base * 100 + order[i + 1]) for i in range(39)]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs]) for k in (0, 1)], names=["a", "b"])
    edges = spark.range(8).mapInArrow(tree, "a long, b long")
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {base * 100 + i: base * 100 for base in range(8) for i in range(40)}

