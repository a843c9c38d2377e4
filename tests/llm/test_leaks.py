import random
import re

import numpy as np
import pytest

from attesta.llm.fmindex import FMIndex, find_leaks, remove_leaks

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(ASCII))


def plain(rows, items, window):
    phrases = {}
    for name, text in items:
        w = words(text)
        for j in range(max(len(w) - window, 0) + 1 if w else 0):
            phrases.setdefault(tuple(w[j:j + window]), set()).add(name)
    out = []
    for i, text in rows:
        w, hit, named = words(text), set(), set()
        for p, owners in phrases.items():
            for j in range(len(w) - len(p) + 1):
                if tuple(w[j:j + len(p)]) == p:
                    hit.update(range(j, j + len(p)))
                    named |= owners
        out.append((i, len(w), len(hit), sorted(str(n) for n in named if n is not None)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_hits_are_those_of_a_plain_search(spark, docs_of, odd, block_bytes):
    rng = random.Random(6)
    pool = ["aa", "bb", "cc", "dd", "Éé", "x1"]
    items = [(i, " ".join(rng.choices(pool, k=rng.randint(1, 9)))) for i in range(12)] + [(50, None), (51, " ..."), (52, "aa-BB")]
    rows = odd + [(100 + i, rng.choice([" ", ", ", "\n"]).join(rng.choices(pool + ["zz"], k=rng.randint(0, 40)))) for i in range(60)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = find_leaks(docs_of(rows), bench, window=4, block_bytes=block_bytes).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got), key=str) == sorted(plain(rows, items, 4), key=str)
    for r in got:
        raw = (r.text or "").encode()
        assert sum(len(words(raw[s.start:s.end].decode())) for s in r.spans) == r.n_hit


def test_leaks_are_cut_out_and_the_rest_stays(spark, docs_of, odd):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    rows = odd + [(70, "Before. ONE two, three four five six seven eight nine ten! after"), (71, "one two three four five")]
    got = {r.doc_id: r.text for r in remove_leaks(docs_of(rows), bench).collect()}
    assert got[70] == "Before. ! after" and got[71] == "one two three four five" and got[6] == odd[5][1] and got[1] is None
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_hit for r in find_leaks(docs_of(rows), none).collect()} == {0}
    assert find_leaks(docs_of([]), bench).count() == 0


def test_ranges_and_positions_of_an_index():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(0, 5, 600), 0)
    index = FMIndex(text, 4)
    for size in (1, 2, 3, 7):
        p = rng.integers(1, 5, (40, size))
        lo, hi = index.search(p, np.full(40, size))
        for q, a, b in zip(p, lo, hi, strict=True):
            want = [i for i in range(len(text) - size + 1) if (text[i:i + size] == q).all()]
            assert sorted(index.locate(np.arange(a, b))) == want
