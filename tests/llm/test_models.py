import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesta.llm import langid, toxicity, urls
from attesta.llm.model_queries import URL_RULES

RNG = random.Random(1)
SOUNDS = {"aa": ["ka", "to", "mi", "nu"], "bb": ["sch", "ent", "ung", "gel"], "cc": ["é", "oux", "tre", "le"]}


def prose(lang, n=40):
    return " ".join("".join(RNG.choices(SOUNDS[lang], k=3)) for _ in range(n))


def test_languages_are_told_apart(spark, docs_of, odd):
    rows = [(lang, prose(lang)) for lang in SOUNDS for _ in range(40)] + [(None, "x"), ("aa", None)]
    model = langid.fit(spark.createDataFrame(rows, "lang string, text string"))
    assert model.languages == ["aa", "bb", "cc"]
    fresh = [(i, prose(lang, 5)) for i, lang in enumerate(list(SOUNDS) * 10)] + [(100 + (i or 0), t) for i, t in odd] + [(200, "12 ?!")]
    got = {r.doc_id: r for r in langid.identify(docs_of(fresh).withColumn("score", F.lit("old")), model).collect()}
    assert all(got[i].lang_pred == lang and got[i].score > 0.6 for i, lang in enumerate(list(SOUNDS) * 10))
    assert {(got[i].lang_pred, got[i].score) for i in (101, 102, 103, 200)} == {("und", 0.0)}
    assert all(0 <= r.score <= 1 and r.lang_pred for r in got.values())


def test_nothing_to_learn_from(spark, docs_of, odd):
    assert langid.fit(spark.createDataFrame([], "lang string, text string")) is None
    assert {r.lang_pred for r in langid.identify(docs_of(odd), None).collect()} == {"und"}
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs_of(odd), toxicity.fit(docs_of(odd), none)).collect()
    assert len(got) == len(odd) and {r.score for r in got} == {0.0}


def test_passes_are_corrected_for_false_ones():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 123, 4000).astype(np.uint8)
    bits = (rng.random((langid.SLOTS, 1)) < 0.8).astype(np.uint8)  # a filter so full that half of all n-grams pass
    for n in langid.GRAMS:
        hashes = langid.grams(text, np.array([0, len(text)]), n)[1]
        for i in range(langid.HASHES):
            bits[langid.slots(hashes[:len(hashes) * 2 // 5], i), 0] |= 2
    fill = np.array([np.mean(bits & 1), np.mean(bits >> 1)])
    model = langid.Filters(["full", "true"], bits, fill ** langid.HASHES, "full")
    at = np.array([0, len(text)])
    total, hits = model.counts(text, at)
    assert hits[0, 0] > hits[0, 1] > 0.39 * total[0]
    names, score = model.decide(text, at)
    assert names == ["true"] and score[0] > 0.9


def test_grams_stay_in_their_row():
    data = np.frombuffer(b"abxyz", np.uint8)
    for n in langid.GRAMS:
        place, hashes = langid.grams(data, np.array([0, 2, 2, 5]), n)
        alone = np.concatenate([langid.grams(data[a:b], np.array([0, b - a]), n)[1] for a, b in ((0, 2), (2, 2), (2, 5))])
        assert list(hashes) == list(alone)


def toxic_rows():
    rng = random.Random(4)
    plain = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(400):
        words = rng.choices(plain, k=rng.randint(20, 80))
        bad = i % 5 == 0
        if bad:
            words[3:3] = rng.sample(["nastyone", "nastytwo", "vilething", "foulness"], 2)
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxic_texts_are_found_with_evidence(spark, docs_of, odd):
    rows = toxic_rows()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:300]] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of([r[:2] for r in rows]), labels)
    got = {r.doc_id: r for r in toxicity.score(docs_of([r[:2] for r in rows] + [(1000 + (i or 0), t) for i, t in odd]), model).collect()}
    for i, _, y in rows[300:]:
        assert (got[i].score >= 0.3) == bool(y)
        assert not y or (got[i].evidence and all(0 < e.cosine <= 1 for e in got[i].evidence))
    assert all(got[1000 + (i or 0)].score < 0.3 for i, _ in odd)


@pytest.mark.parametrize("k", [1, 5, 15])
def test_neighbours_are_exact(k):
    rng = np.random.default_rng(k)
    terms, n = 40, 500
    dense = np.where(rng.random((n, terms)) < 0.1, rng.random((n, terms)), 0)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-12)
    e, t = np.nonzero(dense)
    model = toxicity.Examples.build(np.arange(terms, dtype=np.uint64), np.ones(terms), np.arange(n), np.zeros(n), e, t, dense[e, t])
    for _ in range(50):
        slots = np.sort(rng.choice(terms, 4, replace=False))
        weights = model.unit(slots, rng.integers(1, 5, 4))
        found, cosines = model.nearest(slots, weights, k)
        want = dense[:, slots] @ weights
        best = np.sort(want[want > 0])[::-1][:k]
        assert np.allclose(cosines, best) and np.allclose(want[found], cosines)


def test_urls(spark):
    rng = random.Random(3)
    good = [f"https://a{i}.net/en/{rng.randrange(99)}" for i in range(80)]
    bad = [f"http://x{i}.com/de/{rng.randrange(10 ** 9)}?a={i}&b=2&c=3" for i in range(80)]
    fixed = [None, "", "no scheme", "HTTP://Sub.EXAMPLE.net/en/a?x://y", "ftp://net", "x://net/", "x://planet/", "x://example.com/de/",
             "a://b.example.org/fr/#q", "://a.net#frag/", "q" * 5000]
    rows = [(i, u, "mine") for i, u in enumerate(good + bad + fixed + fixed)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").withColumn("length", F.lit("clash"))
    labels = pages.withColumn("label", F.when(F.col("page_id") < 80, 0).when(F.col("page_id") < 160, 1))
    model = urls.fit(labels)
    got = {r.page_id: r for r in urls.judge(pages, model, []).collect()}
    assert len(got) == len(rows)
    assert sum(got[i].verdict == ("block" if i >= 80 else "allow") for i in range(160)) > 155
    ruled = {r.page_id: r for r in urls.judge(pages, model, URL_RULES).collect()}
    want = {None: ("", "", None), "": ("", "", None), "no scheme": ("", "", None), "x://planet/": ("planet", "/", None),
            "HTTP://Sub.EXAMPLE.net/en/a?x://y": ("sub.example.net", "/en/a", "example.net/en/"), "ftp://net": ("net", "", None),
            "x://net/": ("net", "/", "net/"), "x://example.com/de/": ("example.com", "/de/", "example.com/de/"),
            "a://b.example.org/fr/#q": ("b.example.org", "/fr/", "org/fr/"), "://a.net#frag/": ("a.net", "", None)}
    for i, u, _ in rows[160:]:
        if u in want:
            assert (ruled[i].host, ruled[i].path, ruled[i].rule) == want[u]
            assert ruled[i].verdict == dict(URL_RULES).get(ruled[i].rule, got[i].verdict)
        assert got[i].length == "clash"


def test_urls_without_both_labels(spark):
    pages = spark.createDataFrame([(1, "a://b.c/d", None), (2, None, None)], "page_id long, url string, label int")
    assert {r.verdict for r in urls.judge(pages, urls.fit(pages), []).collect()} == {"allow"}
    assert urls.judge(pages.limit(0), urls.fit(pages.limit(0)), URL_RULES).count() == 0


def test_url_statistics_are_those_of_all_pages(spark, monkeypatch):
    rows = [(f"http://h{i}.zz{i % 50}/{i}", None) for i in range(2400)]  # each host and most suffixes rare, no labels
    rows += [(f"http://www.bad{i}.com/{j}", 1) for i in range(30) for j in range(2)]
    rows += [(f"http://www.good{i}.com/{j}", 0) for i in range(30) for j in range(2)] + [("http://hot.com/", 0)] * 480
    model = urls.fit(spark.createDataFrame(rows, "url string, label int"), max_urls=40)
    total, prior = len(rows), 60 / 600
    asked = [u for u, _ in rows[:100] + rows[-700:]]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(asked)], "id long, __url string").withColumns(
        {"__host": urls.host(F.col("__url")), "__path": urls.path(F.col("__url"))})

    def facts():
        got = {r.id: r for r in model.features(pages).collect()}
        assert len(got) == len(asked)
        return [tuple(round(got[i][c], 9) for c in ("suffix_share", "suffix_block", "host_block")) for i in range(len(asked))]

    def expected(u):
        if ".com/" not in u:
            return 48 / total, prior, prior
        name = u.split("/")[2].split(".")[-2]
        own = (2 + 5 * prior) / 7 if "bad" in name else 5 * prior / 7 if "good" in name else 5 * prior / 485
        return 600 / total, (60 + 5 * prior) / 605, own

    want = [tuple(round(x, 9) for x in expected(u)) if u in {r[0] for r in rows[2400:]} or ".zz" in u else None for u in asked]
    assert facts() == want
    monkeypatch.setattr(urls, "SMALL_ROWS", 0)
    assert facts() == want


def test_url_sample_has_copies_once(spark, monkeypatch):
    kept = {}
    put = urls.stored
    monkeypatch.setattr(urls, "stored", lambda df, name: kept.setdefault(name, put(df, name)))
    rows = [("http://hot.com/a", 1)] * 300 + [(f"http://a{i}.com/", i % 2) for i in range(20)]
    urls.fit(spark.createDataFrame(rows, "url string, label int"), trees=1)
    assert kept["url-sample"].count() == 21
