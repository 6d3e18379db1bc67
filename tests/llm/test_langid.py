import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import words
from vectables.llm import langid
from vectables.llm.store import Workspace
from vectables.llm.text import Texts

ITEMS = "id long, host string, domain string, declared string, suffix string, text string"


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(2)
    rows = [(lang, words(rng, 80, lang)) for lang in "ab" for _ in range(40)] + [(None, "x"), ("a", None), ("b", "")]
    return langid.fit(spark.createDataFrame(rows, "lang string, text string"), "text", "lang", sample=30)


def identify(spark, rows, model):
    return {r["id"]: r for r in langid.identify(spark.createDataFrame(rows, ITEMS), model, Workspace(spark, "langid-test")).collect()}


def test_held_out_accuracy_and_rejection(spark, model):
    rng = random.Random(7)
    rows = [(i, f"h{i % 3}.{'ab'[i % 2]}", "ab"[i % 2], None, None, words(rng, 15, "ab"[i % 2])) for i in range(60)]
    rows += [(100, None, None, None, None, "12 ## 99 *** 5"), (101, "h0.a", "a", "a", "x", None), (102, "h0.a", "a", None, None, ""),
             (103, None, None, None, None, "zqxj vkwz jqxz wvkq zzqj xkvw qjzx " * 20)]
    got = identify(spark, rows, model)
    assert all(got[i]["lang"] == got[i]["text_lang"] == "ab"[i % 2] and got[i]["accepted"] for i in range(60))
    assert not any(got[i]["accepted"] for i in range(100, 104)) and got[103]["lang"] == "und"


def test_other_evidence_decides_where_the_text_says_little(spark, model):
    """A word of both languages goes with its host, and with its declaration against no host."""
    from itertools import product

    rng = random.Random(3)
    pairs = ["".join(p) for p in product("aeiounrst", repeat=2)]
    bucket, bounds = langid.trigrams(Texts(pa.array(pairs)))
    apart = [abs(float(np.diff(model.log[:2, bucket[a:b]].astype(np.float64).sum(axis=1))[0])) for a, b in zip(bounds, bounds[1:])]
    word = pairs[int(np.argmin(apart))]
    assert min(apart) < 1
    rows = [(i, "only.a", "a", "a", "ay", words(rng, 40, "a")) for i in range(40)] + [(50 + i, "only.b", "b", "b", "be", words(rng, 40, "b")) for i in range(40)]
    rows += [(200, "only.a", "a", None, None, word), (201, "only.b", "b", None, None, word), (202, None, None, "a", None, word), (203, None, None, "b", None, word),
             (204, None, None, None, "ay", word), (205, None, None, None, "be", word), (206, "new.b", "b", None, None, word)]
    got = identify(spark, rows, model)
    assert [got[i]["lang"] for i in range(200, 207)] == ["a", "b", "a", "b", "a", "b", "b"]


def test_posterior_is_bayes_rule_for_one_row(spark, model):
    text = "there enre"
    got = identify(spark, [(1, None, None, None, None, text)], model)[1]
    bucket, _ = langid.trigrams(Texts(pa.array([text])))
    logs = model.log[:, bucket].astype(np.float64).sum(axis=1)
    prior = np.array([(1 - langid.UNKNOWN) / 2] * 2 + [langid.UNKNOWN])
    own = np.exp(logs - logs.max()) * prior
    own /= own.sum()
    overall = (own + langid.SMOOTH * prior) / (1 + langid.SMOOTH)
    fused = np.exp(logs - logs.max()) * overall
    assert got["posterior"] == pytest.approx((fused / fused.sum()).max(), rel=1e-5)


def test_pages_and_documents(spark, hard_docs, model):
    pages = spark.createDataFrame([(1, "http://m.x.example.org:80/a", "<html class=q LANG='EN-us'><script>var a='<p>';</script><p>the&amp;re</p><!-- no --></html>"),
                                   (2, None, None), (None, "nonsense", "<html><body>x")], "page_id long, url string, html string")
    rows = {r["id"]: r for r in langid.page_items(pages, "page_id", "url", "html").collect()}
    assert (rows[1]["host"], rows[1]["domain"], rows[1]["suffix"], rows[1]["declared"]) == ("m.x.example.org", "example.org", "org", "en")
    assert rows[1]["text"].split() == ["the", "re"] and rows[2]["text"] is None and rows[None]["host"] is None
    items = langid.document_items(hard_docs, "doc_id", "source", "lang", "text")
    assert langid.identify(items, model, Workspace(spark, "langid-test")).count() == hard_docs.count()


def test_no_rows_and_no_labels(spark, model, no_docs, hard_docs):
    empty = langid.document_items(no_docs, "doc_id", "source", "lang", "text")
    assert langid.identify(empty, model, Workspace(spark, "langid-test")).collect() == []
    blank = langid.fit(no_docs, "text", "lang")
    got = langid.identify(langid.document_items(hard_docs, "doc_id", "source", "lang", "text"), blank, Workspace(spark, "langid-test")).collect()
    assert len(got) == hard_docs.count() and not any(r["accepted"] for r in got) and {r["lang"] for r in got} == {"und"}


@pytest.mark.parametrize("heavy", [1, 4, 4096])
def test_fusion_equals_brute_force(spark, model, monkeypatch, heavy):
    """All evidence row by row in numpy: hot and rare hosts, rows without text, host or domain, repeated rows, and hosts of each side
    of the cut between those that travel and those that are joined."""
    monkeypatch.setattr(langid, "HEAVY", heavy)
    rng = random.Random(5)
    rows = []
    for i in range(120):
        host = rng.choice(["hot.a"] * 5 + ["x.a", "y.b", f"h{i}.b", None])
        rows.append((i, host, host and host[-1] if i % 11 else None, rng.choice(["a", "b", "zz", None]), rng.choice(["s", "t", None]),
                     rng.choice([None, "", "7 7", words(rng, 3, "a"), words(rng, 2, "b"), words(rng, 60, "ab"[i % 2])])))
    rows += [(500 + i, *rows[i][1:]) for i in range(10)] + [(600, "empty.c", "c", None, None, None)]
    got = identify(spark, rows, model)

    size, smooth = 3, langid.SMOOTH
    prior = np.array([(1 - langid.UNKNOWN) / 2] * 2 + [langid.UNKNOWN])
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    bucket, bounds = langid.trigrams(Texts(pa.array([r[5] for r in rows], pa.string())))
    n = np.diff(bounds)
    logs = np.array([model.log[:, bucket[a:b]].astype(np.float64).sum(axis=1) for a, b in zip(bounds, bounds[1:])]) \
        * np.minimum(1, langid.WEIGHT / np.maximum(n, 1))[:, None]
    own = np.array([soft(x + np.log(prior)) for x in logs])

    def sums(of):
        out = {}
        for i, r in enumerate(rows):
            if n[i] and None not in of(r):
                out[of(r)] = out.get(of(r), 0) + own[i]
        return out

    hosts, domains = sums(lambda r: (r[2], r[1])), sums(lambda r: (r[2],))
    every = own[n > 0].sum(axis=0)
    base = (every + smooth * prior) / (every.sum() + smooth)
    smoothed = lambda counts, parent: (counts + smooth * parent) / (counts.sum() + smooth)
    for i, r in enumerate(rows):
        total = logs[i].copy()
        p = base
        if (r[2], r[1]) in hosts:
            p = smoothed(np.maximum(0, hosts[r[2], r[1]] - (own[i] if n[i] else 0)), smoothed(domains[r[2],], base))
        total += np.log(p)
        for col in (3, 4):
            seen = sums(lambda x: (x[col],)).get((r[col],))
            if seen is not None:
                total += np.log((seen + smooth * seen.sum() / every.sum()) / (every + smooth))
        fused = soft(total)
        assert abs(got[r[0]]["posterior"] - fused.max()) < 1e-9
        assert got[r[0]]["lang"] == [*model.languages, "und"][int(fused.argmax())]
        assert got[r[0]]["accepted"] == bool(fused.argmax() < size - 1 and fused.max() >= langid.LEAST and n[i] > 0)
