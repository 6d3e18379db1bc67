import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from vectables.llm import phrases

from tests.llm.reference import lower


def brute(rows, least, longest=5, share=100, top=2000):
    n, counts = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    counts[lang, tuple(w[i: i + m])] += 1
    counts = {k: v for k, v in counts.items() if v >= least}
    longer = Counter()
    for (lang, p), a in counts.items():
        for m in range(2, len(p)):
            for i in range(len(p) - m + 1):
                longer[lang, p[i: i + m]] = max(longer[lang, p[i: i + m]], a)
    found = defaultdict(list)
    for (lang, p), a in counts.items():
        if len(p) > 1 and 100 * longer[lang, p] < share * a:
            score, k = min((1000 * a * n[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
            found[lang].append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
    return {(lang, i, p.decode(), -a, left, right, n[lang], -score) for lang, ps in found.items()
            for i, (score, a, p, left, right) in enumerate(sorted(ps)[:top], 1)}


def table(n, seed=1):
    rng = random.Random(seed)
    vocabulary = ["the", "a", "of", "New", "york", "ÉTÉ", "über", "x1", "it's", "日本"]
    rows = []
    for i in range(n):
        parts = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            parts.insert(rng.randint(0, len(parts)), "best of the west end")
        for _ in range(rng.randint(0, 4)):
            parts.insert(rng.randint(0, len(parts)), rng.choice([".", ", ", "\n", "!?", " \t ", "\x0b", "\x1f", "x;y"]))
        rows.append((" ".join(parts), rng.choice(["en", "fr", None, "und"])))
    return rows + [(None, "en"), ("", None), (" . , ", "de"), ("same words same words " * 3000, "en"), ("same words same words " * 3000, "en")]


def found(df, **kind):
    out = phrases.collocations(df, "text", "lang", **kind)
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in out.collect()}


SCHEMA = "text string, lang string, key long, n long, keys string, rank int, a int, k1 int, score string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, 2, "k", 3, 4, 5, "s") for r in table(400)], SCHEMA).repartition(5).cache()


@pytest.mark.parametrize("kind", [{"least": 5}, {"least": 40, "top": 7}, {"least": 20, "share": 60, "longest": 3}])
def test_equals_brute_force(docs, kind):
    want = brute(table(400), **kind)
    assert want and found(docs, **kind) == want


def test_many_ranges_and_small_buffers(docs, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 50)
    monkeypatch.setattr(phrases, "ROUTED", 40)
    assert found(docs, least=8) == brute(table(400), 8)


def test_full_bitmaps_lose_nothing(docs, monkeypatch):
    monkeypatch.setattr(phrases.Bitmap, "bits_for", staticmethod(lambda n: 7))
    assert found(docs, least=8) == brute(table(400), 8)


def test_scores_beyond_64_bits_are_exact(spark):
    sql = "(cast(1000 * a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"
    a, n, left, right = 123_456_789_012, 9_876_543_210_987, 223_456_789_013, 323_456_789_017
    got = spark.createDataFrame([(a, n, left, right)], "a long, n long, l long, r long").selectExpr(sql).first()[0]
    assert got == 1000 * a * n // (left * right)


def test_empty_tables(spark):
    assert found(spark.createDataFrame([], SCHEMA), least=1) == set()
    assert found(spark.createDataFrame([(None, None), ("", "en"), ("one", "en")], "text string, lang string"), least=1) == set()


def test_quicksort_of_pointers():
    rng = np.random.default_rng(2)
    keys = rng.zipf(1.4, (5, 3000)).clip(0, 40).astype(np.int64)
    length = rng.integers(2, 6, 3000)
    for j in range(5):
        keys[j][length <= j] = 0
    weight = rng.integers(1, 4, 3000)
    want = Counter()
    for i in range(3000):
        for d in range(2, length[i] + 1):
            want[tuple(keys[:d, i].tolist())] += int(weight[i])
    got = phrases.frequent_prefixes(keys, weight, 15)
    assert {tuple(keys[:d, i].tolist()): n for i, d, n in got} == {p: n for p, n in want.items() if n >= 15}
    assert phrases.frequent_prefixes(np.zeros((5, 0), np.int64), np.zeros(0, np.int64), 1) == []


def random_rows(n, words=40):
    """Pairs that are frequent, in texts of words that go on at random, and one phrase of five words."""
    rng = random.Random(3)
    return [(" ".join([*rng.choices([f"w{i}" for i in range(words)], k=100), ".", "a b c d e"]), "en") for _ in range(n)]


def test_suffixes_grow_with_frequent_phrases(spark, tmp_path):
    """However many texts there are, a task names a frequent phrase once; before, it named each way in which a pair goes on."""
    made = {}
    for n in (600, 3000):
        space = phrases.Workspace(spark, "phrases")
        space.root = str(tmp_path / str(n))
        rows = random_rows(n)
        docs = spark.createDataFrame(rows, "text string, lang string").repartition(12)
        docs.write.parquet(f"{space.root}/docs")
        docs = spark.read.parquet(f"{space.root}/docs")
        least = n // 60         # 40 * 40 pairs of about n / 16 each are frequent, runs of three random words are not
        _, _, counted = phrases.phrase_counts(docs, "text", "lang", least, 5, space)
        frequent = counted.count()
        assert frequent == 40 * 40 + 10
        made[n] = spark.read.parquet(space.path("suffixes")).count()
        assert made[n] <= 1.1 * frequent * phrases.parallelism(spark)
        assert found(docs, least=least) == brute(rows, least)
    assert made[3000] <= 3 * made[600]


def test_truncated_suffixes_keep_every_frequent_run(docs):
    assert brute(table(400), 300) and found(docs, least=300) == brute(table(400), 300)


def test_bucket_counts_add_up_over_tasks():
    counts = np.zeros(2 * phrases.BLOCK, dtype=np.uint16)
    counts[[1, 5000, 5001]] = 150, 299, 150
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([c.tobytes() for c in counts.reshape(2, -1)])], names=["block", "buckets"])
    got, = phrases._full_buckets(300)(iter([batch, batch]))
    bits = {b: np.flatnonzero(np.unpackbits(np.frombuffer(m, np.uint8), bitorder="little")).tolist()
            for b, m in zip(got["block"].to_pylist(), got["buckets"].to_pylist())}
    assert bits == {0: [1], 1: [5000 - phrases.BLOCK, 5001 - phrases.BLOCK]}


def test_counts_are_merged_before_they_are_passed_on(monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 100)
    held, keys = phrases._Counts(1), np.arange(1, 41, dtype=np.uint64)
    for _ in range(50):
        held.add(keys[None, :], keys)
        assert not held.full() and held.n <= 100
    (rows, n), = held.take()
    assert rows[0].tolist() == keys.tolist() and set(n.tolist()) == {50}
    held.add(np.arange(101, dtype=np.uint64)[None, :], np.arange(101, dtype=np.uint64))
    assert held.full()
