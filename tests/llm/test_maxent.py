import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.reference import words_of
from vectables.llm import maxent


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


def scored(docs):
    held_out = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).alias("held")
    return maxent.score(docs.select("*", held_out), "doc_id", "text", "held").collect()


@pytest.mark.parametrize("head", [1 << 18, 5])
def test_base_scores_match_brute_force(hard_docs, hard_rows, monkeypatch, head):
    monkeypatch.setattr(maxent, "HEAD", head)
    got = scored(hard_docs)
    tokens = [(i, [*words_of(t), None]) for i, t, *_ in hard_rows]
    counts = Counter(w for i, ws in tokens if not held(i) for w in ws)
    total, scale = sum(counts.values()), sum(counts.values()) + 0.1 * (len(counts) + 1)
    want = sorted((str(i), held(i), len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 0.1) / scale) for w in ws), 6)) for i, ws in tokens)
    assert sorted((str(r["id"]), r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {total}
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)


def test_model_is_better_than_its_base_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = [r for r in scored(docs) if r["held_out"]]
    assert len(out) > 50
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out) + 0.2 * sum(r["n_tokens"] for r in out)


def test_class_shares_sum_to_one_and_unseen_events_are_counted():
    rng = np.random.default_rng(1)
    w = rng.standard_normal((maxent.ROWS, maxent.CLASSES)).astype(np.float32)
    rows = maxent.features(maxent.Tokens(pa.array(["the cat sat on", "", None, "a"])))
    assert rows.shape == (4, 9)
    assert np.allclose(np.exp(maxent._log_shares(w, rows)).sum(axis=1), 1, atol=1e-5)
    t = maxent.Tokens(pa.array(["b a", None]))
    assert t.hash[[2, 3]].tolist() == [int(maxent.END)] * 2 and t.ending[[2, 3]].tolist() == [0, 0]
    assert t.before(1).tolist() == [0, t.ending[0], t.ending[1], 0]


def test_nothing_to_learn_from(spark, no_docs):
    assert scored(no_docs) == []
    i = next(i for i in range(100) if held(i))
    row = scored(spark.createDataFrame([(i, "one two")], "doc_id long, text string"))[0]
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0)
    assert row["base_score"] == pytest.approx(0.0) and math.isfinite(row["score"])


def test_a_counting_task_holds_little_beside_its_distinct_words():
    texts = [" ".join(map(str, range(i, i + 25_000))) for i in range(0, 2_000_000, 12_500)]       # nearly every word is in two texts
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i: i + 10])], names=["text"]) for i in range(0, len(texts), 10)]
    list(maxent._count(iter(batches[:1])))
    tracemalloc.start()
    words = tokens = cells = 0
    for b in maxent._count(iter(batches)):
        kind, n = b["kind"].to_numpy(), b["n"].to_numpy()
        words, tokens, cells = words + (kind == 0).sum(), tokens + n[kind == 0].sum(), cells + n[kind == 1].sum()
        assert b.num_rows <= 100_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tokens == len(texts) * 25_001 and 2_012_500 < words < 2_100_000
    assert cells == 2 * tokens
    assert peak < 200e6


def test_what_follows_is_counted_if_the_last_batch_passes_the_words_on(monkeypatch):
    for name in ("_MEMORY", "_WAITING"):
        monkeypatch.setattr(maxent, name, 1, raising=False)
    batch = pa.RecordBatch.from_arrays([pa.array(["one two three", "two"])], names=["text"])
    rows = [r for b in maxent._count(iter([batch, batch])) for r in b.to_pylist()]
    assert sum(r["n"] for r in rows if r["kind"] == 0) == 12
    assert sum(r["n"] for r in rows if r["kind"] == 1) == 24


def test_every_round_learns_from_all_training_texts(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat and a dog lay by the door " * 5, False)], "doc_id long, text string, held boolean")
    once, often = (maxent.score(docs, "doc_id", "text", "held", rounds=n).first()["score"] for n in (1, 4))
    assert often > once + 1
