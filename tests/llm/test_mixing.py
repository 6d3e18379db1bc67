import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.reference import words_of
from vectables.llm import mixing


def test_targets():
    assert mixing.targets([], []) == []
    assert mixing.targets([0, 0], [5, 2]) == [0.0, 0.0]
    got = mixing.targets([10, 1000, 0], [5.0, 2.0, 1.0])
    assert got == [30.0, 980.0, 0.0]
    got = mixing.targets([100, 100, 100], [5.0, 2.0, 1.0])
    assert got == [187.5, 75.0, 37.5]
    assert mixing.targets([1, 1, 2000], [5.0, 5.0, 1.0])[:2] == [3.0, 3.0]


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(n):
    got = mixing.permuted(np.arange(n), n, [3, 1])
    assert sorted(got.tolist()) == list(range(n))
    if n > 100:
        assert (got != np.arange(n)).mean() > 0.9 and (got != mixing.permuted(np.arange(n), n, [3, 2])).any()


def test_mix_is_near_its_targets_and_repeats(hard_docs, hard_rows, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 16)
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 10)
    rows = mixing.mix(hard_docs, "doc_id", "source", "text").collect()
    assert len(rows) == len(hard_rows)
    assert sorted(r["size"] for r in rows) == sorted(len(words_of(t)) for _, t, *_ in hard_rows)
    sizes = {}
    for _, t, _, s in hard_rows:
        sizes[s] = sizes.get(s, 0) + len(words_of(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    want = dict(zip(order, mixing.targets([sizes[s] for s in order], [mixing.WEIGHTS[i % 3] for i in range(len(order))])))
    taken = {}
    for r in rows:
        s = None if r["src"] == "n" else r["src"][1:]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 3 * r["size"]
        for x in r["ranges"]:
            assert 0 <= x["lo"] < x["hi"] <= r["size"]
        by_turn = {}
        for x in r["ranges"]:
            by_turn.setdefault(x["turn"], []).append((x["lo"], x["hi"]))
        for parts in by_turn.values():      # no word twice in one pass
            parts.sort()
            assert all(a[1] <= b[0] for a, b in zip(parts, parts[1:]))
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in order:
        assert abs(taken[s] - want[s]) <= mixing.BLOCK
    again = mixing.mix(hard_docs.repartition(5), "doc_id", "source", "text").collect()
    key = lambda r: (str(r["id"]), r["size"], r["taken"], r["src"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_empty(no_docs):
    assert mixing.mix(no_docs, "doc_id", "source", "text").collect() == []


def test_slots_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 64)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"), F.lit(100).cast("long").alias("size"))
    slots = mixing.shard_slots(spark, mixing.plan(docs, "source", "size"))
    per_task = slots.groupBy(F.spark_partition_id()).count().collect()
    assert len(per_task) > 20 and max(r["count"] for r in per_task) < slots.count() / 8
