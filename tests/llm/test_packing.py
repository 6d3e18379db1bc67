import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from vectables.llm import packing

ODD = ["", None, " lead", "trail ", "a  b", "x y z", "a\tb c", "end <|endoftext|> q", "a \n b", "é è ü", "’s it's  ", "　x y",
       " ", "\n", "don't we'll 123 45 6,7", "ok\r\nnext line here", "the the the", "tiontion the. And of\nthe"]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizers(tokenizer, hard_rows, monkeypatch):
    texts = ODD + [t for _, t, *_ in hard_rows]
    monkeypatch.setattr(packing, "CACHE_UNITS", 50)
    bpe = packing.ByteBpe()
    for part in (texts, texts[::-1], ["plain words only"], []):
        ids, bounds = bpe.encode(pa.array(part, pa.string()))
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in part]
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want


def test_whole_table_has_the_same_ids(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    got = {}
    for r in packing.pieces(docs, "doc_id", "text", with_ids=True).collect():
        got.setdefault(r["id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"], r["ids"]))
    for r in rows:
        ids = tokenizer.encode(r["text"], add_special_tokens=False).ids + [0]
        parts = sorted(got[r["doc_id"]])
        assert sum((p[4] for p in parts), []) == ids
        assert [p[1] for p in parts] == [sum(q[2] for q in parts[:i]) for i in range(len(parts))]
        assert all(p[2] == len(p[4]) == (2048 if i else len(ids) - 2048 * (len(parts) - 1)) for i, p in enumerate(parts))
        assert all(p[3] == zlib.crc32(np.array(p[4], dtype="<u4").tobytes()) for p in parts)


def test_best_fit_takes_the_tightest_bin():
    bins, n = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert n == 2 and bins[0] == bins[2] and bins[1] == bins[3] == bins[4]
    assert packing.best_fit(np.array([], dtype=np.int64), 10)[1] == 0
    rng = random.Random(1)
    sizes = np.array([rng.randint(1, 100) for _ in range(500)])
    bins, n = packing.best_fit(sizes, 100)
    assert np.bincount(bins, sizes).max() <= 100 and n <= sizes.sum() / 100 * 1.05


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("partitions", [1, 40])
def test_packing_is_gapless_and_tight(spark, monkeypatch, partitions):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 400)
    rng = random.Random(4)
    rows = [(i, 0, 0, rng.choice([rng.randint(1, 100), rng.randint(30, 70)]), i) for i in range(2000)]
    cut = spark.createDataFrame(rows, "id long, piece int, start long, length long, ids_crc32 long").repartition(partitions)
    got = packing.pack(cut, 100).collect()
    assert sorted((r["id"], r["length"], r["ids_crc32"]) for r in got) == sorted((r[0], r[3], r[4]) for r in rows)
    least = sum(r[3] for r in rows) / 100
    assert check(got, 100) <= least * 1.06


def test_items_that_do_not_combine(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ITEMS", 50)
    cut = spark.createDataFrame([(i, 0, 0, 60, i) for i in range(300)], "id long, piece int, start long, length long, ids_crc32 long").repartition(12)
    assert check(packing.pack(cut, 100).collect(), 100) == 300


def test_hard_rows(hard_docs, hard_rows, no_docs):
    got = packing.pack(packing.pieces(hard_docs, "doc_id", "text")).collect()
    check(got, 2048)
    assert sum(r["piece"] == 0 for r in got) == len(hard_rows)
    empty = [r for r in got if r["id"] in (600, 601)]
    assert [(r["piece"], r["length"], r["ids_crc32"]) for r in empty] == [(0, 1, zlib.crc32(b"\0\0\0\0"))] * 2
    assert packing.pack(packing.pieces(no_docs, "doc_id", "text")).collect() == []
