import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import words
from tests.llm.reference import components, jaccard, shingle_set
from vectables.llm import parity
from vectables.llm.text import mix


def brute(rows, k, num, den):
    """Component of each row by (id, text); rows with a null id are left out."""
    some = [(i, t) for i, t, *_ in rows if i is not None]
    sets = [shingle_set(t, k) for _, t in some]
    root = components(len(some), lambda a, b: jaccard(sets[a], sets[b]) * den >= num)
    least = {}
    for (i, _), r in zip(some, root):
        least[r] = min(i, least.get(r, i))
    return sorted((i, len(s), least[r]) for (i, _), s, r in zip(some, sets, root))


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_components_match_all_pairs(hard_docs, hard_rows, k, num):
    got = parity.jaccard_components(hard_docs, "doc_id", "text", k, num, 100).collect()
    assert sorted((r["id"], r["n_shingles"], r["component"]) for r in got if r["id"] is not None) == brute(hard_rows, k, num, 100)
    assert sorted(r["n_shingles"] for r in got if r["id"] is None) == sorted(len(shingle_set(t, k)) for i, t, *_ in hard_rows if i is None)
    assert all(r["component"] is None for r in got if r["id"] is None)


def test_group_whose_members_do_not_link_to_one_pivot(spark):
    """Variants of one text that link to the original but hardly to each other, over several sides of blocks."""
    rng = random.Random(3)
    base = words(rng, 200).split()
    rows = []
    for i in range(60):
        edited = list(base)
        for j in rng.sample(range(0, 200, 4), 0 if i == 31 else rng.randint(1, 4)):
            edited[j] = f"e{i}x{j}"
        rows.append((i, " ".join(edited)))
    side, parity.SIDE = parity.SIDE, 16
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = parity.jaccard_components(docs, "doc_id", "text").collect()
    finally:
        parity.SIDE = side
    assert sorted((r["id"], r["n_shingles"], r["component"]) for r in got) == brute(rows, 3, 90, 100)


def test_empty_table(no_docs):
    assert parity.jaccard_components(no_docs, "doc_id", "text").collect() == []


def test_linking_sets_share_a_block_and_sketches_bound_the_difference():
    rng = np.random.default_rng(2)
    for num in (80, 90):
        bands = parity.Bands(num, 100)
        for _ in range(150):
            n = int(rng.integers(1, 400))
            a = rng.integers(0, 1 << 52, n, dtype=np.uint64)
            cut = int(rng.integers(0, n // 8 + 1))
            b = np.concatenate([a[cut:], rng.integers(0, 1 << 52, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            common = len(np.intersect1d(a, b))
            union = len(a) + len(b) - common
            if not len(b) or 100 * common < num * union:
                continue
            flat, bounds = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            at, band = bands.joined(np.diff(bounds))
            blocks, held, edges = parity.sketch(flat, bounds, at, band, bands, wide=True)
            keys = [set(), set()]
            for i, (s, g) in enumerate(zip(at, band)):
                x, m = blocks[edges[i]: edges[i + 1]], held[edges[i]: edges[i + 1]]
                spare = (m == 0).sum() >= bands.blocks[g] - bands.apart[g]
                keys[s] |= {(g, j, int(v)) for j, v in enumerate(x) if m[j] or spare}
            assert keys[0] & keys[1]
            g = bands.of(np.array([min(len(a), len(b))]))
            both = parity.sketch(flat, bounds, np.array([0, 1]), np.repeat(g, 2), bands, wide=False)[0].reshape(2, -1)
            assert np.bitwise_count(both[0] ^ both[1]).sum() <= union - common


def test_linking_sets_join_a_block_in_common_and_bitmaps_bound_the_difference():
    rng = np.random.default_rng(4)
    linked = 0
    for num in (80, 90):
        bands = parity.Bands(num, 100)
        for turn in range(600):
            n = int(rng.integers(1, 60 if turn % 2 else 600))
            a = np.unique(rng.integers(0, 1 << 52, n, dtype=np.uint64))
            cut, more = (int(x) for x in rng.integers(0, n // 5 + 2, 2) * (rng.random(2) < 0.7))
            b = np.unique(np.concatenate([a[cut:], rng.integers(0, 1 << 52, more, dtype=np.uint64)]))
            common = len(np.intersect1d(a, b))
            apart = len(a) + len(b) - 2 * common
            flat, bounds = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
            maps = parity.bitmaps(flat, bounds)
            assert parity.bits_apart(maps[:1], maps[1:])[0] <= apart
            if not len(b) or 100 * common < num * (common + apart):
                continue
            linked += 1
            at, band = bands.joined(np.diff(bounds))
            blocks, held, edges = parity.sketch(flat, bounds, at, band, bands, wide=True)
            member = np.repeat(np.arange(len(at)), np.diff(edges))
            where = np.arange(len(blocks)) - edges[:-1][member]
            keys = mix(blocks ^ mix((band.astype(np.uint64)[member] << np.uint64(40)) + where.astype(np.uint64)))
            use = parity.joins(keys, held, member, edges, bands.differ(np.diff(bounds)[at], band))
            assert set(keys[use[at[member[use]] == 0]]) & set(keys[use[at[member[use]] == 1]])
    assert linked > 200


def test_texts_with_common_runs_of_words_seldom_meet(monkeypatch):
    """Unrelated texts share runs of common words. Where one such run makes a block, all texts come to lie in one cluster."""
    rng = random.Random(6)
    common, rare = words(rng, 8).split(), [f"w{i}" for i in range(2000)]
    texts = [" ".join(rng.choice(common if rng.random() < 0.85 else rare) for _ in range(rng.randint(250, 350))) for _ in range(1000)]
    monkeypatch.setattr(parity.TaskContext, "get", lambda: type("task", (), {"partitionId": lambda self: 0})())
    met = list(parity._blocks(5, parity.Bands(80, 100), 64)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])))
    assert sum(len(x) for m in met for x in m["left"].to_pylist()) < len(texts) / 2
