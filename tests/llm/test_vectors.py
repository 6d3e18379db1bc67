import numpy as np
import pytest
from pyspark.sql import functions as F

from vectables.llm import pstable, vptree
from vectables.llm.vectors import unit

SCHEMA = "vec_id long, embedding array<float>, label int, id string, key string, vector int, table int, shard int, mult int"


def rows_with_everything():
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(16).astype(np.float32).tolist(), int(i % 3)) for i in range(300)]
    for g in range(8):                      # clusters of near copies around the limit
        c = rng.standard_normal(16)
        rows += [(1000 + 50 * g + j, (c + rng.standard_normal(16) * 0.08).astype(np.float32).tolist(), 1) for j in range(20)]
    hot = rng.standard_normal(16).astype(np.float32)
    rows += [(2000 + i, hot.tolist(), 2) for i in range(60)]
    rows += [(2100 + i, (hot * 2).tolist(), 2) for i in range(3)]                   # the same direction
    rows += [(3000, None, 1), (3001, [0.0] * 16, 1), (3002, [float("nan")] + [1.0] * 15, 1), (3003, [None] + [1.0] * 15, 1),
             (3004, [float("inf")] + [1.0] * 15, 1), (3005, [], 1), (3006, hot.tolist(), None), (None, hot.tolist(), 2), (3007, [1.0, 0.0], 2),
             (3008, [1.0, 0.001], 2), (3009, [1e-30] * 16, 0), (3010, [3e38] * 16, 0), (4000, hot.tolist(), 2), (4000, hot.tolist(), 2)]
    return rows


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, "x", "k", 1, 2, 3, 4) for r in rows_with_everything()], SCHEMA).repartition(3).cache()


def cosines(rows):
    """Matrix of cosines; minus one for vectors of different lengths."""
    out = np.full((len(rows), len(rows)), -1.0)
    for dim in {len(r[1]) for r in rows}:
        at = [i for i, r in enumerate(rows) if len(r[1]) == dim]
        u = unit(np.array([rows[i][1] for i in at], dtype=np.float32).astype(np.float64))
        out[np.ix_(at, at)] = u @ u.T
    return out


@pytest.mark.parametrize("side", [512, 7])
def test_near_duplicates_match_all_pairs(table, monkeypatch, side):
    monkeypatch.setattr(pstable, "SIDE", side)
    rows = rows_with_everything()
    ok = [r for r in rows if usable(r[1]) and r[0] is not None and r[2] is not None]
    label = np.array([r[2] for r in ok])
    link = (cosines(ok) >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    ids = np.array([r[0] for r in ok])
    comp = ids.copy()
    while True:
        new = np.minimum(comp, np.where(link, comp[None, :], 1 << 60).min(axis=1))
        if (new == comp).all():
            break
        comp = new
    want = [(int(i), int(n), int(c), bool(i == c)) for i, n, c in zip(ids, link.sum(axis=1), comp)]
    want += [(r[0], 0, r[0], r[0] is not None) for r in rows if not (usable(r[1]) and r[0] is not None and r[2] is not None)]
    got = pstable.near_duplicates(table, "vec_id", "embedding", "label").collect()
    assert sorted(str(tuple(r)) for r in got) == sorted(map(str, want))


def brute_nearest(rows, k):
    ok = [r for r in rows if usable(r[1]) and r[0] is not None]
    cos, ids = cosines(ok), np.array([r[0] for r in ok])
    out = []
    for q in sorted({r[0] for r in ok if r[0] % 50 == 0}):
        i = min((i for i in range(len(ok)) if ids[i] == q), key=lambda i: ok[i][1])
        can = [j for j in range(len(ok)) if ids[j] != q and len(ok[j][1]) == len(ok[i][1])]
        best = sorted(can, key=lambda j: (-round(cos[i, j], 12), ids[j]))[:k]
        out += [(q, n + 1, int(ids[j]), round(float(cos[i, j]), 9)) for n, j in enumerate(best)]
    return out


@pytest.mark.parametrize("shard", [16_384, 40])
def test_search_is_exact_at_factor_one(table, monkeypatch, shard):
    monkeypatch.setattr(vptree, "SHARD_ROWS", shard)
    monkeypatch.setattr(vptree, "QUERY_ROWS", 5)
    monkeypatch.setattr(vptree, "LEAF", 8)
    got = vptree.search(table, "vec_id", "embedding", F.col("id") % 50 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 9)) for r in got) == sorted(brute_nearest(rows_with_everything(), 5))


def test_larger_factors_prune_more_and_find_most(spark):
    rng = np.random.default_rng(6)
    centers = rng.standard_normal((200, 24))
    x = np.concatenate([c + 0.15 * rng.standard_normal((20, 24)) for c in centers])
    ids = np.arange(len(x))
    tree = vptree.Tree(ids, x)
    queries = ids % 20 == 0
    truth = unit(x[queries]) @ unit(x).T
    truth[np.arange(queries.sum()), ids[queries]] = -2
    best = np.argsort(-truth, axis=1)[:, :5]
    work, recall = [], []
    for factor in (1.0, 1.5, 3.0):
        found, n = vptree.nearest(tree, ids[queries], x[queries], 5, factor)
        hits = {(q, i) for q, i, _ in found}
        work.append(n)
        recall.append(np.mean([(int(q), int(i)) in hits for q, row in zip(ids[queries], best) for i in row]))
    assert recall[0] == 1.0 and recall[1] >= 0.9 and work[0] > work[1] > work[2]
    assert work[1] < 0.5 * queries.sum() * len(x)


def test_copies_in_many_leaves_are_found_by_id():
    """Groups of copies larger than a leaf: rounded distances near zero must not prune the smaller ids."""
    rng = np.random.default_rng(12)
    wrong = 0
    for group in range(60):
        x = np.tile(rng.standard_normal(64), (600, 1)) * 2.0 ** rng.integers(-3, 4, (600, 1))
        ids = rng.permutation(len(x))
        asked = np.arange(0, 600, 20)
        got, _ = vptree.nearest(vptree.Tree(ids, x, group), ids[asked], x[asked], 5, 1.0)
        copies = np.sort(ids)
        wrong += sorted((q, i) for q, i, _ in got) != sorted((q, i) for q in ids[asked] for i in copies[copies != q][:5])
    assert wrong == 0


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert pstable.near_duplicates(none, "vec_id", "embedding", "label").collect() == []
    assert vptree.search(none, "vec_id", "embedding", F.col("id") % 50 == 0).collect() == []


@pytest.mark.parametrize("rows, want", [
    # one id with two vectors of one label, each with a near copy
    ([(1, 0, 0.0, "a"), (1, 1, 0.0, "a"), (2, 0, 0.01, "a"), (3, 1, 0.01, "a")], [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]),
    # one id under two labels
    ([(1, 0, 0.0, "a"), (1, 1, 0.0, "b"), (2, 0, 0.01, "a"), (3, 1, 0.01, "b")], [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]),
    # a copy of one of the two vectors, and a vector of its own
    ([(5, 0, 0.0, "a"), (5, 1, 0.0, "a"), (4, 1, 0.0, "a"), (9, 2, 0.0, "a")], [(4, 1, 4), (5, 0, 5), (5, 1, 4), (9, 0, 9)]),
])
def test_rows_that_repeat_an_id_are_judged_one_by_one(spark, rows, want):
    base = np.random.default_rng(6).standard_normal((3, 16))
    table = spark.createDataFrame([(i, (base[b] + off).tolist(), label) for i, b, off, label in rows], "vec_id long, embedding array<double>, label string")
    out = pstable.near_duplicates(table, "vec_id", "embedding", "label").collect()
    assert sorted((r.id, r.n_links, r.component) for r in out) == want
