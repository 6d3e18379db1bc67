"""Searches through the index, over codes and by plain scans agree, on valid and on broken vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectables.functions.vectors import vector_literal
from vectables.operators import ivf, quant, search

POINTS = "id long, vec array<float>, a string"
QUERIES = "query_id long, qvec array<float>, must_a string"
NAN, INF = float("nan"), float("inf")


def clustered(n=1200, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim)) * 4
    return [(i, (centres[i % 12] + rng.standard_normal(dim) * 0.4).astype(np.float32).tolist(), f"keyword_{i % 2}") for i in range(n)]


def asked(n=25, dim=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, dim)) * 4
    rng = np.random.default_rng(seed + 1)
    return [(i, (centres[i % 12] + rng.standard_normal(dim)).astype(np.float32).tolist(), [None, "keyword_0", "keyword_1"][i % 3]) for i in range(n)]


BROKEN = [(9000, [NAN] + [1.0] * 11, "keyword_0"), (9001, [INF] + [1.0] * 11, "keyword_0"), (9002, [None] + [1.0] * 11, "keyword_1"),
          (9003, [1.0, 2.0], "keyword_0"), (9004, [0.0] * 12, "keyword_0"), (9005, None, "keyword_0"), (9006, [], "keyword_1"), (9007, [1.0] * 12, None)]


def rows(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "id", "score", "a").collect())


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(clustered() + BROKEN, POINTS).repartition(5).cache()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(asked(), QUERIES)


def brute(points, queries, k):
    out = []
    ok = [(i, np.array(v, dtype=np.float64), a) for i, v, a in points if v is not None and len(v) == 12 and None not in v and np.isfinite(v).all() and any(v)]
    for q, v, must in queries:
        v = np.array(v, dtype=np.float64)
        hits = sorted((-round(float(v @ p / np.linalg.norm(v) / np.linalg.norm(p)), 6), i, a) for i, p, a in ok if must in (None, a))
        out += [(q, r, i, -s, a) for r, (s, i, a) in enumerate(hits[:k], 1)]
    return sorted(out)


def same(got, want):
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=1.5e-6) and [x[4] for x in got] == [x[4] for x in want]


def test_all_searches_agree_on_broken_vectors(spark, points, queries, tmp_path):
    want = brute(clustered() + BROKEN, asked(), 10)
    same(rows(search.search_batch(points, queries, 10)), want)
    index = ivf.build_index(points, None, str(tmp_path / "ivf"), files_per_cell=None)
    same(rows(ivf.exact_search(index, queries, 10)), want)
    same(rows(ivf.ivf_search(index, queries, 10, nprobe=len(index[0]))), want)
    same(rows(quant.search_int8(points, queries, 10, oversample=200)), want)
    q, v, must = asked()[1]
    one = search.search_one(points, vector_literal(v), F.col("a") == must, 10, query_id=q)
    same(rows(one), [x for x in want if x[0] == q])


def test_broken_queries_have_no_hits(spark, points):
    bad = [(i, v, None) for i, (_, v, _) in enumerate(BROKEN[:7])]
    queries = spark.createDataFrame(bad + [(100 + i, v, m) for i, v, m in asked(8)], QUERIES)
    index = ivf.build_index(points, 6)
    for hits in (search.search_batch(points, queries, 5), ivf.exact_search(index, queries, 5), ivf.ivf_search(index, queries, 5),
                 quant.search_int8(points, queries, 5)):
        assert {r.query_id for r in hits.collect()} == {100 + i for i in range(8)}


def test_empty_tables(spark, points, queries):
    none = spark.createDataFrame([], POINTS)
    useless = spark.createDataFrame(BROKEN[:7], POINTS)
    for table in (none, useless):
        index = ivf.build_index(table, 4)
        for hits in (search.search_batch(table, queries, 5), ivf.exact_search(index, queries, 5), ivf.ivf_search(index, queries, 5),
                     ivf.hybrid_search(index, table, queries, 5), quant.search_int8(table, queries, 5)):
            assert hits.columns == ["query_id", "rank", "id", "score", "a"] and hits.count() == 0
    index = ivf.build_index(points, 4)
    assert ivf.exact_search(index, spark.createDataFrame([], QUERIES), 5).count() == 0


def test_exact_search_reads_few_cells_of_clustered_points(spark, points, queries, tmp_path):
    index = ivf.build_index(points, 40, str(tmp_path / "ivf"))
    report = []
    same(rows(ivf.exact_search(index, queries, 5, nprobe=2, report=report)), brute(clustered() + BROKEN, asked(), 5))
    assert len(report) == 1 and report[0] < 0.5


def test_bounds_hold_for_every_point(spark):
    rng = np.random.default_rng(5)
    pts = rng.standard_normal((500, 6))
    pivots = ivf._unit(pts[:9])
    cells = ivf.nearest_cells(pts, pivots, 1)[:, 0]
    unit = ivf._unit(pts)
    spread = {int(c): (float((unit[cells == c] @ pivots[c]).min()), int((cells == c).sum())) for c in np.unique(cells)}
    asked_for = rng.standard_normal((40, 6))
    bound = ivf.cell_bounds(asked_for, pivots, spread)
    assert (bound[:, cells] >= ivf._unit(asked_for) @ unit.T - 1e-9).all()


@pytest.mark.parametrize("covered", [0, 1, 700, 1200])
def test_hybrid_search_equals_a_scan_at_every_state(spark, points, queries, covered, tmp_path):
    path = str(tmp_path / "ivf")
    index = ivf.build_index(points.where(F.col("id") < covered), None, path, files_per_cell=None)
    want = brute(clustered() + BROKEN, asked(), 10)
    same(rows(ivf.hybrid_search(index, points, queries, 10)), want)
    if covered:
        before = index[1].where("cell is not null").count()
        grown = ivf.extend_index(index, points, path)
        assert before <= covered and grown[1].where("cell is not null").count() == 1202    # the zero vector has a cell, too; other lengths have none
        assert ivf.tail_of(grown, points).count() == 0
        same(rows(ivf.hybrid_search(grown, points, queries, 10)), want)


def test_hybrid_search_sees_rewritten_and_deleted_points(spark, points, queries, tmp_path):
    index = ivf.build_index(points.where("id < 900"), None, str(tmp_path / "ivf"), files_per_cell=None)
    now = [(i, (np.array(v) * -1).tolist() if i % 50 == 0 else v, a) for i, v, a in clustered() if i % 70]
    changed = spark.createDataFrame([(i,) for i in range(1200) if i % 50 == 0 or i % 70 == 0], "id long")
    table = spark.createDataFrame(now, POINTS)
    same(rows(ivf.hybrid_search(index, table, queries, 10, changed=changed)), brute(now, asked(), 10))


def test_cells_follow_the_rows():
    assert [ivf.cells_for(n) for n in (0, 10, 10_000, 10**12)] == [8, 8, 100, ivf.MOST_CELLS]


def test_quantized_search_reads_codes_and_fetches_the_shortlist_only(spark, points, queries, tmp_path):
    unit = [(i, (np.array(v) / np.linalg.norm(v)).astype(np.float32).tolist(), a) for i, v, a in clustered()]   # integer products rank by length, too
    points = spark.createDataFrame(unit + BROKEN, POINTS)
    questions = [(q, (np.array(v) / np.linalg.norm(v)).astype(np.float32).tolist(), must) for q, v, must in asked()]     # beyond alpha a code is cut off
    queries = spark.createDataFrame(questions, QUERIES)
    codes = quant.build_codes(points, 12, str(tmp_path / "codes"))
    assert dict(codes[1].dtypes) == {"id": "bigint", "code": "binary", "a": "string"}
    assert codes[1].count() == 1201 and codes[1].where("octet_length(code) <> 12").count() == 0
    stored = str(tmp_path / "points")
    points.write.parquet(stored)
    table = spark.read.schema(POINTS).parquet(stored)
    hits = quant.search_codes(codes, table, queries, 10, oversample=3.0)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    scored, fetched = plan.index("code#"), plan.index("Join")
    assert plan.count("Scan parquet") == 2 and fetched < scored       # the codes are cut below the join that fetches vectors
    exact = {(x[0], x[2]) for x in brute(unit + BROKEN, questions, 10)}
    found = {(r.query_id, r.id) for r in hits.collect()}
    assert len(exact & found) >= 0.95 * len(exact)
    assert quant.alpha_of(points) < 1e6


def test_quantized_scores_equal_integers(spark, points):
    alpha = quant.alpha_of(points)
    codes = quant.encode(points, alpha, 12)
    by_id = {r.id: np.frombuffer(bytes(r.code), dtype=np.int8).tolist() for r in codes.collect()}
    sql = {r.id: r.q for r in points.select("id", quant.quantize(F.col("vec"), alpha).alias("q")).collect()}
    assert all(sql[i] == q for i, q in by_id.items()) and sql[9000] is None and sql[9002] is None
