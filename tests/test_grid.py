"""Searches of many queries, dealt to groups, against the searches that scan the points for all queries at once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from test_index import BROKEN, POINTS, QUERIES, asked, clustered, rows
from vectables.operators import grid, ivf, quant, search

DIM = 12


@pytest.fixture(scope="module")
def points(spark):
    twice = [(i, v, a) for i, v, a in clustered()[:40]]                  # points that come twice, and one vector under many ids
    copies = [(5000 + i, clustered()[3][1], "keyword_1") for i in range(60)]
    return spark.createDataFrame(clustered() + BROKEN + twice + copies, POINTS).repartition(5).cache()


@pytest.fixture(scope="module")
def queries(spark):
    broken = [(200 + i, v, None) for i, (_, v, _) in enumerate(BROKEN[:7])]
    return spark.createDataFrame(asked(60) + asked(60)[:5] + broken + [(300, asked(1)[0][1], "no such keyword")], QUERIES).cache()


def both(monkeypatch, run, **sizes):
    """Hits of ``run`` by scans, and through groups that never bring a query to the driver."""
    want = rows(run())
    monkeypatch.setattr(grid, "MANY", 0)
    for name, value in {"TASK_PAIRS": 5000, "POINT_ROWS": 100, "PENDING": 50, "EXACT_PAIRS": 64, "QUERY_TILE": 7, **sizes}.items():
        monkeypatch.setattr(grid, name, value)
    monkeypatch.setattr(search, "collect_queries", None)
    return rows(run()), want


def agree(got, want):
    assert len(got) == len(want) > 0 and [x[:3] for x in got] == [x[:3] for x in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=1.5e-6) and [x[4] for x in got] == [x[4] for x in want]


@pytest.mark.parametrize("k", [1, 10, 2000])
def test_search_batch_in_groups(monkeypatch, points, queries, k):
    agree(*both(monkeypatch, lambda: search.search_batch(points, queries, k)))


def test_groups_follow_the_queries_and_a_task_emits_its_hits_once(spark, monkeypatch):
    """What a task holds does not grow with the query set, and no more than ``k`` rows per query leave the tasks."""
    per_query = 20 * 100 + 12 * 64
    assert [grid.groups_for(spark, n, 1, 64, 100) for n in (1, 10**6, 10**7)] == [1, -(-10**6 * per_query // grid.GROUP_BYTES), -(-10**7 * per_query // grid.GROUP_BYTES)]
    rng = np.random.default_rng(4)
    run = grid.scan_kernel(4, 3)
    schema = pa.schema([("at", pa.int32()), ("id", pa.int64()), ("vec", pa.list_(pa.float32())), ("a", pa.string())])
    asked_for = pa.RecordBatch.from_arrays([pa.array([grid.QUERY_AT] * 50, pa.int32()), pa.array(range(50)), pa.array(rng.standard_normal((50, 4)).tolist(), pa.list_(pa.float32())),
                                            pa.nulls(50, pa.string())], schema=schema)
    shares = [pa.RecordBatch.from_arrays([pa.array([grid.NO_CELL] * 100, pa.int32()), pa.array(range(lo, lo + 100)), pa.array(rng.standard_normal((100, 4)).tolist(), pa.list_(pa.float32())),
                                          pa.array(["x"] * 100)], schema=schema) for lo in range(0, 2000, 100)]
    monkeypatch.setattr(grid, "POINT_ROWS", 100)
    monkeypatch.setattr(grid, "PENDING", 10)
    assert sum(b.num_rows for b in run(iter([asked_for, *shares]))) == 150


@pytest.mark.parametrize("nprobe", [1, 3, 40])
def test_ivf_search_in_groups(monkeypatch, points, queries, nprobe, tmp_path):
    index = ivf.build_index(points, 40, str(tmp_path / "ivf"))
    agree(*both(monkeypatch, lambda: ivf.ivf_search(index, queries, 30, nprobe)))


@pytest.mark.parametrize("covered", [0, 700, 1200])
def test_exact_and_hybrid_search_in_groups(monkeypatch, points, queries, covered, tmp_path):
    index = ivf.build_index(points.where(F.col("id") < covered), None, str(tmp_path / "ivf"), files_per_cell=None)
    changed = points.select("id").where("id % 50 = 0")
    table = points.where("id % 70 > 0")
    got, want = both(monkeypatch, lambda: ivf.hybrid_search(index, table, queries, 10, changed=changed.union(points.select("id").where("id % 70 = 0"))))
    agree(got, want)
    monkeypatch.undo()
    if covered:
        agree(*both(monkeypatch, lambda: ivf.exact_search(index, queries, 10)))


def test_exact_search_in_groups_reads_few_cells(monkeypatch, points, queries, tmp_path):
    index = ivf.build_index(points, 40, str(tmp_path / "ivf"))
    report = []
    agree(*both(monkeypatch, lambda: ivf.exact_search(index, queries, 5, nprobe=2, report=report)))
    assert len(report) == 2 and 0 < report[1] < 0.5


@pytest.mark.parametrize("oversample", [1.0, 3.0])
def test_quantized_search_in_groups(monkeypatch, points, queries, oversample):
    once = queries.dropDuplicates(["query_id"])
    agree(*both(monkeypatch, lambda: quant.search_int8(points, once, 10, oversample)))


def test_searches_without_hits_in_groups(monkeypatch, spark, queries):
    monkeypatch.setattr(grid, "MANY", 0)
    for table in (spark.createDataFrame([], POINTS), spark.createDataFrame(BROKEN[:7], POINTS)):
        index = ivf.build_index(table, 4)
        for hits in (search.search_batch(table, queries, 5), ivf.exact_search(index, queries, 5), ivf.ivf_search(index, queries, 5),
                     ivf.hybrid_search(index, table, queries, 5), quant.search_int8(table, queries, 5)):
            assert hits.columns == ["query_id", "rank", "id", "score", "a"] and hits.count() == 0


def test_drill_search_reads_written_tables(spark, monkeypatch):
    """The refreshed table and its hits are made once, however many checks read them."""
    from vectables.plans import drills

    made = []
    whole = drills.search_batch
    monkeypatch.setattr(drills, "search_batch", lambda points, *a, **kw: made.append(points._jdf.queryExecution().analyzed().toString()) or whole(points, *a, **kw))
    from vectables.sources import generators
    table = generators.gen_points(spark.range(300), drills.DIM, 2, stream="t/drill").select("id", "vec", "payload")
    queries = generators.gen_queries(spark.range(5), drills.DIM, 2, stream="t/drillq")
    got = drills.searched_rows(table, queries, spark.createDataFrame([(300,)], "n long"))
    assert all(r["ok"] for r in got.collect()) and len(made) == 3 and all("Range" not in plan for plan in made)
