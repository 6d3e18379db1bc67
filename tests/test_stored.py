"""Comparisons that move little: id sets by fingerprint, versions by bucket, keywords by row group."""

import random

import pyarrow.parquet as pq
import pytest
from pathlib import Path

from pyspark.sql import functions as F

from vectables.operators import catalog as cat
from vectables.operators import checks as ck
from vectables.operators import versions


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "id long")


def kinds(df):
    return sorted(map(tuple, df.collect()), key=str)


def final_plan(df):
    """The plan as it ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.executedPlan().toString() if plan.nodeName() == "AdaptiveSparkPlan" else plan.toString()


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_fingerprints_find_what_the_join_finds(spark, buckets):
    rnd = random.Random(buckets)
    for _ in range(4):
        have = rnd.sample(range(500), 300)
        back = [i for i in have if rnd.random() < 0.98] + rnd.sample(range(600), 3) + [have[0]] * rnd.randrange(3)
        rnd.shuffle(back)
        got = ck.id_set_diff(ids(spark, have), ids(spark, back), keyed=True, buckets=buckets)
        assert kinds(got) == kinds(ck.id_set_diff(ids(spark, have), ids(spark, back)))


def test_fingerprints_and_null_ids(spark):
    for have, back in (([None, 1], [None, 1]), ([], []), ([], [4, 4]), ([5], []), ([None], [])):
        got = ck.id_set_diff(ids(spark, have), ids(spark, back), keyed=True)
        assert kinds(got) == kinds(ck.id_set_diff(ids(spark, have), ids(spark, back)))


def test_two_swapped_ids_are_not_equal(spark):
    """Counts and plain sums of ids agree here."""
    got = ck.id_set_diff(ids(spark, [1, 4, 9]), ids(spark, [2, 3, 9]), keyed=True, buckets=1)
    assert {(r["id"], r["kind"]) for r in got.collect()} == {(1, "missing"), (4, "missing"), (2, "extra"), (3, "extra")}


def test_equal_sets_join_nothing(spark):
    have = spark.range(0, 20_000, numPartitions=5)
    plan = final_plan(ck.id_set_diff(have, have.repartition(7), keyed=True))
    assert "FullOuter" not in plan


def test_differing_buckets_are_few(spark):
    have, back = spark.range(20_000), spark.range(20_000).where("id <> 77").union(spark.range(30_000, 30_001))
    assert 1 <= ck.differing_buckets(have, back).count() <= 2


POINTS = "id long, vec array<float>, a string"


def test_stored_versions_merge_without_an_exchange(spark):
    rows = [(i, [float(i), 1.0], "x") for i in range(300)] + [(300, None, None), (301, [], "y")]
    later = [(i, v if i % 3 else [9.5, float(i)], a) for i, v, a in rows[10:]] + [(900, [1.0, 2.0], "z")]
    before, after = (versions.save_version(spark.createDataFrame(r, POINTS), 4) for r in (rows, later))
    diff = versions.vector_diff(before, after)
    plan = diff._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and plan.count("SelectedBucketsCount: 4 out of 4") == 2
    assert kinds(diff) == kinds(ck.vector_diff(spark.createDataFrame(rows, POINTS), spark.createDataFrame(later, POINTS)))
    assert versions.check_vectors_changed(before, after).collect() == ck.check_vectors_changed(before, after).collect()


def test_buckets_follow_the_bytes(spark):
    table = spark.range(1000).select("id", F.array_repeat(F.lit(1.0).cast("float"), 64).alias("vec"))
    assert versions.buckets_for(table) == 1
    assert versions.buckets_for(table, bucket_bytes=27_200) == 10
    assert versions.buckets_for(table.limit(0)) == 1


def test_field_index_skips_row_groups(spark, tmp_path):
    """100,000 keywords, one of them on a third of the points: few files, and a keyword is in one row group or two."""
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.format_string("%06d", F.col("id") * 7919 % 100_000)))
    points = spark.range(0, 400_000, numPartitions=8).select("id", F.when(F.col("id") != 5, key).alias("a"))
    path = f"{tmp_path}/index"
    cat.write_field_index(points, path, row_group_bytes=64 << 10)
    files = list(Path(path).glob("*.parquet"))
    groups = []
    for f in files:
        meta = pq.ParquetFile(f).metadata
        groups += [meta.row_group(i).column(1).statistics for i in range(meta.num_row_groups)]
    assert len(files) <= 16 and len(groups) >= 20
    for value in ("k000001", "k050000", "k099999"):
        got = sorted(r["id"] for r in cat.ids_with(spark, path, value).collect())
        assert got == sorted(r["id"] for r in points.where(F.col("a") == value).collect())
        assert sum(s.min <= value <= s.max for s in groups) <= 2
    assert cat.ids_with(spark, path, "hot").count() == points.where("a = 'hot'").count()
    assert cat.ids_with(spark, path, "hot", "k000001").count() == points.where("a in ('hot', 'k000001')").count()
    assert cat.ids_with(spark, path, "none").count() == 0
    assert "PushedFilters: [IsNotNull(a), EqualTo(a,k000001)]" in cat.ids_with(spark, path, "k000001")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("most", [4, 1 << 20])
def test_replayed_names_equal_a_walk(spark, monkeypatch, most):
    """Attempt by attempt in Python, with equal timestamps, a hot name, missing ops and chunks of a few rows."""
    import datetime as dt

    from vectables.operators import scan

    monkeypatch.setattr(scan, "CHUNK_ROWS", most)
    rnd = random.Random(most)
    rows = []
    for i in range(300):
        name = rnd.choice(["hot", "hot", "hot", "a", "b"])
        op = rnd.choice(["create", "delete", "create", "delete", None])
        message = rnd.choice([None, None, f"Collection `{name}` already exists!", "deadline exceeded", "Collection `x` already exists!"])
        rows.append((i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * (i // 3)), name, op, message))
    rows.append((300, dt.datetime(2024, 1, 1), "never", "create", "deadline exceeded"))
    rows.append((301, dt.datetime(2024, 1, 1), "never", "create", "Collection `never` already exists!"))
    want = {}
    for _, _, name, op, message in sorted(rows, key=lambda r: (r[1], r[0])):
        w = want.setdefault(name, dict(creates=0, deletes=0, created_twice=0, deleted_twice=0, refused_wrongly=0, exists=False))
        if message is None and op == "create":
            w["creates"] += 1
            w["created_twice"] += w["exists"]
            w["exists"] = True
        elif message is None and op == "delete":
            w["deletes"] += 1
            w["deleted_twice"] += not w["exists"]
            w["exists"] = False
        elif op == "create" and message is not None and f"Collection `{name}` already exists!" in message:
            w["refused_wrongly"] += not w["exists"]
    rnd.shuffle(rows)
    got = ck.replay_names(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, collection string, op string, message string"))
    assert {r["collection"]: {k: v for k, v in r.asDict().items() if k != "collection"} for r in got.collect()} == want
