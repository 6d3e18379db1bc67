"""Every registered query against its DuckDB oracle (or rows-only), plus streaming, folds and plans."""

from __future__ import annotations

import os
import random
import tempfile

import duckdb
import pytest

import __spark_entry__ as entry
from oracle_check import compare, duck

SF = os.environ.get("VECTABLES_TEST_SF", "/root/testdata/sf0.001")
QUERIES = entry.queries()
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "score" in df.columns


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLE:
        assert len(got) > 0 and ("ok" not in got.columns or bool(got["ok"].all()))
        return
    want = con.sql(ORACLE[name]).df()
    err = compare(got, want)
    assert err is None, err


def test_streaming_over_several_files_equals_batch(spark):
    """Split the log into time-ordered files: state must carry across micro-batches."""
    from vectables.streaming import stateful

    out = tempfile.mkdtemp(prefix="vt-split-")
    src = f"{SF}/events.parquet"
    c = duckdb.connect()
    n = c.execute(f"SELECT count(*) FROM '{src}'").fetchall()[0][0]
    for i in range(4):
        c.execute(f"COPY (SELECT * FROM '{src}' ORDER BY ts, event_id LIMIT {n // 4 + 1} OFFSET {i * (n // 4 + 1)}) "
              f"TO '{out}/part-{i}.parquet' (FORMAT parquet)")
    want = QUERIES["health_transitions"](spark, SF).toPandas()
    got = stateful.stream_health_transitions(spark, f"{out}/*.parquet", 1).toPandas()
    assert compare(got, want) is None
    want_runs = QUERIES["run_transitions"](spark, SF).toPandas()
    got = stateful.stream_run_transitions(spark, f"{out}/*.parquet", 1).toPandas()
    assert compare(got, want_runs) is None
    got_log = stateful.stream_apply_oplog(spark, f"{out}/*.parquet", 1).toPandas()
    want_log = QUERIES["apply_oplog"](spark, SF).toPandas()
    assert compare(got_log, want_log) is None


def _fold(log):
    table = {}
    for seq, pid, op, k, v in sorted(log):
        if op == "upsert":
            table[pid] = {k: v} if k else {}
        elif op == "delete":
            table.pop(pid, None)
        elif op == "set_payload" and pid in table:
            table[pid][k] = v
    return {(pid, k, v) for pid, p in table.items() for k, v in (p.items() or [(None, None)])}


@pytest.mark.parametrize("seed", range(5))
def test_apply_oplog_equals_sequential_fold(spark, seed):
    from vectables.operators.mutations import apply_oplog

    rnd = random.Random(seed)
    log = []
    for seq in range(60):
        op = rnd.choice(["upsert", "upsert", "delete", "set_payload", "set_payload"])
        k = None if op == "delete" or (op == "upsert" and rnd.random() < 0.3) else f"k{rnd.randrange(3)}"
        log.append((seq, rnd.randrange(6), op, k, None if k is None else f"v{seq}"))
    df = spark.createDataFrame(log, "seq long, id long, op string, k string, v string")
    got = {tuple(r) for r in apply_oplog(df).collect()}
    assert got == _fold(log)
    # idempotent: folding the state again changes nothing
    from vectables.streaming.stateful import fold_to_state_log
    again = {tuple(r) for r in apply_oplog(fold_to_state_log(df)).collect()}
    assert again == got


def test_generators_do_not_depend_on_partitioning(spark):
    from vectables.sources import generators

    a = generators.gen_points(spark.range(0, 300, numPartitions=1), 8, 2)
    b = generators.gen_points(spark.range(0, 300, numPartitions=7).repartition(5), 8, 2)
    key = ["id", "vec", "a"]
    assert sorted(map(tuple, a.select(*key).collect())) == sorted(map(tuple, b.select(*key).collect()))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_search_shuffles_no_vectors(spark):
    plan = _plan(QUERIES["search_batch"](spark, SF))
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "vec" not in line and "embedding" not in line


def test_promoted_filter_is_pushed_to_scan(spark):
    df = QUERIES["delete_range"](spark, SF)
    plan = _plan(df)
    assert "PushedFilters" in plan
    plan2 = _plan(QUERIES["get_by_id"](spark, SF))
    assert "PushedFilters: [IsNotNull(vec_id), EqualTo(vec_id,7)]" in plan2


def test_count_reads_no_vectors(spark):
    plan = _plan(QUERIES["points_count"](spark, SF))
    assert "ReadSchema: struct<>" in plan or "embedding" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_no_cross_joins_in_any_plan(spark):
    """One-row aggregates combine through scalar subqueries; no query plans a cartesian product."""
    for name, q in QUERIES.items():
        if name.startswith("stream_"):
            continue
        plan = _plan(q(spark, SF))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_error_taxonomy_reads_the_log_once(spark):
    plan = _plan(QUERIES["error_taxonomy"](spark, SF))
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Window" not in plan


def _scrambled(tmp_path, files=5, seed=3):
    """Events dealt to files at random, read one after the other."""
    src = f"{SF}/events.parquet"
    c = duckdb.connect()
    for i in range(files):
        path = f"{tmp_path}/part-{i}.parquet"
        c.execute(f"COPY (SELECT * FROM '{src}' WHERE hash(event_id + {seed}) % {files} = {i}) TO '{path}' (FORMAT parquet)")
        os.utime(path, (1e9 + i, 1e9 + i))
    return f"{tmp_path}/*.parquet"


def test_shuffled_files_give_the_batch_rows(spark, tmp_path):
    from vectables.streaming import stateful

    glob = _scrambled(tmp_path)
    got = stateful.stream_health_transitions(spark, glob, 1, delay="60 days").toPandas()
    assert compare(got, QUERIES["health_transitions"](spark, SF).toPandas()) is None
    got = stateful.stream_run_transitions(spark, glob, 1, delay="60 days").toPandas()
    assert compare(got, QUERIES["run_transitions"](spark, SF).toPandas()) is None


def test_rows_behind_the_frontier_are_late_and_change_nothing(spark, tmp_path):
    """Against a replay of the rules in Python: late rows, and the transitions of all others."""
    import pandas as pd

    from vectables.operators import logs
    from vectables.streaming import stateful
    from pyspark.sql import functions as F

    glob = _scrambled(tmp_path)
    run = stateful.ordered_health_transitions(stateful.probes_stream(stateful.read_events_stream(spark, glob, 1)), "10 days")
    newest, late = None, set()
    for i in range(5):
        rows = pd.read_parquet(f"{tmp_path}/part-{i}.parquet")
        if newest is not None:
            late |= set(rows[rows.ts < newest - pd.Timedelta(days=10)].event_id)
        newest = rows.ts.max() if newest is None else max(newest, rows.ts.max())
    assert len(late) > 50 and {r["event_id"] for r in run.late.collect()} == late
    ontime = stateful.probes_stream(spark.read.parquet(f"{SF}/events.parquet")).where(~F.col("event_id").isin(list(late)))
    want = logs.transitions(ontime, ["uri"], F.col("outcome") == "ok", carry=("latency_ms", "outcome"))
    assert compare(run.transitions.toPandas(), want.select(*run.transitions.columns).toPandas()) is None


def test_debounce_reads_once_and_shuffles_twice(spark):
    """One scan, one exchange by (key, slice) and one by key, no join."""
    plan = QUERIES["green_debounce"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_window_argument_sets_the_windows(spark):
    from vectables.streaming import stateful

    got = stateful.stream_window_latency(spark, f"{SF}/events.parquet*", window="2 hours").toPandas()
    assert len(got) and (got["window_start"].dt.hour % 2 == 0).all() and not got.duplicated(["uri", "window_start"]).any()


def test_unreadable_state_is_an_error(spark):
    from vectables.streaming.stateful import _list_dir

    assert _list_dir(spark, "file:///nowhere/at/all") is None
    with pytest.raises(Exception):
        _list_dir(spark, "no-such-scheme://bucket/state")
