"""Hand-made fixtures for the semantic rules (FIXTURES.md section 4)."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vectables.operators import checks as ck
from vectables.operators import logs
from vectables.operators import mutations as mu
from vectables.operators.search import search_batch, search_one
from vectables.functions.vectors import vector_literal
from vectables.sources import generators


def _ts(i: int) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i)


@pytest.mark.parametrize("n,expected", [
    (0, [(0, 0, 0)]), (1, [(0, 0, 1)]), (100, [(0, 0, 100)]), (101, [(0, 0, 100), (1, 100, 1)]),
    (200, [(0, 0, 100), (1, 100, 100)]), (250, [(0, 0, 100), (1, 100, 100), (2, 200, 50)]),
])
def test_batch_plan(spark, n, expected):
    got = generators.batch_plan(spark.range(n)).orderBy("batch_id").collect()
    assert [tuple(r) for r in got] == expected


def test_upsert_replaces_payload(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0], {"a": "x"})], "id long, vec array<float>, payload map<string,string>")
    delta = spark.createDataFrame([(1, None, {})], "id long, vec array<float>, payload map<string,string>")
    row = mu.upsert(base, delta).collect()[0]
    assert row["payload"] == {} and row["vec"] is None


def test_upsert_refuses_an_unordered_duplicate_and_takes_the_last_ordered_one(spark):
    base = spark.createDataFrame([(1, [1.0], {"a": "x"})], "id long, vec array<float>, payload map<string,string>")
    delta = spark.createDataFrame([(1, [2.0], 1), (1, [3.0], 2)], "id long, vec array<float>, seq int") \
        .withColumn("payload", F.create_map().cast("map<string,string>"))
    with pytest.raises(Exception, match="several rows for id 1"):
        mu.upsert(base, delta).collect()
    assert [r["vec"] for r in mu.upsert(base, delta, order="seq").collect()] == [[3.0]]


def test_patch_of_a_point_without_payload_is_kept(spark):
    base = spark.createDataFrame([(1, None, None), (2, None, None)], "id long, vec array<float>, payload map<string,string>")
    patch = spark.createDataFrame([(1, "k", "v", 1)], "id long, k string, v string, seq long")
    assert {r["id"]: r["payload"] for r in mu.set_payload(base, patch).collect()} == {1: {"k": "v"}, 2: None}


def test_empty_generators(spark):
    df = generators.gen_points(spark.range(3), 0, 0)
    rows = df.collect()
    assert all(r["vec"] is None and r["payload"] == {} for r in rows)


def test_filter_with_zero_variants_is_an_error(spark):
    with pytest.raises(ValueError):
        generators.random_filter("s", F.col("id"), 0)
    assert generators.random_filter("s", F.col("id"), None) is not None  # None = no filter (a null column)


def _statuses(spark, seqs):
    rows = []
    eid = 0
    for ci, seq in enumerate(seqs):
        for s in seq:
            rows.append((eid, _ts(eid), f"c_{ci}", "green" if s == "G" else "red"))
            eid += 1
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, collection string, status string")


def test_green_debounce(spark):
    seqs = ["GGG", "GNGG", "NGG", "GNNG", "NG"]
    got = {r["collection"]: r["ready_poll"] for r in logs.green_debounce(_statuses(spark, seqs)).collect()}
    assert got == {"c_0": 3, "c_1": 4, "c_2": 3, "c_3": None, "c_4": None}


@pytest.mark.parametrize("polls", [1, 3, 5])
@pytest.mark.parametrize("most", [3, 1 << 20])
def test_green_debounce_against_a_loop(spark, monkeypatch, polls, most):
    """Runs of greens that cross slices of any size, from one poll up; a key of one poll, one that is never ready."""
    import random

    from vectables.operators import scan

    monkeypatch.setattr(scan, "CHUNK_ROWS", most)
    rng = random.Random(polls)
    seqs = ["G", "N", "G" * 7, "N" * 7] + ["".join(rng.choice("GGN") for _ in range(rng.randint(2, 25))) for _ in range(30)]
    got = {r["collection"]: r["ready_poll"] for r in logs.green_debounce(_statuses(spark, seqs), polls=polls).collect()}
    for i, seq in enumerate(seqs):
        count, ready = 0, None
        for at, status in enumerate(seq, 1):
            count = count + 1 if status == "G" else 1
            if count >= polls and ready is None:
                ready = at
        assert got[f"c_{i}"] == ready, seq


def test_id_sets(spark):
    exp = spark.createDataFrame([(i,) for i in range(5)], "id long")
    ret = spark.createDataFrame([(i,) for i in (0, 1, 1, 3, 9)], "id long")
    kinds = {(r["id"], r["kind"]) for r in ck.id_set_diff(exp, ret).collect()}
    assert kinds == {(2, "missing"), (4, "missing"), (1, "duplicate"), (9, "extra")}
    summary = ck.check_id_set(exp, ret).collect()[0]
    assert (summary["missing"], summary["duplicate"], summary["extra"], summary["ok"]) == (2, 1, 1, False)


def test_counts_null_rules(spark):
    empty = spark.createDataFrame([], "id long")
    assert ck.check_count(empty, 0).collect()[0]["ok"] is True               # S7: missing count reads 0
    info = spark.createDataFrame([(None,)], "indexed long")
    got = info.select((F.coalesce("indexed", F.lit(0)) > 0).alias("ok")).collect()[0]["ok"]
    assert got is False                                                       # S8: missing indexed count fails


def _runs(spark, rounds):
    rows, eid = [], 0
    for r, outcomes in enumerate(rounds, start=1):
        for u, (o, d) in enumerate(outcomes):
            err = f"{o} error" if o in ("client", "invariant") else None
            rows.append(("d", f"node_{u}", r, eid, _ts(eid), d, o, err))
            eid += 1
    return spark.createDataFrame(rows, "drill string, uri string, round long, event_id long, ts timestamp_ntz, "
                                       "duration_s double, outcome string, error string")


def test_round_classes_and_seconds(spark):
    ok = ("ok", 1.9)
    rounds = [[ok, ok, ok], [ok, ("client", 1.0), ok], [("client", 1.0)] * 3, [ok, ok, ("cancelled", 0.5)],
              [ok, ok, ("ok", 0.9)]]
    rep = {r["round"]: (r["class"], r["seconds"]) for r in logs.round_report(_runs(spark, rounds), 3).collect()}
    assert [rep[i][0] for i in range(1, 5)] == ["success", "partial", "failed", "partial"]
    assert rep[5][1] == 2  # 1.9 + 1.9 + 0.9 -> 1 + 1 + 0 (S15)


def test_name_selection(spark):
    names = spark.createDataFrame([("x",), ("y",)], "name string")
    assert [r["name"] for r in logs.select_names(names, include=["x"], ignore=["x"]).collect()] == ["x"]
    with pytest.raises(ValueError):
        logs.require_rows(logs.select_names(names, include=["unknown"]))


def test_histogram_buckets(spark):
    vals = [0, 1, 255, 256, 257, 511, 512, 3_600_000, 3_600_001]
    df = spark.createDataFrame([(v,) for v in vals], "latency_ms long")
    tops = [r["t"] for r in df.select(logs.bucket_hi(F.col("latency_ms")).alias("t")).collect()]
    assert tops[:8] == [0, 1, 255, 257, 257, 511, 515, 3_604_479]
    probes = df.withColumn("uri", F.lit("u"))
    assert logs.rejects(probes).count() == 1
    assert logs.latency_histogram(probes).agg(F.sum("n")).collect()[0][0] == 8


def test_failure_run(spark):
    outcomes = ["ok", "error", "timeout", "ok", "error"]
    df = spark.createDataFrame([(i, _ts(i), "u", o) for i, o in enumerate(outcomes)],
                               "event_id long, ts timestamp_ntz, uri string, outcome string")
    t = logs.transitions(df, ["uri"], F.col("outcome") == "ok").orderBy("event_id").collect()
    assert [(r["event_id"], r["kind"], r["failures"]) for r in t] == [(1, "failed", None), (3, "recovered", 2),
                                                                       (4, "failed", None)]


def _points(spark, rows):
    return spark.createDataFrame(rows, "id long, vec array<float>, a string")


def test_zero_null_and_ties(spark):
    pts = _points(spark, [(0, [0.0, 0.0], "k"), (1, None, "k"), (2, [1.0, 0.0], "k"), (3, [1.0, 0.0], "k"),
                          (4, [0.0, 1.0], "k")])
    got = search_one(pts, vector_literal([1.0, 0.0]), F.col("a") == "k", k=10).collect()
    assert [r["id"] for r in got] == [2, 3, 4]          # zero and null vectors never hit; tie -> lower id
    qs = spark.createDataFrame([(7, [1.0, 0.0], "k")], "query_id long, qvec array<float>, must_a string")
    got_b = search_batch(pts, qs, k=10, dim=2).orderBy("rank").collect()
    assert [r["id"] for r in got_b] == [2, 3, 4]


def test_unused_vector_gives_no_rows(spark):
    pts = spark.createDataFrame([(0, None, "k"), (1, None, "k")], "id long, vec array<float>, a string")
    assert search_one(pts, vector_literal([1.0, 0.0]), None).count() == 0


def test_transitions_across_chunks(spark):
    # rows spread over several hours: the chunked running count must equal a plain loop
    outcomes = ["ok", "error", "error", "ok", "timeout", "ok", "ok", "error"] * 3
    df = spark.createDataFrame([(i, _ts(i * 1800), "u", o) for i, o in enumerate(outcomes)],
                               "event_id long, ts timestamp_ntz, uri string, outcome string")
    got = [(r["event_id"], r["kind"], r["failures"]) for r in
           logs.transitions(df, ["uri"], F.col("outcome") == "ok").orderBy("event_id").collect()]
    exp, failing, fails = [], False, 0
    for i, o in enumerate(outcomes):
        if o == "ok":
            if failing:
                exp.append((i, "recovered", fails))
            failing, fails = False, 0
        else:
            if not failing:
                exp.append((i, "failed", None))
            failing, fails = True, fails + 1
    assert got == exp


def test_search_over_several_query_chunks_equals_one(spark, monkeypatch):
    from vectables.operators import search as S

    pts = generators.gen_points(spark.range(300), 8, 2, stream="t/points").select("id", "vec", "a")
    qs = generators.gen_queries(spark.range(40), 8, 2, stream="t/query")
    one = {tuple(r) for r in S.search_batch(pts, qs, k=5, dim=8).collect()}
    monkeypatch.setattr(S, "MAX_QUERY_BYTES", 8 * 8 * 7)   # 7 queries per chunk -> several jobs
    many = {tuple(r) for r in S.search_batch(pts, qs, k=5, dim=8).collect()}
    assert one == many and len(one) == 40 * 5


def test_chunked_lag_equals_plain_lag(spark):
    from pyspark.sql import Window

    from vectables.operators.scan import block_chunk, chunked_lag

    rows = [(i, f"k{i % 3}", i * 7 % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "seq long, key string, v long")
    got = chunked_lag(df, ["key"], ["seq"], F.col("v"), "prev", block_chunk("seq", 16))
    want = df.withColumn("prev", F.lag("v").over(Window.partitionBy("key").orderBy("seq")))
    assert sorted(map(tuple, got.select("seq", "key", "v", "prev").collect())) == \
        sorted(map(tuple, want.select("seq", "key", "v", "prev").collect()))


def test_ivf_with_kmeans_pivots_finds_exact_neighbours_when_probing_all_cells(spark):
    from vectables.operators import ivf

    pts = generators.gen_points(spark.range(400), 8, 2, stream="t/ivf").select("id", "vec", "a")
    qs = generators.gen_queries(spark.range(10), 8, 2, stream="t/ivfq")
    index = ivf.build_index(pts, nlist=4, pivots="kmeans")
    approx = {tuple(r) for r in ivf.ivf_search(index, qs, k=5, nprobe=4).collect()}
    exact = {tuple(r) for r in search_batch(pts, qs, k=5, dim=8).collect()}
    assert approx == exact


@pytest.mark.parametrize("seed", range(3))
def test_local_then_global_topk_equals_brute_force(spark, seed):
    """Small integer vectors make many equal scores: the per-task cut and the global cut must
    agree with one sort of all pairs by (score desc, id asc)."""
    import numpy as np

    rng = np.random.default_rng(seed)
    n, nq, dim, k = 240, 12, 3, 7
    vecs = rng.integers(-2, 3, size=(n, dim)).astype(float)
    labels = rng.choice(["keyword_0", "keyword_1"], size=n)
    pts = spark.createDataFrame([(i, [float(x) for x in vecs[i]], str(labels[i])) for i in range(n)],
                                "id long, vec array<float>, a string").repartition(6)
    qv = rng.integers(-2, 3, size=(nq, dim)).astype(float)
    qm = rng.choice(["keyword_0", "keyword_1", None], size=nq)
    qs = spark.createDataFrame([(j, [float(x) for x in qv[j]], None if qm[j] is None else str(qm[j])) for j in range(nq)],
                               "query_id long, qvec array<float>, must_a string")
    got = sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in search_batch(pts, qs, k=k, dim=dim).collect())
    want = []
    for j in range(nq):
        if not np.linalg.norm(qv[j]):
            continue
        cand = []
        for i in range(n):
            if np.linalg.norm(vecs[i]) == 0 or (qm[j] is not None and labels[i] != qm[j]):
                continue
            s = round(float(qv[j] @ vecs[i] / (np.linalg.norm(qv[j]) * np.linalg.norm(vecs[i]))), 6)
            cand.append((-s, i))
        for rank, (ns, i) in enumerate(sorted(cand)[:k], start=1):
            want.append((j, rank, i, -ns))
    assert got == sorted(want)


def test_transitions_do_not_depend_on_chunk_rows(spark, monkeypatch):
    from vectables.operators import scan

    outcomes = ["ok", "error", "error", "ok", "timeout", "ok", "ok", "error"] * 5
    df = spark.createDataFrame([(i, _ts(i * 700), "u", o) for i, o in enumerate(outcomes)],
                               "event_id long, ts timestamp_ntz, uri string, outcome string")
    got = []
    for rows in (1 << 20, 7, 1):
        monkeypatch.setattr(scan, "CHUNK_ROWS", rows)
        got.append(sorted(map(tuple, logs.transitions(df, ["uri"], F.col("outcome") == "ok").collect())))
    assert got[0] == got[1] == got[2]


def test_one_uri_in_one_hour_is_many_window_groups(spark):
    from vectables.operators.scan import time_chunk

    df = spark.range(20_000).select(F.lit("u").alias("uri"), F.expr("timestampadd(MILLISECOND, cast(id as int) % 3600000, timestamp_ntz'2024-01-01')").alias("ts"))
    chunk = time_chunk(df, ["uri"], most=500)
    sizes = [r["count"] for r in df.groupBy("uri", chunk.alias("c")).count().collect()]
    assert max(sizes) <= 500 and len(sizes) >= 40


def test_search_without_a_spark_context_ships_queries_in_the_closure(spark, monkeypatch):
    from vectables import session
    from vectables.operators import search as S

    pts = generators.gen_points(spark.range(200), 8, 2, stream="t/ship").select("id", "vec", "a")
    qs = generators.gen_queries(spark.range(10), 8, 2, stream="t/shipq")
    want = {tuple(r) for r in S.search_batch(pts, qs, k=5, dim=8).collect()}
    monkeypatch.setattr(S, "ship", lambda _spark, value: session._Inline(value))
    got = {tuple(r) for r in S.search_batch(pts, qs, k=5, dim=8).collect()}
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_chunked_running_sums_equal_plain_window(spark, seed):
    import random

    from pyspark.sql import Window

    from vectables.operators.scan import running_sums, time_chunk

    rnd = random.Random(seed)
    rows = []
    for i in range(400):
        ts = _ts(rnd.choice([rnd.randrange(0, 20000), 3600 * rnd.randrange(0, 6)]))   # ties on hour edges
        rows.append((i, ts, f"k{rnd.randrange(3)}", rnd.randrange(-2, 5)))
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, key string, v long")
    got = running_sums(df, ["key"], ["ts", "event_id"], {"s": F.col("v"), "n": F.lit(1)}, time_chunk(df, ["key"], most=20))
    w = Window.partitionBy("key").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("s", F.sum("v").over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    cols = ["event_id", "key", "s", "n"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_set_payload_merges_keys_and_ignores_absent_ids(spark):
    base = spark.createDataFrame([(1, [1.0], {"a": "x", "b": "y"})], "id long, vec array<float>, payload map<string,string>")
    patch = spark.createDataFrame([(1, "a", "z", 1), (1, "a", "w", 2), (1, "c", "q", 3), (9, "a", "nope", 4)],
                                  "id long, k string, v string, seq long")
    rows = mu.set_payload(base, patch).collect()
    assert len(rows) == 1 and rows[0]["payload"] == {"a": "w", "b": "y", "c": "q"} and rows[0]["vec"] == [1.0]


def test_lifecycle_audit_accepts_only_already_exists_on_create(spark):
    msg = "Collection `c_1` already exists!"
    rows = [(0, "c_1", "create", None), (1, "c_1", "create", msg), (2, "c_1", "create", "deadline exceeded"),
            (3, "c_1", "delete", msg), (4, "c_1", "delete", None)]
    df = spark.createDataFrame(rows, "event_id long, collection string, op string, message string")
    got = {r["op"]: (r["succeeded"], r["accepted_failures"], r["violations"], r["ok"])
           for r in ck.audit_lifecycle(df).collect()}
    assert got == {"create": (1, 1, 1, False), "delete": (1, 0, 1, False)}


def test_timeout_wins_over_client_result(spark):
    df = spark.createDataFrame([(10.0, True), (10.0, False), (50.0, False), (50.01, True), (90.0, False)],
                               "elapsed double, client_ok boolean")
    got = [r["o"] for r in df.select(logs.classify_probe(F.col("elapsed"), F.col("client_ok")).alias("o")).collect()]
    assert got == ["ok", "error", "error", "timeout", "timeout"]


def test_cumulative_latency_does_not_depend_on_block_size(spark):
    from vectables.operators.cumulative import latency_at_transitions
    from vectables.sources import views

    probes = views.probes(spark, "/root/testdata/sf0.001")
    one_block = sorted(map(tuple, latency_at_transitions(probes, block_rows=1 << 20).collect()))
    many_blocks = sorted(map(tuple, latency_at_transitions(probes, block_rows=37).collect()))
    assert one_block == many_blocks and len(one_block) > 0


def test_a_probe_beyond_the_histogram_keeps_its_transition(spark):
    from vectables.operators.cumulative import latency_at_transitions

    rows = [(0, "u", 10, "ok"), (1, "u", 4_000_000, "timeout"), (2, "u", 20, "ok"), (3, "v", 4_000_000, "timeout"), (4, "v", 30, "ok")]
    probes = spark.createDataFrame([(i, _ts(i), u, ms, o) for i, u, ms, o in rows], "event_id long, ts timestamp_ntz, uri string, latency_ms long, outcome string")
    got = {r["event_id"]: (r["kind"], r["failures"], r["total"], r["min_ms"], r["max_ms"], r["text"]) for r in latency_at_transitions(probes).collect()}
    assert got == {1: ("failed", None, 1, 10, 10, "[min: 10ms, p50: 10ms, p95: 10ms, p99: 10ms, max: 10ms]"),
                   2: ("recovered", 1, 2, 10, 20, "[min: 10ms, p50: 10ms, p95: 20ms, p99: 20ms, max: 20ms]"),
                   3: ("failed", None, 0, None, None, None),
                   4: ("recovered", 1, 1, 30, 30, "[min: 30ms, p50: 30ms, p95: 30ms, p99: 30ms, max: 30ms]")}
    assert [r["event_id"] for r in logs.rejects(probes).collect()] == [1, 3]


@pytest.mark.parametrize("block_rows", [5, 60, 1 << 20])
def test_cumulative_latency_equals_a_replay(spark, block_rows):
    """Probe by probe in Python: equal timestamps, missing latencies and outcomes, a hot uri, a run over many slices."""
    import math
    import random

    from vectables.operators.cumulative import latency_at_transitions

    rng = random.Random(block_rows)
    rows = []
    for i in range(400):
        uri = rng.choice(["hot"] * 6 + ["u", None])
        ok = "error" if uri == "hot" and 100 < i < 260 else rng.choice(["ok", "ok", "error", None])
        rows.append((i, _ts(i // 3), uri, rng.choice([None, 1, 3, 255, 256, 300, 5000, 3_600_000, 4_000_000]), ok))
    rng.shuffle(rows)
    probes = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, uri string, latency_ms long, outcome string")
    got = {r["event_id"]: (r["uri"], r["kind"], r["failures"], r["total"], r["min_ms"], r["p50_ms"], r["p95_ms"], r["p99_ms"], r["max_ms"])
           for r in latency_at_transitions(probes, block_rows).collect()}

    def low(v):
        return v >> max(0, v.bit_length() - 8) << max(0, v.bit_length() - 8)

    def top(v):
        return low(v) + (1 << max(0, v.bit_length() - 8)) - 1

    want, seen, open_ = {}, {}, {}
    for event_id, _, uri, ms, outcome in sorted(rows, key=lambda r: (r[1], r[0])):
        have = seen.setdefault(uri, [])
        if ms is not None and ms <= 3_600_000:
            have.append(ms)
        run, ok = open_.get(uri, 0), outcome == "ok"
        open_[uri] = 0 if ok else run + 1
        if ok != (run == 0):
            tops = sorted(map(top, have))
            at = [tops[max(1, math.ceil(len(tops) * q)) - 1] if tops else None for q in (0.5, 0.95, 0.99)]
            want[event_id] = (uri, "recovered" if ok else "failed", run if ok else None, len(have), low(min(have)) if have else None,
                              *at, tops[-1] if tops else None)
    assert got == want


def test_cumulative_latency_shuffles_the_probes_once(spark):
    from vectables.operators.cumulative import latency_at_transitions
    from vectables.sources import views

    df = latency_at_transitions(views.probes(spark, "/root/testdata/sf0.001"))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 1 and plan.count("+- Exchange") + plan.count(":- Exchange") == 3
    assert "Join" not in plan


def test_kernel_memory_does_not_grow_with_the_query_set(monkeypatch):
    """Scores are made a tile of queries at a time: no matrix of all queries by an Arrow batch appears."""
    import numpy as np
    import pyarrow as pa

    from vectables.operators import search as S

    rng = np.random.default_rng(1)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(500)), pa.array(rng.standard_normal((500, 4)).tolist(), pa.list_(pa.float32())), pa.array(["x"] * 500)], names=["id", "vec", "a"])
    shapes = []
    whole = S._top_candidates
    monkeypatch.setattr(S, "_top_candidates", lambda scores, k: shapes.append(scores.shape) or whole(scores, k))
    for n in (1500, 6000):
        kernel = S.make_topk_kernel(np.arange(n), rng.standard_normal((n, 4)), np.array([None] * n, dtype=object), 3, "vec")
        assert sum(b.num_rows for b in kernel(iter([batch]))) == 3 * n
    assert max(rows for rows, _ in shapes) == S.QUERY_TILE


def _grid(monkeypatch, running, block):
    from vectables.operators import search as S

    monkeypatch.setattr(S, "RUNNING_BYTES", running)
    monkeypatch.setattr(S, "BLOCK_BYTES", block)
    return S


def test_grid_of_points_and_queries_keeps_every_hit(spark, monkeypatch):
    """Same hits from a grid of small cells; rows of another dimension and broken vectors are no hits."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    vecs = rng.standard_normal((300, 6)).astype(np.float32).tolist()
    vecs[7], vecs[8], vecs[9], vecs[10] = vecs[7][:5], None, [float("nan")] * 6, vecs[11]       # 10 and 11 tie
    queries = rng.standard_normal((40, 6))
    musts = np.array([None, "x", "y", "none"] * 10, dtype=object)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(lo, lo + 50)), pa.array(vecs[lo: lo + 50], pa.list_(pa.float32())),
                                           pa.array([["x", "y", None][i % 3] for i in range(lo, lo + 50)])], names=["id", "vec", "a"]) for lo in range(0, 300, 50)]

    def best(kernel):
        out = {}
        for b in kernel(iter(batches)):
            for q, i, s, a in zip(*(c.to_pylist() for c in b.columns)):
                out.setdefault(q, set()).add((-s, i, a))
        return {q: sorted(h)[:4] for q, h in out.items()}

    S = _grid(monkeypatch, 1 << 30, 1 << 30)
    want = best(S.make_grid_kernel(np.arange(40), queries, musts, 4, "vec"))
    assert len(want) == 30 and all(i not in (7, 8, 9) for h in want.values() for _, i, _ in h)
    for running, block in ((7 * 4 * S.HIT_BYTES, 1), (1, 4000), (39 * 4 * S.HIT_BYTES, 1 << 30)):
        S = _grid(monkeypatch, running, block)
        assert best(S.make_grid_kernel(np.arange(40), queries, musts, 4, "vec")) == want


def test_running_hits_of_a_grid_are_bounded(monkeypatch):
    import numpy as np
    import pyarrow as pa

    S = _grid(monkeypatch, 500 * 3 * 48, 4000)
    rng = np.random.default_rng(1)
    batches = [pa.RecordBatch.from_arrays([pa.array(range(lo, lo + 100)), pa.array(rng.standard_normal((100, 4)).tolist(), pa.list_(pa.float32())),
                                           pa.array(["x"] * 100)], names=["id", "vec", "a"]) for lo in range(0, 600, 100)]
    held, whole = [], S.reduce_topk
    monkeypatch.setattr(S, "reduce_topk", lambda q, *a: held.append(len(whole(q, *a)[0])) or whole(q, *a))
    for n in (2000, 8000):
        kernel = S.make_grid_kernel(np.arange(n), rng.standard_normal((n, 4)), np.array([None] * n, dtype=object), 3, "vec")
        rows = [b.num_rows for b in kernel(iter(batches))]
        assert max(rows) <= 500 * 3 and sum(rows) >= 3 * n
    assert max(held) <= 500 * 3


def test_many_queries_scan_the_points_once(spark):
    """200,000 queries of 64 components are one chunk: one broadcast, one scan of the points."""
    from vectables.operators import search as S
    from vectables.sources import views

    pts = views.points(spark, "/root/testdata/sf0.001")
    queries = spark.range(200_000).select(F.col("id").alias("query_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: (i + F.col("id") % 7).cast("float")).alias("qvec"),
                                          F.lit(None).cast("string").alias("must_a"))
    assert len(list(S.query_chunks(queries, 64, 0))) == 1
    plan = search_batch(pts, queries, k=2, dim=64)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("MapInArrow") == 1


def test_indexed_search_fills_k_and_probes_more_cells_only_where_needed(spark):
    import numpy as np

    from vectables.operators import ivf
    from vectables.operators import search as S

    pts = generators.gen_points(spark.range(400), 8, 2, stream="t/fill").select("id", "vec", "a")
    qs = generators.gen_queries(spark.range(20), 8, 2, stream="t/fillq")
    index = ivf.build_index(pts, nlist=8)
    got = ivf.ivf_search(index, qs, k=100, nprobe=1).groupBy("query_id").count().collect()
    exact = S.search_batch(pts, qs, k=100, dim=8).groupBy("query_id").count().collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in exact}
    probes = ivf.probes_of(np.eye(3), np.array(["x", "y", None], dtype=object), np.eye(3), {"x": {0: 5}, "y": {1: 1, 0: 9}, None: {2: 1, 0: 1, 1: 1}}, 4, 1)
    assert [len(p) for p in probes] == [1, 2, 3]


def test_drill_checks_go_red_when_a_step_breaks(spark):
    from vectables.plans import drills

    n = spark.createDataFrame([(300,)], "n long")
    many = spark.range(300).select(F.lit("c").alias("collection"), "id", F.lit("keyword_0").alias("a"))
    log = spark.createDataFrame([("c", 1, "create"), ("c", 2, "drop")], "collection string, seq int, action string")

    def verdicts(df):
        return {(r["step"], r["check"]): r["ok"] for r in df.collect()}

    assert all(verdicts(drills.churn_rows(many, log, n)).values())
    assert not verdicts(drills.churn_rows(many, log.where("seq = 1"), n))[("c", "deleted")]
    assert not verdicts(drills.churn_rows(many.where("id > 0"), log, n))[("c", "count")]
    assert not verdicts(drills.churn_rows(many.withColumn("a", F.lit(None).cast("string")), log, n))[("c", "field_indexed")]
    polls = spark.createDataFrame([(i, _ts(i), "c", s) for i, s in enumerate(["green", "green", "red", "green"])],
                                  "event_id long, ts timestamp_ntz, collection string, status string")
    assert not drills.green_row(polls).first()["ok"] and drills.green_row(polls.where("status = 'green'")).first()["ok"]
    table = generators.gen_points(spark.range(300), drills.DIM, 2, stream="t/drill").select("id", "vec", "payload")
    queries = generators.gen_queries(spark.range(5), drills.DIM, 2, stream="t/drillq")
    assert all(verdicts(drills.searched_rows(table, queries, n)).values())
    assert not verdicts(drills.searched_rows(table.where("id < 299"), queries, n))[("refresh", "count")]
    shifted = table.withColumn("id", F.col("id") + 1000)
    assert not verdicts(drills.searched_rows(shifted, queries, n))[("search", "queries_ok")]


def test_change_log_drill_can_fail(spark):
    """An applied table that lost an id, kept a deleted one or holds a foreign value is found out."""
    from vectables.operators import mutations as mu
    from vectables.plans import drills

    log = spark.createDataFrame(
        [(0, 1, "upsert", "k", "a"), (1, 2, "upsert", "k", "b"), (2, 2, "delete", None, None), (3, 3, "set_payload", "k", "c"),
         (4, 4, "delete", None, None), (5, 4, "upsert", None, None), (6, 1, "set_payload", "j", "d")], "seq long, id long, op string, k string, v string")

    def bad(applied):
        return {r["check"] for r in drills.change_log_rows(log, applied).collect() if not r["ok"]}

    applied = mu.apply_oplog(log)
    assert bad(applied) == set()
    assert bad(applied.where("id <> 4")) == {"live_points"}
    extra = applied.union(spark.createDataFrame([(2, "k", "b")], applied.schema))
    assert bad(extra) == {"leftover_points"}
    assert bad(applied.withColumn("v", F.concat("v", F.lit("x")))) == {"values_in_log"}


def test_replayed_epoch_reads_the_state_of_the_epoch_before(spark, tmp_path):
    from vectables.streaming.stateful import _latest

    root = str(tmp_path / "state")
    for e in range(3):
        spark.range(1).write.parquet(f"{root}/epoch={e:012d}")
    assert _latest(spark, root).endswith("epoch=000000000002")
    assert _latest(spark, root, before=2).endswith("epoch=000000000001")   # replay of epoch 2
    assert _latest(spark, root, before=0) is None
