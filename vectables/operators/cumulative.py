"""Latency summary as of each transition (OP-59 cumulative, S17).

The source tool renders its running histogram each time a uri fails or recovers; the current
probe is recorded first. Re-expressed without holding a uri's history anywhere, in three shuffles of
one scan:

1. probes are dealt by (uri, slice of time), slices as narrow as it takes for at most ``block_rows`` probes of a
   uri in one; each slice is summarised where it lies: the failures that end it, and its histogram in parts by
   power of two;
2. the summaries are folded in order of time, each part of a uri's histogram in a stream of its own, into what
   held before each slice: the length of the open failure run, the histogram, its least and most;
3. these meet the probes of their slice (the first shuffle's files, read again), which walk on from there: a probe is a transition
   where its state differs from the one before, and its quantiles are read off a cumulative sum over the buckets.

A task holds one slice's probes and at most 2,048 buckets, whatever the key skew; the fold holds one part of
one histogram at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectables.operators import logs
from vectables.operators.scan import time_chunk

BLOCK_ROWS = 1 << 20
OUT_SCHEMA = ("uri string, event_id long, kind string, failures long, total long, least long, p50_ms long, p95_ms long, "
              "p99_ms long, most long")
OUT_COLUMNS = ["uri", "event_id", "kind", "failures", "total", "least", "p50_ms", "p95_ms", "p99_ms", "most"]
SUB_BATCH = 2048   # transitions summarised at once: bounds the (transitions x buckets) matrix
YEAR_US = 365 * 86_400_000_000
PARTS = 15         # parts of a histogram by power of two: 256 buckets, then 128 each, up to its range
STATE = -1         # the part that carries the open run and the extremes
SUMMARY = ("uri string, slice long, part int, has_ok boolean, run long, least long, most long, buckets array<long>, counts array<long>")
_FIELDS = [("uri", pa.string()), ("slice", pa.int64()), ("part", pa.int32()), ("has_ok", pa.bool_()), ("run", pa.int64()),
           ("least", pa.int64()), ("most", pa.int64()), ("buckets", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    return rows.sort_values(["ts", "event_id"], kind="stable").reset_index(drop=True)


def _summary(rows: pd.DataFrame) -> pd.DataFrame:
    """A slice as rows of ``SUMMARY``: failures after its last ok (all of them without one) and extremes, and the parts of its histogram."""
    ok = _ordered(rows)["is_ok"].to_numpy(bool)
    oks = np.flatnonzero(ok)
    inside = rows["bucket"].notna().to_numpy()
    lat = rows["latency_ms"].to_numpy(np.float64, na_value=-1)[inside].astype(np.int64)
    uri, at = rows["uri"].iloc[0], int(rows["slice"].iloc[0])
    least, most = (int(lat.min()), int(lat.max())) if len(lat) else (None, None)
    out = [(uri, at, STATE, bool(len(oks)), len(ok) - 1 - int(oks[-1]) if len(oks) else len(ok), least, most, [], [])]
    buckets, counts = np.unique(rows["bucket"].to_numpy(np.float64, na_value=-1)[inside].astype(np.int64), return_counts=True)
    part = np.maximum(np.floor(np.log2(np.maximum(buckets, 1))).astype(np.int64) - 7, 0)
    for p in range(PARTS):      # parts without a bucket too: every slice needs to know what came before it
        out.append((uri, at, p, False, 0, None, None, buckets[part == p], counts[part == p]))
    return pd.DataFrame(out, columns=[n for n, _ in _FIELDS]).astype({"least": "Int64", "most": "Int64"})


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries sorted by (uri, part, slice) -> for each, what the slices before it fold to."""
    key, run, least, most = None, 0, None, None
    buckets = counts = np.zeros(0, np.int64)
    for batch in batches:
        uris, slices, parts, has_ok, runs, lows, highs = (batch.column(n).to_pylist() for n, _ in _FIELDS[:7])
        own_buckets, own_counts = batch.column("buckets"), batch.column("counts")
        out = []
        for i, uri in enumerate(uris):
            if key != (uri, parts[i]):
                key, run, least, most = (uri, parts[i]), 0, None, None
                buckets = counts = np.zeros(0, np.int64)
            out.append((uri, slices[i], parts[i], False, run, least, most, buckets, counts))
            run = runs[i] if has_ok[i] else run + runs[i]
            least = min((x for x in (least, lows[i]) if x is not None), default=None)
            most = max((x for x in (most, highs[i]) if x is not None), default=None)
            more = own_buckets[i].values.to_numpy()
            if len(more):
                both, where = np.unique(np.concatenate([buckets, more]), return_inverse=True)
                total = np.zeros(len(both), np.int64)
                np.add.at(total, where, np.concatenate([counts, own_counts[i].values.to_numpy()]))
                buckets, counts = both, total
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), _FIELDS)], names=[n for n, _ in _FIELDS])


def _transitions(rows: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
    """The transitions of a slice with their summaries. The histogram after each is the start histogram plus a
    cumulative sum, over the segments between transitions, of per-segment bucket counts."""
    rows = _ordered(rows)
    state, uri = start[start["part"] == STATE].iloc[0], rows["uri"].iloc[0]
    run, smin, smax = int(state["run"]), state["least"], state["most"]
    start = start[start["part"] != STATE].sort_values("part")     # parts rise with their buckets
    sb = np.concatenate([np.asarray(x, dtype=np.int64) for x in start["buckets"]])
    sc = np.concatenate([np.asarray(x, dtype=np.int64) for x in start["counts"]])
    ok, place = rows["is_ok"].to_numpy(bool), np.arange(len(rows))
    before = np.concatenate([[run == 0], ok[:-1]])                # a uri starts as if it were ok
    changed = ok != before
    last_ok = np.concatenate([[-1], np.maximum.accumulate(np.where(ok, place, -1))[:-1]])
    failures = place - 1 - last_ok + np.where(last_ok < 0, run, 0)
    inside = rows["bucket"].notna().to_numpy()             # a slower probe changes state, not the histogram
    rb = rows["bucket"].to_numpy(np.float64, na_value=-1).astype(np.int64)
    buckets = np.unique(np.concatenate([sb, rb[inside]]))
    k = len(buckets)
    base = np.zeros(k, np.int64)
    base[np.searchsorted(buckets, sb)] += sc
    idx = np.searchsorted(buckets, rb)
    lat = rows["latency_ms"].to_numpy(np.float64, na_value=-1).astype(np.int64)
    run_min = np.minimum.accumulate(np.where(inside, lat, np.iinfo(np.int64).max))
    run_max = np.maximum.accumulate(np.where(inside, lat, -1))
    if not pd.isna(smin):
        run_min = np.minimum(run_min, int(smin))
        run_max = np.maximum(run_max, int(smax))
    tpos = np.flatnonzero(changed)
    parts = []
    done = 0
    for lo in range(0, len(tpos), SUB_BATCH):
        tp = tpos[lo:lo + SUB_BATCH]
        # segment j holds rows (previous transition, transition j]; rows before 'done' are in base
        seg = np.searchsorted(tp, np.arange(done, tp[-1] + 1), side="left")
        some = inside[done:tp[-1] + 1]
        counts = np.zeros((len(tp), k), np.int64)
        np.add.at(counts, (seg[some], idx[done:tp[-1] + 1][some]), 1)
        hist = base[None, :] + np.cumsum(counts, axis=0)
        cum = np.cumsum(hist, axis=1)
        total = cum[:, -1] if k else np.zeros(len(tp), np.int64)
        empty = total == 0
        values = {"uri": uri, "event_id": rows["event_id"].to_numpy(np.int64)[tp], "kind": np.where(ok[tp], "recovered", "failed"),
                  "failures": pd.array(np.where(ok[tp], failures[tp], -1), dtype="Int64"), "total": total,
                  "least": pd.array(run_min[tp], dtype="Int64"), "most": pd.array(run_max[tp], dtype="Int64")}
        for name, q in logs.QUANTILES:
            rank = np.maximum(1, np.ceil(total * q).astype(np.int64))
            at = (cum >= rank[:, None]).argmax(axis=1) if k else np.zeros(len(tp), np.int64)
            values[f"{name}_ms"] = pd.array(buckets[at] if k else at, dtype="Int64")
        part = pd.DataFrame(values)
        part.loc[~ok[tp], "failures"] = pd.NA
        part.loc[empty, ["least", "most", "p50_ms", "p95_ms", "p99_ms"]] = pd.NA
        parts.append(part[OUT_COLUMNS])
        base = hist[-1]
        done = tp[-1] + 1
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=OUT_COLUMNS)


def latency_at_transitions(probes: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Summary at every health transition of ``probes`` (uri, event_id, ts, latency_ms, outcome).

    A transition on a probe slower than the histogram's range (or without a latency) is a row like any other; its histogram
    is that of the probes before it (``total`` 0 and no quantiles where there are none). A null uri is a uri of its own, a null
    outcome a failure. Counts probes per uri and slice while the plan is built, to set the width of the slices."""
    spark = probes.sparkSession
    n_tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    if block_rows is None:      # small enough to give every task work, never above the memory bound
        busiest = probes.groupBy("uri").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        block_rows = int(min(BLOCK_ROWS, max(4096, -(-busiest * 3 // max(1, n_tasks)))))
    rows = probes.select(
        "uri", "event_id", "ts", "latency_ms", F.coalesce(F.col("outcome") == "ok", F.lit(False)).alias("is_ok"),
        F.when(F.col("latency_ms") <= logs.HIST_MAX_MS, logs.bucket_hi(F.col("latency_ms"))).alias("bucket"),
        time_chunk(probes, ["uri"], most=block_rows, widest=YEAR_US).alias("slice"))
    # explicit counts: both branches share the first exchange, and AQE does not merge the byte-light, CPU-heavy groups
    rows = rows.repartition(n_tasks, "uri", "slice")
    summaries = rows.groupBy("uri", "slice").applyInPandas(_summary, SUMMARY)
    start = summaries.repartition(n_tasks, "uri", "part").sortWithinPartitions("uri", "part", "slice").mapInArrow(_fold, SUMMARY)
    start = start.select(F.col("uri").alias("s_uri"), F.col("slice").alias("s_slice"), "part", "run", "least", "most", "buckets", "counts") \
        .repartition(n_tasks, "s_uri", "s_slice")
    out = rows.groupBy("uri", "slice").cogroup(start.groupBy("s_uri", "s_slice")).applyInPandas(_transitions, OUT_SCHEMA)
    out = out.withColumns({"min_ms": F.when(F.col("least").isNotNull(), logs.bucket_lo(F.col("least"))),
                           "max_ms": F.when(F.col("most").isNotNull(), logs.bucket_hi(F.col("most")))})
    shown = ("min_ms", "p50_ms", "p95_ms", "p99_ms", "max_ms")
    text = F.when(F.col("total") > 0, logs.summary_text({c: F.col(c) for c in shown}))
    return out.select("uri", "event_id", "kind", "failures", "total", *shown, text.alias("text"))
