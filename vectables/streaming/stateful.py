"""Structured Streaming forms of the log operators (OP-67..OP-71).

* Health / run transitions run each micro-batch through the parallel island operators of
  :mod:`vectables.operators.logs` (``foreachBatch``), seeded by a small state table
  ``(key) -> (failing, failures, rounds, last_ts)``: an open failure run enters the next batch as one
  weighted synthetic row, so no key is confined to one task. Rows may come out of order: they are held
  until the frontier (newest event time less ``delay``) has passed them, then released in time order;
  rows that come behind the frontier go to a late output.
* The latency histogram is a streaming ``groupBy(uri, bucket).count()`` in update mode; each
  epoch's changed counts are merged into a versioned table through ``foreachBatch``.
* The change log is applied per micro-batch through ``foreachBatch``: the state (one reset row per id and
  the live keys with their sequence numbers) is kept in hashed buckets; a batch re-reads the written
  buckets it touches - which cuts lineage -, folds them with its rows and writes their next version.
* The tumbling summary uses event time with a watermark; only closed windows are emitted.

Sources read Parquet with an explicit schema; every query runs with ``availableNow`` and a
checkpoint under the shared storage root, so a restart resumes from the last committed batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectables.operators import logs
from vectables.operators import mutations as mu
from vectables.session import storage_root

DELAY = "10 minutes"     # how far out of order rows may come

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{storage_root(spark)}/streams/{name}-{uuid.uuid4().hex[:10]}"


def read_events_stream(spark: SparkSession, path_glob: str, files_per_trigger: int | None = None) -> DataFrame:
    """``files_per_trigger`` bounds a micro-batch where the caller asks for it; else a batch takes what there is."""
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path_glob)


def run_available(writer, checkpoint: str) -> None:
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


# ------------------------------------------------------------------ event streams

def probes_stream(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", "ts",
        F.concat(F.lit("node_"), (F.col("user_id") % 3).cast("string")).alias("uri"),
        F.floor("value").cast("bigint").alias("latency_ms"),
        logs.classify_probe(F.col("value"), F.col("event_type") != "error").alias("outcome"),
    )


def runs_stream(events: DataFrame) -> DataFrame:
    outcome = (F.when(F.col("event_type") == "error", "client").when(F.col("event_type") == "signup", "invariant")
               .when((F.col("event_type") == "purchase") & (F.col("value") < 5), "cancelled").otherwise("ok"))
    df = events.select(
        F.concat(F.lit("drill_"), (F.col("user_id") % 10).cast("string")).alias("drill"),
        F.concat(F.lit("node_"), (F.col("event_id") % 3).cast("string")).alias("uri"),
        "event_id", "ts", F.col("value").alias("duration_s"), outcome.alias("outcome"))
    return df.withColumn("error", F.when(F.col("outcome").isin("client", "invariant"), F.concat(
        F.col("outcome"), F.lit(" error "), (F.col("event_id") % 5).cast("string"))))


# ------------------------------------------------------------------ OP-69 histogram

def stream_latency_histogram(spark: SparkSession, path_glob: str, files_per_trigger: int | None = None) -> DataFrame:
    probes = probes_stream(read_events_stream(spark, path_glob, files_per_trigger))
    counts = probes.where(F.col("latency_ms") <= logs.HIST_MAX_MS).groupBy(
        "uri", logs.bucket_hi(F.col("latency_ms")).alias("bucket_hi")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    sink = scratch(spark, "hist")

    def merge(batch: DataFrame, epoch: int) -> None:
        # update mode: the batch holds the new totals of changed buckets; keep the rest
        prev_path = _latest(spark, f"{sink}/table", before=epoch)
        nxt = batch
        if prev_path is not None:
            prev = spark.read.parquet(prev_path)
            nxt = prev.join(batch.select("uri", "bucket_hi"), on=["uri", "bucket_hi"], how="left_anti").unionByName(batch)
        nxt.write.mode("overwrite").parquet(f"{sink}/table/epoch={epoch:012d}")   # a replay rewrites it
        _forget(spark, f"{sink}/table", epoch - 1)

    run_available(counts.writeStream.outputMode("update").foreachBatch(merge), f"{sink}/checkpoint")
    last = _latest(spark, f"{sink}/table")
    return spark.read.parquet(last) if last else spark.createDataFrame([], "uri string, bucket_hi long, n long")


def _list_dir(spark: SparkSession, root: str) -> list[str] | None:
    """Names in a directory of the shared folder; None where it does not exist. Any other failure is
    raised: an unreadable state must never be taken for an empty one."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return None
    return [st.getPath().getName() for st in fs.listStatus(path)]


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def _forget(spark: SparkSession, root: str, before: int) -> None:
    """Delete the state of epochs before ``before``: no replay can ask for it any more."""
    for name in _list_dir(spark, root) or []:
        if name.startswith("epoch=") and int(name.split("=", 1)[1]) < before:
            _delete(spark, f"{root}/{name}")


def _latest(spark: SparkSession, root: str, before: int | None = None) -> str | None:
    """Newest ``epoch=N`` directory, only among epochs before ``before`` when given: a replayed
    micro-batch must start from the state of the batch before it, never from its own output."""
    names = sorted(n for n in (_list_dir(spark, root) or []) if n.startswith("epoch=")
                   and (before is None or int(n.split("=", 1)[1]) < before))
    return f"{root}/{names[-1]}" if names else None


# ------------------------------------------------------------------ OP-70 change log

STATE_LOG_SCHEMA = "seq long, id long, op string, k string, v string"


def oplog_stream(events: DataFrame) -> DataFrame:
    et = F.col("event_type")
    no_kv = et.isin("signup", "error")
    return events.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("id"),
        F.when(et.isin("signup", "purchase"), "upsert").when(et == "error", "delete").otherwise("set_payload").alias("op"),
        F.when(~no_kv, F.concat(F.lit("k"), (F.col("event_id") % 4).cast("string"))).alias("k"),
        F.when(~no_kv, F.concat(F.lit("keyword_"), (F.col("event_id") % 7).cast("string"))).alias("v"),
    )


def fold_to_state_log(log: DataFrame) -> DataFrame:
    """Compact a change log to its state, written as a log again: one reset row per id (its last
    upsert or delete) and, for live ids, one row per key with the sequence of its last write."""
    resets = (log.where(F.col("op").isin("upsert", "delete")).groupBy("id")
              .agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq")))
    reset_rows = resets.select("seq", "id", "op", F.lit(None).cast("string").alias("k"), F.lit(None).cast("string").alias("v"))
    live = resets.where(F.col("op") == "upsert").select("id", F.col("seq").alias("reset_seq"))
    kv = (log.where(F.col("op").isin("upsert", "set_payload") & F.col("k").isNotNull())
          .join(live, on="id", how="inner").where(F.col("seq") >= F.col("reset_seq"))
          .groupBy("id", "k").agg(F.max_by("v", "seq").alias("v"), F.max("seq").alias("seq")))
    kv_rows = kv.select("seq", "id", F.lit("set_payload").alias("op"), "k", "v")
    return reset_rows.unionByName(kv_rows)


def _bucket_versions(spark: SparkSession, root: str, before: int | None = None) -> dict[int, list[str]]:
    """Per state bucket the directories that hold a version of it, oldest first, from epochs before ``before``."""
    found: dict[int, list[str]] = {}
    for epoch in sorted(n for n in (_list_dir(spark, root) or []) if n.startswith("epoch=")):
        if before is None or int(epoch.split("=", 1)[1]) < before:
            for name in _list_dir(spark, f"{root}/{epoch}") or []:
                if name.startswith("bucket="):
                    found.setdefault(int(name.split("=", 1)[1]), []).append(f"{root}/{epoch}/{name}")
    return found


def stream_apply_oplog(spark: SparkSession, path_glob: str, files_per_trigger: int | None = None, buckets: int = 64) -> DataFrame:
    """OP-70: same rows as the batch ``apply_oplog``.

    The state is kept in ``buckets`` by a hash of the id; a micro-batch reads and rewrites the buckets it touches, and
    versions that no replay can ask for are deleted."""
    log = oplog_stream(read_events_stream(spark, path_glob, files_per_trigger))
    sink = scratch(spark, "oplog")
    root = f"{sink}/state"

    def merge(batch: DataFrame, epoch: int) -> None:
        delta = batch.select("seq", "id", "op", "k", "v", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket"))
        touched = [r["bucket"] for r in delta.select("bucket").distinct().collect()]    # at most ``buckets`` rows
        versions = _bucket_versions(spark, root, before=epoch)
        old = [versions[b][-1] for b in touched if b in versions]
        rows = delta.drop("bucket")
        if old:
            rows = spark.read.schema(STATE_LOG_SCHEMA).parquet(*old).unionByName(rows)
        folded = fold_to_state_log(rows).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
        folded.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/epoch={epoch:012d}")   # a replay rewrites it
        for b in touched:
            for path in versions.get(b, [])[:-1]:
                _delete(spark, path)

    run_available(log.writeStream.foreachBatch(merge), f"{sink}/checkpoint")
    last = [paths[-1] for paths in _bucket_versions(spark, root).values()]
    state = spark.read.schema(STATE_LOG_SCHEMA).parquet(*last) if last else spark.createDataFrame([], STATE_LOG_SCHEMA)
    return mu.apply_oplog(state)


# ------------------------------------------------------------------ OP-71 tumbling windows

def utc_event_time(ts: str = "ts") -> F.Column:
    """The wall clock of a TIMESTAMP_NTZ column read as UTC: an instant built from its fields, so
    windows and watermarks do not depend on the session time zone."""
    c = F.col(ts)
    return F.make_timestamp_ltz(F.year(c), F.month(c), F.dayofmonth(c), F.hour(c), F.minute(c),
                                F.extract(F.lit("SECOND"), c), F.lit("UTC"))


def stream_window_latency(spark: SparkSession, path_glob: str, files_per_trigger: int | None = None,
                          window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Extension: per uri and closed event-time window: probes, min / max / total latency.

    ``window_start`` is the wall clock (UTC) of the window's start, as the event times are read. Rows later than the
    watermark are left out of closed windows, and windows still open at the end are not emitted."""
    probes = probes_stream(read_events_stream(spark, path_glob, files_per_trigger)).withColumn("ets", utc_event_time("ts"))
    agg = (probes.withWatermark("ets", delay)
           .groupBy("uri", F.window("ets", window).alias("w"))
           .agg(F.count(F.lit(1)).cast("bigint").alias("probes"), F.min("latency_ms").alias("min_ms"),
                F.max("latency_ms").alias("max_ms"), F.sum("latency_ms").cast("bigint").alias("total_ms")))
    start = F.expr("timestampadd(MICROSECOND, unix_micros(w.start), timestamp_ntz'1970-01-01 00:00:00')")
    out = agg.select("uri", start.alias("window_start"), "probes", "min_ms", "max_ms", "total_ms")
    sink = scratch(spark, "window")
    run_available(out.writeStream.format("parquet").option("path", f"{sink}/out").outputMode("append"),
                  f"{sink}/checkpoint")
    return spark.read.parquet(f"{sink}/out")


# ------------------------------------------------------------------ transitions per micro-batch, in parallel

def _carried_rows(state: DataFrame, keys: list[str], carry_types: dict[str, str]) -> DataFrame:
    """One synthetic failure row per key whose failure run is still open: it sorts before every
    real row (year 1, event_id -1) and weighs as many failures as were counted so far."""
    return state.where(F.col("failing")).select(
        *keys,
        F.lit("0001-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
        F.lit(-1).cast("bigint").alias("event_id"),
        F.lit(False).alias("__ok"),
        F.col("failures").alias("__w"),
        *[F.lit(None).cast(t).alias(c) for c, t in carry_types.items()],
    )


def transitions_step(batch: DataFrame, state: DataFrame, keys: list[str], is_ok: F.Column,
                     carry_types: dict[str, str], reported: F.Column | None = None,
                     keep: Callable[[DataFrame], DataFrame] = lambda rows: rows):
    """Transitions of one micro-batch and the next per-key state ``(keys, failing, failures, rounds, last_ts)``.

    Both read the numbered rows; ``keep`` may write them once and read them again.

    The batch is processed with the same parallel island operators as the batch queries (no key is
    confined to one task); the previous batches enter only through the small state table."""
    chunk = logs.time_chunk(batch, keys)      # a carried row is alone in its slice
    counted = logs.running_sums(batch, keys, ["ts", "event_id"], {"__n": F.lit(1)}, chunk) if "round" in carry_types else \
        batch.withColumn("__n", F.lit(0))
    counted = counted.join(state.select(*keys, F.col("rounds").alias("__r0")), on=keys, how="left") \
        .withColumn("round", (F.coalesce("__r0", F.lit(0)) + F.col("__n")).cast("bigint")).drop("__r0", "__n")
    rep = counted if reported is None else counted.where(reported)
    real = rep.select(*keys, "ts", "event_id", is_ok.alias("__ok"), F.lit(1).cast("bigint").alias("__w"),
                      *[F.col(c) for c in carry_types])
    rows = real.unionByName(_carried_rows(state, keys, carry_types))
    isl = keep(logs.islands(rows, keys, F.col("__ok"), chunk=chunk))
    runs = logs.runs_from_islands(isl, keys, list(carry_types), weight="__w")
    out = logs.transitions_from_runs(runs, keys, list(carry_types)).where(F.col("event_id") != -1)

    last = isl.groupBy(*keys).agg(F.max_by("is_ok", F.struct("ts", "event_id")).alias("__last_ok"),
                                  F.max("g").alias("run"))
    open_runs = runs.select(*keys, "run", F.col("failures").alias("__f"))
    seen = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.max("ts").alias("__ts"))
    touched = last.join(open_runs, on=keys + ["run"], how="left").join(seen, on=keys, how="full_outer") \
        .join(state.select(*keys, F.col("rounds").alias("__r0"), F.col("last_ts").alias("__t0")), on=keys, how="left")
    nxt = touched.select(
        *keys,
        F.coalesce(~F.col("__last_ok"), F.lit(False)).alias("failing"),
        F.when(~F.col("__last_ok"), F.col("__f")).otherwise(F.lit(0)).cast("bigint").alias("failures"),
        (F.coalesce("__r0", F.lit(0)) + F.coalesce("__n", F.lit(0))).cast("bigint").alias("rounds"),
        F.coalesce("__ts", "__t0").alias("last_ts"),
    )
    untouched = state.join(nxt.select(*keys), on=keys, how="left_anti")
    return out, untouched.unionByName(nxt)


class Ordered(NamedTuple):
    """What an out-of-order stream gives: the transitions, and the rows that came too late for them."""

    transitions: DataFrame
    late: DataFrame


def _clock(spark: SparkSession, root: str, before: int) -> str | None:
    """Newest event time of the epochs before ``before``, as text; None where there is none yet."""
    path = _latest(spark, root, before=before)
    return spark.read.schema("ts timestamp_ntz").parquet(path).agg(F.max("ts").cast("string")).first()[0] if path else None


def _stream_transitions(spark: SparkSession, rows_stream: DataFrame, keys: list[str], is_ok: F.Column, carry_types: dict[str, str],
                        reported: F.Column | None, name: str, delay: str, kept: list[str],
                        sink: str | None, ended: bool) -> Ordered:
    """Transitions of a stream whose rows may come up to ``delay`` out of order.

    The frontier is the newest event time seen, less ``delay``. A micro-batch and the rows held so far are dealt in one
    write: rows before the frontier are released in order, the others are held for a later batch, and rows that come
    before the frontier of the batches before theirs (or have no time) go to the late output, which no transition sees.
    What is held is bounded by the rows of ``delay``. Called again with the ``sink`` of an earlier run, the stream goes on
    with what has come since; ``ended`` says that no more will come, and releases what is held."""
    sink = sink or scratch(spark, name)
    state_schema = ", ".join([f"{k} string" for k in keys] + ["failing boolean", "failures long", "rounds long", "last_ts timestamp_ntz"])
    row_schema = rows_stream.schema
    wait = F.expr(f"INTERVAL {delay}")

    def frontier(newest: str) -> F.Column:
        return F.lit(newest).cast("timestamp_ntz") - wait

    def rows(part: str, epoch_dir: str | None) -> DataFrame:
        if epoch_dir is None or not _exists(spark, f"{epoch_dir}/part={part}"):
            return spark.createDataFrame([], row_schema)
        return spark.read.schema(row_schema).parquet(f"{epoch_dir}/part={part}")

    def advance(ready: DataFrame, epoch: int) -> None:
        prev = _latest(spark, f"{sink}/state", before=epoch)
        state = spark.read.schema(state_schema).parquet(prev) if prev else spark.createDataFrame([], state_schema)
        def numbered(islands: DataFrame) -> DataFrame:
            islands.write.mode("overwrite").parquet(f"{sink}/islands/epoch={epoch:012d}")
            return spark.read.schema(islands.schema).parquet(f"{sink}/islands/epoch={epoch:012d}")

        out, nxt = transitions_step(ready, state, keys, is_ok, carry_types, reported, numbered)
        # one directory per epoch, overwritten on replay: the sink stays exactly-once
        out.write.mode("overwrite").parquet(f"{sink}/out/epoch={epoch:012d}")
        nxt.write.mode("overwrite").parquet(f"{sink}/state/epoch={epoch:012d}")
        _forget(spark, f"{sink}/islands", epoch + 1)

    def step(batch: DataFrame, epoch: int) -> None:
        before = _clock(spark, f"{sink}/clock", epoch)
        newest = max((t for t in (before, batch.agg(F.max("ts").cast("timestamp_ntz").cast("string")).first()[0]) if t), default=None)
        late = F.col("ts").isNull() if before is None else F.col("ts").isNull() | (F.col("ts") < frontier(before))
        dealt = batch.withColumn("part", F.when(late, "late")).unionByName(
            rows("held", _latest(spark, f"{sink}/rows", before=epoch)).withColumn("part", F.lit(None).cast("string")))
        released = F.lit(False) if newest is None else F.col("ts") < frontier(newest)
        dealt = dealt.withColumn("part", F.coalesce("part", F.when(released, "ready").otherwise("held")))
        here = f"{sink}/rows/epoch={epoch:012d}"
        dealt.write.mode("overwrite").partitionBy("part").parquet(here)
        rows("late", here).write.mode("overwrite").parquet(f"{sink}/late/epoch={epoch:012d}")
        advance(rows("ready", here), epoch)
        spark.range(1).select(F.lit(newest).cast("timestamp_ntz").alias("ts")).write.mode("overwrite").parquet(
            f"{sink}/clock/epoch={epoch:012d}")
        for old in ("state", "rows", "clock"):
            _forget(spark, f"{sink}/{old}", epoch - 1)

    run_available(rows_stream.writeStream.foreachBatch(step), f"{sink}/checkpoint")
    last = _latest(spark, f"{sink}/rows")
    if last is None:        # a source without any batch
        empty = spark.createDataFrame([], row_schema)
        state = spark.createDataFrame([], state_schema)
        return Ordered(transitions_step(empty, state, keys, is_ok, carry_types, reported)[0].select(*kept), empty)
    if ended:
        advance(rows("held", last), int(last.rsplit("=", 1)[1]) + 1)
    return Ordered(spark.read.parquet(f"{sink}/out").select(*kept), spark.read.schema(row_schema).parquet(f"{sink}/late/epoch=*"))


def _exists(spark: SparkSession, path: str) -> bool:
    parent, name = path.rstrip("/").rsplit("/", 1)
    return name in (_list_dir(spark, parent) or [])


def ordered_health_transitions(probes: DataFrame, delay: str = DELAY, sink: str | None = None, ended: bool = True) -> Ordered:
    """OP-67 over any streaming ``probes``: transitions of the rows in time order, and the late rows."""
    return _stream_transitions(probes.sparkSession, probes, ["uri"], F.col("outcome") == "ok",
                               {"latency_ms": "bigint", "outcome": "string"}, None, "health-mb", delay,
                               ["uri", "event_id", "kind", "failures", "latency_ms", "outcome"], sink, ended)


def ordered_run_transitions(runs: DataFrame, delay: str = DELAY, sink: str | None = None, ended: bool = True) -> Ordered:
    """OP-68 over any streaming ``runs``; a late run has no round number, since its round was counted without it."""
    return _stream_transitions(runs.sparkSession, runs, ["drill", "uri"], F.col("outcome") == "ok",
                               {"round": "bigint", "error": "string"}, F.col("outcome") != "cancelled", "runs-mb", delay,
                               ["drill", "uri", "event_id", "kind", "failures", "round", "error"], sink, ended)


def stream_health_transitions(spark: SparkSession, path_glob: str, files_per_trigger: int | None = None, delay: str = DELAY) -> DataFrame:
    """OP-67, micro-batch form: per batch the chunked island operators, across batches a
    ``(uri) -> (failing, failures)`` state table. Same rows as the batch ``health_transitions``, if no row
    comes more than ``delay`` late."""
    return ordered_health_transitions(probes_stream(read_events_stream(spark, path_glob, files_per_trigger)), delay).transitions


def stream_run_transitions(spark: SparkSession, path_glob: str, files_per_trigger: int | None = None, delay: str = DELAY) -> DataFrame:
    """OP-68, micro-batch form; the state also carries the round counter per (drill, uri)."""
    return ordered_run_transitions(runs_stream(read_events_stream(spark, path_glob, files_per_trigger)), delay).transitions
