"""Streaming queries (OP-67..OP-71): each runs a Structured Streaming query to completion
(``availableNow``) over the events file and returns the sink as a DataFrame. The oracles are
the batch ones: streaming output must equal batch output."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectables.plans import log_queries, table_queries  # noqa: F401 - they register the batch oracles
from vectables.plans.registry import ORACLE, register
from vectables.sources import tables
from vectables.sources.views import with_views
from vectables.streaming import stateful


def events_glob(sf_dir: str) -> str:
    return f"{sf_dir.rstrip('/')}/events.parquet*"


@register("stream_health_transitions", ORACLE["health_transitions"])
def q_stream_health_transitions(spark, sf_dir):
    return stateful.stream_health_transitions(spark, events_glob(sf_dir)).select(
        "uri", "event_id", "kind", "failures", "latency_ms", "outcome")


@register("stream_run_transitions", ORACLE["run_transitions"])
def q_stream_run_transitions(spark, sf_dir):
    return stateful.stream_run_transitions(spark, events_glob(sf_dir)).select(
        "drill", "uri", "event_id", "kind", "failures", "round", "error")


# --- OP-67, rows out of order ------------------------------------------------------------------
# Events arrive in four slices of arrival time: up to 48 minutes after their own time, every twentieth three days after it.

ARRIVALS = 4
ARRIVED_SQL = {
    "sent": ("SELECT event_id, ts, epoch_us(ts) + CASE WHEN event_id % 20 = 0 THEN 259200000000 ELSE event_id % 7 * 480000000 END AS arrival "
             "FROM events"),
    "slices": ("SELECT event_id, ts, (arrival - (SELECT min(arrival) FROM sent)) * 4 // "
               "((SELECT max(arrival) - min(arrival) FROM sent) + 1) AS slice FROM sent"),
    "newest": "SELECT slice, max(max(ts)) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ts FROM slices GROUP BY slice",
    "late": ("SELECT s.event_id FROM slices s JOIN newest n ON s.slice = n.slice WHERE s.ts < n.ts - INTERVAL 1 hour"),
    "ontime": "SELECT * FROM probes WHERE event_id NOT IN (SELECT event_id FROM late)",
}


@register("stream_out_of_order", with_views(
    log_queries.HEALTH_SELECT + " UNION ALL SELECT uri, event_id, 'late', NULL, latency_ms, outcome FROM probes "
    "WHERE event_id IN (SELECT event_id FROM late)",
    "probes", extra=ARRIVED_SQL | log_queries.runs_sql("ontime", "uri", "outcome = 'ok'", ("latency_ms", "outcome"))))
def q_stream_out_of_order(spark, sf_dir):
    """Slices arrive one after the other, the stream goes on from its checkpoint each time; late rows are rows of their own."""
    sink = stateful.scratch(spark, "arrivals")
    at = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    lag = F.when(F.col("event_id") % 20 == 0, F.lit(259_200_000_000)).otherwise(F.col("event_id") % 7 * 480_000_000)
    sent = tables.events(spark, sf_dir, "event_id", "ts", "user_id", "event_type", "value", "props").withColumn("arrival", at + lag)
    lo, hi = sent.agg(F.min("arrival"), F.max("arrival")).first()
    if lo is None:
        lo = hi = 0
    sent = sent.withColumn("slice", F.expr(f"(arrival - {lo}L) * {ARRIVALS} div {hi - lo + 1}L"))
    probes = stateful.probes_stream(stateful.read_events_stream(spark, f"{sink}/events/*"))
    for i in range(ARRIVALS):
        sent.where(F.col("slice") == i).drop("arrival", "slice").write.parquet(f"{sink}/events/slice={i}")
        run = stateful.ordered_health_transitions(probes, "1 hour", f"{sink}/run", ended=i == ARRIVALS - 1)
    late = run.late.select("uri", "event_id", F.lit("late").alias("kind"), F.lit(None).cast("bigint").alias("failures"), "latency_ms", "outcome")
    return run.transitions.unionByName(late)


@register("stream_latency_histogram", ORACLE["latency_histogram"])
def q_stream_latency_histogram(spark, sf_dir):
    return stateful.stream_latency_histogram(spark, events_glob(sf_dir)).select("uri", "bucket_hi", "n")


@register("stream_apply_oplog", ORACLE["apply_oplog"])
def q_stream_apply_oplog(spark, sf_dir):
    return stateful.stream_apply_oplog(spark, events_glob(sf_dir))


@register("stream_window_latency", with_views(
    "SELECT * FROM (SELECT uri, time_bucket(INTERVAL 1 hour, ts) AS window_start, CAST(count(*) AS BIGINT) AS probes, "
    "min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, CAST(sum(latency_ms) AS BIGINT) AS total_ms "
    "FROM probes GROUP BY uri, window_start) w "
    "WHERE window_start + INTERVAL 1 hour <= (SELECT max(ts) FROM events) - INTERVAL 10 minutes",
    "probes",
))
def q_stream_window_latency(spark, sf_dir):
    return stateful.stream_window_latency(spark, events_glob(sf_dir))
