"""Operational-log analytics queries (OP-56..OP-66) over the ``probes``, ``runs`` and ``statuses`` views."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectables.operators import logs
from vectables.plans.registry import register
from vectables.sources import tables, views
from vectables.sources.views import URIS, with_views

N_URIS = len(URIS)


def bucket_sql(v: str, top: bool = True) -> str:
    sh = f"greatest(0, CAST(floor(log2(greatest({v}, 1))) AS INTEGER) - 7)"
    if top:
        return f"CAST((({v} >> {sh}) + 1) * (CAST(1 AS BIGINT) << {sh}) - 1 AS BIGINT)"
    return f"CAST(({v} >> {sh}) << {sh} AS BIGINT)"


ISLANDS_SQL = ("SELECT *, CAST(sum(CASE WHEN {ok} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY ts, event_id "
               "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS g FROM {rel}")


def runs_sql(rel: str, keys: str, ok: str, carry: tuple[str, ...] = ()) -> dict[str, str]:
    """CTEs for failure runs: ``isl`` (islands), ``fr`` (one row per run, with recovery)."""
    carry_first = "".join(f", arg_min({c}, (ts, event_id)) AS {c}" for c in carry)
    carry_rec = "".join(f", {c} AS rec_{c}" for c in carry)
    on = " AND ".join(f"r.{k.strip()} = o.{k.strip()}" for k in keys.split(","))
    return {
        "isl": ISLANDS_SQL.format(ok=ok, keys=keys, rel=rel),
        "fr0": (f"SELECT {keys}, g, arg_min(event_id, (ts, event_id)) AS first_event_id, "
                f"arg_max(event_id, (ts, event_id)) AS last_event_id, CAST(count(*) AS BIGINT) AS failures{carry_first} "
                f"FROM isl WHERE NOT ({ok}) GROUP BY {keys}, g"),
        "oks": f"SELECT {keys}, g - 1 AS g, event_id AS recovered_event_id{carry_rec} FROM isl WHERE {ok}",
        "fr": f"SELECT r.*, o.* EXCLUDE ({keys}, g) FROM fr0 r LEFT JOIN oks o ON {on} AND r.g = o.g",
    }


# --- OP-56 -----------------------------------------------------------------------------------

@register("probe_outcomes", with_views("SELECT event_id, uri, latency_ms, outcome FROM probes", "probes"))
def q_probe_outcomes(spark, sf_dir):
    ev = tables.events(spark, sf_dir, "event_id", "user_id", "event_type", "value")
    latency = F.floor("value").cast("bigint")
    return ev.select(
        "event_id",
        F.concat(F.lit("node_"), (F.col("user_id") % 3).cast("string")).alias("uri"),
        latency.alias("latency_ms"),
        # elapsed time is compared before flooring, as the timer reads it
        logs.classify_probe(F.col("value"), F.col("event_type") != "error", views.PROBE_TIMEOUT_MS).alias("outcome"),
    )


# --- OP-57 -----------------------------------------------------------------------------------

@register("failure_runs", with_views(
    "SELECT uri, g AS run, first_event_id, last_event_id, failures, recovered_event_id FROM fr",
    "probes", extra=runs_sql("probes", "uri", "outcome = 'ok'"),
))
def q_failure_runs(spark, sf_dir):
    runs = logs.failure_runs(views.probes(spark, sf_dir), ["uri"], F.col("outcome") == "ok")
    return runs.select("uri", "run", "first_event_id", "last_event_id", "failures", "recovered_event_id")


HEALTH_SELECT = (
    "SELECT uri, first_event_id AS event_id, 'failed' AS kind, CAST(NULL AS BIGINT) AS failures, latency_ms, outcome FROM fr "
    "UNION ALL SELECT uri, recovered_event_id, 'recovered', failures, rec_latency_ms, rec_outcome FROM fr "
    "WHERE recovered_event_id IS NOT NULL"
)


@register("health_transitions", with_views(
    HEALTH_SELECT, "probes", extra=runs_sql("probes", "uri", "outcome = 'ok'", ("latency_ms", "outcome")),
))
def q_health_transitions(spark, sf_dir):
    t = logs.transitions(views.probes(spark, sf_dir), ["uri"], F.col("outcome") == "ok", carry=("latency_ms", "outcome"))
    return t.select("uri", "event_id", "kind", "failures", "latency_ms", "outcome")


# --- OP-58 / OP-59 -----------------------------------------------------------------------------

@register("latency_histogram", with_views(
    f"SELECT uri, {bucket_sql('latency_ms')} AS bucket_hi, CAST(count(*) AS BIGINT) AS n FROM probes "
    "WHERE latency_ms <= 3600000 GROUP BY ALL", "probes",
))
def q_latency_histogram(spark, sf_dir):
    return logs.latency_histogram(views.probes(spark, sf_dir))


@register("latency_rejects", with_views(
    "SELECT event_id, uri, latency_ms, outcome FROM probes WHERE latency_ms > 3600000", "probes",
))
def q_latency_rejects(spark, sf_dir):
    """OP-58: probes slower than the histogram's range, row by row."""
    return logs.rejects(views.probes(spark, sf_dir)).select("event_id", "uri", "latency_ms", "outcome")


SUMMARY_SQL = (
    "SELECT uri, total, min_ms, p50_ms, p95_ms, p99_ms, max_ms, "
    "format('[min: {}ms, p50: {}ms, p95: {}ms, p99: {}ms, max: {}ms]', min_ms, p50_ms, p95_ms, p99_ms, max_ms) AS text FROM ("
    "SELECT h.uri, CAST(h.total AS BIGINT) AS total, " + bucket_sql("e.mn", top=False) + " AS min_ms, "
    "CAST(min(CASE WHEN cum >= greatest(1, ceil(total * 0.5)) THEN bucket_hi END) AS BIGINT) AS p50_ms, "
    "CAST(min(CASE WHEN cum >= greatest(1, ceil(total * 0.95)) THEN bucket_hi END) AS BIGINT) AS p95_ms, "
    "CAST(min(CASE WHEN cum >= greatest(1, ceil(total * 0.99)) THEN bucket_hi END) AS BIGINT) AS p99_ms, "
    + bucket_sql("e.mx") + " AS max_ms "
    "FROM (SELECT uri, bucket_hi, sum(n) OVER (PARTITION BY uri ORDER BY bucket_hi) AS cum, "
    "sum(n) OVER (PARTITION BY uri) AS total FROM hist) h "
    "JOIN (SELECT uri, min(latency_ms) AS mn, max(latency_ms) AS mx FROM probes WHERE latency_ms <= 3600000 GROUP BY uri) e "
    "ON h.uri = e.uri GROUP BY h.uri, h.total, e.mn, e.mx) s"
)
HIST_SQL = (f"SELECT uri, {bucket_sql('latency_ms')} AS bucket_hi, count(*) AS n FROM probes "
            "WHERE latency_ms <= 3600000 GROUP BY ALL")


@register("latency_summary", with_views(SUMMARY_SQL, "probes", extra={"hist": HIST_SQL}))
def q_latency_summary(spark, sf_dir):
    return logs.latency_summary(views.probes(spark, sf_dir))


# --- OP-60 / OP-61 / OP-64 / OP-65 -------------------------------------------------------------

RUN_TRANSITIONS_SELECT = (
    "SELECT drill, uri, first_event_id AS event_id, 'failed' AS kind, CAST(NULL AS BIGINT) AS failures, round, error FROM fr "
    "UNION ALL SELECT drill, uri, recovered_event_id, 'recovered', failures, rec_round, rec_error FROM fr "
    "WHERE recovered_event_id IS NOT NULL"
)


@register("run_transitions", with_views(
    RUN_TRANSITIONS_SELECT, "runs",
    extra={"rep": "SELECT * FROM runs WHERE outcome <> 'cancelled'",
           **runs_sql("rep", "drill, uri", "outcome = 'ok'", ("round", "error"))},
))
def q_run_transitions(spark, sf_dir):
    # one chunked pass numbers the rounds and the oks (a cancelled row is never ok, so dropping
    # cancelled rows afterwards leaves the islands of the reported rows unchanged)
    ok = F.col("outcome") == "ok"
    rows = views.runs(spark, sf_dir, extra={"g": ok.cast("bigint")}).withColumn("is_ok", ok) \
        .withColumn("__ord", F.col("round"))   # the round is the row's ordinal: it orders the runs
    reported = rows.where(F.col("outcome") != "cancelled")
    t = logs.transitions_from_islands(reported, ["drill", "uri"], carry=("round", "error"))
    return t.select("drill", "uri", "event_id", "kind", "failures", "round", "error")


REPORT_SQL = (
    "SELECT drill, round, successes, reports, seconds, "
    f"CASE WHEN successes = 0 THEN 'failed' WHEN successes = {N_URIS} THEN 'success' ELSE 'partial' END AS class, errors, "
    f"CASE WHEN successes = 0 THEN 'failed: ' || timed WHEN successes = {N_URIS} THEN 'finished in ' || seconds || ' seconds' "
    "ELSE 'partially failed: ' || errors END AS message FROM ("
    "SELECT drill, round, CAST(count(*) FILTER (WHERE outcome = 'ok') AS BIGINT) AS successes, "
    "CAST(count(*) FILTER (WHERE outcome <> 'cancelled') AS BIGINT) AS reports, "
    "CAST(coalesce(sum(floor(duration_s)) FILTER (WHERE outcome <> 'cancelled'), 0) AS BIGINT) AS seconds, "
    "coalesce(string_agg(uri || ' (' || error || ')', ', ' ORDER BY uri, error) FILTER (WHERE error IS NOT NULL), '') AS errors, "
    "coalesce(string_agg(uri || ' (' || error || ', ' || CAST(floor(duration_s) AS BIGINT) || ' s)', ', ' ORDER BY uri, error, floor(duration_s)) "
    "FILTER (WHERE error IS NOT NULL), '') AS timed "
    "FROM runs GROUP BY drill, round) t"
)


@register("round_report", with_views(REPORT_SQL, "runs"))
def q_round_report(spark, sf_dir):
    return logs.round_report(views.runs(spark, sf_dir), N_URIS)


@register("until_first_fatal", with_views(
    "SELECT drill, uri, round, event_id, outcome FROM runs r WHERE (SELECT min(e) FROM ("
    " SELECT max((ts, event_id)) AS e FROM runs x WHERE (x.drill, x.round) IN "
    "  (SELECT (drill, round) FROM report WHERE class = 'failed') GROUP BY drill, round)) IS NULL "
    "OR (r.ts, r.event_id) <= (SELECT min(e) FROM (SELECT max((ts, event_id)) AS e FROM runs x WHERE (x.drill, x.round) IN "
    "  (SELECT (drill, round) FROM report WHERE class = 'failed') GROUP BY drill, round))",
    "runs", extra={"report": REPORT_SQL},
))
def q_until_first_fatal(spark, sf_dir):
    return logs.until_first_fatal(views.runs(spark, sf_dir)).select("drill", "uri", "round", "event_id", "outcome")


@register("error_taxonomy", with_views(
    "SELECT outcome, CAST(count(*) AS BIGINT) AS n, outcome <> 'cancelled' AS reported FROM runs GROUP BY outcome", "runs",
))
def q_error_taxonomy(spark, sf_dir):
    return logs.error_taxonomy(views.reports(spark, sf_dir))


# --- OP-62 -------------------------------------------------------------------------------------

INCLUDE = ("drill_1", "drill_3", "drill_unknown")
IGNORE = ("drill_1",)


@register("select_by_name", with_views(
    "SELECT DISTINCT drill AS name FROM runs WHERE drill IN ('drill_1', 'drill_3', 'drill_unknown')", "runs",
))
def q_select_by_name(spark, sf_dir):
    names = views.reports(spark, sf_dir).select(F.col("drill").alias("name")).distinct()
    return logs.select_names(names, include=INCLUDE, ignore=IGNORE)


@register("select_by_ignore", with_views(
    "SELECT DISTINCT drill AS name FROM runs WHERE drill NOT IN ('drill_1')", "runs",
))
def q_select_by_ignore(spark, sf_dir):
    names = views.reports(spark, sf_dir).select(F.col("drill").alias("name")).distinct()
    return logs.select_names(names, ignore=IGNORE)


# --- OP-63 / OP-66 -----------------------------------------------------------------------------

DEBOUNCE_CTES = {
    "s": "SELECT *, row_number() OVER (PARTITION BY collection ORDER BY ts, event_id) AS ordinal, "
         "sum(CASE WHEN status <> 'green' THEN 1 ELSE 0 END) OVER (PARTITION BY collection ORDER BY ts, event_id "
         "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM statuses",
    "seen": "SELECT *, row_number() OVER (PARTITION BY collection, island ORDER BY ts, event_id) AS seen FROM s",
    "ready": "SELECT collection, min(ordinal) AS ordinal FROM seen WHERE seen = 3 GROUP BY collection",
    "hit": "SELECT s.collection, s.event_id, s.ordinal, s.ts FROM s JOIN ready r "
           "ON s.collection = r.collection AND s.ordinal = r.ordinal",
    "first_poll": "SELECT collection, min(ts) AS first_ts FROM statuses GROUP BY collection",
}


@register("green_debounce", with_views(
    "SELECT f.collection, h.event_id AS ready_event_id, CAST(h.ordinal AS BIGINT) AS ready_poll, "
    "date_diff('microsecond', f.first_ts, h.ts) / 1e6 AS waited_s "
    "FROM first_poll f LEFT JOIN hit h ON f.collection = h.collection",
    "statuses", extra=DEBOUNCE_CTES,
))
def q_green_debounce(spark, sf_dir):
    return logs.green_debounce(views.statuses(spark, sf_dir))


# --- OP-59 cumulative: summary as of each transition (S17) -----------------------------------

CUMULATIVE_CTES = {
    **runs_sql("probes", "uri", "outcome = 'ok'"),
    "tr": "SELECT uri, first_event_id AS event_id, 'failed' AS kind, CAST(NULL AS BIGINT) AS failures FROM fr UNION ALL "
          "SELECT uri, recovered_event_id, 'recovered', failures FROM fr WHERE recovered_event_id IS NOT NULL",
    "pos": f"SELECT uri, event_id, ts, latency_ms, {bucket_sql('latency_ms')} AS bucket FROM probes WHERE latency_ms <= 3600000",
    "pairs": "SELECT t.uri, t.event_id, t.kind, p.bucket, p.latency_ms FROM tr t JOIN probes tp ON tp.event_id = t.event_id "
             "JOIN pos p ON p.uri = t.uri AND (p.ts < tp.ts OR (p.ts = tp.ts AND p.event_id <= tp.event_id))",
    "hist": "SELECT uri, event_id, kind, bucket, count(*) AS n FROM pairs GROUP BY ALL",
    "cum": "SELECT *, sum(n) OVER (PARTITION BY uri, event_id ORDER BY bucket) AS cum, "
           "sum(n) OVER (PARTITION BY uri, event_id) AS total FROM hist",
    "qs": "SELECT uri, event_id, kind, CAST(total AS BIGINT) AS total, "
          "CAST(min(CASE WHEN cum >= greatest(1, ceil(total * 0.5)) THEN bucket END) AS BIGINT) AS p50_ms, "
          "CAST(min(CASE WHEN cum >= greatest(1, ceil(total * 0.95)) THEN bucket END) AS BIGINT) AS p95_ms, "
          "CAST(min(CASE WHEN cum >= greatest(1, ceil(total * 0.99)) THEN bucket END) AS BIGINT) AS p99_ms "
          "FROM cum GROUP BY uri, event_id, kind, total",
    "mm": "SELECT uri, event_id, min(latency_ms) AS mn, max(latency_ms) AS mx FROM pairs GROUP BY uri, event_id",
}


@register("latency_cumulative", with_views(
    "SELECT *, CASE WHEN total > 0 THEN format('[min: {}ms, p50: {}ms, p95: {}ms, p99: {}ms, max: {}ms]', min_ms, p50_ms, p95_ms, p99_ms, max_ms) END AS text "
    f"FROM (SELECT t.uri, t.event_id, t.kind, t.failures, coalesce(q.total, 0) AS total, {bucket_sql('m.mn', top=False)} AS min_ms, q.p50_ms, q.p95_ms, "
    f"q.p99_ms, {bucket_sql('m.mx')} AS max_ms FROM tr t LEFT JOIN qs q ON q.uri = t.uri AND q.event_id = t.event_id "
    "LEFT JOIN mm m ON t.uri = m.uri AND t.event_id = m.event_id) x",
    "probes", extra=CUMULATIVE_CTES,
))
def q_latency_cumulative(spark, sf_dir):
    from vectables.operators.cumulative import latency_at_transitions

    return latency_at_transitions(views.probes(spark, sf_dir))
