"""Canonical input views over the supplied tables.

FIXED VALUES (they define the test inputs and must stay as written):
  points     id = vec_id, vec = embedding, a = 'keyword_' || (label % 2)
  probes     uri = 'node_' || (user_id % 3), latency_ms = floor(value),
             outcome = timeout if value > 50, else error if event_type = 'error', else ok
  runs       drill = 'drill_' || (user_id % 10), uri = 'node_' || (event_id % 3),
             outcome = client (error), invariant (signup), cancelled (purchase with value < 5), else ok,
             error = outcome || ' error ' || (event_id % 5) for client / invariant rows,
             round = ordinal of the row per (drill, uri) in (ts, event_id) order
  oplog      seq = event_id, id = user_id; signup / purchase -> upsert, error -> delete,
             click / view -> set_payload; k = 'k' || (event_id % 4), v = 'keyword_' || (event_id % 7),
             both null for signup and error
  attempts   collection = 'c_' || (user_id % 20), op = create on even event_id else delete,
             message: error -> 'Collection `c_<n>` already exists!', signup -> 'deadline exceeded'
  statuses   collection = 'c_' || (user_id % 20), status: error -> yellow, signup -> red, else green

Each view exists twice: a Spark builder (DataFrame API, so pruning and pushdown reach the scan)
and the same definition as DuckDB text for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectables.operators.scan import running_sums, time_chunk
from vectables.sources import tables

PROBE_TIMEOUT_MS = 50
URIS = ("node_0", "node_1", "node_2")


# ---------------------------------------------------------------- Spark builders

def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = tables.embeddings(spark, sf_dir, "vec_id", "embedding", "label")
    return emb.select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("vec"),
        F.concat(F.lit("keyword_"), (F.col("label") % 2).cast("string")).alias("a"),
    )


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.events(spark, sf_dir, "event_id", "ts", "user_id", "event_type", "value")
    return ev.select(
        "event_id",
        "ts",
        F.concat(F.lit("node_"), (F.col("user_id") % 3).cast("string")).alias("uri"),
        F.floor("value").cast("bigint").alias("latency_ms"),
        F.when(F.col("value") > PROBE_TIMEOUT_MS, "timeout")
        .when(F.col("event_type") == "error", "error")
        .otherwise("ok")
        .alias("outcome"),
    )


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``runs`` view without its round numbers, for what does not read them (no window, no join)."""
    ev = tables.events(spark, sf_dir, "event_id", "ts", "user_id", "event_type", "value")
    base = ev.select(
        F.concat(F.lit("drill_"), (F.col("user_id") % 10).cast("string")).alias("drill"),
        F.concat(F.lit("node_"), (F.col("event_id") % 3).cast("string")).alias("uri"),
        "event_id",
        "ts",
        F.col("value").alias("duration_s"),
        F.when(F.col("event_type") == "error", "client")
        .when(F.col("event_type") == "signup", "invariant")
        .when((F.col("event_type") == "purchase") & (F.col("value") < 5), "cancelled")
        .otherwise("ok")
        .alias("outcome"),
    )
    return base.withColumn(
        "error",
        F.when(
            F.col("outcome").isin("client", "invariant"),
            F.concat(F.col("outcome"), F.lit(" error "), (F.col("event_id") % 5).cast("string")),
        ),
    )


def runs(spark: SparkSession, sf_dir: str, extra: dict | None = None) -> DataFrame:
    """The ``runs`` view; ``extra`` running sums (name -> column) ride along in the same chunked
    pass that numbers the rounds."""
    base = reports(spark, sf_dir)
    with_round = running_sums(
        base, ["drill", "uri"], ["ts", "event_id"], {"round": F.lit(1), **(extra or {})}, time_chunk(base, ["drill", "uri"])
    )
    return with_round.select("drill", "uri", "round", "event_id", "ts", "duration_s", "outcome", "error",
                             *(extra or {}))


def oplog(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.events(spark, sf_dir, "event_id", "user_id", "event_type")
    et = F.col("event_type")
    no_kv = et.isin("signup", "error")
    return ev.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("id"),
        F.when(et.isin("signup", "purchase"), "upsert").when(et == "error", "delete").otherwise("set_payload").alias("op"),
        F.when(~no_kv, F.concat(F.lit("k"), (F.col("event_id") % 4).cast("string"))).alias("k"),
        F.when(~no_kv, F.concat(F.lit("keyword_"), (F.col("event_id") % 7).cast("string"))).alias("v"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.events(spark, sf_dir, "event_id", "ts", "user_id", "event_type")
    coll = F.concat(F.lit("c_"), (F.col("user_id") % 20).cast("string"))
    return ev.select(
        "event_id",
        "ts",
        coll.alias("collection"),
        F.when(F.col("event_id") % 2 == 0, "create").otherwise("delete").alias("op"),
        F.when(
            F.col("event_type") == "error",
            F.concat(F.lit("Collection `c_"), (F.col("user_id") % 20).cast("string"), F.lit("` already exists!")),
        )
        .when(F.col("event_type") == "signup", "deadline exceeded")
        .alias("message"),
    )


def statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = tables.events(spark, sf_dir, "event_id", "ts", "user_id", "event_type")
    return ev.select(
        "event_id",
        "ts",
        F.concat(F.lit("c_"), (F.col("user_id") % 20).cast("string")).alias("collection"),
        F.when(F.col("event_type") == "error", "yellow")
        .when(F.col("event_type") == "signup", "red")
        .otherwise("green")
        .alias("status"),
    )


# ---------------------------------------------------------------- DuckDB text (oracle)

POINTS_SQL = """SELECT vec_id AS id, embedding AS vec, concat('keyword_', CAST(label % 2 AS VARCHAR)) AS a
FROM embeddings"""

PROBES_SQL = """SELECT event_id, ts, concat('node_', CAST(user_id % 3 AS VARCHAR)) AS uri, CAST(floor(value) AS BIGINT) AS latency_ms,
       CASE WHEN value > 50 THEN 'timeout' WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS outcome
FROM events"""

RUNS_SQL = """SELECT drill, uri, CAST(row_number() OVER (PARTITION BY drill, uri ORDER BY ts, event_id) AS BIGINT) AS round, event_id, ts, value AS duration_s, outcome,
       CASE WHEN outcome IN ('client','invariant') THEN concat(outcome, ' error ', CAST(event_id % 5 AS VARCHAR)) END AS error
FROM (SELECT concat('drill_', CAST(user_id % 10 AS VARCHAR)) AS drill, concat('node_', CAST(event_id % 3 AS VARCHAR)) AS uri, event_id, ts, value,
       CASE WHEN event_type = 'error' THEN 'client' WHEN event_type = 'signup' THEN 'invariant' WHEN event_type = 'purchase' AND value < 5 THEN 'cancelled' ELSE 'ok' END AS outcome
FROM events) t"""

OPLOG_SQL = """SELECT event_id AS seq, user_id AS id,
       CASE event_type WHEN 'signup' THEN 'upsert' WHEN 'purchase' THEN 'upsert' WHEN 'error' THEN 'delete' ELSE 'set_payload' END AS op,
       CASE WHEN event_type IN ('signup','error') THEN NULL ELSE concat('k', CAST(event_id % 4 AS VARCHAR)) END AS k,
       CASE WHEN event_type IN ('signup','error') THEN NULL ELSE concat('keyword_', CAST(event_id % 7 AS VARCHAR)) END AS v
FROM events"""

ATTEMPTS_SQL = """SELECT event_id, ts, concat('c_', CAST(user_id % 20 AS VARCHAR)) AS collection,
       CASE WHEN event_id % 2 = 0 THEN 'create' ELSE 'delete' END AS op,
       CASE event_type WHEN 'error' THEN concat('Collection `c_', CAST(user_id % 20 AS VARCHAR), '` already exists!') WHEN 'signup' THEN 'deadline exceeded' END AS message
FROM events"""

STATUSES_SQL = """SELECT event_id, ts, concat('c_', CAST(user_id % 20 AS VARCHAR)) AS collection,
       CASE event_type WHEN 'error' THEN 'yellow' WHEN 'signup' THEN 'red' ELSE 'green' END AS status
FROM events"""

VIEW_SQL = {
    "points": POINTS_SQL,
    "probes": PROBES_SQL,
    "runs": RUNS_SQL,
    "oplog": OPLOG_SQL,
    "attempts": ATTEMPTS_SQL,
    "statuses": STATUSES_SQL,
}


def with_views(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with ``WITH`` clauses for the named canonical views (and extra CTEs, in order)."""
    ctes = [f"{n} AS ({VIEW_SQL[n]})" for n in names]
    ctes += [f"{n} AS ({body})" for n, body in (extra or {}).items()]
    return ("WITH " + ",\n".join(ctes) + "\n" + sql) if ctes else sql
