"""Mutation and read queries on the ``points`` collection (OP-11..OP-19, OP-23..OP-28)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectables.functions.random import uniform_int_sql
from vectables.functions.vectors import random_vector_sql
from vectables.operators import mutations as mu
from vectables.operators import reads
from vectables.operators.checks import one_row_join
from vectables.plans.registry import register
from vectables.sources import generators, tables, views
from vectables.sources.views import with_views

DIM = 64
VARIANTS = 2


def collection(spark, sf_dir):
    """The ``points`` view as a collection: ``(id, vec, payload)``."""
    pts = views.points(spark, sf_dir)
    return pts.select("id", "vec", F.create_map(F.lit("a"), F.col("a")).alias("payload"))


def summary(df, *extra):
    return df.select("id", *mu.summary_columns(), *extra)


def gen_points_sql(id_expr: str, source: str, dim: int, variants: int | None, stream: str) -> str:
    a = "CAST(NULL AS VARCHAR)" if not variants else (
        f"concat('keyword_', CAST({uniform_int_sql(stream + '/payload', variants, id_expr)} AS VARCHAR))")
    return (f"SELECT CAST({id_expr} AS BIGINT) AS id, {random_vector_sql(stream + '/vector', id_expr, dim)} AS vec, "
            f"{a} AS a FROM {source}")


def summary_sql(rel: str, extra: str = "") -> str:
    return (
        "SELECT id, a, CAST(CASE WHEN a IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_keys, "
        "CAST(len(vec) AS BIGINT) AS dim, round(list_sum(CAST(vec AS DOUBLE[])), 6) AS vsum"
        f"{extra} FROM {rel}"
    )


# --- OP-11: bulk upsert: half the delta replaces points, half is new ------------------------

@register("upsert_bulk", with_views(
    summary_sql("merged", ", src"),
    "points",
    extra={
        "delta": gen_points_sql("vec_id * 2", "embeddings", DIM, VARIANTS, "upsert"),
        "merged": "SELECT id, vec, a, 'base' AS src FROM points WHERE id NOT IN (SELECT id FROM delta) "
                  "UNION ALL SELECT id, vec, a, 'delta' AS src FROM delta",
    },
))
def q_upsert_bulk(spark, sf_dir):
    base = collection(spark, sf_dir).withColumn("src", F.lit("base"))
    ids = tables.embeddings(spark, sf_dir, "vec_id").select((F.col("vec_id") * 2).alias("id"))
    delta = generators.gen_points(ids, DIM, VARIANTS, stream="upsert").select(
        "id", "vec", "payload", F.lit("delta").alias("src"))
    return summary(mu.upsert(base, delta), "src")


# --- OP-12: one-row upsert with an empty payload wipes the old payload (S1) ------------------

@register("upsert_one", with_views(
    summary_sql("merged"),
    "points",
    extra={
        "delta": gen_points_sql("vec_id", "embeddings WHERE vec_id = 0", DIM, 0, "upsert_one"),
        "merged": "SELECT id, vec, a FROM points WHERE id NOT IN (SELECT id FROM delta) "
                  "UNION ALL SELECT id, vec, a FROM delta",
    },
))
def q_upsert_one(spark, sf_dir):
    base = collection(spark, sf_dir)
    ids = tables.embeddings(spark, sf_dir, "vec_id").where(F.col("vec_id") == 0)
    delta = generators.gen_points(ids, DIM, 0, id_col="vec_id", stream="upsert_one").select("id", "vec", "payload")
    return summary(mu.upsert(base, delta))


# --- OP-13: payload patch from the click log ---------------------------------------------

PATCH_SQL = ("SELECT user_id AS id, concat('k', CAST(event_id % 3 AS VARCHAR)) AS k, "
             "concat('v', CAST(event_id % 11 AS VARCHAR)) AS v, event_id AS seq FROM events WHERE event_type = 'click'")


def click_patch(spark, sf_dir):
    ev = tables.events(spark, sf_dir, "event_id", "user_id", "event_type").where(F.col("event_type") == "click")
    return ev.select(
        F.col("user_id").alias("id"),
        F.concat(F.lit("k"), (F.col("event_id") % 3).cast("string")).alias("k"),
        F.concat(F.lit("v"), (F.col("event_id") % 11).cast("string")).alias("v"),
        F.col("event_id").alias("seq"),
    )


@register("set_payload", with_views(
    "SELECT p.id, 'a' AS k, p.a AS v FROM points p "
    "WHERE NOT EXISTS (SELECT 1 FROM patch x WHERE x.id = p.id AND x.k = 'a') "
    "UNION ALL SELECT x.id, x.k, arg_max(x.v, x.seq) AS v FROM patch x JOIN points p ON p.id = x.id GROUP BY x.id, x.k",
    "points", extra={"patch": PATCH_SQL},
))
def q_set_payload(spark, sf_dir):
    patched = mu.set_payload(collection(spark, sf_dir), click_patch(spark, sf_dir))
    return mu.long_payload(patched)


# --- OP-14 / OP-15 ------------------------------------------------------------------------

@register("delete_by_id", with_views(
    "SELECT id, a FROM points WHERE id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')", "points",
))
def q_delete_by_id(spark, sf_dir):
    ids = tables.events(spark, sf_dir, "user_id", "event_type").where(F.col("event_type") == "error") \
        .select(F.col("user_id").alias("id"))
    return mu.delete_ids(collection(spark, sf_dir), ids).select("id", F.col("payload")["a"].alias("a"))


DELETE_N = 250


@register("delete_range", with_views(
    f"SELECT id, a FROM points WHERE NOT (id >= 0 AND id < {DELETE_N})", "points",
))
def q_delete_range(spark, sf_dir):
    return mu.delete_range(collection(spark, sf_dir), DELETE_N).select("id", F.col("payload")["a"].alias("a"))


# --- OP-16: change-log apply ---------------------------------------------------------------

APPLY_CTES = """resets AS (SELECT id, arg_max(op, seq) AS reset_op, max(seq) AS reset_seq FROM {log}
             WHERE op IN ('upsert', 'delete') GROUP BY id),
live AS (SELECT id, reset_seq FROM resets WHERE reset_op = 'upsert'),
kv AS (SELECT o.id, o.k, arg_max(o.v, o.seq) AS v FROM {log} o JOIN live l ON o.id = l.id AND o.seq >= l.reset_seq
       WHERE o.op IN ('upsert', 'set_payload') AND o.k IS NOT NULL GROUP BY o.id, o.k),
final AS (SELECT l.id, kv.k, kv.v FROM live l LEFT JOIN kv ON l.id = kv.id)"""


def _apply_sql(log: str, log_sql: str, select: str = "SELECT id, k, v FROM final") -> str:
    return f"WITH {log} AS ({log_sql}),\n" + APPLY_CTES.format(log=log) + "\n" + select


@register("apply_oplog", _apply_sql("oplog", views.OPLOG_SQL))
def q_apply_oplog(spark, sf_dir):
    return mu.apply_oplog(views.oplog(spark, sf_dir))


CYCLE_LOG_SQL = (
    "SELECT event_id * 6 + s.step AS seq, event_id AS id, "
    "CASE s.step WHEN 0 THEN 'upsert' WHEN 1 THEN 'search' WHEN 2 THEN 'set_payload' WHEN 3 THEN 'upsert' "
    "WHEN 4 THEN 'get' ELSE 'delete' END AS op, "
    "CASE WHEN s.step IN (0, 2, 3) THEN 'a' END AS k, "
    "CASE WHEN s.step IN (0, 2, 3) THEN concat('keyword_', CAST("
    + uniform_int_sql("cycle/payload", VARIANTS, "event_id * 6 + s.step")
    + " AS VARCHAR)) END AS v FROM events, (SELECT range AS step FROM range(6)) s"
)


def cycle_log(spark, sf_dir):
    """The drill's operation cycles (OP-09) on every event id, as a change log with payloads."""
    from vectables.functions.random import uniform_int

    cycles = generators.gen_oplog(tables.events(spark, sf_dir, "event_id"), 3, id_col="event_id")
    writes = F.col("op").isin("upsert", "set_payload")
    return cycles.select(
        "seq", "id", "op",
        F.when(writes, F.lit("a")).alias("k"),
        F.when(writes, F.concat(F.lit("keyword_"), uniform_int("cycle/payload", VARIANTS, F.col("seq")).cast("string")))
        .alias("v"),
    )


@register("apply_oplog_cycle_empty", _apply_sql(
    "cyc", CYCLE_LOG_SQL,
    "SELECT CAST((SELECT count(DISTINCT id) FROM cyc) AS BIGINT) AS cycles, "
    "CAST((SELECT count(*) FROM cyc) AS BIGINT) AS ops, "
    "CAST((SELECT count(DISTINCT id) FROM final) AS BIGINT) AS live_points",
))
def q_apply_oplog_cycle_empty(spark, sf_dir):
    log = cycle_log(spark, sf_dir)
    final = mu.apply_oplog(log)
    stats = log.agg(F.countDistinct("id").cast("bigint").alias("cycles"), F.count(F.lit(1)).cast("bigint").alias("ops"))
    live = final.agg(F.countDistinct("id").cast("bigint").alias("live_points"))
    return one_row_join(stats, live).select("cycles", "ops", "live_points")


# --- OP-17: progressive fill: empty points -> payload -> vectors (payload wiped) ------------

FILL_DIM = 768


@register("progressive_fill", with_views(
    "SELECT id, CAST(NULL AS VARCHAR) AS a, CAST(0 AS BIGINT) AS n_keys, CAST(len(vec) AS BIGINT) AS dim, "
    "round(list_sum(CAST(vec AS DOUBLE[])), 6) AS vsum FROM phase3",
    extra={"phase3": gen_points_sql("vec_id", "embeddings", FILL_DIM, 0, "fill/vectors")},
))
def q_progressive_fill(spark, sf_dir):
    ids = tables.embeddings(spark, sf_dir, "vec_id").select(F.col("vec_id").alias("id"))
    empty = generators.gen_points(ids, 0, 0, stream="fill/empty").select("id", "vec", "payload")
    keyed = generators.gen_points(ids, 0, VARIANTS, stream="fill/payload")
    patch = keyed.select("id", F.lit("a").alias("k"), F.col("a").alias("v"), F.lit(0).cast("bigint").alias("seq"))
    phase2 = mu.set_payload(empty, patch)
    vectors = generators.gen_points(ids, FILL_DIM, 0, stream="fill/vectors").select("id", "vec", "payload")
    phase3 = mu.upsert(phase2, vectors)
    return summary(phase3)


# --- OP-18: refresh ids 0..99, the rest untouched -------------------------------------------

@register("refresh_slice", with_views(
    summary_sql("merged"),
    "points",
    extra={
        "delta": gen_points_sql("vec_id", "embeddings WHERE vec_id < 100", DIM, VARIANTS, "refresh"),
        "merged": "SELECT id, vec, a FROM points WHERE id NOT IN (SELECT id FROM delta) "
                  "UNION ALL SELECT id, vec, a FROM delta",
    },
))
def q_refresh_slice(spark, sf_dir):
    base = collection(spark, sf_dir)
    ids = tables.embeddings(spark, sf_dir, "vec_id").where(F.col("vec_id") < 100)
    delta = generators.gen_points(ids, DIM, VARIANTS, id_col="vec_id", stream="refresh").select("id", "vec", "payload")
    return summary(mu.upsert(base, delta))


# --- OP-19: write acknowledgement ledger ---------------------------------------------------

@register("write_ledger_audit", """
SELECT batch_id, CAST(count(*) AS BIGINT) AS expected,
       CAST(count(*) FILTER (WHERE status = 2) AS BIGINT) AS acked,
       CAST(count(*) FILTER (WHERE status <> 2) AS BIGINT) AS failed,
       count(*) FILTER (WHERE status <> 2) = 0 AS ok
FROM (SELECT CAST(floor(event_id / 100) AS BIGINT) AS batch_id,
             CASE WHEN event_type = 'error' AND value > 50 THEN 1 ELSE 2 END AS status FROM events) t
GROUP BY batch_id""")
def q_write_ledger_audit(spark, sf_dir):
    from vectables.operators.checks import write_ledger

    ev = tables.events(spark, sf_dir, "event_id", "event_type", "value")
    acks = ev.select(
        F.col("event_id").alias("id"),
        F.when((F.col("event_type") == "error") & (F.col("value") > 50), 1).otherwise(2).alias("status"),
    )
    return write_ledger(acks)


# --- reads ---------------------------------------------------------------------------------

@register("get_by_id", with_views("SELECT id, a FROM points WHERE id = 7 LIMIT 1", "points"))
def q_get_by_id(spark, sf_dir):
    return reads.get_by_id(views.points(spark, sf_dir), 7)


@register("retrieve_ids", with_views(
    "SELECT id, a, CAST(len(vec) AS BIGINT) AS dim, round(list_sum(CAST(vec AS DOUBLE[])), 6) AS vsum "
    "FROM points WHERE id IN (SELECT user_id FROM events)", "points",
))
def q_retrieve_ids(spark, sf_dir):
    from vectables.functions.vectors import vsum

    ids = tables.events(spark, sf_dir, "user_id").select(F.col("user_id").alias("id"))
    got = reads.retrieve(views.points(spark, sf_dir), ids)
    return got.select("id", "a", F.size("vec").cast("bigint").alias("dim"), F.round(vsum(F.col("vec")), 6).alias("vsum"))


@register("points_count", "SELECT CAST(count(*) AS BIGINT) AS points_count FROM embeddings")
def q_points_count(spark, sf_dir):
    return reads.points_count(views.points(spark, sf_dir))


@register("collection_info", with_views(
    "SELECT CASE WHEN i >= v THEN 'green' ELSE 'yellow' END AS status, CAST(n AS BIGINT) AS points_count, CAST(v AS BIGINT) AS vectors_count, "
    "CAST(a AS BIGINT) AS a_points, CAST(i AS BIGINT) AS indexed_vectors_count, CAST(CASE WHEN a > 0 THEN 1 ELSE 0 END AS BIGINT) AS payload_fields "
    "FROM (SELECT count(*) AS n, count(vec) AS v, count(a) AS a, count(*) FILTER (WHERE len(vec) > 0) AS i FROM points)", "points",
))
def q_collection_info(spark, sf_dir):
    from vectables.operators import ivf

    points = views.points(spark, sf_dir)
    return reads.collection_info(points, indexed=ivf.assign_cells(points, ivf.pick_pivots(points)))


@register("collection_status_errors", with_views(
    "SELECT n.collection, s.status, s.last_event_id, CASE WHEN s.status IS NULL THEN 'Collection `' || n.collection || '` not found' "
    "WHEN s.status = 'red' THEN 'Collection `' || n.collection || '` failed: status red' END AS error "
    "FROM (SELECT DISTINCT concat('c_', CAST(user_id % 25 AS VARCHAR)) AS collection FROM events) n LEFT JOIN "
    "(SELECT collection, arg_max(status, (ts, event_id)) AS status, arg_max(event_id, (ts, event_id)) AS last_event_id FROM statuses GROUP BY collection) s "
    "ON n.collection = s.collection", "statuses",
))
def q_collection_status_errors(spark, sf_dir):
    """Statuses asked for 25 names, five of which no poll has seen."""
    names = tables.events(spark, sf_dir, "user_id").select(F.concat(F.lit("c_"), (F.col("user_id") % 25).cast("string")).alias("collection"))
    return reads.status_errors(names, views.statuses(spark, sf_dir))


@register("collection_status", with_views(
    "SELECT collection, arg_max(status, (ts, event_id)) AS status, arg_max(event_id, (ts, event_id)) AS last_event_id, "
    "CAST(count(*) AS BIGINT) AS polls FROM statuses GROUP BY collection", "statuses",
))
def q_collection_status(spark, sf_dir):
    return reads.latest_status(views.statuses(spark, sf_dir))
