"""Data-quality check queries (OP-38, OP-39, OP-47..OP-55) and manifest folds (OP-46)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectables.operators import catalog as cat
from vectables.operators import ivf
from vectables.operators import checks as ck
from vectables.operators import versions
from vectables.operators import mutations as mu
from vectables.operators.scan import block_chunk, chunked_lag, running_sums
from vectables.plans.registry import register
from vectables.plans.search_queries import PARTLY_NULL_SQL, partly_null_points
from vectables.plans.table_queries import collection, gen_points_sql
from vectables.sources import generators, tables, views
from vectables.sources.views import with_views

DIM = 64


@register("check_count", with_views(
    "SELECT 'count' AS \"check\", 'points' AS collection, CAST(max(id) + 1 AS BIGINT) AS expected, "
    "CAST(count(*) AS BIGINT) AS actual, count(*) = max(id) + 1 AS ok FROM points "
    "UNION ALL SELECT 'empty_after_delete', 'points', CAST(0 AS BIGINT), "
    "CAST((SELECT count(*) FROM points WHERE id NOT IN (SELECT id FROM points)) AS BIGINT), "
    "(SELECT count(*) FROM points WHERE id NOT IN (SELECT id FROM points)) = 0",
    "points",
))
def q_check_count(spark, sf_dir):
    pts = collection(spark, sf_dir)
    agg = pts.agg(F.count(F.lit(1)).alias("n"), (F.max("id") + 1).alias("dense"))
    dense = ck.check_row(agg, "count", "points", F.col("dense"), F.col("n"), F.col("n") == F.col("dense"))
    emptied = mu.delete_ids(pts, pts.select("id"))
    return dense.unionByName(ck.check_count(emptied, 0, "empty_after_delete"))


RETURNED_SQL = "SELECT user_id AS id FROM events"


@register("id_set_diff", with_views(
    "SELECT id, CAST(coalesce(en, 0) AS BIGINT) AS n_expected, CAST(coalesce(rn, 0) AS BIGINT) AS n_returned, kind FROM ("
    " SELECT coalesce(e.id, r.id) AS id, e.n AS en, r.n AS rn,"
    " CASE WHEN r.n IS NULL THEN 'missing' WHEN e.n IS NULL THEN 'extra' WHEN r.n > 1 THEN 'duplicate' END AS kind"
    " FROM (SELECT id, count(*) AS n FROM points GROUP BY id) e"
    " FULL OUTER JOIN (SELECT id, count(*) AS n FROM ret GROUP BY id) r ON e.id = r.id) x WHERE kind IS NOT NULL",
    "points", extra={"ret": RETURNED_SQL},
))
def q_id_set_diff(spark, sf_dir):
    expected = views.points(spark, sf_dir).select("id")
    returned = tables.events(spark, sf_dir, "user_id").select(F.col("user_id").alias("id"))
    return ck.id_set_diff(expected, returned, keyed=True)


@register("check_id_set", with_views(
    "SELECT 'points' AS collection, CAST((SELECT count(*) FROM points) AS BIGINT) AS expected, "
    "CAST((SELECT count(*) FROM ret) AS BIGINT) AS returned, "
    "CAST(count(*) FILTER (WHERE kind = 'missing') AS BIGINT) AS missing, "
    "CAST(count(*) FILTER (WHERE kind = 'duplicate') AS BIGINT) AS duplicate, "
    "CAST(count(*) FILTER (WHERE kind = 'extra') AS BIGINT) AS extra, "
    "(SELECT count(*) FROM points) = (SELECT count(*) FROM ret) AND count(*) FILTER (WHERE kind IS NOT NULL) = 0 AS ok "
    "FROM (SELECT CASE WHEN r.n IS NULL THEN 'missing' WHEN e.n IS NULL THEN 'extra' WHEN r.n > 1 THEN 'duplicate' END AS kind "
    " FROM (SELECT id, count(*) AS n FROM points GROUP BY id) e"
    " FULL OUTER JOIN (SELECT id, count(*) AS n FROM ret GROUP BY id) r ON e.id = r.id) x",
    "points", extra={"ret": RETURNED_SQL},
))
def q_check_id_set(spark, sf_dir):
    expected = views.points(spark, sf_dir).select("id")
    returned = tables.events(spark, sf_dir, "user_id").select(F.col("user_id").alias("id"))
    return ck.check_id_set(expected, returned, keyed=True)


@register("check_id_set_refreshed", with_views(
    "SELECT 'points' AS collection, CAST((SELECT count(*) FROM points) AS BIGINT) AS expected, "
    "CAST((SELECT count(*) FROM ret) AS BIGINT) AS returned, "
    "CAST(count(*) FILTER (WHERE p.id IS NOT NULL AND r.id IS NULL) AS BIGINT) AS missing, "
    "CAST((SELECT count(*) FROM (SELECT id FROM ret GROUP BY id HAVING count(*) > 1) x) AS BIGINT) AS duplicate, "
    "CAST(count(*) FILTER (WHERE p.id IS NULL) AS BIGINT) AS extra, "
    "(SELECT count(*) FROM points) = (SELECT count(*) FROM ret) AND count(*) FILTER (WHERE p.id IS NULL OR r.id IS NULL) = 0 AS ok "
    "FROM points p FULL OUTER JOIN ret r ON p.id = r.id",
    "points", extra={"ret": "SELECT p.id FROM points p LEFT JOIN (SELECT vec_id FROM embeddings WHERE vec_id < 100) d ON p.id = d.vec_id"},
))
def q_check_id_set_refreshed(spark, sf_dir):
    """A refresh of ids 0..99 keeps the id set: equal by fingerprint, so no id is joined."""
    before = collection(spark, sf_dir)
    return ck.check_id_set(before.select("id"), mu.upsert(before, refreshed(spark, sf_dir)).select("id"), keyed=True)


REFRESH_SQL = gen_points_sql("vec_id", "embeddings WHERE vec_id < 100", DIM, 2, "refresh")


DIFF_SQL = with_views(
    "SELECT p.id, NOT (p.vec IS NOT DISTINCT FROM coalesce(d.vec, p.vec)) AS changed FROM points p "
    "LEFT JOIN delta d ON p.id = d.id",
    "points", extra={"delta": REFRESH_SQL},
)


def refreshed(spark, sf_dir):
    """New vectors for ids 0..99."""
    ids = tables.embeddings(spark, sf_dir, "vec_id").where(F.col("vec_id") < 100)
    return generators.gen_points(ids, DIM, 2, id_col="vec_id", stream="refresh").select("id", "vec", "payload")


@register("vector_diff", DIFF_SQL)
def q_vector_diff(spark, sf_dir):
    before = collection(spark, sf_dir)
    return ck.vector_diff(before, mu.upsert(before, refreshed(spark, sf_dir)))


@register("vector_diff_stored", DIFF_SQL)
def q_vector_diff_stored(spark, sf_dir):
    """The same diff between two stored versions: buckets are merged where they lie."""
    table = collection(spark, sf_dir)
    buckets = versions.buckets_for(table)
    before = versions.save_version(table, buckets)
    after = versions.save_version(mu.upsert(before, refreshed(spark, sf_dir)), buckets)
    return versions.vector_diff(before, after)


CHANGED_SQL = with_views(
    "SELECT 'vectors_changed' AS \"check\", 'points' AS collection, CAST(count(*) AS BIGINT) AS expected, "
    "CAST(count(*) FILTER (WHERE p.vec IS DISTINCT FROM d.vec) AS BIGINT) AS actual, "
    "count(*) = count(*) FILTER (WHERE p.vec IS DISTINCT FROM d.vec) AS ok FROM points p JOIN delta d ON p.id = d.id",
    "points", extra={"delta": gen_points_sql("vec_id", "embeddings", DIM, 2, "overwrite")},
)


def overwritten(spark, sf_dir):
    """New vectors for every id."""
    ids = tables.embeddings(spark, sf_dir, "vec_id")
    return generators.gen_points(ids, DIM, 2, id_col="vec_id", stream="overwrite").select("id", "vec", "payload")


@register("check_vectors_changed", CHANGED_SQL)
def q_check_vectors_changed(spark, sf_dir):
    before = collection(spark, sf_dir)
    return ck.check_vectors_changed(before, mu.upsert(before, overwritten(spark, sf_dir)))


@register("check_vectors_changed_stored", CHANGED_SQL)
def q_check_vectors_changed_stored(spark, sf_dir):
    table = collection(spark, sf_dir)
    buckets = versions.buckets_for(table)
    before = versions.save_version(table, buckets)
    return versions.check_vectors_changed(before, versions.save_version(mu.upsert(before, overwritten(spark, sf_dir)), buckets))


@register("check_vectors_present", with_views(
    "SELECT 'vectors_present' AS \"check\", 'points' AS collection, CAST(0 AS BIGINT) AS expected, "
    "CAST(count(*) FILTER (WHERE aux IS NULL) AS BIGINT) AS actual, count(*) FILTER (WHERE aux IS NULL) = 0 AS ok FROM partly",
    extra={"partly": PARTLY_NULL_SQL},
))
def q_check_vectors_present(spark, sf_dir):
    return ck.check_vectors_present(partly_null_points(spark, sf_dir), vector="aux")


SAMPLES_SQL = "SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'purchase'"


@register("check_points_exist", with_views(
    "SELECT 'points_exist' AS \"check\", 'points' AS collection, CAST(count(*) AS BIGINT) AS expected, "
    "CAST(count(*) FILTER (WHERE id IN (SELECT id FROM points)) AS BIGINT) AS actual, "
    "count(*) FILTER (WHERE id NOT IN (SELECT id FROM points)) = 0 AS ok FROM samples",
    "points", extra={"samples": SAMPLES_SQL},
))
def q_check_points_exist(spark, sf_dir):
    samples = tables.events(spark, sf_dir, "user_id", "event_type").where(F.col("event_type") == "purchase") \
        .select(F.col("user_id").alias("id"))
    return ck.check_points_exist(collection(spark, sf_dir), samples)


def _search_hits_sql():
    from vectables.plans.search_queries import QUERIES_SQL, cos_sql, topk_sql

    hits = topk_sql(f"SELECT q.query_id, p.id, round({cos_sql('q.qv', 'p.vec')}, 6) AS score, p.a "
                    "FROM queries q JOIN points p ON p.a = q.must_a")
    return with_views(
        "SELECT q.query_id, CAST(coalesce(c.hits, 0) AS BIGINT) AS hits, "
        "CASE WHEN c.hits IS NULL THEN 'no_hits' WHEN t.a IS NULL THEN 'empty_payload' "
        "WHEN t.id IS NULL OR t.id < 0 OR t.id >= (SELECT count(*) FROM points) THEN 'bad_id' ELSE 'ok' END AS reason "
        "FROM queries q LEFT JOIN (SELECT * FROM hits WHERE rank = 1) t ON q.query_id = t.query_id "
        "LEFT JOIN (SELECT query_id, count(*) AS hits FROM hits GROUP BY query_id) c ON q.query_id = c.query_id",
        "points", extra={"queries": QUERIES_SQL, "hits": hits},
    )


@register("check_search_hits", _search_hits_sql())
def q_check_search_hits(spark, sf_dir):
    from vectables.operators.search import search_batch
    from vectables.plans.search_queries import supplied_queries

    pts = views.points(spark, sf_dir)
    queries = supplied_queries(spark, sf_dir)
    hits = search_batch(pts, queries, dim=DIM)
    return ck.check_search_hits(queries, hits, points=pts)


@register("audit_lifecycle_attempts", with_views(
    "SELECT collection, op, CAST(count(*) AS BIGINT) AS attempts, "
    "CAST(count(*) FILTER (WHERE message IS NULL) AS BIGINT) AS succeeded, "
    "CAST(count(*) FILTER (WHERE message IS NOT NULL AND acc) AS BIGINT) AS accepted_failures, "
    "CAST(count(*) FILTER (WHERE message IS NOT NULL AND NOT acc) AS BIGINT) AS violations, "
    "count(*) FILTER (WHERE message IS NOT NULL AND NOT acc) = 0 AS ok FROM ("
    " SELECT *, coalesce(op = 'create' AND contains(message, 'Collection `' || collection || '` already exists!'), false) AS acc"
    " FROM attempts) t GROUP BY collection, op",
    "attempts",
))
def q_audit_lifecycle_attempts(spark, sf_dir):
    return ck.audit_lifecycle(views.attempts(spark, sf_dir))


# --- snapshot manifest derived from the event log (OP-46, OP-53) -------------------------

MANIFEST_SQL = (
    "SELECT event_id AS seq, concat('c_', CAST(user_id % 5 AS VARCHAR)) AS collection, "
    "concat('snap_', CAST(user_id % 20 AS VARCHAR)) AS snapshot, "
    "CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'create' ELSE 'delete' END AS action FROM events"
)


def snapshot_manifest(spark, sf_dir):
    ev = tables.events(spark, sf_dir, "event_id", "user_id", "event_type")
    return ev.select(
        F.col("event_id").alias("seq"),
        F.concat(F.lit("c_"), (F.col("user_id") % 5).cast("string")).alias("collection"),
        F.concat(F.lit("snap_"), (F.col("user_id") % 20).cast("string")).alias("snapshot"),
        F.when(F.col("event_type").isin("click", "view", "purchase"), "create").otherwise("delete").alias("action"),
    )


@register("snapshot_listing", with_views(
    "SELECT collection, snapshot, max(seq) AS created_seq FROM manifest GROUP BY collection, snapshot "
    "HAVING arg_max(action, seq) = 'create'",
    extra={"manifest": MANIFEST_SQL},
))
def q_snapshot_listing(spark, sf_dir):
    return cat.live_snapshots(snapshot_manifest(spark, sf_dir))


@register("check_snapshot_delta", with_views(
    "SELECT seq, collection, snapshot, action, CAST(sum(delta) OVER (PARTITION BY collection ORDER BY seq "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS count_after, "
    "CASE WHEN action = 'create' THEN delta = 1 ELSE delta = -1 END AS ok FROM ("
    " SELECT *, CASE WHEN action = 'create' AND NOT prev_live THEN 1 WHEN action = 'delete' AND prev_live THEN -1 ELSE 0 END AS delta"
    " FROM (SELECT *, coalesce(lag(action = 'create') OVER (PARTITION BY collection, snapshot ORDER BY seq), false) AS prev_live"
    " FROM manifest) a) b",
    extra={"manifest": MANIFEST_SQL},
))
def q_check_snapshot_delta(spark, sf_dir):
    m = snapshot_manifest(spark, sf_dir)
    # previous action on the same snapshot name, chunked so a hot name never sits in one window
    m = chunked_lag(m, ["collection", "snapshot"], ["seq"], F.col("action") == "create", "prev_live",
                    block_chunk("seq"))
    m = m.withColumn("prev_live", F.coalesce("prev_live", F.lit(False)))
    delta = (F.when((F.col("action") == "create") & ~F.col("prev_live"), 1)
             .when((F.col("action") == "delete") & F.col("prev_live"), -1).otherwise(0))
    m = m.withColumn("delta", delta)
    counted = running_sums(m, ["collection"], ["seq"], {"count_after": F.col("delta")}, block_chunk("seq"))
    ok = F.when(F.col("action") == "create", F.col("delta") == 1).otherwise(F.col("delta") == -1)
    return counted.select("seq", "collection", "snapshot", "action", "count_after", ok.alias("ok"))


@register("check_catalog", with_views(
    "SELECT 'field_indexed' AS \"check\", 'points' AS collection, CAST(1 AS BIGINT) AS expected, "
    "CAST(count(DISTINCT 'a') FILTER (WHERE a IS NOT NULL) AS BIGINT) AS actual, "
    "count(*) FILTER (WHERE a IS NOT NULL) > 0 AS ok FROM points "
    "UNION ALL SELECT 'index_progress', 'points', CAST(count(vec) AS BIGINT), CAST(count(*) FILTER (WHERE len(vec) > 0) AS BIGINT), "
    "count(vec) = count(*) FILTER (WHERE len(vec) > 0) FROM points",
    "points",
))
def q_check_catalog(spark, sf_dir):
    pts = collection(spark, sf_dir)
    schema = cat.payload_schema(mu.long_payload(pts), indexed=("a",))
    field = schema.agg(F.count_if((F.col("field") == "a") & F.col("indexed")).alias("n"))
    field_row = ck.check_row(field, "field_indexed", "points", F.lit(1), F.col("n"), F.col("n") > 0)
    indexed = ivf.assign_cells(pts.select("id", "vec"), ivf.pick_pivots(pts))     # the index itself, not the table
    info = ck.one_row_join(pts.agg(F.count("vec").alias("v")), indexed.agg(F.count("cell").alias("n")))
    progress = ck.check_row(info, "index_progress", "points", F.col("v"), F.col("n"), F.col("v") == F.col("n"))
    return field_row.unionByName(progress)
