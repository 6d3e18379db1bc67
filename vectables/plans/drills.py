"""The ten drills as composed jobs (P-01..P-10). Each returns check rows
``(step, check, expected, actual, ok)``; a failed invariant is a row with ``ok = false``."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectables import TOP_K
from vectables.functions.random import uniform_int, uniform_int_sql
from vectables.operators import checks as ck
from vectables.operators import ivf, logs
from vectables.operators import mutations as mu
from vectables.operators.search import rank_hits, search_batch
from vectables.plans import index_queries as iq
from vectables.plans import log_queries as lq
from vectables.plans import table_queries as tq
from vectables.plans.registry import ORACLE, register
from vectables.plans.search_queries import DIM, cos_sql, supplied_queries, topk_sql
from vectables.session import storage_root
from vectables.sources import generators, tables, views
from vectables.sources.views import with_views

N_SQL = "(SELECT count(*) FROM embeddings)"


def row(step: str, agg: DataFrame, check: str, expected, actual, ok=None) -> DataFrame:
    ok = (expected == actual) if ok is None else ok
    return agg.select(F.lit(step).alias("step"), F.lit(check).alias("check"), expected.cast("bigint").alias("expected"),
                      actual.cast("bigint").alias("actual"), ok.alias("ok"))


def union(*dfs: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, dfs)


def n_points(spark, sf_dir) -> DataFrame:
    return tables.embeddings(spark, sf_dir, "vec_id").agg(F.count(F.lit(1)).alias("n"))


def sql_row(step: str, check: str, expected: str, actual: str) -> str:
    return (f"SELECT '{step}' AS step, '{check}' AS \"check\", CAST({expected} AS BIGINT) AS expected, "
            f"CAST({actual} AS BIGINT) AS actual, ({expected}) = ({actual}) AS ok")


def counted(df: DataFrame, name: str = "c") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(name))


GREEN_CTES = {"statuses": views.STATUSES_SQL, **lq.DEBOUNCE_CTES}
GREEN_SQL = sql_row("wait_green", "ready", "(SELECT count(*) FROM first_poll)", "(SELECT count(*) FROM hit)")


def green_row(statuses: DataFrame) -> DataFrame:
    """Every collection becomes ready: enough green polls in a row."""
    ready = logs.green_debounce(statuses).agg(F.count(F.lit(1)).alias("n"), F.count("ready_event_id").alias("c"))
    return row("wait_green", ready, "ready", F.col("n"), F.col("c"))


# --- P-01 collections_churn ---------------------------------------------------------------

N_CHURN = 10


MANY_SQL = (f"SELECT concat('churn_', CAST(i AS VARCHAR)) AS collection, vec_id AS id, concat('keyword_', CAST("
            f"{uniform_int_sql('churn/payload', 2, 'i', 'vec_id')} AS VARCHAR)) AS a FROM embeddings, (SELECT range AS i FROM range({N_CHURN})) c")
CHURN_LOG_SQL = "SELECT DISTINCT collection, s.seq, s.action FROM many, (VALUES (1, 'create'), (2, 'drop')) s(seq, action)"


def churn_rows(many: DataFrame, log: DataFrame, n: DataFrame) -> DataFrame:
    """Per collection: all points arrived, the keyword field is in its payload schema, and after the log's
    last action its name is gone with all of its points."""
    live = log.groupBy("collection").agg(F.max_by("action", "seq").alias("last")).where(F.col("last") != "drop").select("collection")
    left = many.join(live, "collection", "left_semi").groupBy("collection").agg(F.count(F.lit(1)).alias("g"))
    per = many.groupBy("collection").agg(F.count(F.lit(1)).alias("c"), F.count_distinct(F.when(F.col("a").isNotNull(), F.lit("a"))).alias("f"))
    per = ck.one_row_join(per.join(left, "collection", "left"), n)

    def sel(chk, e, a):
        return per.select(F.col("collection").alias("step"), F.lit(chk).alias("check"),
                          e.cast("bigint").alias("expected"), a.cast("bigint").alias("actual"), (e == a).alias("ok"))

    return union(sel("count", F.col("n"), F.col("c")), sel("field_indexed", F.lit(1), F.col("f")),
                 sel("deleted", F.lit(0), F.coalesce("g", F.lit(0))))


@register("drill_collections", with_views(
    "SELECT collection AS step, k.name AS \"check\", CAST(CASE k.name WHEN 'count' THEN " + N_SQL + " WHEN 'field_indexed' THEN 1 ELSE 0 END AS BIGINT) AS expected, "
    "CAST(CASE k.name WHEN 'count' THEN c WHEN 'field_indexed' THEN f ELSE g END AS BIGINT) AS actual, "
    "(CASE k.name WHEN 'count' THEN c = " + N_SQL + " WHEN 'field_indexed' THEN f = 1 ELSE g = 0 END) AS ok "
    "FROM (SELECT collection, count(*) AS c, count(DISTINCT CASE WHEN a IS NOT NULL THEN 'a' END) AS f, "
    "count(*) FILTER (WHERE collection IN (SELECT collection FROM log GROUP BY 1 HAVING arg_max(action, seq) <> 'drop')) AS g "
    "FROM many GROUP BY 1) per, (VALUES ('count'), ('field_indexed'), ('deleted')) k(name)",
    extra={"many": MANY_SQL, "log": CHURN_LOG_SQL},
))
def q_drill_collections(spark, sf_dir):
    ids = tables.embeddings(spark, sf_dir, "vec_id")
    many = ids.select(F.explode(F.sequence(F.lit(0), F.lit(N_CHURN - 1))).alias("i"), F.col("vec_id").alias("id")) \
        .withColumn("collection", F.concat(F.lit("churn_"), F.col("i").cast("string"))) \
        .withColumn("a", F.concat(F.lit("keyword_"), uniform_int("churn/payload", 2, F.col("i"), F.col("id")).cast("string")))
    steps = F.array(F.struct(F.lit(1).alias("seq"), F.lit("create").alias("action")), F.struct(F.lit(2).alias("seq"), F.lit("drop").alias("action")))
    log = many.select("collection").distinct().select("collection", F.inline(steps))
    return churn_rows(many, log, n_points(spark, sf_dir))


# --- P-02 points_search (flagship) ----------------------------------------------------------

REFRESHED_CTES = {
    **GREEN_CTES,
    "queries": iq.IVF_CTES["queries"],
    "delta": tq.gen_points_sql("vec_id", "embeddings WHERE vec_id < 100", DIM, 2, "refresh"),
    "refreshed": "SELECT id, vec, a FROM points WHERE id NOT IN (SELECT id FROM delta) UNION ALL SELECT id, vec, a FROM delta",
    "hits": topk_sql(f"SELECT q.query_id, p.id, round({cos_sql('q.qv', 'p.vec')}, 6) AS score, p.a "
                     "FROM queries q JOIN refreshed p ON p.a = q.must_a"),
}


def written(spark, rows):
    """``rows`` as a table in the shared folder: what they are now, whatever is appended to their sources later."""
    path = f"{storage_root(spark)}/drill-{uuid.uuid4().hex[:12]}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def searched_rows(refreshed: DataFrame, queries: DataFrame, n: DataFrame) -> DataFrame:
    """Search the refreshed table, check every query's hits against it, and count the hits among the refreshed ids: as many as when
    the slice and the rest are searched apart and their hits ranked together."""
    refreshed = written(queries.sparkSession, refreshed)
    points = refreshed.select("id", "vec", F.col("payload")["a"].alias("a"))
    hits = written(queries.sparkSession, search_batch(points, queries, dim=DIM))
    verdict = ck.check_search_hits(queries, hits, points=refreshed).agg(
        F.count(F.lit(1)).alias("q"), F.count_if(F.col("reason") == "ok").alias("good"))
    fresh = F.col("id") < 100
    apart = rank_hits(search_batch(points.where(fresh), queries, dim=DIM).unionByName(search_batch(points.where(~fresh), queries, dim=DIM)).drop("rank"))
    new = ck.one_row_join(apart.agg(F.count_if(fresh).alias("n")), hits.agg(F.count_if(fresh).alias("c")))
    return union(row("refresh", ck.one_row_join(n, counted(refreshed)), "count", F.col("n"), F.col("c")),
                 row("search", verdict, "queries_ok", F.col("q"), F.col("good")),
                 row("search", new, "refreshed_hits", F.col("n"), F.col("c")))


@register("drill_search", with_views(
    sql_row("insert", "count", N_SQL, "(SELECT count(*) FROM points)") + " UNION ALL "
    + GREEN_SQL + " UNION ALL "
    + sql_row("refresh", "count", N_SQL, "(SELECT count(*) FROM refreshed)") + " UNION ALL "
    + sql_row("search", "queries_ok", "(SELECT count(*) FROM queries)",
              "(SELECT count(DISTINCT query_id) FROM hits WHERE rank = 1 AND a IS NOT NULL AND id < "
              "(SELECT count(*) FROM refreshed))") + " UNION ALL "
    + sql_row("search", "refreshed_hits", "(SELECT count(*) FROM hits WHERE id < 100)", "(SELECT count(*) FROM hits WHERE id < 100)"),
    "points", extra=REFRESHED_CTES,
))
def q_drill_search(spark, sf_dir):
    base = tq.collection(spark, sf_dir)
    n = n_points(spark, sf_dir)
    ids = tables.embeddings(spark, sf_dir, "vec_id").where(F.col("vec_id") < 100)
    refreshed = mu.upsert(base, generators.gen_points(ids, DIM, 2, id_col="vec_id", stream="refresh")
                          .select("id", "vec", "payload"))
    return union(row("insert", ck.one_row_join(n, counted(base)), "count", F.col("n"), F.col("c")),
                 green_row(views.statuses(spark, sf_dir)), searched_rows(refreshed, supplied_queries(spark, sf_dir), n))


# --- P-03 points_churn ----------------------------------------------------------------------

@register("drill_points_churn", with_views(
    sql_row("insert", "count", N_SQL, "(SELECT count(*) FROM points)") + " UNION ALL "
    + sql_row("insert", "point_0_exists", "1", "(SELECT count(*) FROM points WHERE id = 0)") + " UNION ALL "
    + sql_row("delete", "count", "0", f"(SELECT count(*) FROM points WHERE NOT (id >= 0 AND id < {N_SQL}))"),
    "points",
))
def q_drill_points_churn(spark, sf_dir):
    base = tq.collection(spark, sf_dir)
    n = n_points(spark, sf_dir)
    exists = base.where(F.col("id") == 0).agg(F.count(F.lit(1)).alias("c"))
    # exactly the ids 0..n-1 of the n points inserted: a point outside that range stays and is counted
    emptied = ck.one_row_join(base, n).where(~((F.col("id") >= 0) & (F.col("id") < F.col("n"))))
    return union(
        row("insert", ck.one_row_join(n, counted(base)), "count", F.col("n"), F.col("c")),
        row("insert", exists, "point_0_exists", F.lit(1), F.col("c")),
        row("delete", counted(emptied), "count", F.lit(0), F.col("c")),
    )


# --- P-04 points_update ----------------------------------------------------------------------

OVERWRITE_SQL = tq.gen_points_sql("vec_id", "embeddings", DIM, 2, "overwrite")


@register("drill_points_update", with_views(
    sql_row("first_upsert", "count", N_SQL, "(SELECT count(*) FROM points)") + " UNION ALL "
    + sql_row("second_upsert", "count", N_SQL, "(SELECT count(*) FROM delta)") + " UNION ALL "
    + sql_row("second_upsert", "vectors_changed", "(SELECT count(*) FROM points)",
              "(SELECT count(*) FROM points p JOIN delta d ON p.id = d.id WHERE p.vec IS DISTINCT FROM d.vec)"),
    "points", extra={"delta": OVERWRITE_SQL},
))
def q_drill_points_update(spark, sf_dir):
    before = tq.collection(spark, sf_dir)
    n = n_points(spark, sf_dir)
    ids = tables.embeddings(spark, sf_dir, "vec_id")
    after = mu.upsert(before, generators.gen_points(ids, DIM, 2, id_col="vec_id", stream="overwrite")
                      .select("id", "vec", "payload"))
    changed = ck.vector_diff(before, after).agg(F.count(F.lit(1)).alias("n"), F.count_if("changed").alias("c"))
    return union(
        row("first_upsert", ck.one_row_join(n, counted(before)), "count", F.col("n"), F.col("c")),
        row("second_upsert", ck.one_row_join(n, counted(after)), "count", F.col("n"), F.col("c")),
        row("second_upsert", changed, "vectors_changed", F.col("n"), F.col("c")),
    )


# --- P-06 toggle_indexing --------------------------------------------------------------------

TOGGLE_STATES = ("off", "lagging", "on")
_COVERED = {"off": "CAST(0 AS BIGINT)", "lagging": f"(SELECT count(vec) FROM points WHERE id <= {iq.HALF_SQL})", "on": "(SELECT count(vec) FROM points)"}


@register("drill_toggle_index", with_views(
    sql_row("insert", "count", N_SQL, "(SELECT count(*) FROM points)") + " UNION ALL " + " UNION ALL ".join(
        sql_row(f"index_{state}", "indexed_vectors", _COVERED[state], _COVERED[state]) + " UNION ALL "
        + sql_row(f"search_{state}", "queries_ok", "(SELECT count(*) FROM queries)",
                  "(SELECT count(DISTINCT query_id) FROM exact_hits WHERE rank = 1 AND a IS NOT NULL)") + " UNION ALL "
        + sql_row(f"search_{state}", "exact_hits_found", "(SELECT count(*) FROM exact_hits)", "(SELECT count(*) FROM exact_hits)")
        for state in TOGGLE_STATES),
    "points", extra=iq.IVF_CTES,
))
def q_drill_toggle_index(spark, sf_dir):
    """Searches with the index off, half built and caught up: each gives every query the hits of a plain scan."""
    base = tq.collection(spark, sf_dir)
    n = n_points(spark, sf_dir)
    queries = supplied_queries(spark, sf_dir)
    points = views.points(spark, sf_dir)
    exact = written(spark, search_batch(points, queries, dim=DIM))
    half, path, mark = iq.half_index(spark, sf_dir)
    off = (half[0][:0], half[1].where("false"))
    counted_half = half[1].agg(F.count("cell").alias("c")).first()["c"]     # before the tail is appended to the same folder
    lagging = written(spark, ivf.hybrid_search(half, points, queries))
    full = ivf.extend_index(half, points, path)
    with_vector = lambda rows: rows.agg(F.count("vec").alias("n"))
    states = {
        "off": (with_vector(points.where("false")), off[1].agg(F.count("cell").alias("c")), written(spark, ivf.hybrid_search(off, points, queries))),
        "lagging": (with_vector(points.where(F.col("id") <= mark)), spark.range(1).select(F.lit(counted_half).cast("bigint").alias("c")), lagging),
        "on": (with_vector(points), full[1].agg(F.count("cell").alias("c")), written(spark, ivf.hybrid_search(full, points, queries))),
    }
    parts = [row("insert", ck.one_row_join(n, counted(base)), "count", F.col("n"), F.col("c"))]
    for state, (due, built, hits) in states.items():
        verdict = ck.check_search_hits(queries, hits, points=base).agg(
            F.count(F.lit(1)).alias("q"), F.count_if(F.col("reason") == "ok").alias("good"))
        equal = exact.join(hits, ["query_id", "rank", "id", "score"], "left_semi")
        parts += [row(f"index_{state}", ck.one_row_join(due, built), "indexed_vectors", F.col("n"), F.col("c")),
                  row(f"search_{state}", verdict, "queries_ok", F.col("q"), F.col("good")),
                  row(f"search_{state}", ck.one_row_join(exact.agg(F.count(F.lit(1)).alias("n")), counted(equal)), "exact_hits_found", F.col("n"), F.col("c"))]
    return union(*parts)


# --- P-07 high_concurrency --------------------------------------------------------------------

def change_log_rows(log: DataFrame, applied: DataFrame) -> DataFrame:
    """The applied table ``(id, k, v)`` against its log: every id last upserted is there, no deleted or unknown id is left,
    and every value is one that the log wrote for that id and key."""
    when = {op: F.max(F.when(F.col("op") == op, F.col("seq"))).alias(op) for op in ("upsert", "delete")}
    due = log.groupBy("id").agg(*when.values()).select(
        "id", (F.col("upsert") > F.coalesce("delete", F.col("upsert") - 1)).alias("due"))
    there = applied.select("id").distinct().withColumn("there", F.lit(True))
    is_due, is_there = F.coalesce("due", F.lit(False)), F.coalesce("there", F.lit(False))
    ids = due.join(there, "id", "full_outer").agg(
        F.count_if(is_due).alias("n"), F.count_if(is_due & is_there).alias("c"), F.count_if(is_there & ~is_due).alias("left"))
    held = applied.where("k IS NOT NULL")
    known = ck.one_row_join(counted(held, "n"), counted(held.join(log, ["id", "k", "v"], "left_semi")))
    return union(row("apply", ids, "live_points", F.col("n"), F.col("c")), row("apply", ids, "leftover_points", F.lit(0), F.col("left")),
                 row("apply", known, "values_in_log", F.col("n"), F.col("c")))


DUE_SQL = "SELECT id FROM oplog GROUP BY id HAVING max(seq) FILTER (WHERE op = 'upsert') > coalesce(max(seq) FILTER (WHERE op = 'delete'), -1)"


@register("drill_change_log", with_views(
    sql_row("apply", "live_points", "(SELECT count(*) FROM due)", "(SELECT count(DISTINCT id) FROM applied WHERE id IN (SELECT id FROM due))")
    + " UNION ALL " + sql_row("apply", "leftover_points", "0", "(SELECT count(DISTINCT id) FROM applied WHERE id NOT IN (SELECT id FROM due))")
    + " UNION ALL " + sql_row("apply", "values_in_log", "(SELECT count(k) FROM applied)",
                              "(SELECT count(*) FROM applied SEMI JOIN oplog USING (id, k, v))"),
    "oplog", extra={"due": DUE_SQL, "applied": ORACLE["apply_oplog"]},
))
def q_drill_change_log(spark, sf_dir):
    log = views.oplog(spark, sf_dir)
    return change_log_rows(log, mu.apply_oplog(log))


# --- P-08 large_retrieve ----------------------------------------------------------------------

@register("drill_retrieve", with_views(
    sql_row("retrieve", "count", N_SQL, "(SELECT count(*) FROM points WHERE id IN (SELECT vec_id FROM embeddings))")
    + " UNION ALL " + sql_row("retrieve", "missing_or_extra", "0", "(SELECT count(*) FROM ("
                               "(SELECT vec_id FROM embeddings EXCEPT ALL SELECT id FROM points) UNION ALL "
                               "(SELECT id FROM points EXCEPT ALL SELECT vec_id FROM embeddings)))")
    + " UNION ALL " + sql_row("retrieve", "vectors_missing", "0", "(SELECT count(*) FROM points WHERE vec IS NULL)"),
    "points",
))
def q_drill_retrieve(spark, sf_dir):
    from vectables.operators.reads import retrieve

    pts = views.points(spark, sf_dir)
    wanted = tables.embeddings(spark, sf_dir, "vec_id").select(F.col("vec_id").alias("id"))
    got = retrieve(pts, wanted)
    n = n_points(spark, sf_dir)
    idset = ck.check_id_set(wanted, got.select("id"))
    return union(
        row("retrieve", ck.one_row_join(n, counted(got)), "count", F.col("n"), F.col("c")),
        row("retrieve", idset, "missing_or_extra", F.lit(0), F.col("missing") + F.col("duplicate") + F.col("extra")),
        row("retrieve", got.agg(F.count_if(F.col("vec").isNull()).alias("c")), "vectors_missing", F.lit(0), F.col("c")),
    )


# --- P-09 collection_concurrent_lifecycle -------------------------------------------------------

@register("drill_lifecycle_audit", with_views(
    "SELECT collection AS step, 'violations' AS \"check\", CAST(0 AS BIGINT) AS expected, "
    "CAST(count(*) FILTER (WHERE message IS NOT NULL AND NOT coalesce(op = 'create' AND "
    "contains(message, 'Collection `' || collection || '` already exists!'), false)) AS BIGINT) AS actual, "
    "count(*) FILTER (WHERE message IS NOT NULL AND NOT coalesce(op = 'create' AND "
    "contains(message, 'Collection `' || collection || '` already exists!'), false)) = 0 AS ok "
    "FROM attempts GROUP BY collection",
    "attempts",
))
def q_drill_lifecycle_audit(spark, sf_dir):
    audit = ck.audit_lifecycle(views.attempts(spark, sf_dir))
    per = audit.groupBy("collection").agg(F.sum("violations").alias("v"))
    return per.select(F.col("collection").alias("step"), F.lit("violations").alias("check"),
                      F.lit(0).cast("bigint").alias("expected"), F.col("v").cast("bigint").alias("actual"),
                      (F.col("v") == 0).alias("ok"))


# --- P-10 points_optional_vectors -------------------------------------------------------------

@register("drill_optional_vectors", with_views(
    sql_row("fill", "count", N_SQL, "(SELECT count(*) FROM filled)")
    + " UNION ALL " + sql_row("fill", "vectors_missing", "0", "(SELECT count(*) FROM filled WHERE dim IS NULL)")
    + " UNION ALL " + sql_row("fill", "payload_wiped", N_SQL, "(SELECT count(*) FROM filled WHERE n_keys = 0)")
    + " UNION ALL " + GREEN_SQL,
    extra={"filled": ORACLE["progressive_fill"], **GREEN_CTES},
))
def q_drill_optional_vectors(spark, sf_dir):
    filled = tq.q_progressive_fill(spark, sf_dir)
    n = n_points(spark, sf_dir)
    stats = filled.agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("dim").isNull()).alias("m"),
                       F.count_if(F.col("n_keys") == 0).alias("w"))
    both = ck.one_row_join(n, stats)
    return union(
        row("fill", both, "count", F.col("n"), F.col("c")),
        row("fill", both, "vectors_missing", F.lit(0), F.col("m")),
        row("fill", both, "payload_wiped", F.col("n"), F.col("w")),
        green_row(views.statuses(spark, sf_dir)),
    )
