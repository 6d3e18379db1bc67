"""Names over a log of attempts, and indexes that lag: OP-27, OP-54, OP-55, P-01 and P-09 with checks that can fail."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vectables.operators import catalog as cat
from vectables.operators import checks as ck
from vectables.operators import ivf, reads
from vectables.operators import mutations as mu
from vectables.plans.checks_queries import DIM, overwritten
from vectables.plans.drills import N_SQL, counted, n_points, q_drill_lifecycle_audit, row, sql_row, union, written
from vectables.plans.index_queries import HALF_SQL, half_index
from vectables.plans.registry import ORACLE, register
from vectables.plans.table_queries import collection, gen_points_sql
from vectables.session import storage_root
from vectables.sources import views
from vectables.sources.views import with_views

REFUSED_SQL = "op = 'create' AND contains(message, 'Collection `' || collection || '` already exists!')"
NAME_CTES = {
    "numbered": "SELECT *, count(*) FILTER (WHERE message IS NULL) OVER (PARTITION BY collection ORDER BY ts, event_id) AS g FROM attempts",
    "states": "SELECT collection, g, max(op) FILTER (WHERE message IS NULL) AS op, "
              f"count(*) FILTER (WHERE message IS NOT NULL AND {REFUSED_SQL}) AS refused FROM numbered GROUP BY collection, g",
    "lagged": "SELECT *, lag(op) OVER (PARTITION BY collection ORDER BY g) AS prev FROM states",
    "names": "SELECT collection, CAST(count(*) FILTER (WHERE op = 'create') AS BIGINT) AS creates, CAST(count(*) FILTER (WHERE op = 'delete') AS BIGINT) AS deletes, "
             "CAST(count(*) FILTER (WHERE op = 'create' AND prev = 'create') AS BIGINT) AS created_twice, "
             "CAST(count(*) FILTER (WHERE op = 'delete' AND coalesce(prev <> 'create', true)) AS BIGINT) AS deleted_twice, "
             "CAST(sum(CASE WHEN op = 'create' THEN 0 ELSE refused END) AS BIGINT) AS refused_wrongly, "
             "coalesce(arg_max(op, g) = 'create', false) AS \"exists\" FROM lagged GROUP BY collection",
}


@register("replay_names", with_views("SELECT * FROM names", "attempts", extra=NAME_CTES))
def q_replay_names(spark, sf_dir):
    return ck.replay_names(views.attempts(spark, sf_dir))


# --- P-01 collections_churn, by the names of the log ---------------------------------------------

#: check -> (what it expects, what the replayed log says)
NAME_CHECKS = {"created_twice": ("0", "created_twice"), "deleted_twice": ("0", "deleted_twice"), "refused_wrongly": ("0", "refused_wrongly"),
               "deletes": ("creates", "deletes"), "gone": ("0", "CAST(\"exists\" AS BIGINT)")}


@register("drill_names", with_views(
    " UNION ALL ".join(f"SELECT collection AS step, '{check}' AS \"check\", CAST({e} AS BIGINT) AS expected, CAST({a} AS BIGINT) AS actual, ({e}) = ({a}) AS ok FROM names"
                       for check, (e, a) in NAME_CHECKS.items()),
    "attempts", extra=NAME_CTES,
))
def q_drill_names(spark, sf_dir):
    """Every name of the log is created once, deleted as often as created, and gone at the end."""
    names = ck.replay_names(views.attempts(spark, sf_dir))
    checks = [F.struct(F.lit(check).alias("check"), (F.lit(0) if e == "0" else F.col(e)).cast("bigint").alias("expected"),
                       F.col("exists" if check == "gone" else a).cast("bigint").alias("actual")) for check, (e, a) in NAME_CHECKS.items()]
    return names.select(F.col("collection").alias("step"), F.inline(F.array(*checks))).withColumn("ok", F.col("expected") == F.col("actual"))


# --- P-09 collection_concurrent_lifecycle, with its field index and insert steps -------------------

@register("drill_concurrent_lifecycle", with_views(
    "SELECT * FROM audit UNION ALL "
    + sql_row("field_index", "ids", "(SELECT count(a) FROM delta)", "(SELECT count(DISTINCT id) FROM delta WHERE a IS NOT NULL)") + " UNION ALL "
    + sql_row("field_index", "wrong_keyword", "0", "(SELECT count(*) FROM delta d1 JOIN delta d2 USING (id) WHERE d1.a <> d2.a)") + " UNION ALL "
    + sql_row("insert", "count", N_SQL, "(SELECT count(*) FROM (SELECT id FROM points UNION SELECT id FROM delta) x)"),
    "points", extra={"delta": gen_points_sql("vec_id", "embeddings", DIM, 2, "overwrite"), "audit": ORACLE["drill_lifecycle_audit"]},
))
def q_drill_concurrent_lifecycle(spark, sf_dir):
    """Creates and deletes raced for the names; between them a field index was written and points were inserted: the
    index holds every inserted id once, under its own keyword."""
    before = collection(spark, sf_dir)
    inserted = mu.upsert(before, overwritten(spark, sf_dir))
    keyed = inserted.select("id", F.col("payload")["a"].alias("a"))
    path = f"{storage_root(spark)}/byfield-{uuid.uuid4().hex[:10]}"
    cat.write_field_index(keyed, path)
    index = cat.read_field_index(spark, path)
    ids = ck.one_row_join(keyed.agg(F.count("a").alias("n")), index.agg(F.count_distinct("id").alias("c")))
    wrong = keyed.join(index.withColumnRenamed("a", "indexed"), "id").agg(F.count_if(F.col("a") != F.col("indexed")).alias("c"))
    return union(
        q_drill_lifecycle_audit(spark, sf_dir),
        row("field_index", ids, "ids", F.col("n"), F.col("c")),
        row("field_index", wrong, "wrong_keyword", F.lit(0), F.col("c")),
        row("insert", ck.one_row_join(n_points(spark, sf_dir), counted(inserted)), "count", F.col("n"), F.col("c")),
    )


# --- OP-27 / OP-54 while the index lags --------------------------------------------------------

def _info_sql(state: str, covered: str) -> str:
    return (f"SELECT '{state}' AS state, CASE WHEN i >= v THEN 'green' ELSE 'yellow' END AS status, CAST(n AS BIGINT) AS points_count, "
            "CAST(v AS BIGINT) AS vectors_count, CAST(a AS BIGINT) AS a_points, CAST(i AS BIGINT) AS indexed_vectors_count, "
            "CAST(CASE WHEN a > 0 THEN 1 ELSE 0 END AS BIGINT) AS payload_fields FROM (SELECT count(*) AS n, count(vec) AS v, count(a) AS a, "
            f"count(*) FILTER (WHERE len(vec) > 0 AND {covered}) AS i FROM points)")


@register("collection_info_lagging", with_views(
    _info_sql("half", f"id <= {HALF_SQL}") + " UNION ALL " + _info_sql("caught up", "true"), "points",
))
def q_collection_info_lagging(spark, sf_dir):
    """Counts and status by the rows of a written index: yellow while it covers half of the table, green after its tail is assigned."""
    points = views.points(spark, sf_dir)
    index, path, _ = half_index(spark, sf_dir)
    half = written(spark, reads.collection_info(points, indexed=index[1]))      # before the tail is appended to the same folder
    full = reads.collection_info(points, indexed=ivf.extend_index(index, points, path)[1])
    return half.select(F.lit("half").alias("state"), "*").unionByName(full.select(F.lit("caught up").alias("state"), "*"))
