"""Index, quantization, threshold switch (OP-33..OP-37) and catalog / layout / snapshot queries
(OP-40..OP-46)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vectables.functions.random import uniform_int, uniform_int_sql, uniform_sql
from vectables.operators import catalog as cat
from vectables.operators import ivf, quant
from vectables.operators import mutations as mu
from vectables.operators.search import search_batch
from vectables.plans.registry import register
from vectables.plans.search_queries import DIM, QUERIES_SQL, cos_sql, supplied_queries, topk_sql
from vectables.session import storage_root
from vectables.sources import views
from vectables.sources.views import with_views

NLIST, NPROBE = ivf.NLIST, ivf.NPROBE
SHORTLIST = 150

IVF_CTES = {
    "queries": QUERIES_SQL,
    "pivots": (f"SELECT CAST(row_number() OVER (ORDER BY h, id) - 1 AS INTEGER) AS cell, vec FROM ("
               f"SELECT id, vec, {uniform_sql('ivf/pivot', 'id')} AS h FROM points WHERE vec IS NOT NULL "
               f"ORDER BY h, id LIMIT {NLIST}) t"),
    "assign": (f"SELECT p.id, arg_max(pv.cell, (round({cos_sql('p.vec', 'pv.vec')}, 6), -pv.cell)) AS cell "
               "FROM points p, pivots pv WHERE p.vec IS NOT NULL GROUP BY p.id"),
    "in_cell": "SELECT s.cell, p.a, count(*) AS n FROM assign s JOIN points p ON p.id = s.id GROUP BY ALL",
    "qranked": (f"SELECT q.query_id, q.must_a, pv.cell, row_number() OVER (PARTITION BY q.query_id "
                f"ORDER BY round({cos_sql('q.qv', 'pv.vec')}, 6) DESC, pv.cell) AS r FROM queries q, pivots pv"),
    # the nearest cells, and further ones while those before them hold fewer than k matching points
    "qcells": (f"SELECT query_id, cell FROM (SELECT r.query_id, r.cell, r.r, coalesce(sum(coalesce(c.n, 0)) OVER (PARTITION BY r.query_id "
               "ORDER BY r.r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before "
               f"FROM qranked r LEFT JOIN in_cell c ON c.cell = r.cell AND c.a = r.must_a) t WHERE r <= {NPROBE} OR before < 100"),
    "ivf_hits": topk_sql(f"SELECT q.query_id, p.id, round({cos_sql('q.qv', 'p.vec')}, 6) AS score, p.a FROM queries q "
                         "JOIN qcells c ON q.query_id = c.query_id JOIN assign s ON s.cell = c.cell "
                         "JOIN points p ON p.id = s.id AND p.a = q.must_a"),
    "exact_hits": topk_sql(f"SELECT q.query_id, p.id, round({cos_sql('q.qv', 'p.vec')}, 6) AS score, p.a "
                           "FROM queries q JOIN points p ON p.a = q.must_a"),
}


def _index(spark, sf_dir, write: bool = True):
    pts = views.points(spark, sf_dir)
    path = f"{storage_root(spark)}/ivf-{uuid.uuid4().hex[:10]}" if write else None
    return ivf.build_index(pts, NLIST, path=path)


@register("ivf_assign", with_views("SELECT id, cell FROM assign", "points", extra=IVF_CTES))
def q_ivf_assign(spark, sf_dir):
    pivots = ivf.pick_pivots(views.points(spark, sf_dir), NLIST)
    return ivf.assign_cells(views.points(spark, sf_dir), pivots).select("id", "cell")


@register("ivf_search", with_views("SELECT * FROM ivf_hits", "points", extra=IVF_CTES))
def q_ivf_search(spark, sf_dir):
    return ivf.ivf_search(_index(spark, sf_dir), supplied_queries(spark, sf_dir), nprobe=NPROBE)


@register("ivf_recall", with_views(
    "SELECT e.query_id, round(count(i.id) / count(*), 6) AS recall, CAST(count(*) AS BIGINT) AS exact_hits "
    "FROM exact_hits e LEFT JOIN ivf_hits i ON e.query_id = i.query_id AND e.id = i.id GROUP BY e.query_id",
    "points", extra=IVF_CTES,
))
def q_ivf_recall(spark, sf_dir):
    queries = supplied_queries(spark, sf_dir)
    approx = ivf.ivf_search(_index(spark, sf_dir), queries, nprobe=NPROBE)
    exact = search_batch(views.points(spark, sf_dir), queries, dim=DIM)
    return ivf.recall(approx, exact)


@register("ivf_search_exact", with_views("SELECT * FROM exact_hits", "points", extra=IVF_CTES))
def q_ivf_search_exact(spark, sf_dir):
    """The exact hits, found through an index of as many cells as its rows ask for."""
    points = views.points(spark, sf_dir)
    index = ivf.build_index(points, None, f"{storage_root(spark)}/ivf-{uuid.uuid4().hex[:10]}", files_per_cell=None)
    return ivf.exact_search(index, supplied_queries(spark, sf_dir))


HALF_SQL = "(SELECT CAST(floor((min(id) + max(id)) / 2) AS BIGINT) FROM points)"


def half_index(spark, sf_dir):
    """An index that has seen the lower half of the ids only: ``(index, its path, the last id)``."""
    points = views.points(spark, sf_dir)
    ends = points.agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    mark = (ends["a"] + ends["b"]) // 2 if ends["a"] is not None else -1
    path = f"{storage_root(spark)}/ivf-{uuid.uuid4().hex[:10]}"
    return ivf.build_index(points.where(F.col("id") <= mark), None, path, files_per_cell=None), path, mark


@register("ivf_search_lagging", with_views("SELECT * FROM exact_hits", "points", extra=IVF_CTES))
def q_ivf_search_lagging(spark, sf_dir):
    """The exact hits while the index covers half of the table: cells for the half, a scan for the tail."""
    index, _, _ = half_index(spark, sf_dir)
    return ivf.hybrid_search(index, views.points(spark, sf_dir), supplied_queries(spark, sf_dir))


@register("ivf_exact_recall", with_views(
    "SELECT query_id, CAST(1 AS DOUBLE) AS recall, CAST(count(*) AS BIGINT) AS exact_hits FROM exact_hits GROUP BY query_id",
    "points", extra=IVF_CTES,
))
def q_ivf_exact_recall(spark, sf_dir):
    """Share of the exact hits that the bound-driven search finds, per query: all of them."""
    return ivf.recall(q_ivf_search_exact(spark, sf_dir), search_batch(views.points(spark, sf_dir), supplied_queries(spark, sf_dir), dim=DIM))


def search_in_mode(spark, sf_dir, mode: str):
    """OP-33: the caller names how to search; nothing is decided by the table's size."""
    queries = supplied_queries(spark, sf_dir)
    if mode == "exact":
        return search_batch(views.points(spark, sf_dir), queries, dim=DIM)
    if mode == "indexed":
        return ivf.ivf_search(_index(spark, sf_dir), queries, nprobe=NPROBE)
    raise ValueError(f"mode is 'exact' or 'indexed', not {mode!r}")


@register("search_threshold_switch", with_views(
    "SELECT 'exact' AS mode, * FROM exact_hits UNION ALL SELECT 'indexed' AS mode, * FROM ivf_hits", "points", extra=IVF_CTES,
))
def q_search_threshold_switch(spark, sf_dir):
    exact, indexed = (search_in_mode(spark, sf_dir, m).select(F.lit(m).alias("mode"), "*") for m in ("exact", "indexed"))
    return exact.unionByName(indexed)


# --- OP-36 / OP-37 ---------------------------------------------------------------------------

def _q8(col: str) -> str:
    return (f"list_transform({col}, lambda x: CAST(greatest(-127, least(127, floor(CAST(x AS DOUBLE) / m * 127 + 0.5))) AS INTEGER))")


ALPHA_SQL = "SELECT max(list_max(list_transform(vec, lambda x: abs(CAST(x AS DOUBLE))))) AS m FROM points"


@register("quantize_int8", with_views(
    "SELECT id, CAST(list_sum(qv) AS BIGINT) AS qsum, CAST(list_sum(list_transform(qv, lambda x: x * x)) AS BIGINT) AS qsq, "
    f"CAST(list_min(qv) AS BIGINT) AS qmin, CAST(list_max(qv) AS BIGINT) AS qmax FROM (SELECT id, {_q8('vec')} AS qv FROM points, alpha) t",
    "points", extra={"alpha": ALPHA_SQL},
))
def q_quantize_int8(spark, sf_dir):
    pts = views.points(spark, sf_dir)
    alpha = quant.alpha_of(pts)
    q = pts.select("id", quant.quantize(F.col("vec"), alpha).alias("qv"))
    ints = F.transform("qv", lambda x: x.cast("bigint"))
    return q.select(
        "id",
        F.aggregate(ints, F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("qsum"),
        F.aggregate(ints, F.lit(0).cast("bigint"), lambda acc, x: acc + x * x).alias("qsq"),
        F.array_min(ints).alias("qmin"), F.array_max(ints).alias("qmax"),
    )


INT8_CTES = {
    "alpha": ALPHA_SQL,
    "queries": QUERIES_SQL,
    "cand": (f"SELECT q.query_id, p.id, p.a, CAST(list_dot_product(CAST({_q8('q.qv')} AS DOUBLE[]), "
             f"CAST({_q8('p.vec')} AS DOUBLE[])) AS BIGINT) AS iscore, round({cos_sql('q.qv', 'p.vec')}, 6) AS score "
             "FROM queries q JOIN points p ON p.a = q.must_a, alpha"),
    "short": (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY iscore DESC, id) AS s "
              f"FROM cand) t WHERE s <= {SHORTLIST}"),
}


@register("search_int8", with_views(
    topk_sql("SELECT query_id, id, score, a FROM short"), "points", extra=INT8_CTES,
))
def q_search_int8(spark, sf_dir):
    return quant.search_int8(views.points(spark, sf_dir), supplied_queries(spark, sf_dir),
                             oversample=SHORTLIST / 100, dim=DIM)


@register("int8_recall", with_views(
    "SELECT e.query_id, round(count(i.id) / count(*), 6) AS recall, CAST(count(*) AS BIGINT) AS exact_hits FROM exact_hits e "
    f"LEFT JOIN ({topk_sql('SELECT query_id, id, score, a FROM short')}) i ON e.query_id = i.query_id AND e.id = i.id GROUP BY e.query_id",
    "points", extra={**INT8_CTES, "exact_hits": IVF_CTES["exact_hits"]},
))
def q_int8_recall(spark, sf_dir):
    """Share of the exact top hits that the int8 shortlist keeps, per query."""
    queries = supplied_queries(spark, sf_dir)
    exact = search_batch(views.points(spark, sf_dir), queries, dim=DIM)
    return ivf.recall(q_search_int8(spark, sf_dir), exact)


# --- OP-41: ten collections in one DataFrame ------------------------------------------------

N_COLLECTIONS = 10


@register("multi_collection_counts",
          "SELECT concat('churn_', CAST(c.i AS VARCHAR)) AS collection, CAST(count(*) AS BIGINT) AS points, "
          f"CAST(count(*) FILTER (WHERE {uniform_int_sql('churn/payload', 2, 'c.i', 'e.vec_id')} = 0) AS BIGINT) AS keyword_0 "
          f"FROM embeddings e, (SELECT range AS i FROM range({N_COLLECTIONS})) c GROUP BY c.i")
def q_multi_collection_counts(spark, sf_dir):
    from vectables.sources import tables

    ids = tables.embeddings(spark, sf_dir, "vec_id")
    many = ids.select(F.explode(F.sequence(F.lit(0), F.lit(N_COLLECTIONS - 1))).alias("i"), "vec_id")
    kw = uniform_int("churn/payload", 2, F.col("i"), F.col("vec_id"))
    return many.groupBy(F.concat(F.lit("churn_"), F.col("i").cast("string")).alias("collection")).agg(
        F.count(F.lit(1)).cast("bigint").alias("points"), F.count_if(kw == 0).cast("bigint").alias("keyword_0"))


# --- OP-42 / OP-43 / OP-44 -------------------------------------------------------------------

@register("field_index_postings", with_views(
    "SELECT a AS value, CAST(count(*) AS BIGINT) AS points, min(id) AS min_id, max(id) AS max_id FROM points "
    "WHERE a IS NOT NULL GROUP BY a", "points",
))
def q_field_index_postings(spark, sf_dir):
    return cat.field_postings(views.points(spark, sf_dir))


@register("filter_via_index", with_views("SELECT id, a FROM points WHERE a = 'keyword_1'", "points"))
def q_filter_via_index(spark, sf_dir):
    """The field index holds ids by keyword, no vectors; a filter reads one keyword's row groups."""
    path = f"{storage_root(spark)}/byfield-{uuid.uuid4().hex[:10]}"
    cat.write_field_index(views.points(spark, sf_dir), path)
    return cat.ids_with(spark, path, "keyword_1").select("id", "a")


@register("payload_schema",
          "WITH oplog AS (" + views.OPLOG_SQL + "), "
          "resets AS (SELECT id, arg_max(op, seq) AS reset_op, max(seq) AS reset_seq FROM oplog WHERE op IN ('upsert', 'delete') GROUP BY id), "
          "live AS (SELECT id, reset_seq FROM resets WHERE reset_op = 'upsert'), "
          "kv AS (SELECT o.id, o.k FROM oplog o JOIN live l ON o.id = l.id AND o.seq >= l.reset_seq "
          "WHERE o.op IN ('upsert', 'set_payload') AND o.k IS NOT NULL GROUP BY o.id, o.k) "
          "SELECT k AS field, 'keyword' AS data_type, CAST(count(DISTINCT id) AS BIGINT) AS points, k = 'k1' AS indexed "
          "FROM kv GROUP BY k")
def q_payload_schema(spark, sf_dir):
    return cat.payload_schema(mu.apply_oplog(views.oplog(spark, sf_dir)), indexed=("k1",))


SHARDS = 4


@register("shard_layout", f"SELECT CAST(vec_id % {SHARDS} AS BIGINT) AS shard, CAST(count(*) AS BIGINT) AS points "
                          "FROM embeddings GROUP BY ALL")
def q_shard_layout(spark, sf_dir):
    pts = views.points(spark, sf_dir).withColumn("shard", cat.shard_of("id", SHARDS))
    laid = pts.repartition(SHARDS, "shard")  # one shard per partition, co-located on the shard key
    return laid.groupBy("shard").agg(F.count(F.lit(1)).cast("bigint").alias("points"))
