"""Search and filter queries over the ``points`` view (OP-20..OP-22, OP-25, OP-29..OP-32)."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectables import TOP_K
from vectables.functions import pyrandom
from vectables.functions.predicates import build_filter
from vectables.functions.random import uniform_int_sql
from vectables.functions.vectors import cosine, random_vector_sql, vector_literal
from vectables.operators import search
from vectables.plans.registry import register
from vectables.sources import generators, tables, views
from vectables.sources.views import with_views

DIM = 64          # dimension of the supplied embeddings
VARIANTS = 2      # keyword variants, as in the drills
Q0 = 0            # key of the single-query searches


def _query0():
    vec = pyrandom.random_vector("query/vector", Q0, DIM)
    must = pyrandom.random_keyword("query/filter", Q0, VARIANTS)
    return vec, must


QUERIES_SQL = (
    f"SELECT vec_id AS query_id, {random_vector_sql('query/vector', 'vec_id', DIM)} AS qv, "
    f"concat('keyword_', CAST({uniform_int_sql('query/filter', VARIANTS, 'vec_id')} AS VARCHAR)) AS must_a "
    f"FROM embeddings"
)
QUERY0_SQL = (
    f"SELECT CAST({Q0} AS BIGINT) AS query_id, {random_vector_sql('query/vector', str(Q0), DIM)} AS qv, "
    f"concat('keyword_', CAST({uniform_int_sql('query/filter', VARIANTS, str(Q0))} AS VARCHAR)) AS must_a"
)


def cos_sql(a: str, b: str) -> str:
    return f"list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


def topk_sql(scored: str, k: int = TOP_K) -> str:
    return (
        "SELECT query_id, rank, id, score, a FROM ("
        " SELECT query_id, id, score, a,"
        " CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS BIGINT) AS rank"
        f" FROM ({scored}) s WHERE score IS NOT NULL AND NOT isnan(score)) t WHERE rank <= {k}"
    )


def supplied_queries(spark, sf_dir):
    ids = tables.embeddings(spark, sf_dir, "vec_id")
    return generators.gen_queries(ids, DIM, VARIANTS, id_col="vec_id")


# --- OP-29 -------------------------------------------------------------------------------

@register("search_one", with_views(
    topk_sql(
        f"SELECT q.query_id, p.id, round({cos_sql('q.qv', 'p.vec')}, 6) AS score, p.a "
        "FROM points p JOIN q0 q ON p.a = q.must_a"
    ),
    "points", extra={"q0": QUERY0_SQL},
))
def q_search_one(spark, sf_dir):
    vec, must = _query0()
    return search.search_one(views.points(spark, sf_dir), vector_literal(vec), F.col("a") == must, query_id=Q0)


# --- OP-30 -------------------------------------------------------------------------------

@register("search_batch", with_views(
    topk_sql(
        f"SELECT q.query_id, p.id, round({cos_sql('q.qv', 'p.vec')}, 6) AS score, p.a "
        "FROM queries q JOIN points p ON p.a = q.must_a"
    ),
    "points", extra={"queries": QUERIES_SQL},
))
def q_search_batch(spark, sf_dir):
    return search.search_batch(views.points(spark, sf_dir), supplied_queries(spark, sf_dir), dim=DIM)


# --- OP-31 -------------------------------------------------------------------------------

@register("cosine_scores", with_views(
    f"SELECT p.id, round({cos_sql('q.qv', 'p.vec')}, 6) AS score FROM points p, q0 q",
    "points", extra={"q0": QUERY0_SQL},
))
def q_cosine_scores(spark, sf_dir):
    vec, _ = _query0()
    pts = views.points(spark, sf_dir)
    return pts.select("id", F.round(cosine(F.col("vec"), vector_literal(vec)), 6).alias("score"))


# --- OP-32: named vector present on part of the rows only ---------------------------------

PARTLY_NULL_SQL = (
    "SELECT vec_id AS id, CASE WHEN label < 5 THEN embedding END AS aux, "
    "concat('keyword_', CAST(label % 2 AS VARCHAR)) AS a FROM embeddings"
)


def partly_null_points(spark, sf_dir):
    emb = tables.embeddings(spark, sf_dir, "vec_id", "embedding", "label")
    return emb.select(
        F.col("vec_id").alias("id"),
        F.when(F.col("label") < 5, F.col("embedding")).alias("aux"),
        F.concat(F.lit("keyword_"), (F.col("label") % 2).cast("string")).alias("a"),
    )


@register("search_unused_vector", with_views(
    topk_sql(
        f"SELECT q.query_id, p.id, round({cos_sql('q.qv', 'p.aux')}, 6) AS score, p.a "
        "FROM partly p JOIN q0 q ON p.a = q.must_a WHERE p.aux IS NOT NULL"
    ),
    extra={"partly": PARTLY_NULL_SQL, "q0": QUERY0_SQL},
))
def q_search_unused_vector(spark, sf_dir):
    vec, must = _query0()
    pts = partly_null_points(spark, sf_dir)
    return search.search_one(pts, vector_literal(vec), F.col("a") == must, vector="aux", query_id=Q0)


# --- OP-20 / OP-21 -----------------------------------------------------------------------

@register("filter_must", with_views(
    "SELECT id, a FROM points WHERE a = 'keyword_1'", "points",
))
def q_filter_must(spark, sf_dir):
    pred = build_filter(must=[("a", "keyword_1")])
    return views.points(spark, sf_dir).where(pred).select("id", "a")


FILTER_BOOL_SQL = (
    "SELECT vec_id AS id, concat('keyword_', CAST(label % 2 AS VARCHAR)) AS a, "
    "concat('label_', CAST(label AS VARCHAR)) AS l FROM embeddings"
)


@register("filter_bool", with_views(
    "SELECT id, a, l FROM tagged WHERE (l = 'label_1' OR l = 'label_2' OR l = 'label_3') "
    "AND NOT (a = 'keyword_0' OR l = 'label_3') "
    "AND ((CAST(l = 'label_1' AS INT) + CAST(a = 'keyword_1' AS INT) + CAST(l = 'label_9' AS INT)) >= 2)",
    extra={"tagged": FILTER_BOOL_SQL},
))
def q_filter_bool(spark, sf_dir):
    emb = tables.embeddings(spark, sf_dir, "vec_id", "label")
    tagged = emb.select(
        F.col("vec_id").alias("id"),
        F.concat(F.lit("keyword_"), (F.col("label") % 2).cast("string")).alias("a"),
        F.concat(F.lit("label_"), F.col("label").cast("string")).alias("l"),
    )
    promoted = ("a", "l")
    any_of = build_filter(should=[("l", "label_1"), ("l", "label_2"), ("l", "label_3")], promoted=promoted)
    none_of = build_filter(must_not=[("a", "keyword_0"), ("l", "label_3")], promoted=promoted)
    two_of = build_filter(should=[("l", "label_1"), ("a", "keyword_1"), ("l", "label_9")], min_should=2,
                          promoted=promoted)
    return tagged.where(any_of & none_of & two_of).select("id", "a", "l")


# --- OP-25 -------------------------------------------------------------------------------

@register("scroll_filtered", with_views(
    "SELECT id, a FROM points WHERE a = 'keyword_0' ORDER BY id LIMIT 100", "points",
))
def q_scroll_filtered(spark, sf_dir):
    from vectables.operators.reads import scroll
    return scroll(views.points(spark, sf_dir), F.col("a") == "keyword_0", limit=100)
