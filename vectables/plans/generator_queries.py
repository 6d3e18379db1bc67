"""Generator queries (OP-01..OP-09): seeded columns over the ids of the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectables.functions.random import uniform, uniform_int_sql, uniform_sql
from vectables.functions.vectors import random_vector_sql, vsum
from vectables.plans.registry import register
from vectables.sources import generators, tables

GEN_DIM = 128


def _ev_ids(spark, sf_dir):
    return tables.events(spark, sf_dir, "event_id").select(F.col("event_id").alias("id"))


def _emb_ids(spark, sf_dir):
    return tables.embeddings(spark, sf_dir, "vec_id").select(F.col("vec_id").alias("id"))


def kw_sql(stream: str, n: int, key: str) -> str:
    return f"concat('keyword_', CAST({uniform_int_sql(stream, n, key)} AS VARCHAR))"


@register("gen_keyword", f"SELECT event_id AS id, {kw_sql('gen/keyword', 5, 'event_id')} AS a FROM events")
def q_gen_keyword(spark, sf_dir):
    ids = _ev_ids(spark, sf_dir)
    return ids.select("id", generators.random_keyword("gen/keyword", F.col("id"), 5).alias("a"))


@register("gen_payload",
          f"SELECT event_id AS id, {kw_sql('gen/payload', 3, 'event_id')} AS a, CAST(1 AS BIGINT) AS n_keys, "
          "CAST(0 AS BIGINT) AS n_keys_empty FROM events")
def q_gen_payload(spark, sf_dir):
    ids = _ev_ids(spark, sf_dir)
    full = generators.random_payload("gen/payload", F.col("id"), 3)
    empty = generators.random_payload("gen/payload", F.col("id"), 0)
    return ids.select("id", full["a"].alias("a"), F.size(full).cast("bigint").alias("n_keys"),
                      F.size(empty).cast("bigint").alias("n_keys_empty"))


GEN_VECTOR_SQL = (
    f"SELECT id, CAST(len(v) AS BIGINT) AS dim, round(list_sum(CAST(v AS DOUBLE[])), 6) AS vsum, "
    f"CAST(list_min(v) AS DOUBLE) AS vmin, CAST(list_max(v) AS DOUBLE) AS vmax FROM ("
    f"SELECT vec_id AS id, {random_vector_sql('gen/vector', 'vec_id', GEN_DIM)} AS v FROM embeddings) t"
)


@register("gen_vector", GEN_VECTOR_SQL)
def q_gen_vector(spark, sf_dir):
    from vectables.functions.vectors import random_vector

    v = random_vector("gen/vector", F.col("id"), GEN_DIM)
    df = _emb_ids(spark, sf_dir).select("id", v.alias("v"))
    return df.select("id", F.size("v").cast("bigint").alias("dim"), F.round(vsum(F.col("v")), 6).alias("vsum"),
                     F.array_min("v").cast("double").alias("vmin"), F.array_max("v").cast("double").alias("vmax"))


@register("gen_named_vector",
          "SELECT vec_id AS id, 'vec' AS name, CAST(16 AS BIGINT) AS dim, "
          f"round(list_sum(CAST({random_vector_sql('gen/named', 'vec_id', 16)} AS DOUBLE[])), 6) AS vsum FROM embeddings")
def q_gen_named_vector(spark, sf_dir):
    named = generators.random_named_vector("vec", "gen/named", F.col("id"), 16)
    none = generators.random_named_vector("vec", "gen/named", F.col("id"), 0)
    df = _emb_ids(spark, sf_dir).select("id", named.alias("m"), none.alias("m0"))
    # dim 0 gives an empty map: explode drops it, so only the named vector remains
    return df.select("id", F.explode(F.map_concat("m", "m0")).alias("name", "v")).select(
        "id", "name", F.size("v").cast("bigint").alias("dim"), F.round(vsum(F.col("v")), 6).alias("vsum"))


@register("gen_query_filters", f"SELECT vec_id AS query_id, {kw_sql('query/filter', 2, 'vec_id')} AS must_a FROM embeddings")
def q_gen_query_filters(spark, sf_dir):
    q = generators.gen_queries(tables.embeddings(spark, sf_dir, "vec_id"), 0, 2, id_col="vec_id")
    return q.select("query_id", "must_a")


@register("gen_points",
          "SELECT id, a, CAST(len(vec) AS BIGINT) AS dim, round(list_sum(CAST(vec AS DOUBLE[])), 6) AS vsum FROM ("
          f"SELECT vec_id AS id, {random_vector_sql('point/vector', 'vec_id', GEN_DIM)} AS vec, "
          f"{kw_sql('point/payload', 2, 'vec_id')} AS a FROM embeddings) t")
def q_gen_points(spark, sf_dir):
    pts = generators.gen_points(_emb_ids(spark, sf_dir), GEN_DIM, 2)
    return pts.select("id", "a", F.size("vec").cast("bigint").alias("dim"), F.round(vsum(F.col("vec")), 6).alias("vsum"))


SUBSTREAMS = ("drill_0/op", "drill_1/op", "drill_0/op/child")


@register("gen_substreams",
          "SELECT event_id AS id, " + ", ".join(
              f"{uniform_sql(s, 'event_id')} AS u{i}" for i, s in enumerate(SUBSTREAMS)) + " FROM events")
def q_gen_substreams(spark, sf_dir):
    ids = _ev_ids(spark, sf_dir)
    return ids.select("id", *[uniform(s, F.col("id")).alias(f"u{i}") for i, s in enumerate(SUBSTREAMS)])


@register("batch_plan",
          "SELECT CAST(floor(event_id / 100) AS BIGINT) AS batch_id, CAST(floor(event_id / 100) * 100 AS BIGINT) AS base_id, "
          "CAST(count(*) AS BIGINT) AS size FROM events GROUP BY ALL")
def q_batch_plan(spark, sf_dir):
    return generators.batch_plan(_ev_ids(spark, sf_dir))


@register("gen_oplog",
          "SELECT event_id AS cycle, CAST(s.step AS BIGINT) AS step, CAST(event_id * 6 + s.step AS BIGINT) AS seq, "
          "CASE s.step WHEN 0 THEN 'upsert' WHEN 1 THEN 'search' WHEN 2 THEN 'set_payload' WHEN 3 THEN 'upsert' "
          "WHEN 4 THEN 'get' ELSE 'delete' END AS op, event_id AS id, "
          f"concat('node_', CAST({uniform_int_sql('cycle/uri', 3, 'event_id')} AS VARCHAR)) AS uri "
          "FROM events, (SELECT range AS step FROM range(6)) s")
def q_gen_oplog(spark, sf_dir):
    return generators.gen_oplog(_ev_ids(spark, sf_dir), 3)
