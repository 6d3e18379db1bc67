"""Seeded generators of points, queries and operation logs (OP-01..OP-09).

All generators take a DataFrame of ids (usually read from a supplied table) and add columns, so
the work is distributed by Spark exactly like the id table, and every value is a pure function of
``(seed, stream, id, j)`` (see :mod:`vectables.functions.random`).

FIXED VALUES
  payload key: 'a';  keyword text: 'keyword_' || i;  default vector name: 'vec'
  operation cycle: upsert, search, set_payload, upsert, get, delete (6 steps on one id)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectables import BATCH_SIZE, SEED
from vectables.functions.random import uniform, uniform_int
from vectables.functions.vectors import random_vector

PAYLOAD_KEY = "a"
CYCLE_OPS = ("upsert", "search", "set_payload", "upsert", "get", "delete")


def empty_payload() -> Column:
    return F.create_map().cast("map<string,string>")


def random_keyword(stream: str, key: Column, n: int, seed: int = SEED) -> Column:
    """OP-01: 'keyword_i' with i uniform in 0..n-1."""
    if n <= 0:
        raise ValueError("keyword variants must be positive")
    return F.concat(F.lit("keyword_"), uniform_int(stream, n, key, seed=seed).cast("string"))


def random_payload(stream: str, key: Column, n: int | None, seed: int = SEED) -> Column:
    """OP-02: one-key map {a: keyword}, or an empty map when ``n`` is None or 0 (S3)."""
    if n is None or n <= 0:
        return empty_payload()
    return F.create_map(F.lit(PAYLOAD_KEY), random_keyword(stream, key, n, seed=seed))


def random_filter(stream: str, key: Column, n: int | None, seed: int = SEED) -> Column:
    """OP-05: the keyword a query must match, or null for no filter (S5). ``n <= 0`` is an error (S4)."""
    if n is None:
        return F.lit(None).cast("string")
    if n <= 0:
        raise ValueError("a filter needs at least one keyword variant")
    return random_keyword(stream, key, n, seed=seed)


def random_named_vector(name: str, stream: str, key: Column, dim: int, seed: int = SEED) -> Column:
    """OP-04, logical form: {name: vector}, or an empty map when ``dim`` is 0."""
    if dim <= 0:
        return F.create_map().cast("map<string,array<float>>")
    return F.create_map(F.lit(name), random_vector(stream, key, dim, seed=seed))


def gen_points(ids: DataFrame, dim: int, variants: int | None, seed: int = SEED, id_col: str = "id",
               stream: str = "point") -> DataFrame:
    """OP-06: one point per id: ``(id, vec, payload, a)``; ``a`` is the payload key promoted to a column."""
    key = F.col(id_col)
    payload = random_payload(f"{stream}/payload", key, variants, seed=seed)
    return ids.select(
        key.cast("bigint").alias("id"),
        random_vector(f"{stream}/vector", key, dim, seed=seed).alias("vec"),
        payload.alias("payload"),
    ).withColumn("a", F.col("payload")[PAYLOAD_KEY])


def gen_queries(ids: DataFrame, dim: int, variants: int | None, seed: int = SEED, id_col: str = "id",
                stream: str = "query") -> DataFrame:
    """Queries as in the search drills: a random vector and a random keyword filter per query."""
    key = F.col(id_col)
    return ids.select(
        key.cast("bigint").alias("query_id"),
        random_vector(f"{stream}/vector", key, dim, seed=seed).alias("qvec"),
        random_filter(f"{stream}/filter", key, variants, seed=seed).alias("must_a"),
    )


def batch_plan(ids: DataFrame, id_col: str = "id", size: int = BATCH_SIZE) -> DataFrame:
    """OP-08: write batches of ``size`` over dense ids 0..n-1: ``(batch_id, base_id, size)``.

    n <= size gives one batch of n; n = 0 gives one empty batch (S6). The count per batch is a
    partial aggregation, so no batch is ever materialised in one place.
    """
    spark = ids.sparkSession
    batches = (
        ids.select(F.floor(F.col(id_col) / size).cast("bigint").alias("batch_id"))
        .groupBy("batch_id")
        .agg(F.count(F.lit(1)).cast("bigint").alias("size"))
        .select("batch_id", (F.col("batch_id") * size).cast("bigint").alias("base_id"), "size")
    )
    # the empty batch exists only when there is no batch at all (a scalar subquery, no join)
    empty = spark.range(1).select(
        F.lit(0).cast("bigint").alias("batch_id"), F.lit(0).cast("bigint").alias("base_id"),
        F.lit(0).cast("bigint").alias("size"),
    ).where(batches.select(F.count(F.lit(1))).scalar() == 0)
    return batches.unionByName(empty)


def gen_oplog(cycles: DataFrame, n_uris: int, id_col: str = "id", seed: int = SEED) -> DataFrame:
    """OP-09: six ordered operations per cycle on the cycle's own id; one uniform target uri per cycle.

    Output ``(cycle, step, seq, op, id, uri)``, ``seq = cycle * 6 + step`` orders one cycle.
    """
    ops = F.array(*[F.lit(o) for o in CYCLE_OPS])
    key = F.col(id_col).cast("bigint")
    return cycles.select(
        key.alias("cycle"),
        F.concat(F.lit("node_"), uniform_int("cycle/uri", n_uris, key, seed=seed).cast("string")).alias("uri"),
        F.posexplode(ops).alias("step", "op"),
    ).select(
        "cycle",
        F.col("step").cast("bigint").alias("step"),
        (F.col("cycle") * len(CYCLE_OPS) + F.col("step")).cast("bigint").alias("seq"),
        "op",
        F.col("cycle").alias("id"),
        "uri",
    )
