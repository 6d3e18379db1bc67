"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vectables.llm.store import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    linked = edges.join(least, "u")
    pairs = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pairs.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, space: Workspace, name: str = "cc") -> DataFrame:
    """``edges(a, b)`` of long ids -> ``(id, component)``, component the smallest id reachable.

    Only ids that occur in an edge between two different ids appear; nulls and loops are ignored. A
    node with very many edges is a partial minimum and a join side that AQE splits, never one list.
    Every round is written to the shared folder and replaces the round before.
    """
    at = space.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{name}-0",
    )
    seen, k = None, 0
    while True:
        mark = at.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark["n"] == 0 or mark == seen:
            return at.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                at.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        seen, k = mark, k + 1
        at = space.save(_small_star(_large_star(at)), f"{name}-{k}")
        space.drop(f"{name}-{k - 1}")
