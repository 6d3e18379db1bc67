"""Keyed table mutations (OP-11..OP-19).

A collection is a DataFrame ``(id bigint, vec array<float>, payload map<string,string>)``; a
mutation returns the next version (write it with :mod:`vectables.operators.catalog`).

Scale notes: the delta of a mutation is normally much smaller than the table. Every operator
here joins the table against the delta's *ids* with left-anti / left-semi / left-outer joins, so
when the delta is small AQE broadcasts it (its size is measured at runtime) and the table is
never shuffled; when the delta is large both sides shuffle on ``id`` and AQE splits skewed ids.
Whole rows are replaced, never merged column by column, so a null vector in an upsert stays
null (S1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT_COLUMNS = ("id", "vec", "payload")


def latest_per_id(delta: DataFrame, order: str | None) -> DataFrame:
    """One row per id: the last by ``order``. Without an order the ids have to be distinct, and a
    delta that names one twice fails when it is read (partial aggregates either way)."""
    cols = [c for c in delta.columns if c not in ("id",)]
    row = F.struct(*cols)
    if order is None:
        picked = delta.groupBy("id").agg(F.first(row).alias("__row"), F.count(F.lit(1)).alias("__n"))
        twice = F.raise_error(F.concat(F.lit("the delta holds several rows for id "), F.col("id").cast("string"),
                                       F.lit("; name the column that orders them")))
        picked = picked.withColumn("__row", F.when(F.col("__n") > 1, twice.cast(picked.schema["__row"].dataType)).otherwise(F.col("__row")))
    else:
        picked = delta.groupBy("id").agg(F.max_by(row, F.col(order)).alias("__row"))
    return picked.select("id", "__row.*")


def upsert(table: DataFrame, delta: DataFrame, order: str | None = None) -> DataFrame:
    """OP-11 / OP-12: replace-or-insert whole rows by id; of several rows for one id the last by ``order``."""
    delta = latest_per_id(delta, order).select(*table.columns)
    kept = table.join(delta.select("id"), on="id", how="left_anti")
    return kept.unionByName(delta)


def delete_ids(table: DataFrame, ids: DataFrame) -> DataFrame:
    """OP-14: delete by id (left-anti join on the distinct id list)."""
    return table.join(ids.select(F.col("id").cast("bigint").alias("id")).distinct(), on="id", how="left_anti")


def delete_range(table: DataFrame, n: int, start: int = 0) -> DataFrame:
    """OP-15: delete ids ``start .. start+n-1`` (a range predicate, pushed to the scan)."""
    return table.where(~((F.col("id") >= start) & (F.col("id") < start + n)))


def set_payload(table: DataFrame, patch: DataFrame) -> DataFrame:
    """OP-13: patch payload keys ``(id, k, v, seq)``; last write per key wins, other keys are kept,
    an id absent from the table is a no-op (S2). Vectors are untouched."""
    last = patch.groupBy("id", "k").agg(F.max_by("v", "seq").alias("v"))
    per_id = last.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("__patch"))
    joined = table.join(per_id, on="id", how="left")
    payload = F.coalesce("payload", F.create_map().cast("map<string,string>"))   # a point without payload takes the patch
    merged = F.map_concat(
        F.map_filter(payload, lambda k, _v: ~F.array_contains(F.map_keys("__patch"), k)),
        F.col("__patch"),
    )
    return joined.withColumn(
        "payload", F.when(F.col("__patch").isNull(), F.col("payload")).otherwise(merged)
    ).drop("__patch")


def apply_oplog(oplog: DataFrame) -> DataFrame:
    """OP-16: final payload of an ordered change log ``(seq, id, op, k, v)`` applied to an empty table.

    Per id the last upsert-or-delete is the reset; a delete (or no reset) leaves nothing; an
    upsert starts from its own keys, then patches after it apply in order. Output is long form
    ``(id, k, v)``, one row per live key, and ``(id, null, null)`` for a live id with an empty
    payload. Everything is partial aggregation and equi-joins on id: no per-id list is built.
    """
    resets = (
        oplog.where(F.col("op").isin("upsert", "delete"))
        .groupBy("id")
        .agg(F.max_by("op", "seq").alias("reset_op"), F.max("seq").alias("reset_seq"))
    )
    live = resets.where(F.col("reset_op") == "upsert").select("id", "reset_seq")
    writes = oplog.where(F.col("op").isin("upsert", "set_payload") & F.col("k").isNotNull()).select("id", "seq", "k", "v")
    kv = (
        writes.join(live, on="id", how="inner")
        .where(F.col("seq") >= F.col("reset_seq"))
        .groupBy("id", "k")
        .agg(F.max_by("v", "seq").alias("v"))
    )
    return live.select("id").join(kv, on="id", how="left").select("id", "k", "v")


def long_payload(table: DataFrame) -> DataFrame:
    """``(id, k, v)`` rows of a collection's payload; an empty payload gives ``(id, null, null)``."""
    return table.select("id", F.explode_outer("payload").alias("k", "v"))


def summary_columns(vector: str = "vec") -> list[Column]:
    """Scalar view of a point for comparisons: payload key ``a``, key count, vector size and sum."""
    from vectables.functions.vectors import vsum

    return [
        F.col("payload")["a"].alias("a"),
        F.size(F.coalesce(F.map_keys("payload"), F.array())).cast("bigint").alias("n_keys"),
        F.when(F.col(vector).isNotNull(), F.size(vector)).cast("bigint").alias("dim"),
        F.round(vsum(F.col(vector)), 6).alias("vsum"),
    ]
