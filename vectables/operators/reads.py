"""Lookups, pages and summaries (OP-22..OP-28)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 100


def get_by_id(points: DataFrame, point_id: int, columns=("id", "a")) -> DataFrame:
    """OP-23: the point with this id, or no row. Id + payload only (S22); the id filter is pushed
    to the Parquet scan, so row groups whose id range misses are skipped."""
    return points.where(F.col("id") == F.lit(point_id)).select(*columns).limit(1)


def retrieve(points: DataFrame, ids: DataFrame, columns=("id", "a", "vec")) -> DataFrame:
    """OP-24: bulk lookup with vectors: a left-semi join on id. The id list is deduplicated first;
    Spark broadcasts it only when its measured size is under the broadcast threshold (AQE),
    otherwise both sides are shuffled on id."""
    wanted = ids.select(F.col("id").cast("bigint").alias("id")).distinct()
    return points.join(wanted, on="id", how="left_semi").select(*columns)


def scroll(points: DataFrame, predicate: Column | None = None, limit: int = PAGE, after_id: int | None = None,
           columns=("id", "a")) -> DataFrame:
    """OP-25: one filtered page in id order (TakeOrderedAndProject). ``after_id`` gives keyset paging."""
    df = points if predicate is None else points.where(predicate)
    if after_id is not None:
        df = df.where(F.col("id") > F.lit(after_id))
    return df.select(*columns).orderBy("id").limit(limit)


def points_count(points: DataFrame) -> DataFrame:
    """OP-26: number of points (a missing count reads as 0, S7)."""
    return points.agg(F.coalesce(F.count(F.lit(1)), F.lit(0)).cast("bigint").alias("points_count"))


def collection_info(points: DataFrame, vector: str = "vec", fields=("a",), indexed: DataFrame | None = None) -> DataFrame:
    """OP-27: counts, payload schema and status in one row, all read from the tables.

    ``indexed`` is the cell-assigned index (``ivf.build_index``): its rows with a cell are the indexed vectors, and
    the status is ``green`` when every vector has one, ``yellow`` while some have not, ``grey`` without an index."""
    counts = points.agg(
        F.count(F.lit(1)).cast("bigint").alias("points_count"), F.count(F.col(vector)).cast("bigint").alias("vectors_count"),
        *[F.count(F.col(f)).cast("bigint").alias(f"{f}_points") for f in fields])
    if indexed is None:
        return counts.select(F.lit("grey").alias("status"), "*", F.lit(0).cast("bigint").alias("indexed_vectors_count"), _schema_size(fields).alias("payload_fields"))
    built = indexed.agg(F.count("cell").cast("bigint").alias("indexed_vectors_count"))
    both = counts.select("*", built.select("indexed_vectors_count").scalar().alias("indexed_vectors_count"))
    status = F.when(F.col("indexed_vectors_count") >= F.col("vectors_count"), "green").otherwise("yellow")
    return both.select(status.alias("status"), "*", _schema_size(fields).alias("payload_fields"))


def _schema_size(fields) -> Column:
    """Payload fields that some point holds."""
    return sum((F.when(F.col(f"{f}_points") > 0, 1).otherwise(0) for f in fields), F.lit(0)).cast("bigint")


def status_errors(names: DataFrame, statuses: DataFrame, key: str = "collection") -> DataFrame:
    """OP-28: what a status request would answer for each name: its latest status, or the error of a name without
    polls (missing) or whose latest poll is red (failed)."""
    latest = latest_status(statuses, key)
    error = (F.when(F.col("status").isNull(), F.concat(F.lit("Collection `"), F.col(key), F.lit("` not found")))
             .when(F.col("status") == "red", F.concat(F.lit("Collection `"), F.col(key), F.lit("` failed: status red"))))
    return names.select(key).distinct().join(latest, key, "left").select(key, "status", "last_event_id", error.alias("error"))


def latest_status(statuses: DataFrame, key: str = "collection") -> DataFrame:
    """OP-28: latest status per collection: ``max_by(status, (ts, event_id))``, a partial
    aggregation (each task keeps one row per key before the shuffle)."""
    return statuses.groupBy(key).agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"),
        F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event_id"),
        F.count(F.lit(1)).cast("bigint").alias("polls"),
    )
