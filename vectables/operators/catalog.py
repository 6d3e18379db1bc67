"""Field indexes, payload schema, layout and snapshot listings (OP-42..OP-46) as plain DataFrame work.

The source tool's collection lifecycle and snapshot files are engine internals and are not rebuilt; what
its logs and manifests say about them is (see :func:`live_snapshots` and the lifecycle audit).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_field_index(points: DataFrame, path: str, field: str = "a", row_group_bytes: int = 16 << 20) -> None:
    """OP-42: ids by keyword, clustered for data skipping. Rows are range-partitioned and sorted by (keyword, id), so a
    row group holds a narrow interval of keywords and a keyword of a third of the points spans several tasks; the
    number of files follows the bytes, not the distinct keywords. Row groups carry statistics and, where the
    keyword column is not dictionary-encoded throughout, a bloom filter. Points without the keyword are left out."""
    (points.where(F.col(field).isNotNull()).select("id", field)
     .repartitionByRange(F.col(field), F.col("id")).sortWithinPartitions(field, "id")
     .write.option("parquet.block.size", row_group_bytes).option(f"parquet.bloom.filter.enabled#{field}", "true").parquet(path))


def ids_with(spark: SparkSession, path: str, *values: str, field: str = "a") -> DataFrame:
    """``(id, keyword)`` of points whose keyword is one of ``values``: the filter reaches the Parquet scan, which skips the
    row groups and pages that cannot hold them."""
    return read_field_index(spark, path, field).where(F.col(field).isin(*values))


def read_field_index(spark: SparkSession, path: str, field: str = "a") -> DataFrame:
    """All of a written field index."""
    return spark.read.schema(f"id long, `{field}` string").parquet(path)


def live_snapshots(manifest: DataFrame, collection: str | None = None) -> DataFrame:
    """OP-46: fold a snapshot manifest ``(seq, collection, snapshot, action)``: latest action per
    name, keep the created ones. Output ``(collection, snapshot, created_seq)``."""
    m = manifest if collection is None else manifest.where(F.col("collection") == collection)
    latest = m.groupBy("collection", "snapshot").agg(
        F.max_by("action", "seq").alias("action"), F.max("seq").alias("created_seq"))
    return latest.where(F.col("action") == "create").select("collection", "snapshot", "created_seq")


def field_postings(points: DataFrame, field: str = "a") -> DataFrame:
    """OP-42: keyword index summary: per value, number of points and id range."""
    return points.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(
        F.count(F.lit(1)).cast("bigint").alias("points"), F.min("id").alias("min_id"), F.max("id").alias("max_id"))


def payload_schema(payload_long: DataFrame, indexed=("a",)) -> DataFrame:
    """OP-43: ``(field, data_type, points, indexed)`` from long-form payload rows ``(id, k, v)``."""
    return payload_long.where(F.col("k").isNotNull()).groupBy(F.col("k").alias("field")).agg(
        F.count_distinct("id").cast("bigint").alias("points")
    ).select("field", F.lit("keyword").alias("data_type"), "points",
             F.col("field").isin(*indexed).alias("indexed"))


def shard_of(id_col: str, shards: int):
    """OP-44: shard number of an id for a fixed shard count."""
    return F.pmod(F.col(id_col), F.lit(shards)).cast("bigint")
