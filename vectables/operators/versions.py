"""Stored versions of a wide table, bucketed by key, so that two of them are compared without moving their vectors.

A version is a table of ``buckets`` files, each holding the keys of one hash bucket. Versions with the same
number of buckets line up file by file: a join on the key reads a bucket of each in one task, without an exchange.
The shuffle is paid once, when a version is written, however often it is compared afterwards.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectables.operators import checks
from vectables.session import storage_root

# bytes of vectors that a bucket should hold: two buckets are sorted and merged in one task
BUCKET_BYTES = 128 << 20


def buckets_for(table: DataFrame, vector: str = "vec", bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for a table, by the bytes of its vectors (one pass that reads their lengths)."""
    size = table.agg(F.sum(F.coalesce(F.size(vector), F.lit(0)).cast("long") * 4 + 16)).first()[0] or 0
    return max(1, -(-size // bucket_bytes))


def save_version(table: DataFrame, buckets: int, key: str = "id", name: str | None = None) -> DataFrame:
    """Write ``table`` as a bucketed Parquet table below the shared folder and return it as read back. ``name`` is the
    catalog's (a fresh one by default); versions to be compared take the same ``buckets``."""
    spark: SparkSession = table.sparkSession
    name = name or f"version_{uuid.uuid4().hex[:12]}"
    (table.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", f"{storage_root(spark)}/{name}").saveAsTable(name))
    return spark.table(name)


def vector_diff(before: DataFrame, after: DataFrame, vector: str = "vec") -> DataFrame:
    """:func:`checks.vector_diff` of two stored versions as a merge of their buckets, never a broadcast of vectors."""
    return checks.vector_diff(before, after.hint("merge"), vector)


def check_vectors_changed(before: DataFrame, after: DataFrame, collection: str = "points") -> DataFrame:
    """:func:`checks.check_vectors_changed` of two stored versions."""
    return checks.check_vectors_changed(before, after.hint("merge"), collection)
