"""Intermediate tables in the shared folder that ``spark.checkpoint.dir`` names.

A table written here cuts lineage: a lost executor costs the tasks it ran, not the work before the
last table. Every call of an operator works in a folder of its own, so reruns never meet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from vectables.session import storage_root


BATCH_BYTES = 8 << 20   # of texts that travel to a Python worker at once


class Workspace:
    """A fresh folder for one run of one operator.

    Where the session has Spark's own limit on the bytes of an Arrow batch, it is lowered to ``BATCH_BYTES``: a batch of long
    texts stands several times in an executor, as rows, as buffers and in the worker.
    """

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        limit = "spark.sql.execution.arrow.maxBytesPerBatch"
        if spark.conf.get(limit, "64m") in ("64m", "67108864", "67108864b"):
            spark.conf.set(limit, BATCH_BYTES)
        self.root = f"{storage_root(spark)}/llm/{operator}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back with its own schema (empty tables included)."""
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


BROADCAST_IDS = 500_000     # long ids that may travel to every task (4 MB)


def rows_of(rows: DataFrame, ids: DataFrame, key: str, others: bool = False) -> DataFrame:
    """The rows whose ``key`` is in ``ids`` (one column of that name), or all ``others``. The ids are counted: up
    to ``BROADCAST_IDS`` are broadcast, so the rows are filtered where they are read; more meet in a shuffle."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids.hint("merge"), key, "left_anti" if others else "left_semi")


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores before it as it takes to differ from all columns."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
