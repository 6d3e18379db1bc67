"""Running sums per key without putting a whole key into one task.

A plain ``sum(x) OVER (PARTITION BY uri ORDER BY ts)`` sends every row of a uri to one task;
with three uris that is a third of the table per task. Here the order is cut into chunks
(a slice of ``ts`` whose width follows the busiest key, or a block of a sequence number):

1. a running sum inside each ``(key, chunk)`` (many small window partitions),
2. one total per ``(key, chunk)`` (partial aggregation, tiny output),
3. a prefix over the chunk totals (rows = keys x chunks, small),
4. an equi-join of the prefix back on ``(key, chunk)``; AQE broadcasts it when its measured
   size allows, else it is a shuffle join.

The result equals the whole-key window as long as the chunk is monotone in the order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Most rows of one key that a window partition may hold.
CHUNK_ROWS = 1 << 20
_HOUR_US = 3_600_000_000


def time_chunk(df: DataFrame, keys: Sequence[str], ts: str = "ts", most: int | None = None, widest: int = _HOUR_US) -> Column:
    """Chunk of a row by time, monotone in ``ts``: slices of equal width, ``widest`` microseconds (an hour) or as much less as it
    takes for the busiest (key, slice) to hold at most ``most`` rows (only rows of one key within the same
    microsecond cannot be split). Reads ``df`` once per width tried: a count per (key, slice) and one maximum."""
    most, width = most or CHUNK_ROWS, widest
    ntz = dict(df.dtypes)[ts] == "timestamp_ntz"     # its wall clock, whatever the session's time zone
    instant = F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', `{ts}`)") if ntz else F.unix_micros(ts)
    while True:
        chunk = F.floor(instant / F.lit(width)) if width > 1 else instant
        busiest = df.groupBy(*keys, chunk.alias("__c")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if busiest <= most or width == 1:
            return chunk
        width = max(1, width // (2 * -(-busiest // most)))


def block_chunk(seq: str, size: int = 1 << 16) -> Column:
    return F.floor(F.col(seq) / F.lit(size)).cast("bigint")


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    chunk: Column,
) -> DataFrame:
    """Add one inclusive running-sum column per entry of ``values`` (name -> bigint column)."""
    keys = list(keys)
    tmp = {name: f"__v_{name}" for name in values}
    df = df.withColumn("__chunk", chunk)
    for name, col in values.items():
        df = df.withColumn(tmp[name], col.cast("bigint"))

    local_w = (
        Window.partitionBy(*keys, "__chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = df.groupBy(*keys, "__chunk").agg(*[F.sum(tmp[n]).alias(f"__t_{n}") for n in values])
    prefix_w = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(
        *keys,
        "__chunk",
        *[F.coalesce(F.sum(f"__t_{n}").over(prefix_w), F.lit(0)).alias(f"__p_{n}") for n in values],
    )
    out = df
    for name in values:
        out = out.withColumn(f"__l_{name}", F.sum(tmp[name]).over(local_w))
    out = out.join(prefix, on=keys + ["__chunk"], how="inner")
    for name in values:
        out = out.withColumn(name, (F.col(f"__p_{name}") + F.col(f"__l_{name}")).cast("bigint"))
    drop = ["__chunk"] + [c for n in values for c in (tmp[n], f"__l_{n}", f"__p_{n}")]
    return out.drop(*drop)


def chunked_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], col: Column, out: str,
                chunk: Column) -> DataFrame:
    """``lag(col)`` per key in ``order`` without a whole-key window partition: a lag inside each
    ``(key, chunk)``; the first row of a chunk takes the last value of the previous non-empty
    chunk, found by a lag over the small per-chunk summary table and an equi-join back."""
    keys = list(keys)
    df = df.withColumn("__chunk", chunk).withColumn("__val", col)
    w = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    df = df.withColumn(out, F.lag("__val").over(w)).withColumn("__first", F.row_number().over(w) == 1)
    last = df.groupBy(*keys, "__chunk").agg(F.max_by("__val", F.struct(*order)).alias("__last"))
    prev = last.select(*keys, "__chunk", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__chunk")).alias("__prev"))
    joined = df.join(prev, on=keys + ["__chunk"], how="inner")
    return joined.withColumn(out, F.when(F.col("__first"), F.col("__prev")).otherwise(F.col(out))).drop(
        "__chunk", "__val", "__first", "__prev")
