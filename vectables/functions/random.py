"""Seeded, partition-independent randomness (OP-07).

A draw is a pure function of ``(seed, stream, key...)``: the first 13 hex digits of an MD5
digest (52 bits) divided by 2**52. It does not depend on partitioning, task order or retries,
so a re-run task after a lost executor produces the same values. ``rand()`` is never used.

Both engines compute the same value, so each function also has a SQL-text twin for the
DuckDB oracle (``*_sql``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vectables import SEED

TWO_POW_52 = 4503599627370496.0


def _key(seed: int, stream: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), F.lit(stream), *[p.cast("string") for p in parts])


def uniform(stream: str, *parts: Column, seed: int = SEED) -> Column:
    """Uniform double in [0, 1) keyed by (seed, stream, parts)."""
    digest = F.md5(_key(seed, stream, *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(TWO_POW_52)


def uniform_int(stream: str, n: int, *parts: Column, seed: int = SEED) -> Column:
    """Uniform integer in 0..n-1."""
    return F.floor(uniform(stream, *parts, seed=seed) * F.lit(n)).cast("bigint")


def uniform_sql(stream: str, *parts: str, seed: int = SEED) -> str:
    """DuckDB text of :func:`uniform`; ``parts`` are SQL expressions."""
    key = ", ".join([f"'{seed}'", f"'{stream}'"] + [f"CAST({p} AS VARCHAR)" for p in parts])
    return f"(CAST(('0x' || substr(md5(concat_ws(':', {key})), 1, 13)) AS BIGINT) / {TWO_POW_52})"


def uniform_int_sql(stream: str, n: int, *parts: str, seed: int = SEED) -> str:
    return f"CAST(floor({uniform_sql(stream, *parts, seed=seed)} * {n}) AS BIGINT)"
