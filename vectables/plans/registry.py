"""Registry of named queries: a Spark builder ``(spark, sf_dir) -> DataFrame`` and, where the
operator is expressible in SQL, the equivalent DuckDB text over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return wrap


def load_all() -> None:
    """Import every module that registers queries."""
    from vectables.plans import (  # noqa: F401
        search_queries,
        table_queries,
        log_queries,
        generator_queries,
        checks_queries,
        index_queries,
        stream_queries,
        drills,
        lifecycle_queries,
    )
