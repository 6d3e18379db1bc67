"""Vector column functions (OP-03, OP-04, OP-31): JVM-side higher-order functions, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vectables import SEED
from vectables.functions.random import uniform, uniform_sql

VECTOR_TYPE = "array<float>"
SCORE_DECIMALS = 6


def random_vector(stream: str, key: Column, dim: int, seed: int = SEED) -> Column:
    """``dim`` floats uniform in [-1, 1), keyed by (seed, stream, key, j). ``dim = 0`` gives null (S3)."""
    if dim <= 0:
        return F.lit(None).cast(VECTOR_TYPE)
    return F.transform(
        F.sequence(F.lit(0), F.lit(dim - 1)),
        lambda j: (uniform(stream, key, j, seed=seed) * 2.0 - 1.0).cast("float"),
    )


def random_vector_sql(stream: str, key: str, dim: int, seed: int = SEED) -> str:
    if dim <= 0:
        return "CAST(NULL AS FLOAT[])"
    return f"[CAST({uniform_sql(stream, key, 'j', seed=seed)} * 2.0 - 1.0 AS FLOAT) FOR j IN range(0, {dim})]"


def dot(a: Column, b: Column) -> Column:
    """Dot product accumulated in double."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def vsum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x.cast("double"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, higher is better. A zero norm, a null or non-finite component or another length on either side
    gives null: never a hit."""
    na, nb = norm(a), norm(b)
    finite = lambda n: (n > 0) & (n < float("inf"))  # noqa: E731 - NaN is above infinity
    return F.when(finite(na) & finite(nb), dot(a, b) / (na * nb))


def finite_vector(vec: Column) -> Column:
    """True where the vector is neither null nor empty and all its components are finite numbers."""
    return F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))), F.lit(False))


def vector_literal(values) -> Column:
    return F.array(*[F.lit(float(v)).cast("float") for v in values])
