"""Payload filters (OP-20, OP-21) as Column predicates.

``must``: every condition holds (AND); ``should``: at least one (OR), or at least ``min_should``;
``must_not``: none holds. Empty lists do not restrict; no filter at all is ``None`` (S5).
A condition is ``(key, value)``: the key is a promoted top-level column when it exists,
else a lookup in the ``payload`` map. Promoted columns let Parquet push the filter down.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Condition = tuple[str, str]


def field(key: str, promoted: Sequence[str] = ("a",)) -> Column:
    return F.col(key) if key in promoted else F.col("payload")[key]


def match(cond: Condition, promoted: Sequence[str] = ("a",)) -> Column:
    key, value = cond
    # a missing key never matches (null-safe: null compares as false)
    return F.coalesce(field(key, promoted) == F.lit(value), F.lit(False))


def build_filter(must: Sequence[Condition] = (), should: Sequence[Condition] = (),
                 must_not: Sequence[Condition] = (), min_should: int | None = None,
                 promoted: Sequence[str] = ("a",)) -> Column | None:
    parts: list[Column] = []
    for c in must:
        parts.append(match(c, promoted))
    if should:
        hits = [match(c, promoted) for c in should]
        if min_should is None:
            parts.append(_or(hits))
        else:
            total = sum((h.cast("int") for h in hits[1:]), hits[0].cast("int"))
            parts.append(total >= F.lit(min_should))
    if must_not:
        parts.append(~_or([match(c, promoted) for c in must_not]))
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def _or(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out | c
    return out
