"""Star edges: every row of a group is paired with the group's first member, in one shuffle.

Rows are range-partitioned and sorted by key and member, so a group with a third of all rows is spread
over many tasks. In a task the first member of a key is the pivot of the rows after it; where a key goes on
from one task to the next, the first member is carried on and takes the place of the next task's pivot, so every
row of a key meets the same member however many tasks the key spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vectables.llm.store import Workspace
from vectables.llm.text import lean


def _pair(members: list[str]):
    names = ["kind", "part", "key", *members, *(f"to_{m}" for m in members)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = last = None

        def rows(kind: int, key: np.ndarray, own: list[np.ndarray], to: list[np.ndarray]) -> pa.RecordBatch:
            n = len(key)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, part, np.int64)), *map(pa.array, (key, *own, *to))], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, *own = (batch.column(i).to_numpy() for i in range(1 + len(members)))
            new = np.concatenate([[last is None or key[0] != last[0]], key[1:] != key[:-1]])
            at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            to = [np.where(at >= 0, c[at], last[1 + i] if last else 0) for i, c in enumerate(own)]
            if first is None:
                first = (key[0], *(c[0] for c in own))
            last = (key[-1], *(c[-1] for c in to))
            old = ~new
            if old.any():
                yield rows(0, key[old], [c[old] for c in own], [c[old] for c in to])
        for kind, ends in ((1, first), (2, last)):
            if ends is not None:
                key, *own = (np.array([x], dtype=np.int64) for x in ends)
                yield rows(kind, key, own, own)

    return run


def carried(ends: list[tuple]) -> list[tuple]:
    """Ends of the tasks' ranges (part, kind, key, *member), sorted -> (part, key, *first member of that range,
    *first member of the key) for every range that begins within a key."""
    out, open_key, pivot = [], None, None
    for part, kind, key, *member in ends:
        if kind == 1:
            begun = key == open_key
            if begun:
                out.append((part, key, *member, *pivot))
            first = key
        elif not (begun and key == first):      # else the key fills the range and keeps its pivot
            open_key, pivot = key, member
    return out


def star_edges(rows: DataFrame, members: list[str], space: Workspace, name: str = "stars") -> DataFrame:
    """``rows(key, *members[, ...])``, all longs -> ``(*members, to_*)``: each row but a key's first with the
    first row of its key. Columns after the members only break ties between tasks."""
    spark = rows.sparkSession
    order = rows.columns
    schema = "kind int, part long, key long, " + ", ".join(f"{m} long" for m in [*members, *(f"to_{m}" for m in members)])
    stars = space.save(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(_pair(members)), schema), name)
    both = [*members, *(f"to_{m}" for m in members)]
    # one row for either end of each task's range, so what is carried has at most a row a task
    ends = sorted(tuple(r) for r in stars.where("kind > 0").select("part", "kind", "key", *members).collect())
    begun = carried(ends)
    if not begun:
        return stars.where("kind = 0").select(*both)
    bridge = spark.createDataFrame([r[2:] for r in begun], ", ".join(f"{c} long" for c in both))
    pivots = spark.createDataFrame([r[:2] + r[2 + len(members):] for r in begun], ", ".join(
        f"{c} long" for c in ["part", "key", *(f"pivot_{m}" for m in members)]))
    return stars.where("kind = 0").join(F.broadcast(pivots), ["part", "key"], "left").select(
        *members, *(F.coalesce(f"pivot_{m}", f"to_{m}").alias(f"to_{m}") for m in members)).union(bridge)
