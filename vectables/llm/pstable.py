"""Near-duplicate vectors by Euclidean p-stable hashing.

A vector scaled to length one is projected on ``tables`` x ``width`` Gaussian directions, shifted, and cut into
steps of ``step``; the ``width`` steps of one table make its bucket. Vectors with a cosine of 0.98 are at
most 0.2 apart, where a step of 2 keeps a projection together in 92 % of cases, so 40 tables of 16 miss
such a pair with a probability of 6e-6; unrelated vectors (1.41 apart) share a bucket of a table
in 1e-5 of cases. Equal vectors under one label are one class with a multiplicity. Buckets of more than ``SIDE`` classes are
split into sides, a task compares two sides by exact cosine, and a pair counts in the first table where it
shares a bucket only. What leaves a task is a number of links per class and a spanning forest of
the links, so a large group costs rows in proportion to its size, not to its pairs.

Defined cases: null labels, null ids and invalid vectors (see ``vectors``) link with nothing; vectors of
different lengths link with nothing; repeated rows count as other vectors that are linked; an id that occurs
twice is judged row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from vectables.llm.components import connected_components
from vectables.llm.store import Workspace
from vectables.llm.text import as_long, mix
from vectables.llm.vectors import Vectors, unit

TABLES, WIDTH, STEP = 40, 16, 2.0
SIDE = 512              # classes on either side of a block of comparisons


def _identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, vector) -> (id, label, key): a digest of the components, null for invalid vectors."""
    for batch in batches:
        v = Vectors(batch.column(2))
        keys = [hashlib.blake2b((v.row(i) + 0.0).tobytes(), digest_size=16).digest() if v.ok[i] else None for i in range(v.n)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary())], names=["id", "label", "key"])


def _hash(tables: int, width: int, step: float, seed: int):
    """(id, label, mult, vector) -> the same and the vector's bucket in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        scale = np.cumprod(np.full(width, 0xD6E8FEB86659FD93, dtype=np.uint64))
        for batch in batches:
            v = Vectors(batch.column(3))
            label = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")
                              for x in batch.column(1).to_pylist()], dtype=np.uint64)
            keys = np.zeros((v.n, tables), dtype=np.uint64)
            for at, x in v.by_size():
                dim = x.shape[1]
                if dim not in drawn:
                    rng = np.random.Generator(np.random.PCG64([seed, dim]))
                    drawn[dim] = rng.standard_normal((dim, tables * width)), rng.uniform(0, step, tables * width)
                a, b = drawn[dim]
                cells = np.floor((unit(x) @ a + b) / step).astype(np.int64).view(np.uint64).reshape(len(at), tables, width)
                own = mix(np.arange(tables, dtype=np.uint64) + np.uint64(dim << 20))
                keys[at] = mix((cells * scale).sum(axis=2, dtype=np.uint64) + own ^ label[at][:, None])
            ids = batch.column(0)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(v.n + 1) * tables, pa.int32()), pa.array(as_long(keys).ravel()))
            yield pa.RecordBatch.from_arrays([ids, batch.column(2), batch.column(3), listed], names=["id", "mult", "vector", "keys"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[pa.RecordBatch]:
    """Whole groups of a sorted stream: runs of rows with equal values in the first ``by`` columns."""
    rest: pa.RecordBatch | None = None
    for batch in batches:
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(i).to_numpy() for i in range(by)])
        cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        edges = [0, *cuts.tolist()]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
        rest = batch.slice(edges[-1])
    if rest is not None and rest.num_rows:
        yield rest


def _compare(least: float, tables: int):
    """Sorted rows (key, i, j, table, id, mult, sub, vector, keys) -> (kind, x, y).

    Kind 0: class x has links to y more vectors. Kind 1: x and y link, enough of them to join what links.
    """

    def pairs(group: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        v = Vectors(group.column(7))
        if len(np.unique(v.sizes)) != 1:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys = group.column(8).flatten().to_numpy().reshape(v.n, tables)
        u = unit(v.flat.reshape(v.n, -1))
        close = u @ u.T >= least
        if group.column(1)[0] != group.column(2)[0]:
            sub = group.column(6).to_numpy()
            close &= sub[:, None] != sub[None, :]
        a, b = np.nonzero(np.triu(close, 1))
        table = group.column(3)[0].as_py()
        for lo in range(0, len(a), 1 << 18):      # a pair belongs to the first table that it shares
            first = (keys[a[lo: lo + (1 << 18)]] == keys[b[lo: lo + (1 << 18)]]).argmax(axis=1)
            a[lo: lo + (1 << 18)][first != table] = -1
        return a[a >= 0], b[a >= 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, xs, ys, rows = [], [], [], 0
        for group in _groups(batches, 3):
            if group.num_rows < 2:
                continue
            a, b = pairs(group)
            if not len(a):
                continue
            ids, mult = group.column(4).to_numpy(), group.column(5).to_numpy()
            n = np.bincount(a, mult[b], len(ids)) + np.bincount(b, mult[a], len(ids))
            some = np.flatnonzero(n)
            root = np.arange(len(ids))
            tree = []
            for x, y in zip(a.tolist(), b.tolist()):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                while root[y] != y:
                    root[y] = root[root[y]]
                    y = root[y]
                if x != y:
                    root[max(x, y)] = min(x, y)
                    tree.append((x, y))
                    if len(tree) == len(ids) - 1:
                        break
            tree = np.array(tree)
            kind += [np.zeros(len(some), np.int32), np.ones(len(tree), np.int32)]
            xs += [ids[some], ids[tree[:, 0]]]
            ys += [n[some].astype(np.int64), ids[tree[:, 1]]]
            rows += len(some) + len(tree)
            if rows > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (kind, xs, ys)], names=["kind", "x", "y"])
                kind, xs, ys, rows = [], [], [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (kind, xs, ys)], names=["kind", "x", "y"])

    return run


def near_duplicates(table: DataFrame, id_col: str, vector_col: str, label_col: str, least: float = 0.98,
                    tables: int = TABLES, width: int = WIDTH, step: float = STEP, seed: int = 11) -> DataFrame:
    """One row per vector: ``(id, n_links, component, kept)``."""
    spark = table.sparkSession
    space = Workspace(spark, "pstable")
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector"))
    known = space.save(rows.mapInArrow(_identify, "id long, label string, key binary"), "known")
    able = known.where("id is not null and label is not null and key is not null")
    classes = space.save(able.groupBy("label", "key").agg(F.min("id").alias("least"), F.count("*").alias("mult")).withColumn(
        "class", F.xxhash64("label", "key")), "classes")

    # the vector of a class: of a row of its least id that has this vector; one id may stand for several classes
    digest = rows.join(classes.withColumnRenamed("least", "id"), ["id", "label"])
    digest = digest.select(F.col("class").alias("id"), "label", "mult", "vector", "key").mapInArrow(
        _same, "id long, label string, mult long, vector array<double>").dropDuplicates(["id"])
    hashed = space.save(digest.mapInArrow(
        _hash(tables, width, step, seed), "id long, mult long, vector array<double>, keys array<long>"), "hashed")

    member = hashed.select("id", F.posexplode("keys").alias("table", "key"))
    shared = member.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select(
        "key", F.ceil(F.col("m") / SIDE).alias("sides"))
    member = member.join(shared, "key").withColumn("sub", F.pmod(F.xxhash64("id"), F.col("sides")))
    member = member.withColumn("other", F.explode(F.expr("sequence(0, sides - 1)")))
    spread = member.join(hashed, "id").select(
        "key", F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"), "table",
        "id", "mult", "sub", "vector", "keys")
    found = space.save(spread.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(
        _compare(least, tables), "kind int, x long, y long"), "found")

    counts = found.where("kind = 0").groupBy(F.col("x").alias("class")).agg(F.sum("y").alias("others"))
    joined = connected_components(found.where("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b")), space)
    of = classes.join(joined.withColumnRenamed("id", "class"), "class", "left").withColumn("of", F.coalesce("component", "class"))
    first = of.groupBy("of").agg(F.min("least").alias("joined"))
    by_class = of.join(first, "of").join(counts, "class", "left").select(
        "label", "key", (F.col("mult") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "joined")
    out = known.join(by_class, ["label", "key"], "left").select(
        "id", F.coalesce(F.when(F.col("id").isNotNull(), F.col("links")), F.lit(0)).alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("joined", "id")).alias("component"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component"), F.lit(False)))


def _same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, label, mult, vector, key) whose vector has this key."""
    for batch in batches:
        v = Vectors(batch.column(3))
        keys = batch.column(4).to_pylist()
        ok = pa.array([bool(v.ok[i]) and hashlib.blake2b((v.row(i) + 0.0).tobytes(), digest_size=16).digest() == keys[i]
                       for i in range(v.n)], pa.bool_())
        yield pa.RecordBatch.from_arrays(
            [c.filter(ok) for c in (*batch.columns[:3], batch.column(3).cast(pa.list_(pa.float64())))],
            names=["id", "label", "mult", "vector"])
