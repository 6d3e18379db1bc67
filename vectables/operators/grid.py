"""Searches of many queries: every group of queries meets every point in one task.

A task that scans a share of the points for all queries sends ``k`` candidates of each query on, so what is moved grows with
queries x tasks, and its running top-k with the queries. Here the queries are dealt to groups whose running top-k fit ``GROUP_BYTES``
(more groups where more tasks can work), the points are sent to each group, and a task reads its queries first and then
streams the points, in order of their cell where there are cells. No query and no hit passes the driver, a hit leaves its task only
as one of the final ``k``, and what a task holds follows its group alone; the rows of its partition are sorted by Spark, which spills.

* Scores are made in single precision a tile of queries by a batch of points at a time; pairs that can reach the running k-th score,
  with the margin of that precision, are scored again in double and rounded, so the hits are those of the plain search.
* ``probe_kernel`` scores the points of a cell for the queries that probe it; ``bound_kernel`` for those whose k-th score the best
  point the cell can hold may still beat.
* Rows with the same ``query_id`` are in one group and share their ``k`` hits, as they do in the plain search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectables.functions.vectors import SCORE_DECIMALS
from vectables.operators.search import QUERY_TILE, arrow_vectors, reduce_topk, unit_rows

MANY = 4096                 # more queries than these are dealt to groups
GROUP_BYTES = 96 << 20      # of a group's vectors and running top-k
TASK_PAIRS = 1 << 26        # (query, point) pairs that are worth a task of their own
POINT_ROWS = 8192           # points scored at once
PENDING = 1 << 20           # candidates that wait to be merged
EXACT_PAIRS = 1 << 16       # pairs scored in double at once
QUERY_AT, NO_CELL = -2, -1  # place of the queries in a task's rows, and of points without a cell
RANKED = "query_id long, rank long, id long, score double, a string"


def measured(queries: DataFrame) -> tuple[int, int]:
    """(rows, dimension) of a query set: the dimension most of them have, the smallest of several."""
    sizes = queries.groupBy(F.coalesce(F.size("qvec"), F.lit(-1)).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.agg(F.sum("n").alias("n"), F.max(F.when(F.col("d") > 0, F.struct("n", -F.col("d")))).alias("top")).first()
    return top["n"] or 0, -top["top"][1] if top["top"] else 0


def groups_for(spark, n_queries: int, n_points: int, dim: int, k: int) -> int:
    """Groups whose queries fit a task; more of them while there are idle cores and work for each."""
    least = -(-n_queries * (20 * k + 12 * dim) // GROUP_BYTES)
    try:
        cores = spark.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 - no SparkContext in this session
        cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, least, min(2 * cores, -(-n_queries * n_points // TASK_PAIRS)))


def dealt(points: DataFrame, queries: DataFrame, groups: int, value: str = "vec") -> DataFrame:
    """Per group a partition with its queries, then all points: ``(at, id, vec, a)``, ``value`` of the points where it is not ``vec``,
    and what else the queries carry. ``points(id, value, a[, cell])``."""
    cell = F.coalesce(F.col("cell"), F.lit(NO_CELL)) if "cell" in points.columns else F.lit(NO_CELL)
    asked = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("grp"), F.lit(QUERY_AT).alias("at"),
                           F.col("query_id").alias("id"), F.col("qvec").alias("vec"), F.col("must_a").alias("a"),
                           *[c for c in queries.columns if c not in ("query_id", "qvec", "must_a")])
    sent = points.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), cell.cast("int").alias("at"), "id", value, "a")
    both = asked.unionByName(sent, allowMissingColumns=True)
    return both.repartitionById(groups, F.col("grp")).drop("grp").sortWithinPartitions("at")


class Running:
    """The ``k`` best ``(score desc, id asc)`` of each of ``n`` queries, merged from candidates as they come. ``floor``: scores that
    the k-th best is known to reach."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.count = k, np.zeros(n, np.int64)
        self.score, self.id, self.label = np.zeros((n, k)), np.zeros((n, k), np.int64), np.zeros((n, k), np.int32)
        self.kth = np.full(n, -np.inf) if floor is None else floor.copy()
        self.kth_id = np.full(n, np.iinfo(np.int64).max)
        self.parts: list[tuple] = []
        self.waiting = 0

    def add(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray, label: np.ndarray) -> None:
        keep = (score > self.kth[q]) | ((score == self.kth[q]) & (ids < self.kth_id[q]))
        if keep.any():
            self.parts.append((q[keep], ids[keep], score[keep], label[keep]))
            self.waiting += int(keep.sum())
            if self.waiting > max(PENDING, self.count.size * self.k // 2):
                self.merge()

    def merge(self) -> None:
        if not self.parts:
            return
        q, ids, score, label = (np.concatenate(x) for x in zip(*self.parts))
        self.parts, self.waiting = [], 0
        order = np.argsort(q, kind="stable")
        q, ids, score, label = q[order], ids[order], score[order], label[order]
        touched = np.unique(q)
        for lo in range(0, len(touched), QUERY_TILE):
            rows = touched[lo: lo + QUERY_TILE]
            new = slice(np.searchsorted(q, rows[0], "left"), np.searchsorted(q, rows[-1], "right"))
            r, c = np.nonzero(np.arange(self.k) < self.count[rows][:, None])
            hq = rows[r]
            qq, ii, ss, (aa,) = reduce_topk(np.concatenate([hq, q[new]]), np.concatenate([self.id[hq, c], ids[new]]),
                                            np.concatenate([self.score[hq, c], score[new]]), [np.concatenate([self.label[hq, c], label[new]])], self.k)
            starts = np.r_[0, np.flatnonzero(np.diff(qq)) + 1]
            n = np.diff(np.r_[starts, len(qq)])
            place = np.arange(len(qq)) - np.repeat(starts, n)
            self.id[qq, place], self.score[qq, place], self.label[qq, place] = ii, ss, aa
            self.count[qq[starts]] = n
            last = (starts + n - 1)[n == self.k]
            last = last[ss[last] >= self.kth[qq[last]]]
            self.kth[qq[last]], self.kth_id[qq[last]] = ss[last], ii[last]

    def hits(self, owner: np.ndarray) -> Iterator[tuple]:
        """(owner, rank, id, score, label) some queries at a time; neighbouring queries of one ``owner`` share their ``k``."""
        self.merge()
        lo = 0
        while lo < len(owner):
            hi = int(np.searchsorted(owner, owner[min(lo + QUERY_TILE, len(owner)) - 1], "right"))
            r, c = np.nonzero(np.arange(self.k) < self.count[lo:hi][:, None])
            r += lo
            q, i, s, (a,) = reduce_topk(owner[r], self.id[r, c], self.score[r, c], [self.label[r, c]], self.k)
            if len(q):
                starts = np.r_[0, np.flatnonzero(np.diff(q)) + 1]
                yield q, np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)])) + 1, i, s, a
            lo = hi


class Labels:
    """Keywords as numbers, in the order of their first sight."""

    def __init__(self):
        self.number: dict = {}

    def of(self, col: pa.Array) -> np.ndarray:
        coded = col.dictionary_encode(null_encoding="encode")
        at = np.array([self.number.setdefault(x, len(self.number)) for x in coded.dictionary.to_pylist()], dtype=np.int32)
        return at[coded.indices.to_numpy(zero_copy_only=False)] if len(col) else np.zeros(0, np.int32)

    def names(self, at: np.ndarray) -> pa.Array:
        return pa.array(list(self.number), pa.string()).take(pa.array(at))


class Group:
    """The queries of a task by ``query_id``, with their unit vectors and those of each keyword (None: any)."""

    def __init__(self, batches: list[pa.RecordBatch], dim: int):
        table = pa.Table.from_batches(batches).combine_chunks() if batches else None
        self.n = table.num_rows if table else 0
        if not self.n:
            return
        order = np.argsort(table["id"].to_numpy(), kind="stable")
        self.table = table.take(pa.array(order)).combine_chunks()
        self.ids = self.table["id"].to_numpy().astype(np.int64)
        found, valid = arrow_vectors(self.table["vec"].combine_chunks(), dim)
        self.mat = np.zeros((self.n, dim))
        self.mat[valid] = found
        self.unit, self.good = unit_rows(self.mat)
        self.musts = np.array(self.table["a"].to_pylist(), dtype=object)
        self.by_must: dict = {}
        for i in np.flatnonzero(self.good).tolist():
            self.by_must.setdefault(self.musts[i], []).append(i)
        self.by_must = {m: np.array(x) for m, x in self.by_must.items()}

    def column(self, name: str) -> np.ndarray:
        return self.table[name].to_numpy()


def split(batches) -> tuple[list[pa.RecordBatch], Iterator[pa.RecordBatch]]:
    """The queries of a task, and its points in batches of about ``POINT_ROWS``."""
    queries, rest, todo = [], [], iter(batches)
    for batch in todo:
        n = int(np.count_nonzero(batch.column("at").to_numpy() == QUERY_AT))
        if n:
            queries.append(batch.slice(0, n))
        if n < batch.num_rows:
            rest.append(batch.slice(n))
            break

    def points():
        held, n = rest, sum(b.num_rows for b in rest)
        for batch in todo:
            if n >= POINT_ROWS:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches(POINT_ROWS)
                held, n = [], 0
            held, n = [*held, batch], n + batch.num_rows
        if n:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(POINT_ROWS)

    return queries, points()


def vector_parts(dim: int):
    """What a batch of points gives to :func:`scored`: (valid rows, single and double precision vectors)."""

    def parts(batch: pa.RecordBatch):
        mat, valid = arrow_vectors(batch.column("vec"), dim)
        unit, good = unit_rows(mat)
        return np.flatnonzero(valid)[good], unit[good].astype(np.float32), unit[good]

    return parts


def scored(group: Group, best: Running, points, labels: Labels, parts, mine: np.ndarray, exact: np.ndarray | None, margin: float,
           wanted: Callable[[int], np.ndarray | None] | None = None, read: np.ndarray | None = None) -> None:
    """Streams the points past the queries. ``mine``: the queries' side of the scores in single precision; ``exact``: in double (None: the
    scores are whole numbers that single precision holds). ``wanted(cell)``: which queries read a cell (None: all)."""
    k = best.k

    def tile(qs, ids, rough, fine, label):
        scores = mine[qs] @ rough.T
        floor = best.kth[qs] - margin
        open_ = np.flatnonzero(np.isneginf(floor))
        if len(open_) and scores.shape[1] > k:
            floor[open_] = np.partition(scores[open_], scores.shape[1] - k, axis=1)[:, -k] - 2 * margin
        near = np.flatnonzero((scores >= floor.astype(scores.dtype)[:, None]).ravel())
        for lo in range(0, len(near), EXACT_PAIRS):
            r, c = np.divmod(near[lo: lo + EXACT_PAIRS], scores.shape[1])
            score = scores[r, c].astype(np.float64) if exact is None else np.round(np.einsum("ij,ij->i", exact[qs[r]], fine[c]), SCORE_DECIMALS)
            best.add(qs[r], ids[c], score, label[c])

    def pairs(queries, ids, rough, fine, label):
        for lo in range(0, len(queries), QUERY_TILE):
            tile(queries[lo: lo + QUERY_TILE], ids, rough, fine, label)

    for batch in points:
        rows, rough, fine = parts(batch)
        if not len(rows):
            continue
        ids = batch.column("id").to_numpy(zero_copy_only=False)[rows].astype(np.int64)
        label = labels.of(batch.column("a"))[rows]
        at = batch.column("at").to_numpy()[rows]        # in order: rows come sorted by it
        names = list(labels.number)
        for a, b in zip(starts := np.r_[0, np.flatnonzero(np.diff(at)) + 1], np.r_[starts[1:], len(at)]):
            mask = wanted(int(at[a])) if wanted is not None and at[a] != NO_CELL else None
            if mask is not None and not mask.any():
                continue
            if read is not None:
                read += (b - a) * (group.good if mask is None else mask & group.good)
            order = a + np.argsort(label[a:b], kind="stable")
            cuts = np.r_[0, np.flatnonzero(np.diff(label[order])) + 1, len(order)]
            for must, some in [(None, np.arange(a, b)), *((names[label[order[x]]], order[x:y]) for x, y in zip(cuts, cuts[1:]) if names[label[order[x]]] is not None)]:
                qs = group.by_must.get(must)
                if qs is not None and mask is not None:
                    qs = qs[mask[qs]]
                if qs is not None and len(qs):
                    pairs(qs, ids[some], rough[some], None if fine is None else fine[some], label[some])


def single_margin(dim: int) -> float:
    """How far a product of unit vectors in single precision, and half a unit of the sixth decimal, can be from the rounded score."""
    return (dim + 8) * 6e-8 + 1e-6


def ranked_rows(group: Group, best: Running, labels: Labels, more: dict | None = None) -> Iterator[pa.RecordBatch]:
    for q, rank, i, s, a in best.hits(np.searchsorted(group.ids, group.ids)):
        yield pa.RecordBatch.from_arrays([pa.array(group.ids[q]), pa.array(rank), pa.array(i), pa.array(s), labels.names(a), *(pa.array(v[q]) for v in (more or {}).values())],
                                         names=["query_id", "rank", "id", "score", "a", *(more or {})])


def scan_kernel(dim: int, k: int, probing: Callable[[Group], Callable[[int], np.ndarray]] | None = None):
    """``mapInArrow`` over :func:`dealt` rows: the ``k`` best points of each query; with ``probing``, of the cells it names."""

    def run(batches):
        queries, points = split(batches)
        group, labels = Group(queries, dim), Labels()
        if group.n:
            best = Running(group.n, k)
            scored(group, best, points, labels, vector_parts(dim), group.unit.astype(np.float32), group.unit, single_margin(dim),
                   probing(group) if probing else None)
            yield from ranked_rows(group, best, labels)

    return run


def members(probes: Iterator[np.ndarray], n: int) -> Callable[[int], np.ndarray]:
    """``wanted`` of :func:`scored` from the cells of each of ``n`` queries, in order."""
    cells = [np.asarray(c, dtype=np.int32) for c in probes]
    query = np.repeat(np.arange(n), [len(c) for c in cells])
    cell = np.concatenate(cells) if cells else np.zeros(0, np.int32)
    order = np.argsort(cell, kind="stable")
    cell, query = cell[order], query[order]

    def wanted(c: int) -> np.ndarray:
        out = np.zeros(n, dtype=bool)
        out[query[np.searchsorted(cell, c, "left"): np.searchsorted(cell, c, "right")]] = True
        return out

    return wanted


def search_many(points: DataFrame, queries: DataFrame, k: int, n_queries: int, dim: int, vector: str = "vec") -> DataFrame:
    """The exact hits of ``search_batch`` for many queries."""
    pts = points.select("id", F.col(vector).alias("vec"), "a")
    groups = groups_for(points.sparkSession, n_queries, points.count(), dim, k)
    return dealt(pts, queries.select("query_id", "qvec", "must_a"), groups).mapInArrow(scan_kernel(dim, k), RANKED)
