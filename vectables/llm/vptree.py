"""Approximate nearest neighbours by vantage-point trees, one per shard.

Rows are dealt by a hash into shards of about ``SHARD_ROWS``; a shard's tree, built once and kept in the shared
folder, splits its points at the median distance from a vantage point. A query leaves out a child whose distance interval is farther
from it than its k-th best distance over ``factor``: factor one only drops what the triangle
inequality excludes (with bounds that cover the rounding of the distances), so the search is exact, and larger factors drop more. Distances are between vectors of length
one, so they order as cosines do. Every query meets every shard, in groups of queries of bounded size;
the k best of each shard are merged by two partial cuts.

Defined cases: invalid vectors (see ``vectors``), null ids and vectors of another length than the query's take no
part; fewer than k candidates give fewer rows; ties go to the smaller id; a repeated row is a candidate like
any other, but rows with the query's own id are not.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from vectables.llm.store import Workspace
from vectables.llm.vectors import Vectors, unit

SHARD_ROWS = 16_384
QUERY_ROWS = 4_096
LEAF = 64
ROUNDED = 1e-12         # cosines that differ by less are ranked by id


class Tree:
    """A vantage-point tree over unit vectors: points in tree order, nodes as arrays."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, seed: int = 0):
        self.ids, self.raw = ids, raw
        x = unit(raw)
        self.order = np.arange(len(x))
        self.nodes: list[tuple] = []       # (lo, hi, vantage row, near, far, near interval, far interval)
        self.x = x
        rng = np.random.Generator(np.random.PCG64([seed, len(x)]))
        todo = [(0, len(x), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            me = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][3 + side] = me
            node = [lo, hi, -1, -1, -1, (0.0, 0.0), (0.0, 0.0)]
            self.nodes.append(node)
            if hi - lo <= LEAF:
                continue
            own = self.order[lo:hi]
            node[2] = int(own[rng.integers(len(own))])
            d = distance(x[own] @ x[node[2]])
            rank = np.argsort(d, kind="stable")
            self.order[lo:hi] = own[rank]
            d, mid = d[rank], (hi - lo) // 2
            node[5], node[6] = (d[0], d[mid - 1]), (d[mid], d[-1])
            todo += [(lo, lo + mid, me, 0), (lo + mid, hi, me, 1)]

    def pack(self) -> bytes:
        """The tree as bytes; the points are kept in tree order."""
        out = io.BytesIO()
        flat = np.array([(*n[:5], *n[5], *n[6]) for n in self.nodes], dtype=np.float64)
        np.savez(out, ids=self.ids, raw=self.raw, order=self.order, nodes=flat)
        return out.getvalue()

    @classmethod
    def unpack(cls, blob: bytes) -> Tree:
        tree, parts = cls.__new__(cls), np.load(io.BytesIO(blob))
        tree.ids, tree.raw, tree.order = parts["ids"], parts["raw"], parts["order"]
        tree.x = unit(tree.raw)
        tree.nodes = [(*map(int, n[:5]), (n[5], n[6]), (n[7], n[8])) for n in parts["nodes"].tolist()]
        return tree

    def search(self, q: np.ndarray, factor: float, take) -> int:
        """Calls ``take(queries, points)`` for every leaf a group of queries visits; it returns the
        queries' current k-th distances. Returns the number of distances computed."""
        reach = np.full(len(q), np.inf)
        error = squared_error(q.shape[1])
        low, high = (lambda d: np.sqrt(np.maximum(0.0, d * d - error))), (lambda d: np.sqrt(d * d + error))
        work = 0
        todo = [(0, np.arange(len(q)), None)]
        while todo:
            at, active, gap = todo.pop()
            if gap is not None:
                active = active[gap <= high(reach[active]) / factor]
            if not len(active):
                continue
            lo, hi, vantage, near, far, near_d, far_d = self.nodes[at]
            if vantage < 0:
                work += len(active) * (hi - lo)
                reach[active] = take(active, self.order[lo:hi])
                continue
            work += len(active)
            d = distance(q[active] @ self.x[vantage])
            gap_near, gap_far = (np.maximum(0.0, np.maximum(low(d) - high(np.float64(b)), low(np.float64(a)) - high(d))) for a, b in (near_d, far_d))
            first = gap_near <= gap_far
            todo += [(far, active[first], gap_far[first]), (near, active[~first], gap_near[~first]),
                     (near, active[first], gap_near[first]), (far, active[~first], gap_far[~first])]
        return work


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def squared_error(dim: int) -> float:
    """How far the square of a distance may be off: its root is off by far more near zero than elsewhere, so
    bounds are drawn on squares. Covers the rounding of unit vectors and their product, and ``ROUNDED``."""
    return 2 * ROUNDED + 4 * (dim + 8) * float(np.finfo(np.float64).eps)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows, each by the same order of operations."""
    a = a / np.abs(a).max(axis=1, keepdims=True)
    b = b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def nearest(tree: Tree, query_ids: np.ndarray, q: np.ndarray, k: int, factor: float) -> tuple[list[tuple], int]:
    """The k nearest points of the tree for each query: rows (query, id, score); and the work."""
    ids, x, xu, qu = tree.ids, tree.raw, tree.x, unit(q)
    best = np.full((len(q), k + 4), -np.inf)          # a few more than k, so rounding cannot drop a tie
    found = np.full((len(q), k + 4), -1)

    def take(active: np.ndarray, points: np.ndarray) -> np.ndarray:
        score = qu[active] @ xu[points].T
        score[query_ids[active][:, None] == ids[points][None, :]] = -np.inf
        both = np.concatenate([best[active], score], axis=1)
        names = np.concatenate([found[active], np.broadcast_to(points, score.shape)], axis=1)
        top = np.lexsort((np.where(names >= 0, ids[names], 0), -np.round(both, 12)), axis=1)[:, : k + 4]
        best[active], found[active] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)
        kth = best[active, k - 1]
        return np.where(np.isfinite(kth), distance(np.where(np.isfinite(kth), kth, 1.0)), np.inf)

    work = tree.search(qu, factor, take)
    row, place = np.nonzero(np.isfinite(best))
    point = found[row, place]
    score = _exact(q[row], x[point]) if len(row) else np.zeros(0)
    frame = pd.DataFrame({"q": row, "query": query_ids[row], "id": ids[point], "score": score})
    frame = frame.sort_values(["q", "score", "id"], ascending=[True, False, True]).groupby("q").head(k)
    return list(frame[["query", "id", "score"]].itertuples(index=False, name=None)), work


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = pa.array(Vectors(batch.column(1)).ok)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).filter(ok), batch.column(1).filter(ok).cast(pa.list_(pa.float64()))], names=["id", "vector"])


def _build(key, frame: pd.DataFrame) -> pd.DataFrame:
    """One tree for each length of vector in the shard."""
    sizes = frame["vector"].map(len)
    out = []
    for dim in sorted(sizes.unique()):
        own = frame[sizes == dim].sort_values("id", kind="stable")
        out.append((key[0], dim, Tree(own["id"].to_numpy(), np.stack(own["vector"])).pack()))
    return pd.DataFrame(out, columns=["shard", "dim", "tree"])


def _search(k: int, factor: float):
    def run(key, trees: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for dim, blob in zip(trees["dim"], trees["tree"]):
            q = queries[queries["vector"].map(len) == dim]
            if len(q):
                out += nearest(Tree.unpack(blob), q["id"].to_numpy(), np.stack(q["vector"]), k, factor)[0]
        return pd.DataFrame(out, columns=["query_id", "id", "score"]).assign(shard=key[0])

    return run


def search(table: DataFrame, id_col: str, vector_col: str, queries, k: int = 5, factor: float = 1.0) -> DataFrame:
    """``(query_id, rank, id, score)``: the k nearest of every row that meets ``queries``, a condition on ``id``."""
    spark = table.sparkSession
    space = Workspace(spark, "vptree")
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector")).where("id is not null")
    rows = space.save(rows.mapInArrow(_valid, "id long, vector array<double>"), "valid")
    asked = rows.where(queries).groupBy("id").agg(F.min("vector").alias("vector"))
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    groups = max(1, -(-asked.count() // QUERY_ROWS))
    trees = space.save(rows.groupBy(F.pmod(F.xxhash64("id", F.hash("vector")), F.lit(shards)).alias("shard")).applyInPandas(
        _build, "shard long, dim int, tree binary"), "trees")
    trees = trees.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(groups))).withColumn(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
    hits = trees.groupBy("shard", "part").cogroup(asked.groupBy("shard", "part")).applyInPandas(
        _search(k, factor), "query_id long, id long, score double, shard long")
    best = [F.col("score").desc(), F.col("id")]
    some = hits.withColumn("n", F.row_number().over(
        Window.partitionBy("query_id", F.col("shard") % 64).orderBy(*best))).where(f"n <= {k}")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).where(
        f"rank <= {k}").select("query_id", "rank", "id", "score")
