"""Inverted-file index (OP-34) and indexed search (OP-35).

* Pivots: the ``nlist`` points with the smallest seeded hash of their id — a deterministic
  sample chosen by a top-k (TakeOrderedAndProject), so it costs one pass and ``nlist`` rows.
  ``nlist x dim`` is a parameter-bounded size, which makes the pivot matrix safe to broadcast.
* Assignment: ``mapInArrow``; each Arrow batch is scored against the pivot matrix with one
  matmul; nearest pivot wins, ties go to the lower cell. The index is the points table plus a
  ``cell`` column, written ``partitionBy('cell')`` so a probe reads only its cells' files.
* Search: each query's nearest cells are found the same way (queries x pivots, small): ``nprobe`` of
  them, and more in order of nearness until they hold ``k`` points that match the query's keyword (counts
  per cell and keyword), or all cells; so a query gets fewer than ``k`` hits only where fewer match.
  The point scan is pruned to the probed cells, and the batch top-k kernel of
  :mod:`vectables.operators.search` scores a point only against the queries probing its cell.
  Exact rescoring, then the same global ``row_number() <= k`` as exact search.
* Exact search through the index: a cell's radius is the widest angle between its pivot and a point of it, so no point of
  the cell is nearer to a query than the angle to the pivot less the radius. A query reads cells in order of that bound,
  in rounds of ``nprobe``, twice as many, ..., and stops when no cell left can beat its k-th hit.
* While the index lags behind the table (new points past its high-water mark, points rewritten since), a search reads the index for
  what it covers and scores the tail exactly; ``extend_index`` assigns the tail alone and appends it.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vectables import TOP_K
from vectables.session import ship, storage_root
from vectables.functions.random import uniform
from vectables.functions.vectors import SCORE_DECIMALS, finite_vector
from vectables.operators import grid
from vectables.operators.search import (EMPTY_HITS, HIT_SCHEMA, arrow_vectors, cut_hits, make_topk_kernel, over_chunks, query_chunks,
                                        query_dim, rank_hits, search_batch, unit_rows)

NLIST = 8
NPROBE = 3
MOST_CELLS = 4096       # cells whose pivots and radii travel to every task
FILE_BYTES = 128 << 20  # of vectors in a file of a cell
SLACK = 2e-6            # scores are rounded to six decimals, and angles near 0 lose half their digits


def cells_for(points: int) -> int:
    """Cells of an index: about the square root of the points, so pivots and a cell cost a query the same."""
    return min(MOST_CELLS, max(NLIST, math.isqrt(max(points, 1))))


def pick_pivots(points: DataFrame, nlist: int = NLIST, vector: str = "vec", stream: str = "ivf/pivot") -> np.ndarray:
    """``nlist`` pivot vectors (row i = cell i), ordered by a seeded hash of the id."""
    rows = (points.where(finite_vector(F.col(vector)))
            .select(uniform(stream, F.col("id")).alias("h"), "id", vector)
            .orderBy("h", "id").limit(nlist).collect())  # nlist rows, bounded by the parameter
    if not rows:
        return np.zeros((0, 0))
    sizes = [len(r[vector]) for r in rows]
    dim = max(sorted(set(sizes)), key=sizes.count)
    return np.stack([np.asarray(r[vector], dtype=np.float64) for r in rows if len(r[vector]) == dim])


def kmeans_pivots(points: DataFrame, nlist: int = NLIST, vector: str = "vec", seed: int = 42,
                  max_iter: int = 20) -> np.ndarray:
    """Pivots from MLlib k-means on the unit vectors (cosine distance), the trained alternative to
    the hash sample. Training is distributed; only the ``nlist`` centers reach the driver."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    feats = points.where(F.col(vector).isNotNull()).select(array_to_vector(F.col(vector)).alias("features"))
    model = KMeans(k=nlist, seed=seed, maxIter=max_iter, distanceMeasure="cosine").fit(feats)
    return np.stack([np.asarray(c, dtype=np.float64) for c in model.clusterCenters()])


def _unit(mat: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(mat, axis=1)
    return mat / np.where(n > 0, n, 1.0)[:, None]


def nearest_cells(mat: np.ndarray, pivots_unit: np.ndarray, n: int) -> np.ndarray:
    """Indices of the ``n`` nearest pivots per row, by (rounded cosine desc, cell asc)."""
    scores = np.round(_unit(mat) @ pivots_unit.T, SCORE_DECIMALS)
    cells = np.arange(pivots_unit.shape[0])
    order = np.lexsort((np.broadcast_to(cells, scores.shape), -scores), axis=1)
    return order[:, :n]


def assign_cells(points: DataFrame, pivots: np.ndarray, vector: str = "vec") -> DataFrame:
    """``points`` plus ``cell``: the nearest pivot of each point (null where the vector is not valid)."""
    spark = points.sparkSession
    bc = ship(spark, _unit(pivots) if len(pivots) else pivots)
    out_schema = T.StructType(list(points.schema.fields) + [T.StructField("cell", T.IntegerType())])

    def assign(batches):
        piv = bc.value
        for batch in batches:
            mat, valid = arrow_vectors(batch.column(vector), piv.shape[1])
            valid = valid & bool(len(piv))
            cell = np.zeros(batch.num_rows, dtype=np.int32)
            if valid.any():
                cell[valid] = nearest_cells(mat, piv, 1)[:, 0]
            yield batch.append_column("cell", pa.array(cell, type=pa.int32(), mask=~valid))

    return points.mapInArrow(assign, out_schema)


def _write_cells(assigned: DataFrame, path: str, files_per_cell: int, mode: str) -> None:
    salt = F.pmod(F.xxhash64("id"), F.lit(files_per_cell))
    laid = assigned.withColumn("__salt", salt).repartition("cell", "__salt").drop("__salt")
    laid.write.mode(mode).partitionBy("cell").parquet(path)


def build_index(points: DataFrame, nlist: int | None = NLIST, path: str | None = None, vector: str = "vec",
                pivots: str = "sample", files_per_cell: int | None = 4):
    """Pivots (``sample``: seeded hash sample; ``kmeans``: MLlib k-means centers) and the
    cell-assigned table; with ``path`` the table is written partitioned by cell and read back, so
    later probes prune partitions.

    Without ``nlist`` the table is counted and ``cells_for`` gives the number of cells; without ``files_per_cell`` an average cell
    gets a file per ``FILE_BYTES``. Before the write the rows are shuffled on ``(cell, salt)`` with ``files_per_cell`` salt values:
    each cell lands in a bounded number of files instead of one file per scan task, and a cell
    holding a third of the points is still written by several tasks."""
    n = points.count() if nlist is None or files_per_cell is None else 0
    nlist = cells_for(n) if nlist is None else nlist
    pivots = kmeans_pivots(points, nlist, vector) if pivots == "kmeans" else pick_pivots(points, nlist, vector)
    indexed = assign_cells(points, pivots, vector)
    if path:
        if files_per_cell is None:
            files_per_cell = max(1, -(-4 * n * max(pivots.shape[1], 1) // (FILE_BYTES * max(len(pivots), 1))))
        _write_cells(indexed, path, files_per_cell, "errorifexists")
        indexed = points.sparkSession.read.schema(indexed.schema).parquet(path)
    return pivots, indexed


def high_water(index) -> int | None:
    """The largest id in the index: points past it are its tail."""
    return index[1].agg(F.max("id").alias("m")).first()["m"]


def tail_of(index, points: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """What the index does not answer for: points past its high-water mark, and those of the ids in ``changed(id)``."""
    mark = high_water(index)
    if mark is None:
        return points
    new = F.col("id") > mark
    if changed is None:
        return points.where(new)
    return points.where(new).union(points.where(~new).join(changed.select("id").distinct(), "id", "left_semi").select(*points.columns))


def extend_index(index, points: DataFrame, path: str, vector: str = "vec", files_per_cell: int = 1):
    """Assigns the points past the high-water mark to the cells there are and appends them to the index at ``path``;
    the points indexed before are not read again. An index without pivots is built anew."""
    pivots, indexed = index
    if not len(pivots):
        return build_index(points, None, path, vector, files_per_cell=None)
    _write_cells(assign_cells(tail_of(index, points), pivots, vector), path, files_per_cell, "append")
    return pivots, points.sparkSession.read.schema(indexed.schema).parquet(path)


def cell_spread(index, vector: str = "vec") -> dict[int, tuple[float, int]]:
    """Per cell: the least cosine between a point that can be a hit and the pivot, and the number of such points."""
    pivots, indexed = index
    bc = ship(indexed.sparkSession, _unit(pivots))

    def spread(batches):
        piv = bc.value
        for batch in batches:
            mat, valid = arrow_vectors(batch.column(0), piv.shape[1])
            cells = batch.column(1).to_numpy(zero_copy_only=False)[valid]
            unit, good = unit_rows(mat)
            if not good.any():
                continue
            unit, cells = unit[good], cells[good].astype(np.int64)
            near = np.full(len(piv), np.inf)
            np.minimum.at(near, cells, np.einsum("ij,ij->i", unit, piv[cells]))
            n = np.bincount(cells, minlength=len(piv))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(near[some]), pa.array(n[some])], names=["cell", "least", "n"])

    rows = indexed.where(F.col("cell").isNotNull()).select(vector, "cell").mapInArrow(spread, "cell int, least double, n long").groupBy("cell").agg(
        F.min("least").alias("least"), F.sum("n").alias("n")).collect()     # a row per cell, bounded by the number of pivots
    return {r["cell"]: (r["least"], r["n"]) for r in rows}


def cell_bounds(mat: np.ndarray, pivots_unit: np.ndarray, spread: dict[int, tuple[float, int]]) -> np.ndarray:
    """The best cosine that a point of each cell can have with each query; below any for cells without points."""
    angle = np.arccos(np.clip(_unit(mat) @ pivots_unit.T, -1, 1))
    radius = np.array([math.acos(max(-1.0, min(1.0, spread[c][0]))) if c in spread else 0.0 for c in range(len(pivots_unit))])
    bound = np.cos(np.clip(angle - radius, 0, math.pi))
    bound[:, [c for c in range(len(pivots_unit)) if c not in spread]] = -2.0
    return bound


def exact_search(index, queries: DataFrame, k: int = TOP_K, nprobe: int = NPROBE, vector: str = "vec", report: list | None = None) -> DataFrame:
    """The exact top-k per query through the index. Each round is a job that reads the cells some query still needs, and the k-th score
    of each query comes back (one row per query of a chunk). ``report`` gets the share of (query, point) pairs that were read."""
    pivots, indexed = index
    spark = indexed.sparkSession
    if not len(pivots):
        return spark.createDataFrame([], EMPTY_HITS)
    n, dim = grid.measured(queries)
    if n > grid.MANY:
        return _exact_many(index, None, queries, n, dim, k, nprobe, vector, report)
    piv, spread = _unit(pivots), cell_spread(index, vector)
    size = np.array([spread.get(c, (0, 0))[1] for c in range(len(piv))])
    root = f"{storage_root(spark)}/ivf-exact-{uuid.uuid4().hex[:12]}"
    chunk_no = iter(range(1 << 62))

    def build(chunk):
        qids, mat, musts = chunk
        path = f"{root}/{next(chunk_no)}"
        if mat.shape[1] != piv.shape[1] or not size.any():
            return spark.createDataFrame([], EMPTY_HITS)
        _, good = unit_rows(mat)
        bound = cell_bounds(mat, piv, spread)
        order = np.argsort(-bound, axis=1, kind="stable")
        ranked = np.take_along_axis(bound, order, axis=1)
        row = {int(q): i for i, q in enumerate(qids)}
        kth = np.full(len(qids), -2.0 + SLACK)           # the cells without points stay below it
        at, step, seen = 0, nprobe, 0
        hits = None
        while at < len(piv):
            wanted = (ranked[:, at: at + step] >= kth[:, None] - SLACK) & (ranked[:, at: at + step] > -2.0) & good[:, None]
            cells = order[:, at: at + step]
            mask = {int(c): np.flatnonzero((wanted & (cells == c)).any(axis=1)) for c in np.unique(cells[wanted])}
            if not mask:
                break
            seen += sum(int(size[c]) * len(q) for c, q in mask.items())
            bc = ship(spark, (qids, mat, musts, mask))

            def run(batches, bc=bc):
                a, b, c, m = bc.value
                yield from make_topk_kernel(a, b, c, k, vector, cell_mask=m)(batches)

            found = indexed.where(F.col("cell").isin(list(mask))).select("id", vector, "a", "cell").mapInArrow(run, HIT_SCHEMA)
            cut_hits(found, k, name="__r").drop("__r").write.mode("append").parquet(path)
            hits = spark.read.schema(HIT_SCHEMA).parquet(path)
            for r in cut_hits(hits, k).where(F.col("rank") == k).select("query_id", "score").collect():
                kth[row[r["query_id"]]] = r["score"]
            at, step = at + step, 2 * step
        if report is not None:
            report.append(seen / max(1, int(size.sum()) * int(good.sum())))
        return rank_hits(hits, k) if hits is not None else spark.createDataFrame([], EMPTY_HITS)

    return over_chunks(spark, query_chunks(queries, pivots.shape[1], k), build)


def _reach(unit: np.ndarray, piv: np.ndarray, spread: dict[int, tuple[float, int]], cell: int) -> np.ndarray:
    """The best cosine that a point of one cell can have with each query."""
    if cell not in spread:
        return np.full(len(unit), -2.0)
    angle = np.arccos(np.clip(unit @ piv[cell], -1, 1))
    return np.cos(np.clip(angle - math.acos(max(-1.0, min(1.0, spread[cell][0]))), 0, math.pi))


def _nearest_by_bound(unit: np.ndarray, piv: np.ndarray, spread: dict, n: int):
    """Per query its ``n`` cells of the highest bound, without those that hold no points; some queries at a time."""
    for lo in range(0, len(unit), grid.QUERY_TILE):
        bound = cell_bounds(unit[lo: lo + grid.QUERY_TILE], piv, spread)
        for row, cells in zip(bound, np.argsort(-bound, axis=1, kind="stable")[:, :n]):
            yield cells[row[cells] > -2.0]


def _first_round(bc, dim: int, k: int, nprobe: int):
    """Queries and the points of cells -> (query_id, kth, read): the score of each query's k-th hit in its ``nprobe`` nearest cells,
    null where they hold fewer, and the points read."""

    def run(batches):
        queries, points = grid.split(batches)
        group, (piv, spread) = grid.Group(queries, dim), bc.value
        if group.n:
            best, read = grid.Running(group.n, k), np.zeros(group.n, np.int64)
            grid.scored(group, best, points, grid.Labels(), grid.vector_parts(dim), group.unit.astype(np.float32), group.unit, grid.single_margin(dim),
                        grid.members(_nearest_by_bound(group.unit, piv, spread, nprobe), group.n), read)
            best.merge()
            yield pa.RecordBatch.from_arrays([pa.array(group.ids), pa.array(best.kth, mask=best.count < k), pa.array(read)], names=["query_id", "kth", "read"])

    return run


def _second_round(bc, dim: int, k: int):
    """Queries with the score their hits reach, and all points -> ranked hits with ``read``: a cell is read for the queries it can serve."""

    def run(batches):
        queries, points = grid.split(batches)
        group, labels, (piv, spread) = grid.Group(queries, dim), grid.Labels(), bc.value
        if group.n:
            floor = group.column("kth").astype(np.float64)
            best, read = grid.Running(group.n, k, np.where(np.isnan(floor), -np.inf, floor)), np.zeros(group.n, np.int64)
            grid.scored(group, best, points, labels, grid.vector_parts(dim), group.unit.astype(np.float32), group.unit, grid.single_margin(dim),
                        lambda cell: _reach(group.unit, piv, spread, cell) >= best.kth - SLACK, read)
            yield from grid.ranked_rows(group, best, labels, {"read": read})

    return run


def _exact_many(index, tail: DataFrame | None, queries: DataFrame, n: int, dim: int, k: int, nprobe: int, vector: str,
                report: list | None = None) -> DataFrame:
    """``exact_search`` (and, with ``tail``, ``hybrid_search``) of many queries, in two rounds: the nearest cells give each query a score that
    its hits reach; the others, and the tail, are read by the queries they can still serve, whose k-th score rises on the way."""
    pivots, indexed = index
    spark = indexed.sparkSession
    columns = ["id", F.col(vector).alias("vec"), "a"]
    if dim != pivots.shape[1]:      # no point of the index has the length of the queries
        return search_batch(tail, queries, k, vector) if tail is not None else spark.createDataFrame([], EMPTY_HITS)
    spread = cell_spread(index, vector)
    bc = ship(spark, (_unit(pivots), spread))
    celled = indexed.where(F.col("cell").isNotNull()).select(*columns, "cell")
    every = celled if tail is None else celled.unionByName(tail.select(*columns), allowMissingColumns=True)
    asked = queries.select("query_id", "qvec", "must_a")
    groups = grid.groups_for(spark, n, every.count(), dim, k)
    first = grid.dealt(celled, asked, groups).mapInArrow(_first_round(bc, dim, k, nprobe), "query_id long, kth double, read long")
    reached = first.groupBy("query_id").agg(F.max("kth").alias("kth"), F.sum("read").alias("read"))
    if report is not None:      # the caller waits for the share of pairs read
        path = f"{storage_root(spark)}/ivf-exact-{uuid.uuid4().hex[:12]}"
        reached.write.parquet(f"{path}/reached")
        reached = spark.read.schema(reached.schema).parquet(f"{path}/reached")
    hits = grid.dealt(every, asked.join(reached.select("query_id", "kth"), "query_id", "left"), groups).mapInArrow(
        _second_round(bc, dim, k), f"{grid.RANKED}, read long")
    if report is not None:
        hits.write.parquet(f"{path}/hits")
        hits = spark.read.schema(hits.schema).parquet(f"{path}/hits")
        seen = (reached.agg(F.sum("read")).first()[0] or 0) + (hits.where("rank = 1").agg(F.sum("read")).first()[0] or 0)
        report.append(seen / max(1, sum(c for _, c in spread.values()) * n))
    return hits.drop("read")


def hybrid_search(index, points: DataFrame, queries: DataFrame, k: int = TOP_K, nprobe: int = NPROBE, vector: str = "vec",
                  changed: DataFrame | None = None) -> DataFrame:
    """The exact top-k over all ``points`` while the index lags: through the index for what it covers, by a scan of the tail for the
    rest. ``changed(id)``: points written again or deleted since they were indexed; the index's rows of them are left out."""
    pivots, indexed = index
    covered = indexed if changed is None else indexed.join(changed.select("id").distinct(), "id", "left_anti").select(*indexed.columns)
    tail = tail_of(index, points, changed)
    n, dim = grid.measured(queries)
    if n > grid.MANY:
        if not len(pivots):
            return search_batch(tail, queries, k, vector)
        return _exact_many((pivots, covered), tail, queries, n, dim, k, nprobe, vector)
    both = exact_search((pivots, covered), queries, k, nprobe, vector).unionByName(
        search_batch(tail, queries, k, vector, dim=query_dim(queries)))
    return rank_hits(both.drop("rank"), k)


def matches_per_cell(indexed: DataFrame, musts, vector: str = "vec") -> dict:
    """Searchable points per keyword and cell: ``{keyword: {cell: n}}``, for the keywords of a query chunk (None: any)."""
    some = indexed.where(F.col("cell").isNotNull() & F.exists(vector, lambda x: x != 0)).groupBy("cell", "a").agg(F.count(F.lit(1)).alias("n"))
    out: dict = {}
    names = sorted({m for m in musts if m is not None})
    if names:
        for r in some.where(F.col("a").isin(names)).collect():
            out.setdefault(r["a"], {})[r["cell"]] = r["n"]
    if any(m is None for m in musts):
        out[None] = {r["cell"]: r["n"] for r in some.groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    return out


def probes_of(mat: np.ndarray, musts: np.ndarray, pivots_unit: np.ndarray, counts: dict, k: int, nprobe: int) -> list[np.ndarray]:
    """The cells each query reads: its ``nprobe`` nearest, then the next ones while fewer than ``k`` points match."""
    ranked = nearest_cells(mat, pivots_unit, len(pivots_unit))
    out = []
    for cells, must in zip(ranked, musts):
        own = counts.get(must, {})
        before = np.cumsum([0, *(own.get(int(c), 0) for c in cells[:-1])])
        out.append(cells[(np.arange(len(cells)) < nprobe) | (before < k)])
    return out


def _enough_per_cell(indexed: DataFrame, queries: DataFrame, k: int, vector: str) -> dict:
    """``matches_per_cell`` for the keywords of ``queries`` that ``k`` searchable points or more have: one that fewer have reads
    every cell whatever the counts. So there are at most 1 / k as many keywords as points."""
    some = indexed.where(F.col("cell").isNotNull() & F.exists(vector, lambda x: x != 0)).groupBy("cell", "a").agg(F.count(F.lit(1)).alias("n"))
    names = queries.select(F.col("must_a").alias("a")).where("a is not null").distinct()
    often = some.groupBy("a").agg(F.sum("n").alias("n")).where(F.col("n") >= k).select("a").join(names, "a", "left_semi")
    out: dict = {None: {r["cell"]: r["n"] for r in some.groupBy("cell").agg(F.sum("n").alias("n")).collect()}}
    for r in some.join(often, "a", "left_semi").collect():
        out.setdefault(r["a"], {})[r["cell"]] = r["n"]
    return out


def _probe_many(index, queries: DataFrame, n: int, dim: int, k: int, nprobe: int, vector: str) -> DataFrame:
    """``ivf_search`` of many queries: each task finds the cells its queries probe and scores a cell's points for those."""
    pivots, indexed = index
    spark = indexed.sparkSession
    if dim != pivots.shape[1]:
        return spark.createDataFrame([], EMPTY_HITS)
    points = indexed.where(F.col("cell").isNotNull()).select("id", F.col(vector).alias("vec"), "a", "cell")
    bc = ship(spark, (_unit(pivots), _enough_per_cell(indexed, queries, k, vector)))

    def probing(group):
        piv, counts = bc.value
        tiles = range(0, group.n, grid.QUERY_TILE)
        return grid.members((cells for lo in tiles for cells in probes_of(group.mat[lo: lo + grid.QUERY_TILE], group.musts[lo: lo + grid.QUERY_TILE],
                                                                          piv, counts, k, nprobe)), group.n)

    groups = grid.groups_for(spark, n, points.count(), dim, k)
    return grid.dealt(points, queries.select("query_id", "qvec", "must_a"), groups).mapInArrow(grid.scan_kernel(dim, k, probing), grid.RANKED)


def ivf_search(index, queries: DataFrame, k: int = TOP_K, nprobe: int = NPROBE, vector: str = "vec") -> DataFrame:
    """Top-k per query through the index ``(pivots, indexed_points)``. Counts cells and collects the query chunks
    before it returns the (lazy) hits."""
    pivots, indexed = index
    spark = indexed.sparkSession
    if not len(pivots):
        return spark.createDataFrame([], EMPTY_HITS)
    piv = _unit(pivots)
    dim = pivots.shape[1]
    n, common = grid.measured(queries)
    if n > grid.MANY:
        return _probe_many(index, queries, n, common, k, nprobe, vector)

    def build(chunk):
        qids, mat, musts = chunk
        if mat.shape[1] != dim:
            return spark.createDataFrame([], EMPTY_HITS)
        counts = matches_per_cell(indexed, set(musts.tolist()), vector)
        cell_mask: dict[int, list] = {}
        for qi, cells in enumerate(probes_of(mat, musts, piv, counts, k, nprobe)):
            for c in cells:
                cell_mask.setdefault(int(c), []).append(qi)
        mask = {c: np.asarray(v, dtype=np.int64) for c, v in cell_mask.items()}
        bc = ship(spark, (qids, mat, musts, mask))
        # partition pruning: only the probed cells' directories are read
        pts = indexed.where(F.col("cell").isin(list(mask))).select("id", vector, "a", "cell")

        def run(batches, bc=bc):
            q_ids, q_mat, q_must, m = bc.value
            yield from make_topk_kernel(q_ids, q_mat, q_must, k, vector, cell_mask=m)(batches)

        return rank_hits(pts.mapInArrow(run, HIT_SCHEMA), k)

    return over_chunks(spark, query_chunks(queries, dim, k), build)


def recall(approx: DataFrame, exact: DataFrame) -> DataFrame:
    """recall@k per query: share of the exact top-k ids that the approximate search returned."""
    e = exact.select("query_id", "id")
    a = approx.select("query_id", "id", F.lit(1).alias("__hit"))
    j = e.join(a, on=["query_id", "id"], how="left")
    return j.groupBy("query_id").agg(
        F.round(F.count("__hit") / F.count(F.lit(1)), 6).alias("recall"),
        F.count(F.lit(1)).cast("bigint").alias("exact_hits"),
    )
