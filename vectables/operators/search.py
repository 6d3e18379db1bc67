"""Filtered top-k cosine search (OP-29..OP-33).

* ``search_one``: one query as plain column expressions (``zip_with`` / ``aggregate``), then
  ``orderBy(...).limit(k)``, which Catalyst turns into TakeOrderedAndProject: each task keeps
  its own k best, only k rows per task reach the final merge.
* ``search_batch``: many queries. The query matrix is size-checked and broadcast; points are
  streamed through ``mapInArrow`` where numpy scores a whole Arrow batch against all queries at
  once and keeps a running local top-k per query. Only ``(query_id, id, score, a)`` leaves the
  task (vectors are never shuffled). A query has at most ``k`` candidates per task; they are cut to
  ``k`` in ``SALTS`` groups first and those to ``k`` again, each ``row_number() <= k`` planned with a
  WindowGroupLimit before its shuffle. A task scores ``QUERY_TILE`` queries at a time, so its matrices
  do not grow with the query set. Points are read once for every ``MAX_QUERY_BYTES`` of query vectors: where their running top-k
  would not fit a task, it walks a grid, a block of points by the queries whose top-k fits, and emits each cell's hits.

Order everywhere is ``(score desc, id asc)`` with the score rounded to 6 decimals first, so a
local cut and the global cut agree on ties (S21). One rule for all searches: a vector that is null, empty, zero, of another
length than the queries, or with a null or non-finite component is never a hit, and such a query has no hits.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectables import TOP_K
from vectables.session import ship, storage_root
from vectables.functions.vectors import SCORE_DECIMALS, cosine

HIT_SCHEMA = "query_id long, id long, score double, a string"
# Bytes of query vectors (and, for searches by cell, running top-k) that a task holds; larger query sets are split into chunks.
MAX_QUERY_BYTES = 128 << 20
RUNNING_BYTES = 128 << 20   # of running top-k that a task holds; more queries are searched a block of points at a time
BLOCK_BYTES = 64 << 20      # of points in such a block
HIT_BYTES = 48          # of one running hit: query, id, score, keyword, and its copy while merging
QUERY_TILE = 1024       # queries scored against an Arrow batch at once
SALTS = 64              # groups that the candidates of one query are cut in before the last cut


def cut_hits(hits: DataFrame, k: int, score: str = "score", name: str = "rank") -> DataFrame:
    """The k best candidates of each query by ``(score desc, id asc)``, numbered: first in ``SALTS`` groups by id, so
    that a query's candidates from many tasks are not one task's, then over what is left."""
    order = [F.col(score).desc(), F.col("id").asc()]
    salted = Window.partitionBy("query_id", F.pmod(F.xxhash64("id"), F.lit(SALTS))).orderBy(*order)
    some = hits.withColumn("__n", F.row_number().over(salted)).where(F.col("__n") <= k).drop("__n")
    best = Window.partitionBy("query_id").orderBy(*order)
    return some.withColumn(name, F.row_number().over(best).cast("bigint")).where(F.col(name) <= k)


def rank_hits(hits: DataFrame, k: int = TOP_K) -> DataFrame:
    """Global top-k per query: ``rank`` by ``(score desc, id asc)``."""
    return cut_hits(hits, k).select("query_id", "rank", "id", F.round("score", SCORE_DECIMALS).alias("score"), "a")


def search_one(points: DataFrame, query: Column, predicate: Column | None = None, k: int = TOP_K,
               vector: str = "vec", query_id: int = 0) -> DataFrame:
    """One filtered top-k search; ``query`` is an array<float> column expression (usually a literal)."""
    cand = points if predicate is None else points.where(predicate)
    scored = cand.where(F.col(vector).isNotNull()).select(
        "id", F.round(cosine(F.col(vector), query), SCORE_DECIMALS).alias("score"), "a"
    ).where(F.col("score").isNotNull())
    top = scored.orderBy(F.col("score").desc(), F.col("id").asc()).limit(k)
    w = Window.orderBy(F.col("score").desc(), F.col("id").asc())  # over k rows only
    return top.select(
        F.lit(query_id).cast("bigint").alias("query_id"),
        F.row_number().over(w).cast("bigint").alias("rank"),
        "id", "score", "a",
    )


# ------------------------------------------------------------------ batch search kernel

def arrow_vectors(col: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(float64 matrix of the valid vectors, row mask) straight from the Arrow list buffers: one gather over the flat values,
    no Python object per row. Valid: of ``dim`` components (without ``dim``: as many as the first non-empty one), all finite."""
    n = len(col)
    if n == 0:
        return np.zeros((0, dim or 0)), np.zeros(0, dtype=bool)
    offsets = np.asarray(col.offsets)
    lengths = np.diff(offsets)
    valid = np.asarray(col.is_valid().to_numpy(zero_copy_only=False)) & (lengths > 0)
    if valid.any():
        valid &= lengths == (dim or int(lengths[np.flatnonzero(valid)[0]]))
    rows = np.flatnonzero(valid)
    if len(rows) == 0:
        return np.zeros((0, dim or 0)), valid
    values = np.asarray(col.values.to_numpy(zero_copy_only=False))
    mat = values[offsets[:-1][rows, None] + np.arange(int(lengths[rows[0]]))].astype(np.float64)
    finite = np.isfinite(mat).all(axis=1)
    if not finite.all():
        valid[rows[~finite]] = False
        mat = mat[finite]
    return mat, valid


def _top_candidates(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, col) of every entry at least as good as the row's k-th best (ties kept)."""
    m, n = scores.shape
    if n <= k:
        rows, cols = np.nonzero(np.isfinite(scores))
        return rows, cols
    kth = np.partition(scores, n - k, axis=1)[:, n - k]
    rows, cols = np.nonzero(scores >= kth[:, None])
    return rows, cols


def reduce_topk(qidx: np.ndarray, ids: np.ndarray, rank_scores: np.ndarray, extra: list[np.ndarray], k: int):
    """Keep the k best ``(rank score desc, id asc)`` per query index; ``extra`` arrays follow."""
    if len(qidx) == 0:
        return qidx, ids, rank_scores, extra
    order = np.lexsort((ids, -rank_scores, qidx))
    qidx, ids, rank_scores = qidx[order], ids[order], rank_scores[order]
    extra = [e[order] for e in extra]
    starts = np.r_[0, np.flatnonzero(np.diff(qidx)) + 1]
    group_start = np.repeat(starts, np.diff(np.r_[starts, len(qidx)]))
    keep = (np.arange(len(qidx)) - group_start) < k
    return qidx[keep], ids[keep], rank_scores[keep], [e[keep] for e in extra]


def unit_rows(mat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows scaled to unit norm, mask of rows with a finite norm above zero); other rows are zero."""
    norms = np.linalg.norm(mat, axis=1) if len(mat) else np.zeros(0)
    good = (norms > 0) & np.isfinite(norms)
    return np.where(good[:, None], mat, 0.0) / np.where(good, norms, 1.0)[:, None], good


def point_batches(batches, vector: str, with_cells: bool = False, dim: int | None = None):
    """Per Arrow batch: ids, unit vectors, raw vectors, keywords (and cells) of the rows that can be hits."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        mat, valid = arrow_vectors(batch.column(vector), dim)
        if not valid.any():
            continue
        ids = np.asarray(batch.column("id").to_numpy(zero_copy_only=False))[valid]
        labels = np.asarray(batch.column("a").to_numpy(zero_copy_only=False), dtype=object)[valid]
        cells = np.asarray(batch.column("cell").to_numpy(zero_copy_only=False))[valid] if with_cells else None
        unit, good = unit_rows(mat)
        if not good.all():
            ids, labels, unit, mat = ids[good], labels[good], unit[good], mat[good]
            cells = cells[good] if cells is not None else None
        if len(ids):
            yield ids.astype(np.int64), unit, mat, labels, cells


def _groups_by_keyword(query_must: np.ndarray, usable: np.ndarray) -> dict:
    groups: dict = {}
    for i, m in enumerate(query_must):
        if usable[i]:
            groups.setdefault(m, []).append(i)
    return {m: np.asarray(ix, dtype=np.int64) for m, ix in groups.items()}


def make_topk_kernel(query_ids: np.ndarray, query_mat: np.ndarray, query_must: np.ndarray, k: int,
                     vector: str, cell_mask=None):
    """Build the ``mapInArrow`` function. ``query_must`` holds the keyword each query requires
    (None = no filter). ``cell_mask`` optionally maps a point's cell to the query indices that probe it.

    Per task it keeps a running top-k per query across Arrow batches and emits it once at the end:
    at most ``k`` rows per query per task leave the task."""
    qn, qgood = unit_rows(query_mat)
    musts = _groups_by_keyword(query_must, qgood)
    by_cell = None
    if cell_mask is not None:   # queries per (keyword, cell), computed once per task
        by_cell = {}
        for must, qsel in musts.items():
            for c, probing in cell_mask.items():
                qs = np.intersect1d(qsel, probing, assume_unique=True)
                if len(qs):
                    by_cell[(must, c)] = qs

    def score(queries, pidx, ids, pn, labels, parts):
        for lo in range(0, len(queries), QUERY_TILE):
            qs = queries[lo: lo + QUERY_TILE]
            scores = np.round(qn[qs] @ pn[pidx].T, SCORE_DECIMALS)
            r, c = _top_candidates(scores, k)
            parts[0].append(qs[r])
            parts[1].append(ids[pidx][c])
            parts[2].append(scores[r, c])
            parts[3].append(labels[pidx][c])

    def kernel(batches):
        acc = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, dtype=object)]
        for ids, pn, _raw, labels, cells in point_batches(batches, vector, cell_mask is not None, query_mat.shape[1]):
            parts = [[x] for x in acc]
            if by_cell is None:
                for must, qsel in musts.items():
                    pidx = np.flatnonzero(np.ones(len(ids), dtype=bool) if must is None else labels == must)
                    if len(pidx):
                        score(qsel, pidx, ids, pn, labels, parts)
            else:
                order = np.argsort(cells, kind="stable")       # contiguous slice per cell
                ucells, starts = np.unique(cells[order], return_index=True)
                ends = np.r_[starts[1:], len(order)]
                for c, a, b in zip(ucells, starts, ends):
                    rows = order[a:b]
                    for must in musts:
                        qs = by_cell.get((must, int(c)))
                        if qs is None:
                            continue
                        pidx = rows if must is None else rows[labels[rows] == must]
                        if len(pidx):
                            score(qs, pidx, ids, pn, labels, parts)
            q, i, sc, extra = reduce_topk(*(np.concatenate(p) for p in parts[:3]), [np.concatenate(parts[3])], k)
            acc = [q, i, sc, extra[0]]
        if len(acc[0]):
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[acc[0]].astype(np.int64)), pa.array(acc[1]), pa.array(acc[2], pa.float64()),
                 pa.array(list(acc[3]), pa.string())],
                names=["query_id", "id", "score", "a"])

    return kernel


def make_grid_kernel(query_ids: np.ndarray, query_mat: np.ndarray, query_must: np.ndarray, k: int, vector: str):
    """:func:`make_topk_kernel` for any number of queries: one whose running top-k is over ``RUNNING_BYTES`` searches
    ``BLOCK_BYTES`` of points at a time, some queries after the other, and emits at most ``k`` hits per query and block."""
    per_cell = max(1, RUNNING_BYTES // (k * HIT_BYTES))
    if len(query_ids) <= per_cell:
        return make_topk_kernel(query_ids, query_mat, query_must, k, vector)
    cells = [make_topk_kernel(query_ids[lo: lo + per_cell], query_mat[lo: lo + per_cell], query_must[lo: lo + per_cell], k, vector)
             for lo in range(0, len(query_ids), per_cell)]

    def kernel(batches):
        block, held = [], 0
        for batch in batches:
            block.append(batch)
            held += batch.nbytes
            if held >= BLOCK_BYTES:
                for cell in cells:
                    yield from cell(iter(block))
                block, held = [], 0
        if block:
            for cell in cells:
                yield from cell(iter(block))

    return kernel


def collect_queries(queries: DataFrame, vector: str = "qvec", must: str = "must_a"):
    """Bring a size-checked query set to the driver as numpy (the broadcast side of the search)."""
    pdf = queries.select("query_id", vector, must).toPandas()
    if pdf.empty:
        return np.zeros(0, dtype=np.int64), np.zeros((0, 0)), np.zeros(0, dtype=object)
    qids = pdf["query_id"].to_numpy(dtype=np.int64)
    sizes = pdf[vector].map(lambda v: 0 if v is None else len(v))
    dim = int(sizes[sizes > 0].mode().min()) if (sizes > 0).any() else 0
    # a query without a valid vector of the common length keeps its row, as zeros: it has no hits
    mat = np.stack([np.asarray(v, dtype=np.float64) if n == dim and dim else np.zeros(dim) for v, n in zip(pdf[vector], sizes)])
    mat[~np.isfinite(mat).all(axis=1)] = 0.0
    musts = np.array([None if (m is None or (isinstance(m, float) and np.isnan(m))) else m for m in pdf[must]],
                     dtype=object)
    return qids, mat, musts


def query_chunks(queries: DataFrame, dim: int, k: int = TOP_K, max_bytes: int | None = None):
    """Yield ``(qids, matrix, musts)`` chunks whose vectors and running top-k (``k`` hits a query) fit ``max_bytes``.

    The query set is counted; one that is larger than a chunk is written once, with a hashed chunk
    number as partition, and read chunk by chunk. The driver holds one chunk at a time."""
    per_chunk = max(1, (max_bytes or MAX_QUERY_BYTES) // max(1, dim * 8 + k * HIT_BYTES))
    n = queries.count()
    chunks = -(-n // per_chunk)
    if chunks <= 1:
        yield collect_queries(queries.limit(per_chunk))
        return
    path = f"{storage_root(queries.sparkSession)}/queries-{uuid.uuid4().hex[:12]}"
    numbered = queries.select("query_id", "qvec", "must_a").withColumn("__chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks)))
    numbered.write.partitionBy("__chunk").parquet(path)
    stored = queries.sparkSession.read.parquet(path)
    for c in range(chunks):
        yield collect_queries(stored.where(F.col("__chunk") == c))


def _hits_for(points: DataFrame, chunk, k: int, vector: str) -> DataFrame:
    qids, mat, musts = chunk
    bc = ship(points.sparkSession, (qids, mat, musts))

    def run(batches, bc=bc):
        q_ids, q_mat, q_must = bc.value
        yield from make_grid_kernel(q_ids, q_mat, q_must, k, vector)(batches)

    return points.mapInArrow(run, HIT_SCHEMA)


EMPTY_HITS = "query_id long, rank long, id long, score double, a string"


def over_chunks(spark, chunks, build) -> DataFrame:
    """Run ``build(chunk) -> ranked hits`` per query chunk. One chunk: a single lazy plan. Several
    (query matrix over the broadcast bound): one job per chunk appending to a table in the shared
    folder, so the driver holds one chunk at a time; the result reads that table."""
    first = next(chunks)
    second = next(chunks, None)
    if second is None:
        if len(first[0]) == 0:
            return spark.createDataFrame([], EMPTY_HITS)
        return build(first)
    out = f"{storage_root(spark)}/search-{uuid.uuid4().hex[:12]}"
    for chunk in (first, second, *chunks):
        if len(chunk[0]):
            build(chunk).write.mode("append").parquet(out)
    return spark.read.parquet(out)


def query_dim(queries: DataFrame) -> int:
    """Dimension of the query vectors (of the first one that has any)."""
    first = queries.select(F.size("qvec").alias("d")).where("d > 0").limit(1).collect()
    return first[0]["d"] if first else 1


def search_batch(points: DataFrame, queries: DataFrame, k: int = TOP_K, vector: str = "vec",
                 dim: int | None = None) -> DataFrame:
    """Top-k per query for every row of ``queries`` (query_id, qvec array<float>, must_a string|null)."""
    from vectables.operators import grid

    spark = points.sparkSession
    pts = points.select("id", vector, "a")
    n, common = grid.measured(queries)
    if n > grid.MANY:
        return grid.search_many(pts, queries, k, n, common, vector)
    chunks = query_chunks(queries, dim or query_dim(queries), 0)      # the kernel bounds its own running top-k
    return over_chunks(spark, chunks, lambda c: rank_hits(_hits_for(pts, c, k, vector), k))
