"""Scalar int8 quantization (OP-36) and quantized search with exact rescoring (OP-37).

``q(x) = clip(floor(x / alpha * 127 + 0.5), -127, 127)`` with ``alpha`` = the largest absolute
element in the collection. ``alpha`` is one global aggregate (a partial max per task, one value
to the driver); the transform itself is a JVM-side ``transform`` on each row.

The codes are stored: a table of (id, one byte a component, keyword), a quarter of the vectors' bytes, written once and
read by every search. Search ranks by the integer dot product of codes, keeps a shortlist of ``k * oversample`` per query,
then fetches the vectors of the shortlisted ids and re-ranks by the exact cosine; no other vector is read by a kernel. Per
task the kernel keeps a local shortlist by ``(int score desc, id asc)``; the global shortlist is a
``row_number`` cut on the same key, so it equals the shortlist over the whole table.

A vector that is null, empty, zero, of another length or with a non-finite component has no code and is no hit, and
``alpha`` does not see it.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectables import TOP_K
from vectables.session import ship, storage_root
from vectables.functions.vectors import SCORE_DECIMALS, finite_vector
from vectables.operators import grid
from vectables.operators.search import (HIT_SCHEMA, QUERY_TILE, _groups_by_keyword, _top_candidates, arrow_vectors, cut_hits, over_chunks,
                                        point_batches, query_chunks, query_dim, rank_hits, reduce_topk, unit_rows)

QMAX = 127
OVERSAMPLE = 1.5
QHIT_SCHEMA = "query_id long, id long, iscore long, a string"


def alpha_of(points: DataFrame, vector: str = "vec") -> float:
    row = points.where(finite_vector(F.col(vector))).agg(F.max(F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))).alias("m")).first()
    return float(row["m"] or 1.0)


def quantize(vec: Column, alpha: float) -> Column:
    return F.when(finite_vector(vec), F.transform(vec, lambda x: F.greatest(F.lit(-QMAX), F.least(F.lit(QMAX), F.floor(
        x.cast("double") / F.lit(float(alpha)) * QMAX + 0.5))).cast("tinyint")))


def quantize_np(mat: np.ndarray, alpha: float) -> np.ndarray:
    """Quantized values kept as float64: integer dot products of int8 vectors are exact in
    float64 (far below 2**53) and go through BLAS, unlike an int64 matmul."""
    return np.clip(np.floor(mat / alpha * QMAX + 0.5), -QMAX, QMAX)


def encode(points: DataFrame, alpha: float, dim: int, vector: str = "vec") -> DataFrame:
    """``(id, code, a)``: one byte per component, for the points that can be hits."""

    def run(batches):
        for ids, _unit, raw, labels, _cells in point_batches(batches, vector, dim=dim):
            codes = quantize_np(raw, alpha).astype(np.int8)
            bounds = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dim)
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, bounds.buffers()[1], pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(ids), packed, pa.array(list(labels), pa.string())], names=["id", "code", "a"])

    return points.select("id", vector, "a").mapInArrow(run, "id long, code binary, a string")


def build_codes(points: DataFrame, dim: int, path: str, vector: str = "vec", alpha: float | None = None) -> tuple[float, DataFrame]:
    """Writes the codes at ``path``: ``(alpha, codes(id, code, a))``, what a quantized search reads."""
    alpha = alpha_of(points, vector) if alpha is None else alpha
    codes = encode(points, alpha, dim, vector)
    codes.write.mode("errorifexists").parquet(path)
    return alpha, points.sparkSession.read.schema(codes.schema).parquet(path)


def make_int8_kernel(qids, qmat, qmust, alpha, shortlist):
    """``mapInArrow`` function over codes: the shortlist of each query by integer dot product."""
    _, qgood = unit_rows(qmat)
    dim = qmat.shape[1]
    kind = np.float32 if dim <= 1024 else np.float64     # sums of dim products of two bytes stay exact
    qq = quantize_np(np.where(qgood[:, None], qmat, 0.0), alpha).astype(kind)
    groups = _groups_by_keyword(qmust, qgood)

    def kernel(batches):
        acc = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, object)]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy()
            labels = np.asarray(batch.column("a").to_numpy(zero_copy_only=False), dtype=object)
            packed = batch.column("code")
            start = np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset]
            pq = np.frombuffer(packed.buffers()[2], dtype=np.int8)[start: start + len(ids) * dim].reshape(len(ids), dim).astype(kind)
            parts = [[x] for x in acc]
            for must, qs in groups.items():
                ps = np.flatnonzero(np.ones(len(ids), bool) if must is None else labels == must)
                if not len(ps):
                    continue
                for lo in range(0, len(qs), QUERY_TILE):
                    tile = qs[lo: lo + QUERY_TILE]
                    iscores = qq[tile] @ pq[ps].T
                    r, c = _top_candidates(iscores, shortlist)
                    for part, x in zip(parts, (tile[r], ids[ps][c], iscores[r, c].astype(np.int64), labels[ps][c])):
                        part.append(x)
            q, i, s, extra = reduce_topk(*(np.concatenate(p) for p in parts[:3]), [np.concatenate(parts[3])], shortlist)
            acc = [q, i, s, extra[0]]
        if len(acc[0]):
            yield pa.RecordBatch.from_arrays([pa.array(qids[acc[0]].astype(np.int64)), *map(pa.array, acc[1:3]), pa.array(list(acc[3]), pa.string())],
                                             names=["query_id", "id", "iscore", "a"])

    return kernel


def _rescored(bc, vector: str):
    """(query_id, a, id, vector) -> the exact score of each shortlisted point."""

    def run(batches):
        qids, qmat, _ = bc.value
        unit, _ = unit_rows(qmat)
        by_id = np.argsort(qids, kind="stable")
        for batch in batches:
            mat, valid = arrow_vectors(batch.column(vector), qmat.shape[1])
            at = by_id[np.searchsorted(qids, batch.column("query_id").to_numpy()[valid], sorter=by_id)]
            score = np.round(np.einsum("ij,ij->i", unit[at], unit_rows(mat)[0]), SCORE_DECIMALS)
            keep = pa.array(valid)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(keep) for c in ("query_id", "id")), pa.array(score), batch.column("a").filter(keep)],
                                             names=["query_id", "id", "score", "a"])

    return run


def _code_parts(dim: int, kind):
    """Codes of a batch of points, for ``grid.scored``."""

    def parts(batch: pa.RecordBatch):
        packed = batch.column("code")
        width = np.diff(np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset: packed.offset + len(packed) + 1])
        rows = np.flatnonzero(width == dim)
        start = np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset: packed.offset + len(packed)][rows]
        flat = np.frombuffer(packed.buffers()[2], dtype=np.int8) if len(rows) else np.zeros(0, np.int8)
        return rows, flat[start[:, None] + np.arange(dim)].astype(kind), None

    return parts


def _shortlists(dim: int, alpha: float, shortlist: int, vectors: pa.DataType):
    """Queries and coded points -> (query_id, qvec, ids, labels): a row per query with its shortlist."""
    kind = np.float32 if dim <= 1024 else np.float64     # sums of dim products of two bytes stay exact

    def run(batches):
        queries, points = grid.split(batches)
        group, labels = grid.Group(queries, dim), grid.Labels()
        if not group.n:
            return
        best = grid.Running(group.n, shortlist)
        mine = quantize_np(np.where(group.good[:, None], group.mat, 0.0), alpha).astype(kind)
        grid.scored(group, best, points, labels, _code_parts(dim, kind), mine, None, 0.0)
        for q, _, i, _, a in best.hits(np.searchsorted(group.ids, group.ids)):
            starts = np.r_[0, np.flatnonzero(np.diff(q)) + 1]
            bounds = pa.array(np.r_[starts, len(q)].astype(np.int32))
            mats = pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * dim), pa.array(group.mat[q[starts]].ravel(), vectors))
            yield pa.RecordBatch.from_arrays([pa.array(group.ids[q[starts]]), mats, pa.ListArray.from_arrays(bounds, pa.array(i)),
                                              pa.ListArray.from_arrays(bounds, labels.names(a))], names=["query_id", "qvec", "ids", "labels"])

    return run


def _rescored_lists(dim: int, k: int):
    """Queries with their shortlists, and all points -> the ``k`` best of each shortlist by exact score, ranked."""

    def run(batches):
        queries, points = grid.split(batches)
        group, labels = grid.Group(queries, dim), grid.Labels()
        if not group.n:
            return
        lists = group.table["ids"].combine_chunks()
        wanted = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(group.n, dtype=np.int32), np.diff(lists.offsets.to_numpy()))
        label = labels.of(group.table["labels"].combine_chunks().flatten())
        order = np.argsort(wanted, kind="stable")
        wanted, owner, label = wanted[order], owner[order], label[order]
        best, parts = grid.Running(group.n, k), grid.vector_parts(dim)
        for batch in points:
            rows, _, unit = parts(batch)
            if not len(rows):
                continue
            ids = batch.column("id").to_numpy(zero_copy_only=False)[rows].astype(np.int64)
            lo, hi = np.searchsorted(wanted, ids, "left"), np.searchsorted(wanted, ids, "right")
            n = hi - lo
            ends = np.cumsum(n)
            for a in range(0, int(ends[-1]), grid.EXACT_PAIRS):        # pairs of a shortlisted point and a query that lists it
                pair = np.arange(a, min(a + grid.EXACT_PAIRS, int(ends[-1])))
                p = np.searchsorted(ends, pair, "right")
                at = lo[p] + pair - (ends[p] - n[p])
                score = np.round(np.einsum("ij,ij->i", group.unit[owner[at]], unit[p]), SCORE_DECIMALS)
                best.add(owner[at], ids[p], score, label[at])
        yield from grid.ranked_rows(group, best, labels)

    return run


def _search_many(codes: tuple[float, DataFrame], points: DataFrame, queries: DataFrame, n: int, dim: int, k: int, shortlist: int, vector: str) -> DataFrame:
    """``search_codes`` of many queries: the codes pass each group of queries, then the vectors pass each group's shortlists."""
    alpha, coded = codes
    spark = points.sparkSession
    kind = {"float": pa.float32(), "double": pa.float64()}[queries.schema["qvec"].dataType.elementType.typeName()]
    qvec = queries.schema["qvec"].dataType.simpleString()
    groups = grid.groups_for(spark, n, coded.count(), dim, 2 * shortlist)
    short = grid.dealt(coded, queries.select("query_id", "qvec", "must_a"), groups, "code").mapInArrow(
        _shortlists(dim, alpha, shortlist, kind), f"query_id long, qvec {qvec}, ids array<long>, labels array<string>")
    pts = points.select("id", F.col(vector).alias("vec"), F.lit(None).cast("string").alias("a"))
    return grid.dealt(pts, short.withColumn("must_a", F.lit(None).cast("string")), groups).mapInArrow(_rescored_lists(dim, k), grid.RANKED)


def search_codes(codes: tuple[float, DataFrame], points: DataFrame, queries: DataFrame, k: int = TOP_K, oversample: float = OVERSAMPLE,
                 vector: str = "vec", dim: int | None = None) -> DataFrame:
    """Top-k per query: the shortlist over the stored ``codes``, the order by the vectors of the shortlisted points."""
    alpha, coded = codes
    spark = points.sparkSession
    shortlist = max(k, int(np.ceil(k * oversample)))
    n, common = grid.measured(queries)
    if n > grid.MANY:
        return _search_many(codes, points, queries, n, common, k, shortlist, vector)

    def build(chunk):
        bc = ship(spark, chunk)

        def run(batches, bc=bc):
            yield from make_int8_kernel(*bc.value, alpha, shortlist)(batches)

        short = cut_hits(coded.mapInArrow(run, QHIT_SCHEMA), shortlist, "iscore", "__s").select("query_id", "id", "a")
        fetched = short.join(points.select("id", vector), "id").select("query_id", "a", "id", vector)
        return rank_hits(fetched.mapInArrow(_rescored(bc, vector), HIT_SCHEMA), k)

    return over_chunks(spark, query_chunks(queries, dim or query_dim(queries), shortlist), build)


def search_int8(points: DataFrame, queries: DataFrame, k: int = TOP_K, oversample: float = OVERSAMPLE,
                vector: str = "vec", alpha: float | None = None, dim: int | None = None) -> DataFrame:
    """``search_codes`` over codes written for this call. Keep ``build_codes`` to search a table more than once."""
    dim = dim or query_dim(queries)
    path = f"{storage_root(points.sparkSession)}/int8-{uuid.uuid4().hex[:12]}"
    return search_codes(build_codes(points, dim, path, vector, alpha), points, queries, k, oversample, vector, dim)
