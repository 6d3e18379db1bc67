"""Whitening of an embedding table by incremental eigendecomposition.

Components are scaled to whole numbers, so means and distances from the mean are exact. Then:

1. every task keeps the eigendecomposition of what it has seen and updates it by one centred vector at a time: the
   eigenvalues of a diagonal plus a rank-one matrix are the roots of the secular equation, one between each two neighbours, all found at
   once by bisection measured from the nearest pole; directions without a share in the vector and repeated eigenvalues are
   deflated; the vector is then recomputed from the roots, so the new eigenvectors are orthogonal to rounding. A batch of more
   vectors than dimensions enters as the rows of its triangular factor, which sum to the same matrix in at most as many updates;
2. spectra are combined up a tree, each eigenpair of one a rank-one update of the other;
3. the final basis is refined by Rayleigh-Ritz: all vectors are projected on it, the small matrix of the projections is summed over
   the cluster and its eigenvectors turn the basis.

A task holds one matrix of d x d, a group of the tree ``FAN`` of them, the driver one; rows are read where they lie and
never shuffled.

Defined cases: a vector that is null, empty or holds a null or non-finite component takes no part, nor does one of another length
than the commonest (of those, the shortest) or with a component of 2**30 and more; null and repeated ids are rows like others; with fewer dimensions than
components there are as many components as dimensions; a component of no variance has a null ``whitened`` and is left out of
``identity_error``; without any variance ``explained`` is null; a ``deviation`` beyond 64 bits is null; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vectables.llm.store import Workspace
from vectables.llm.vectors import Vectors
from vectables.session import ship

SCALE, SHIFT = 1024, 100_000
FAN = 16
BLOCK = 4_096           # vectors that enter by one triangular factor
TINY = 1e-14            # share of the largest eigenvalue below which a direction or a gap is deflated
FLAT = 1e-10            # share of the largest eigenvalue below which a component has no variance


LIMIT = 1 << 40         # whole components are smaller


def whole(x: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * x).astype(np.int64) + SHIFT


class Fit:
    """Length, number and exact sums of the vectors that take part."""

    def __init__(self, dim: int, n: int, sums: list[int]):
        self.dim, self.n, self.sums = dim, n, sums
        # x - S/n as (x - floor(S/n)) - remainder/n: whole numbers first, so nothing is lost to the size of x
        self.low = np.array([s // n for s in sums], dtype=np.int64) if n else np.zeros(dim, np.int64)
        self.rest = np.array([s % n for s in sums], dtype=np.int64) if n else np.zeros(dim, np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.low) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over the dimensions of (n x - S)^2 of each row, exact; null beyond 64 bits."""
        gap = x - self.low
        if float(np.abs(gap).max(initial=0)) * self.n < 2.0 ** 62:
            off = gap * self.n - self.rest
            if float((off.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) < 2.0 ** 62:
                return pa.array((off * off).sum(axis=1))
        exact = (sum((int(g) * self.n - int(r)) ** 2 for g, r in zip(row, self.rest)) for row in gap)
        return pa.array([e if e < 1 << 63 else None for e in exact], pa.int64())


def rows_of(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and whole vectors of a batch that take part; zero vectors do."""
    v = Vectors(column)
    bad = np.concatenate([[0], np.cumsum(~(np.abs(v.flat) < (LIMIT - SHIFT) / SCALE))])
    at = np.flatnonzero((v.sizes == dim) & (bad[v.bounds[1:]] == bad[v.bounds[:-1]]))
    return at, whole(v.flat[v.bounds[at][:, None] + np.arange(dim)])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors -> (dim, i, s): sums of each component, and the number of vectors at i = -1."""
    held: dict[int, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for dim, s in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim + 1, dim, np.int32)), pa.array(np.append(np.arange(dim), -1).astype(np.int32)), pa.array(s)],
                                             names=["dim", "i", "s"])
        held.clear()

    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes[sizes > 0]).tolist():
            at, x = rows_of(batch.column(0), dim)
            if len(at):
                held[dim] = held.get(dim, np.zeros(dim + 1, np.int64)) + np.append(x.sum(axis=0), len(at))
        if any(s[-1] > 1 << 20 for s in held.values()):
            yield from out()
    yield from out()


def measure(rows: DataFrame) -> Fit:
    """The fit of a table of one column of vectors. Lengths are ranked on the cluster; the sums of one reach the driver."""
    sums = Workspace(rows.sparkSession, "whitening").save(
        rows.mapInArrow(_sums, "dim int, i int, s long").groupBy("dim", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")), "sums")
    best = sums.where("i = -1").orderBy(F.desc("s"), "dim").select("dim", "s").first()
    if best is None:
        return Fit(0, 0, [])
    return Fit(best["dim"], int(best["s"]), [int(r["s"]) for r in sums.where((F.col("dim") == best["dim"]) & (F.col("i") >= 0)).orderBy("i").select("s").toLocalIterator()])


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + z z' for ascending, distinct d and z without zeros: the number of each root's
    nearest pole, and its distance from that pole."""
    square = z * z
    top = d[-1] + square.sum()
    right = np.append(d[1:], top)
    gap = d[None, :] - d[:, None]                                   # gap[i, j] = d[j] - d[i]
    middle = (right - d) / 2
    # the sign of 1 + sum z^2 / (d - x) in the middle of an interval tells the half that holds its root
    f = 1 + (square[None, :] / (gap - middle[:, None])).sum(axis=1)
    pole = np.where((f < 0) & (np.arange(len(d)) < len(d) - 1), np.arange(len(d)) + 1, np.arange(len(d)))
    left = pole == np.arange(len(d))
    lo = np.where(left, 0.0, -middle)
    hi = np.where(left, np.where(np.arange(len(d)) < len(d) - 1, middle, top - d), 0.0)
    from_pole = d[None, :] - d[pole][:, None]
    for _ in range(64):
        x = (lo + hi) / 2
        with np.errstate(divide="ignore", invalid="ignore"):
            f = 1 + (square[None, :] / (from_pole - x[:, None])).sum(axis=1)
        lo, hi = np.where(f < 0, x, lo), np.where(f < 0, hi, x)
    return pole, (lo + hi) / 2


def update(values: np.ndarray, basis: np.ndarray, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigendecomposition of basis diag(values) basis' + vector vector', values ascending."""
    z = basis.T @ vector
    limit = TINY * max(float(values[-1]), float(z @ z), 1e-300)
    values, basis = values.copy(), basis.copy()
    # eigenvalues that (nearly) repeat: turn the pair so that one of the two has no share in the vector
    close = np.flatnonzero(np.diff(values) <= limit)
    for i in close:
        r = math.hypot(z[i], z[i + 1])
        if r > 0:
            c, s = z[i + 1] / r, z[i] / r
            basis[:, [i, i + 1]] = basis[:, [i, i + 1]] @ np.array([[c, s], [-s, c]])
            z[i], z[i + 1] = 0.0, r
    live = np.flatnonzero(z * z > limit * 1e-2)
    live = live[np.append(np.diff(values[live]) > 0, True)] if len(live) else live
    if len(live) == 0:
        return values, basis
    d, part = values[live], z[live]
    pole, off = secular_roots(d, part)
    # to[j, i] = root j - d[i], from the nearest pole, so that no digits are lost
    to = (d[pole][:, None] - d[None, :]) + off[:, None]
    m = len(d)
    apart = d[:, None] - d[None, :]                                 # apart[k, i] = d[k] - d[i]
    np.fill_diagonal(apart, 1.0)
    # the vector of which the roots are exact: z_i^2 = prod_j (root_j - d_i) / prod_{k != i} (d_k - d_i)
    ratio = np.abs(to)
    k, i = np.indices((m, m))
    beside = np.where(k < i, np.abs(apart), np.abs(np.roll(apart, -1, axis=0)))      # a root below pole i against its own pole, above it against the next
    beside[-1] = 1.0
    share = np.sqrt(np.prod(ratio / beside, axis=0))
    share = np.copysign(share, part)
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = share[None, :] / to
    exact = ~np.isfinite(turn).all(axis=1)                          # a root on a pole keeps that pole's direction
    turn[exact] = np.eye(m)[pole[exact]]
    turn /= np.sqrt((turn * turn).sum(axis=1, keepdims=True))
    values[live] = d[pole] + off
    basis[:, live] = basis[:, live] @ turn.T
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


def absorb(values: np.ndarray, basis: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    for v in vectors:
        values, basis = update(values, basis, v)
    return values, basis


def _spectrum(fit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        f = fit.value
        values, basis, seen = np.zeros(f.dim), np.eye(f.dim), 0
        for batch in batches:
            _, x = rows_of(batch.column(0), f.dim)
            for lo in range(0, len(x), BLOCK):
                part = f.centred(x[lo: lo + BLOCK])
                seen += len(part)
                values, basis = absorb(values, basis, np.linalg.qr(part, mode="r") if len(part) > f.dim else part)
        if seen:
            yield np.concatenate([values[None, :], basis])
    return run


def _combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two spectra (values above the basis): each eigenpair of ``b`` is a rank-one update of ``a``."""
    values, basis = absorb(a[0], a[1:], (np.sqrt(np.maximum(b[0], 0)) * b[1:]).T)
    return np.concatenate([values[None, :], basis])


def tree(rows: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], combine: Callable[[np.ndarray, np.ndarray], np.ndarray],
         shape: tuple[int, int], space: Workspace, name: str) -> np.ndarray | None:
    """One matrix of ``shape`` a task, combined ``FAN`` at a time until one is left; null if no task had one."""
    schema = "id long, m binary"

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for m in kernel(batches):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([m.astype(np.float64).tobytes()], pa.binary())], names=["id", "m"])

    def merged(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        m = reduce(combine, (np.frombuffer(b, dtype=np.float64).reshape(shape) for b in table["m"].to_pylist()))
        return pa.table({"id": pa.array([table["id"][0].as_py() // FAN]), "m": pa.array([m.tobytes()], pa.binary())})

    at, k = space.save(rows.mapInArrow(first, schema), f"{name}-0"), 0
    while (top := at.agg(F.max("id").alias("id"), F.count("*").alias("n")).first())["n"] > 1 or (top["id"] or 0) > 0:
        k += 1
        at = space.save(at.groupBy((F.col("id") / FAN).cast("long").alias("of")).applyInArrow(merged, schema), f"{name}-{k}")
    found = at.first()
    return None if found is None else np.frombuffer(bytes(found["m"]), dtype=np.float64).reshape(shape)


def eigen(rows: DataFrame, fit: Fit, space: Workspace) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the covariance with divisor n."""
    spark, d = rows.sparkSession, fit.dim
    shipped = ship(spark, fit)
    spectrum = tree(rows, _spectrum(shipped), _combined, (d + 1, d), space, "spectrum")
    basis = ship(spark, np.linalg.qr(spectrum[1:])[0])

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        f, q, total = shipped.value, basis.value, 0.0
        for batch in batches:
            y = f.centred(rows_of(batch.column(0), f.dim)[1]) @ q
            total = total + y.T @ y
        if isinstance(total, np.ndarray):
            yield total

    small = tree(rows, projected, np.add, (d, d), space, "ritz")
    values, turn = np.linalg.eigh((small + small.T) / 2 / fit.n)
    return values[::-1], (basis.value @ turn)[:, ::-1]


def whiten(table: DataFrame, id: str, vector: str, components: int = 8) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), one row per vector that takes part and component."""
    spark = table.sparkSession
    space = Workspace(spark, "whitening")
    vectors = table.select(F.col(vector).alias("vector"))
    fit = measure(vectors)
    kind = table.schema[id].dataType
    schema = f"id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fit.n == 0:
        return spark.createDataFrame([], schema)
    values, basis = eigen(vectors, fit, space)
    k = min(components, fit.dim)
    total = float(values.sum())
    live = values[:k] > FLAT * max(float(values[0]), 0.0)
    shares = values[:k] / total if total > 0 else np.full(k, np.nan)
    model = ship(spark, (fit, basis[:, :k] / np.sqrt(np.where(live, values[:k], 1.0)), live, shares))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        f, q, _, _ = model.value
        total = 0.0
        for batch in batches:
            y = f.centred(rows_of(batch.column(0), f.dim)[1]) @ q
            total = total + np.concatenate([y.sum(axis=0)[None, :], y.T @ y])
        if isinstance(total, np.ndarray):
            yield total

    made = tree(vectors, moments, np.add, (k + 1, k), space, "moments") / fit.n
    off = (made[1:] - np.outer(made[0], made[0]) - np.eye(k))[np.ix_(live, live)]
    error = float(np.abs(off).max()) if live.any() else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, q, live, shares = model.value
        for batch in batches:
            at, x = rows_of(batch.column(1), f.dim)
            y = f.centred(x) @ q
            m = len(at)
            deviation = f.deviations(x)
            each = lambda a: a.take(pa.array(np.repeat(np.arange(len(a)), k)))
            flat, dead = y.reshape(-1), np.tile(~live, m)
            yield pa.RecordBatch.from_arrays([
                each(batch.column(0).take(pa.array(at))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, f.n)),
                each(deviation), pa.array(flat, mask=dead), pa.array(np.tile(shares, m), mask=np.isnan(np.tile(shares, m))),
                pa.array(np.full(m * k, np.nan if error is None else error), mask=np.full(m * k, error is None))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return table.select(F.col(id).alias("id"), F.col(vector).alias("vector")).mapInArrow(rows, schema)
