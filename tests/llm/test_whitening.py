import numpy as np
import pytest

from vectables.llm import whitening

SCHEMA = "vec_id long, vector array<float>, id string, component int, n int, m int"


def brute(vectors, components=8):
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [sum(int(n * c - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = np.array([[float(n * c - s) / n for c, s in zip(row, sums)] for row in x])
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1], basis[:, ::-1]
    k = min(components, len(values))
    return n, deviation, centred @ basis[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum()


def check(spark, vectors, extra=(), parts=3, components=8):
    rows = [(i, v, "x", 1, 2, 3) for i, v in [*enumerate(vectors), *extra]]
    out = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(parts), "vec_id", "vector", components).toPandas()
    n, deviation, y, share = brute(vectors, components)
    k = y.shape[1]
    assert len(out) == n * k and set(out.n) == {n} and out.identity_error.nunique() == 1 and out.identity_error[0] <= 1e-4
    have = out.pivot(index="id", columns="component", values="whitened").loc[range(n)].to_numpy()
    sign = np.sign((have * y).sum(axis=0))
    assert np.allclose(have * sign, y, rtol=0, atol=1e-8)
    assert np.allclose(out.groupby("component").explained.first(), share, rtol=1e-9)
    assert out.drop_duplicates("id").set_index("id").deviation.loc[range(n)].tolist() == deviation


def test_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.standard_normal((700, 24)) * np.linspace(0.2, 3, 24)).astype(np.float32).tolist()
    odd = [(9001, None), (9002, []), (9003, [1.0] * 23 + [None]), (9004, [1.0] * 23 + [float("nan")]), (9005, [1.0] * 23 + [float("inf")]),
           (9006, [1.0, 2.0]), (9007, [3e38] * 24)]
    check(spark, vectors, odd)


@pytest.mark.parametrize("parts", [1, 40])
def test_many_spectra_make_one(spark, parts, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 3)
    rng = np.random.default_rng(2)
    base = (rng.standard_normal((200, 10)) * np.linspace(0.2, 3, 10)).astype(np.float32)
    check(spark, [*base.tolist(), [0.0] * 10, *base[:50].tolist()], parts=parts)


def test_fewer_dimensions_than_components(spark):
    rng = np.random.default_rng(3)
    check(spark, (rng.standard_normal((60, 3)) * [1, 2, 3]).astype(np.float32).tolist())


def test_flat_directions_repeated_rows_and_empty_tables(spark):
    out = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 0.0]), (1, [1.0, 2.0, 0.0]), (None, [2.0, 2.0, 0.0])], "vec_id long, vector array<float>"), "vec_id", "vector").collect()
    assert len(out) == 9 and {r.component for r in out if r.whitened is None} == {2, 3}
    assert [r.deviation for r in out if r.id is None] == [(3 * 1024 * 2 - 1024 * 4) ** 2] * 3
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, vector array<float>"), "vec_id", "vector").collect()
    assert [(r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(0, None, None, None)] * 2
    for rows in ([], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, vector array<float>"), "vec_id", "vector").count() == 0


@pytest.mark.parametrize("kind", ["plain", "repeated", "low rank", "graded", "zero rows"])
def test_rank_one_updates(kind):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 20)) * 50
    if kind == "repeated":
        x = np.repeat(x[:15], 20, axis=0)
    if kind == "low rank":
        x[:, 6:] = 0
    if kind == "graded":
        x *= np.logspace(0, -7, 20)
    if kind == "zero rows":
        x[::2] = 0
    values, basis = whitening.absorb(np.zeros(20), np.eye(20), x)
    full = x.T @ x
    top = np.linalg.eigvalsh(full)[-1]
    assert np.abs(values - np.linalg.eigvalsh(full)).max() < 1e-12 * top
    assert np.abs(basis.T @ basis - np.eye(20)).max() < 1e-12
    assert np.abs(basis * values @ basis.T - full).max() < 1e-7 * top


def test_secular_roots_lie_between_the_poles():
    d, z = np.array([0.0, 1.0, 1.5, 4.0]), np.array([0.3, -1e-6, 2.0, 0.1])
    pole, off = whitening.secular_roots(d, z)
    want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
    assert np.allclose(d[pole] + off, want, rtol=0, atol=1e-14)


def test_deviations_beyond_64_bits_are_null():
    fit = whitening.Fit(2, 10**9, [10**9 * 100_000, 10**9 * 100_000 + 5])
    got = fit.deviations(np.array([[100_000, 100_000], [100_001, 100_000], [100_000 + 10**6, 100_000]], dtype=np.int64))
    assert got.to_pylist() == [25, 10**18 + 25, None]
