import numpy as np
import pytest

from canopy.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, v string, at int, n string"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if e is None else float(e) for e in v], 0, "x", 1, "y") for i, v in zip(ids, vectors)], SCHEMA)


def brute(vectors):
    c = np.array(vectors, np.float32).astype(float)
    x = np.floor(1024 * c) + 100_000
    v = np.cov(x.T, bias=True).reshape(x.shape[1], -1)
    values, parts = np.linalg.eigh(v)
    values, parts = values[::-1], parts[:, ::-1]
    return x, values, (x - x.mean(0)) @ parts / np.sqrt(np.where(values > 0, values, 1)), np.trace(v)


@pytest.mark.parametrize("size", [2, 5, 12])
def test_rows_equal_an_eigendecomposition(spark, size):
    rng = np.random.default_rng(size)
    vectors = rng.standard_normal((60, size)) @ np.diag(np.linspace(1, 3, size)) + 5
    x, values, w, trace = brute(vectors)
    got = whitening.whiten(frame(spark, vectors)).collect()
    width = min(8, size)
    assert len(got) == 60 * width
    found = np.zeros((60, width))
    for r in got:
        found[r.vec_id, r.component - 1] = r.whitened
        assert abs(r.explained - values[r.component - 1] / trace) < 1e-12
        z = [60 * int(e) - int(s) for e, s in zip(x[r.vec_id], x.sum(0))]
        assert (r.n, r.deviation) == (60, sum(e * e for e in z))
        assert r.identity_error < 1e-10
    for c in range(width):
        assert min(np.abs(found[:, c] - w[:, c]).max(), np.abs(found[:, c] + w[:, c]).max()) < 1e-9


def test_small_eigenvalues_stay_accurate():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((6, 6)))
    scale = np.logspace(0, -5, 6)
    graded = np.diag(scale) @ (np.eye(6) + 0.1 * (q + q.T)) @ np.diag(scale)
    values, parts = whitening.one_sided_jacobi(whitening.pivoted_cholesky(graded))
    # A determinant is the product of all eigenvalues; the least of them is 1e-10 of the greatest.
    wanted = np.linalg.det(np.eye(6) + 0.1 * (q + q.T)) * np.prod(scale) ** 2
    assert abs(np.prod(values) / wanted - 1) < 1e-12
    assert np.abs(parts.T @ parts - np.eye(6)).max() < 1e-14


def test_factor_is_triangular_up_to_the_pivots_and_stops_at_the_rank():
    a = np.array([[1.0, 2, 3], [2, 4, 6], [3, 6, 9.5]])
    factor = whitening.pivoted_cholesky(a)
    assert factor.shape == (3, 2) and np.allclose(factor @ factor.T, a)
    assert (np.abs(factor[2]) > 0).tolist() == [True, False]  # the greatest diagonal came first
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def test_integers_and_products_are_exact():
    y = np.array([[1 << 40, 3], [5, -(1 << 40)], [7, 9]])
    wide = y.astype(object)
    assert (whitening.products(y) == wide.T @ wide).all()
    assert whitening.integers([[0.5, -0.0001], [1e300, -1e300]], 2).tolist()[0] == [100_512, 99_999]


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    good = rng.standard_normal((30, 4)).tolist()
    bad = [None, [], [1, None, 2, 3], [float("nan"), 1, 2, 3], [float("inf"), 1, 2, 3], [1, 2, 3], [0, 0, 0, 0], good[0]]
    ids = [*range(30), *range(100, 106), 200, None]
    got = whitening.whiten(frame(spark, good + bad, ids)).collect()
    seen = [r.vec_id for r in got if r.component == 1]
    assert sorted(map(str, seen)) == sorted(map(str, [*range(30), 200, None]))
    assert {r.n for r in got} == {32} and all(r.identity_error < 1e-10 for r in got)
    first = {r.component: r.whitened for r in got if r.vec_id == 0}
    assert first == {r.component: r.whitened for r in got if r.vec_id is None}


def test_few_rows_empty_tables_and_small_ranks(spark):
    assert whitening.whiten(frame(spark, [[1, 2]]).limit(0)).collect() == []
    assert whitening.whiten(frame(spark, [None, []])).collect() == []
    assert whitening.whiten(frame(spark, [[1, 2]])).collect() == []  # no spread, no component
    line = whitening.whiten(frame(spark, [[0, 0, 0], [1, 2, 3], [2, 4, 6]])).collect()
    assert [r.component for r in line] == [1, 1, 1] and abs(line[0].explained - 1) < 1e-12


def test_deviations_beyond_long_are_null(spark):
    got = whitening.whiten(frame(spark, [[1e9, 0], [-1e9, 1], [0, 3]])).collect()
    assert {r.deviation for r in got if r.vec_id in (0, 1)} == {None}
    assert all(abs(r.whitened) < 3 for r in got)
