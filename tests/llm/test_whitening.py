"""Whitening against numpy's symmetric solver, exact fractions and hand-made matrices."""

from fractions import Fraction
from math import floor

import numpy as np
import pytest

from supplyscope.llm import whitening as ops

TABLE = "vec_id long, embedding array<float>, label int, id string, vec string, w string, n long"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 0, "i", "v", "w", 1) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, TABLE)


def exact_polynomial(matrix):
    """Coefficients, constant first, by traces and powers over fractions."""
    d = len(matrix)
    m = [[Fraction(int(x)) for x in row] for row in matrix]
    c, b = [Fraction(0)] * (d + 1), [[Fraction(i == j) for j in range(d)] for i in range(d)]
    c[d] = Fraction(1)
    for k in range(1, d + 1):
        b = [[sum(m[i][t] * b[t][j] for t in range(d)) for j in range(d)] for i in range(d)]
        c[d - k] = -sum(b[i][i] for i in range(d)) / k
        for i in range(d):
            b[i][i] += c[d - k]
    return [int(x) for x in c]


@pytest.mark.parametrize("d,rank,seed", [(1, 1, 0), (2, 2, 1), (6, 6, 2), (9, 5, 3), (12, 12, 4)])
def test_polynomial(spark, d, rank, seed):
    half = np.random.default_rng(seed).integers(-999, 999, (rank, d)).astype(object)
    matrix = half.T @ half
    assert ops.characteristic_polynomial(spark, matrix) == exact_polynomial(matrix)


def test_polynomial_needs_row_exchange(spark):
    matrix = np.array([[5, 0, 0, 2], [0, 4, 0, 0], [0, 0, 3, 0], [2, 0, 0, 5]], object)
    assert ops.characteristic_polynomial(spark, matrix) == exact_polynomial(matrix)


def product(roots):
    out = [1]
    for r in roots:
        out = [(out[k - 1] if k else 0) - r * (out[k] if k < len(out) else 0) for k in range(len(out) + 1)]
    return out


def test_roots_with_repeats_and_zeros():
    got = ops.largest_roots(product([7, 7, 7, 3, 0, 0, 10**12, 10**12 + 1]), 8)
    values = [(Fraction(a, 1 << b), t) for a, b, t in got]
    assert [t for _, t in values] == [1, 1, 3, 1]
    for (value, _), want in zip(values, (10**12 + 1, 10**12, 7, 3)):
        assert abs(value - want) <= Fraction(want, 1 << 150)
    assert [t for *_, t in ops.largest_roots(product([5, 4, 4, 4, 1]), 2)] == [1, 3]
    assert ops.largest_roots(product([0, 0]), 2) == []


def test_close_roots_have_their_own_vectors():
    big = 10**30
    matrix = np.array([[big, 1, 0], [1, big, 0], [0, 0, 7]], object)  # eigenvalues 10^30 +- 1: equal as doubles
    first, second = ops.largest_roots([-7 * (big * big - 1), big * big - 1 + 14 * big, -(2 * big + 7), 1], 2)
    (u,), (v,) = ops.null_space(matrix, *first), ops.null_space(matrix, *second)
    assert np.allclose(u, [2**-0.5, 2**-0.5, 0], atol=1e-15)
    assert np.allclose(np.abs(v), [2**-0.5, 2**-0.5, 0], atol=1e-15) and abs(u @ v) < 1e-15


def check(rows, vectors, ids):
    x = np.array([[floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors], dtype=object)
    n, d = x.shape
    total = x.sum(axis=0)
    centred = (n * x - total).astype(np.float64) / n
    cov = centred.T @ centred / n
    values, units = np.linalg.eigh(cov)
    values, units = values[::-1], units[:, ::-1]
    got = {}
    for r in rows:
        assert (r["vec_id"], r["component"]) not in got
        got[r["vec_id"], r["component"]] = r
    k = min(8, d)
    assert set(got) == {(i, c) for i in ids for c in range(1, k + 1)}
    for c in range(1, k + 1):
        want = centred @ units[:, c - 1] / np.sqrt(values[c - 1])
        mine = np.array([got[i, c]["whitened"] for i in ids])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-9
        assert got[ids[0], c]["explained"] == pytest.approx(values[c - 1] / np.trace(cov), rel=1e-9)
    for i, row in zip(ids, x):
        assert int(got[i, 1]["deviation"]) == sum((n * v - s) ** 2 for v, s in zip(row, total))
    assert {r["n"] for r in rows} == {n} and max(r["identity_error"] for r in rows) < 1e-9


@pytest.mark.parametrize("n,d", [(300, 12), (40, 3), (50, 1)])
def test_against_numpy(spark, n, d):
    vectors = np.random.default_rng(d).normal(size=(n, d)) * np.linspace(1, 3, d)
    check(ops.whiten(table(spark, vectors)).collect(), vectors, list(range(n)))


def test_large_numbers_stay_exact(spark):
    vectors = np.random.default_rng(8).normal(size=(60, 4)) * 2.0**28
    check(ops.whiten(table(spark, vectors)).collect(), vectors, list(range(60)))


def test_too_large_entry_is_an_error(spark):
    with pytest.raises(Exception, match="would not be exact"):
        ops.whiten(table(spark, [[1e30, 0.0], [0.0, 1.0]])).collect()


def test_left_out_rows(spark):
    good = np.random.default_rng(2).normal(size=(20, 3))
    bad = [None, [1, None, 2], [1, float("nan"), 2], [float("inf"), 0, 0], [1, 2], []]
    rows = ops.whiten(table(spark, [*good, *bad])).collect()
    check(rows, good, list(range(20)))


def test_no_variance_and_nulls(spark):
    rows = ops.whiten(table(spark, [[1, 2, 3, 4]] * 5, [1, 1, 2, 3, None])).collect()
    assert len(rows) == 20
    assert {(r["whitened"], r["explained"], r["identity_error"], int(r["deviation"])) for r in rows} == {(None, 0.0, 0.0, 0)}
    # two rows span one direction
    rows = ops.whiten(table(spark, [[0, 0, 1], [0, 1, 0]])).collect()
    assert sorted((r["component"], r["whitened"] is None, r["explained"] == pytest.approx(1.0)) for r in rows) == sorted([(1, False, True), (2, True, False), (3, True, False)] * 2)
    assert sorted(abs(r["whitened"]) for r in rows if r["component"] == 1) == pytest.approx([1, 1])


def test_equal_eigenvalues(spark):
    vectors = [[s * (i == k) for i in range(5)] for k in range(5) for s in (-1, 1)] * 2
    rows = ops.whiten(table(spark, vectors)).collect()
    assert len(rows) == 100 and max(r["identity_error"] for r in rows) < 1e-12
    assert all(r["explained"] == pytest.approx(0.2) for r in rows)


def test_nothing(spark):
    assert ops.whiten(spark.createDataFrame([], TABLE)).collect() == []
    assert ops.whiten(table(spark, [[], [], None])).collect() == []


def test_registered_query(spark):
    from supplyscope.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    given = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    df = QUERIES["op11_whitening"](spark, sf)
    assert dict(df.dtypes)["deviation"] == "bigint"
    check(df.collect(), [r["embedding"] for r in given], [r["vec_id"] for r in given])
