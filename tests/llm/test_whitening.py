"""Whitening against exact fractions, and the registered query."""

from fractions import Fraction
from math import floor, inf, nan

import numpy as np
import pytest

from gleaner.llm import queries, whitening

KIND = "vec_id long, embedding array<float>, label string, n long, component string"


def brute(vectors, components, scale=64, offset=1_000_000):
    """n, x, deviations, covariance by fractions, eigenvalues."""
    x = np.array([[floor(scale * c) + offset for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    c = n * x - s  # centred before multiplying
    v = np.array([[float(Fraction(int(p), n**3)) for p in row] for row in c.T @ c])
    e, w = np.linalg.eigh(v)
    centred = np.array([[float(Fraction(int(p), n)) for p in row] for row in c])
    return n, (c * c).sum(axis=1).tolist(), centred @ w[:, ::-1][:, :components] / np.sqrt(e[::-1][:components]), e[::-1][:components] / np.trace(v)


def hold(got, ids, vectors, components):
    n, deviation, white, explained = brute(vectors, components)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(got) == len(ids) * components
    sign = [np.sign(by[ids[0], c + 1].whitened * white[0, c]) for c in range(components)]
    for at, i in enumerate(ids):
        for c in range(components):
            r = by[i, c + 1]
            assert r.n == n and r.deviation == deviation[at] and r.identity_error < 1e-9
            assert abs(r.whitened * sign[c] - white[at, c]) < 1e-7 and abs(r.explained - explained[c]) < 1e-9


def test_against_fractions(spark):
    rng = np.random.default_rng(3)
    data = (rng.normal(size=(60, 5)) * [5, 3, 2, 1, 0.5]).astype(np.float32)
    data[7] = data[8]
    rows = [(i, [float(c) for c in v], "x", 5, "y") for i, v in enumerate(data)]
    odd = [(100, None, "x", 1, "y"), (101, [1.0, None, 1.0, 1.0, 1.0], "x", 1, "y"), (102, [nan, 1.0, 1.0, 1.0, 1.0], None, 1, "y"), (103, [inf, 1.0, 1.0, 1.0, 1.0], "x", 1, "y"), (104, [], "x", 1, "y")]
    frame = spark.createDataFrame(rows + odd, KIND).repartition(3)
    got = whitening.whiten(frame, components=4)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    hold(got.collect(), list(range(60)), data.tolist(), 4)
    # No result depends on the shift.
    same = {(r.vec_id, r.component): abs(r.whitened) for r in whitening.whiten(frame, components=4, shift=-77).collect()}
    assert all(abs(same[r.vec_id, r.component] - abs(r.whitened)) < 1e-9 for r in got.collect())


def test_large_integers_stay_exact(spark):
    # Products far beyond 2^53 and deviations beyond 2^63.
    vectors = [[float(2**40 + 3 * i), float((-1) ** i * 2**45), float(i)] for i in range(9)]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(2)
    _, deviation, _, _ = brute(vectors, 2)
    got = {r.vec_id: int(r.deviation) for r in whitening.whiten(frame, components=2).collect()}
    assert got == dict(enumerate(deviation)) and max(deviation) > 2**63
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [5.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(huge).collect()
    assert {r.vec_id for r in got} == {1, 2, 3} and all(np.isfinite(r.whitened) for r in got)


@pytest.mark.parametrize("v", [0, 1, -1, 2**31 - 1, 2**31, -(2**31), -(2**31) - 1, 3**80, -(3**80)])
def test_limbs(v):
    assert sum(x << whitening.LIMB * k for k, x in enumerate(whitening.limbs(v))) == v


def test_cross_products():
    rng = np.random.default_rng(1)
    for most in (3, 2**19, 2**21, 2**40, 2**62):
        y = rng.integers(-most, most, (17, 3))
        want = y.astype(object).T @ y.astype(object)
        assert (whitening.cross_products(y) == want).all()


def test_no_variance_and_lengths(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 3.0]), (4, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 3.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    # One dimension varies in the vectors of two entries; none in those of three.
    assert sorted((r.vec_id or 0, r.component, r.n) for r in got) == [(0, 1, 3), (1, 1, 3), (1, 1, 3)]
    assert all(abs(r.explained - 1) < 1e-12 and r.identity_error < 1e-9 for r in got)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(none).count() == 0


def test_query(spark, sf_dir):
    got = queries.QUERIES["op12_whitening"](spark, sf_dir)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = sorted(((r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()), key=lambda x: x[0])
    hold(got.collect(), [r[0] for r in rows], [r[1] for r in rows], 32)
