"""Whitening against a dense eigendecomposition; unusual vectors; rows in a subspace."""

import math

import numpy as np
import pytest

from surtido.llm.bidiagonal_whitening import fit, whiten

KINDS = "vec_id long, embedding array<float>, n long, x string, rows string, component int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x", "r", 3) for i, v in rows], KINDS).repartition(3)


def whole(vectors, dims):
    x = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        x[i, : len(v)] = np.floor(64 * np.array(v, dtype=np.float32).astype(float))
    return x + 1_000_000


def compare(found, ids, vectors, components=32):
    """``found`` rows against the dense solution; ids must be distinct."""
    dims = max(map(len, vectors))
    x = whole(vectors, dims)
    n = len(x)
    centred = x - x.mean(axis=0)
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1], q[:, ::-1]
    m = min(components, np.linalg.matrix_rank(centred, tol=1e-8 * np.abs(centred).max()))
    z = centred @ q[:, :m] / np.sqrt(e[:m])
    got = np.full((n, m), np.nan)
    place = {i: k for k, i in enumerate(ids)}
    far = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, x.sum(axis=0))) for row in x]
    for r in found:
        got[place[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == far[place[r.vec_id]] and r.identity_error < 1e-8
        assert math.isclose(r.explained, e[r.component - 1] / e.sum(), rel_tol=1e-9)
    assert len(found) == n * m
    sign = np.sign((got * z).sum(axis=0))
    assert np.abs(got - sign * z).max() < 1e-6


def test_dense(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.standard_normal((300, 40)) @ np.diag(1.15 ** -np.arange(40.0)) + 5).astype(np.float32).tolist()
    found = whiten(table(spark, list(enumerate(vectors))), rows_each=37)
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(found.collect(), range(300), vectors)


def test_few_rows_subspace_and_short_vectors(spark):
    rng = np.random.default_rng(4)
    few = rng.standard_normal((5, 12)).tolist()
    compare(whiten(table(spark, list(enumerate(few)))).collect(), range(5), few)
    flat = np.repeat(rng.standard_normal((20, 3)), 2, axis=1).tolist()
    compare(whiten(table(spark, list(enumerate(flat)))).collect(), range(20), flat)
    short = [v[: 3 + i % 4] for i, v in enumerate(rng.standard_normal((30, 6)).tolist())] + [[]]
    compare(whiten(table(spark, list(enumerate(short)))).collect(), range(31), short)


def test_what_takes_no_part(spark):
    rng = np.random.default_rng(5)
    good = rng.standard_normal((9, 4)).tolist()
    bad = [(20, None), (21, [1.0, None, 2.0, 3.0]), (22, [1.0, math.nan, 2.0, 3.0]), (23, [math.inf, 1.0, 1.0, 1.0])]
    compare(whiten(table(spark, [*enumerate(good), *bad])).collect(), range(9), good)
    # A null id, a repeated row and a repeated id are rows each.
    more = [*enumerate(good), (None, good[0]), (3, good[3]), (3, good[1])]
    found = whiten(table(spark, more)).collect()
    assert len(found) == 12 * 4 and {r.n for r in found} == {12} and max(r.identity_error for r in found) < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [])], [(1, [1.0]), (2, [1.0])]])
def test_nothing_varies(spark, rows):
    assert whiten(table(spark, rows)).collect() == []


def test_far_entries(spark):
    rows = [(i, [1e30 if i else 0.0, float(i)]) for i in range(3)]
    found = whiten(table(spark, rows)).collect()
    assert found and all(r.deviation is None for r in found)


def test_exact_sums(spark):
    vectors = [[float(i), -float(i)] for i in range(100)]
    centred = fit(table(spark, list(enumerate(vectors))), 7, "vec_id", "embedding")
    assert [int(s) for s in whole(vectors, 2).sum(axis=0)] == [centred.n * a + b for a, b in zip(centred.low, centred.rest)]
