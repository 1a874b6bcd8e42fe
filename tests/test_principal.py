"""Components by joins against a dense decomposition."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators.principal import principal_components, project


def frame(spark, dense):
    rows = [(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense))]
    return spark.createDataFrame(rows, "row long, at long, value double").repartition(3)


def sparse(n, width, seed=0):
    rng = np.random.default_rng(seed)
    out = np.zeros((n, width))
    for i in range(n):
        out[i, rng.integers(0, 20, 6)] += rng.integers(1, 9) * (1 + rng.integers(0, 20, 6) % 3)
        out[i, rng.integers(0, width, 3)] += 1
    return out


def test_against_dense_decomposition(spark):
    dense = sparse(90, 300)
    dense[5] = 0  # a row without entries
    found = principal_components(frame(spark, dense), len(dense), 4)
    centred = dense - dense.mean(axis=0)
    _, values, vectors = np.linalg.svd(centred, full_matrices=False)
    assert np.allclose(found.variance, values[:4] ** 2 / 89, rtol=1e-3)
    assert found.total == pytest.approx((centred**2).sum() / 89)
    parts = {r.at: r.part for r in found.parts.collect()}
    got = np.array([parts.get(j, [0.0] * 4) for j in range(300)])
    assert np.allclose(got.T @ got, np.eye(4), atol=1e-8)
    assert np.allclose(np.abs((got * vectors[:4].T).sum(axis=0))[:2], 1, atol=1e-2)
    assert all(got[np.abs(got[:, j]).argmax(), j] > 0 for j in range(4))
    scores = {r.row: r.scores for r in project(frame(spark, dense), found.parts, 4).collect()}
    assert set(scores) == set(range(90)) - {5}
    assert np.allclose([scores[i] for i in sorted(scores)], np.delete(dense, 5, axis=0) @ got)


def test_fewer_directions_than_asked_for(spark):
    # two independent directions only, and a place that is the same everywhere
    dense = np.array([[1, 2, 0, 5], [2, 4, 0, 5], [0, 0, 3, 5], [1, 2, 3, 5], [3, 6, 1, 5]], dtype=float)
    found = principal_components(frame(spark, dense), 5, 4)
    want = np.sort(np.linalg.eigvalsh(np.cov(dense.T)))[::-1]
    assert np.allclose(found.variance[:2], want[:2]) and np.allclose(found.variance[2:], 0, atol=1e-9)
    assert found.total == pytest.approx(np.trace(np.cov(dense.T)))


def test_repeated_and_null_entries(spark):
    rows = [(1, 0, 1.0), (1, 0, 2.0), (2, 0, None), (3, 0, 6.0), (2, 1, 1.0)]
    found = principal_components(spark.createDataFrame(rows, "row int, at int, value double"), 4, 2)
    dense = np.array([[3, 0], [0, 1], [6, 0], [0, 0]], dtype=float)
    assert np.allclose(found.variance, np.sort(np.linalg.eigvalsh(np.cov(dense.T)))[::-1])


def test_nothing(spark):
    empty = spark.createDataFrame([], "row int, at int, value double")
    found = principal_components(empty, 0, 3)
    assert found.variance == [] and found.total == 0 and found.parts.count() == 0
    same = principal_components(spark.createDataFrame([(1, 0, 2.0)], "row int, at int, value double"), 1, 3)
    assert same.variance == []
