"""Summaries over draws, and sums that meet combinations of levels instead of rows."""

import numpy as np
import pyarrow as pa
import pytest

from understory.functions import noise
from understory.operators import predict


@pytest.mark.parametrize("kind", ["normal", "skewed", "two values", "few"])
def test_bounds_are_the_quantiles(kind):
    rng = np.random.default_rng(1)
    y = {"normal": rng.normal(size=(20, 8000)), "skewed": np.exp(3 * rng.normal(size=(20, 801))), "two values": rng.integers(0, 2, (20, 100)) * 1.0, "few": rng.normal(size=(20, 3))}[kind]
    mean, spread, bounds = predict._summary(y)
    np.testing.assert_allclose(bounds, np.quantile(y, [0.025, 0.975], axis=1), rtol=1e-12)
    np.testing.assert_array_equal(mean, y.mean(1))
    np.testing.assert_array_equal(spread, y.std(1, ddof=1))


def test_deviates_are_those_of_the_cosine():
    keys, draws = np.array([5, -77, 2**62]), np.arange(1, 2001)
    u = [noise.uniforms(keys, draws, k, 3) for k in (0, 1)]
    np.testing.assert_allclose(noise.normals(keys, draws, 3), np.sqrt(-2 * np.log(u[0])) * np.cos(2 * np.pi * u[1]), atol=1e-13)


def test_sums_of_combinations_equal_those_of_rows(monkeypatch):
    rng = np.random.default_rng(2)
    n, numbers = 300, np.arange(1, 41)
    beta = rng.normal(size=(40, 3))
    levels = [rng.integers(0, k, n) for k in (4, 5)]
    columns = {"__trials": np.ones(n), "__x0": rng.normal(50, 2, n), "__x1": rng.normal(0, 1, n), "__key": np.arange(n), "__y": rng.normal(100, 3, n)}
    for i, level in enumerate(levels):
        columns |= {f"__key{i}": level + 10, f"__mean{i}": level / 3.0, f"__error{i}": 0.1 + level / 10.0}
    batch = pa.RecordBatch.from_pydict(columns)
    eta = np.vstack([e.copy() for _, _, _, e, _ in predict._chunks(batch, numbers, beta, 1, ["__y"])])
    met = []
    monkeypatch.setattr(predict, "normals", lambda keys, *a: met.append(len(keys)) or noise.normals(keys, *a))
    total, squares, off, off_squares, rows = predict._linear_sums(batch, numbers, beta, 1, 90.0)
    assert sum(met) == 9 and (rows == n).all()
    error = columns["__y"][:, None] - eta
    np.testing.assert_allclose(total, (eta - 90).sum(0), rtol=1e-9)
    np.testing.assert_allclose(squares, ((eta - 90) ** 2).sum(0), rtol=1e-9)
    np.testing.assert_allclose(off, error.sum(0), rtol=1e-9)
    np.testing.assert_allclose(off_squares, (error**2).sum(0), rtol=1e-9)
