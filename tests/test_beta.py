import math

import numpy as np
import pytest

from understory.functions import links
from understory.operators import fit
from understory.operators.design import Formula


def test_derivatives_of_log_gamma():
    x = np.array([0.01, 0.3, 1.0, 2.5, 40.0, 1e4])
    assert links.digamma_array(np.array([1.0, 0.5])) == pytest.approx([-0.5772156649015329, -1.9635100260214235], abs=1e-12)
    assert links.trigamma_array(np.array([1.0, 0.5])) == pytest.approx([math.pi**2 / 6, math.pi**2 / 2], rel=1e-12)
    h = 1e-5 * x
    slope = np.array([(math.lgamma(a + d) - math.lgamma(a - d)) / (2 * d) for a, d in zip(x, h)])
    assert links.digamma_array(x) == pytest.approx(slope, rel=1e-6)
    curve = (links.digamma_array(x + h) - links.digamma_array(x - h)) / (2 * h)
    assert links.trigamma_array(x) == pytest.approx(curve, rel=1e-6)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    x = rng.normal(size=6000)
    mu = 1 / (1 + np.exp(-(0.3 + 1.2 * x)))
    y = np.clip(rng.beta(mu * 0.8, (1 - mu) * 0.8), 1e-300, 1 - 1e-12)
    return x, y


def log_likelihood(x, y, b0, b1, phi):
    mu = 1 / (1 + np.exp(-(b0 + b1 * x)))
    g = np.vectorize(math.lgamma)
    return (math.lgamma(phi) - g(mu * phi) - g((1 - mu) * phi) + (mu * phi - 1) * np.log(y) + ((1 - mu) * phi - 1) * np.log1p(-y)).sum()


def test_estimate_is_where_the_likelihood_is_highest(spark, rows):
    x, y = rows
    frame = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    found = fit.fit_beta(frame, Formula("y", ("x",)))
    at = np.array([*found.coef, found.scale])
    top = log_likelihood(x, y, *at)
    for k in range(3):
        for d in (-1, 1):
            moved = at.copy()
            moved[k] *= 1 + d * 1e-3
            assert log_likelihood(x, y, *moved) < top
        h = 1e-4 * abs(at[k])
        up, down = at.copy(), at.copy()
        up[k] += h
        down[k] -= h
        slope = (log_likelihood(x, y, *up) - log_likelihood(x, y, *down)) / (2 * h)
        assert abs(slope) < 1e-2
    assert found.scale == pytest.approx(0.8, rel=0.05) and found.coef == pytest.approx([0.3, 1.2], abs=0.1)
    # Deviations are those of the curvature.
    h = 1e-3
    curve = -(log_likelihood(x, y, at[0] + h, *at[1:]) - 2 * top + log_likelihood(x, y, at[0] - h, *at[1:])) / h**2
    assert found.cov[0, 0] > 1 / curve * 0.9


def test_responses_outside_are_refused(spark):
    frame = spark.createDataFrame([(0.1, 0.2), (0.5, 1.0), (0.3, 0.4)], "x double, y double")
    with pytest.raises(ValueError, match="support"):
        fit.fit_beta(frame, Formula("y", ("x",)))
