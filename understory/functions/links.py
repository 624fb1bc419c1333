"""Link functions and log densities as column expressions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, functions as F


def inverse_logit(eta: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-eta))


def lognormal_mean(eta: Column, sigma: float | Column) -> Column:
    """Mean of a lognormal variable from its log-scale location and spread."""
    sigma = sigma if isinstance(sigma, Column) else F.lit(float(sigma))
    return F.exp(eta + sigma * sigma / 2)


def log_gamma(x: Column) -> Column:
    """ln(gamma(x)) for x > 0: Stirling's series after a shift by eight."""
    z = x + 8
    product = x
    for step in range(1, 8):
        product = product * (x + step)
    z2 = z * z
    series = (
        F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - F.lit(1 / 1680) / z2) / z2) / z2
    ) / z
    return (z - 0.5) * F.ln(z) - z + F.lit(0.5 * math.log(2 * math.pi)) + series - F.ln(product)


def log_gamma_array(x: np.ndarray) -> np.ndarray:
    """``log_gamma`` of an array."""
    z = x + 8.0
    product = x.copy() if x.ndim else x
    for step in range(1, 8):
        product = product * (x + step)
    z2 = z * z
    series = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / z2) / z2) / z2) / z
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - np.log(product)


def log_gamma_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``log_gamma_array`` of both, added up, with one logarithm for what both are shifted by."""
    total, products = None, None
    for x in (a, b):
        z = x + 8.0
        product = x.copy()
        for step in range(1, 8):
            product *= x + step
        inverse = np.reciprocal(z)
        square = inverse * inverse
        series = square * (-1 / 1680)
        for c in (1 / 1260, -1 / 360, 1 / 12):
            series += c
            series *= square if c != 1 / 12 else inverse
        part = np.log(z)
        part *= x + 7.5
        part += series
        part -= z
        if total is None:
            total, products = part, product
        else:
            total += part
            products *= product
    total -= np.log(products)
    total += math.log(2 * math.pi)
    return total


def digamma_array(x: np.ndarray) -> np.ndarray:
    """Derivative of ln(gamma(x)) for x > 0: the asymptotic series after a shift by ten."""
    z = x + 10.0
    z2 = z * z
    series = (1 / 12 - (1 / 120 - (1 / 252 - (1 / 240 - 1 / 132 / z2) / z2) / z2) / z2) / z2
    return np.log(z) - 0.5 / z - series - sum(1.0 / (x + k) for k in range(10))


def trigamma_array(x: np.ndarray) -> np.ndarray:
    """Second derivative of ln(gamma(x)) for x > 0."""
    z = x + 10.0
    z2 = z * z
    series = (1 / 6 - (1 / 30 - (1 / 42 - (1 / 30 - 5 / 66 / z2) / z2) / z2) / z2) / (z2 * z)
    return 1.0 / z + 0.5 / z2 + series + sum(1.0 / (x + k) ** 2 for k in range(10))


def normal_log_density(y: Column, mean: Column, sd: Column) -> Column:
    return (
        F.lit(-0.5 * math.log(2 * math.pi)) - F.ln(sd) - F.pow((y - mean) / sd, F.lit(2.0)) / 2
    )


def beta_log_density(y: Column, mean: Column, precision: Column) -> Column:
    a, b = mean * precision, (F.lit(1.0) - mean) * precision
    return (
        log_gamma(precision) - log_gamma(a) - log_gamma(b)
        + (a - 1) * F.ln(y) + (b - 1) * F.ln(F.lit(1.0) - y)
    )


def bernoulli_log_density(y: Column, mean: Column) -> Column:
    return F.when(y == 1, F.ln(mean)).otherwise(F.ln(F.lit(1.0) - mean))
