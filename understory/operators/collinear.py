"""Collinearity checks: pairwise correlation with tests, variance inflation."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from understory.functions.student import holm, two_sided_p
from understory.operators.gram import pairwise_moments
from understory.operators.prepare import complete_cases

PAIR_SCHEMA = (
    "term_a string, term_b string, n long, r double, t double, p double, p_holm double, high boolean"
)


def corr_pairs(df: DataFrame, columns: list[str], threshold: float = 0.7) -> DataFrame:
    """Pearson r of every column pair with its t, p and Holm-adjusted p.

    The row-wise work is two aggregates; the tests are done on the p(p-1)/2
    correlations that come back.
    """
    correlation, count = pairwise_moments(df, columns)
    pairs = list(combinations(range(len(columns)), 2))
    r = np.array([correlation[i, j] for i, j in pairs])
    n = np.array([count[i, j] for i, j in pairs])
    with np.errstate(divide="ignore", invalid="ignore"):
        t = r * np.sqrt((n - 2) / (1.0 - r * r))
    p = np.array([two_sided_p(a, b) for a, b in zip(t, n - 2.0)])
    known = ~np.isnan(p)
    adjusted = np.full(len(p), np.nan)
    adjusted[known] = holm(p[known])

    def number(x: float) -> float | None:
        return None if np.isnan(x) else float(x)

    rows = [
        (
            columns[i], columns[j], int(n[k]),
            number(r[k]), number(t[k]), number(p[k]), number(adjusted[k]),
            bool(abs(r[k]) >= threshold),
        )
        for k, (i, j) in enumerate(pairs)
    ]
    return df.sparkSession.createDataFrame(rows, PAIR_SCHEMA)


def vif(df: DataFrame, columns: list[str]) -> DataFrame:
    """Variance inflation of each design column, ordinary least squares weights."""
    complete = complete_cases(df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in columns]))
    correlation, _ = pairwise_moments(complete, columns)
    inflation = np.diag(np.linalg.inv(correlation))
    return df.sparkSession.createDataFrame(
        [(c, float(v)) for c, v in zip(columns, inflation)], "term string, vif double"
    )
