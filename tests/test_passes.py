"""Cross-products read their rows once, and lose no digits where tasks differ."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from understory.operators.gram import gram, gram_by, pairwise_moments


@pytest.fixture()
def counted(spark):
    """Rows far from zero, unlike from task to task, with missing values, and the number of rows read so far."""
    rng = np.random.default_rng(5)
    n = 4000
    a = rng.normal(1e6, 1.0, n) + np.arange(n) / 100
    b, y = rng.normal(-3e5, 2.0, n), rng.normal(0, 1, n)
    b[::7] = np.nan
    y = y + 0.3 * (a - a.mean())
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    arrow = pa.table({"row_id": np.arange(n), "a": a, "b": b, "y": y, "one": np.ones(n) * 0.1})
    plain = spark.createDataFrame(arrow).repartitionByRange(5, "row_id")
    return plain.mapInArrow(count, plain.schema), read, a, b, y


def test_gram_is_one_pass(counted):
    frame, read, a, b, y = counted
    g = gram(frame, ["a", "b"], F.col("y"))
    assert read.value == 4000
    kept = ~np.isnan(b)
    x = np.column_stack([np.ones(kept.sum()), a[kept] - a[kept].mean(), b[kept] - b[kept].mean()])
    coef, residual = g.coefficients()
    want, rest, *_ = np.linalg.lstsq(x, y[kept], rcond=None)
    assert g.n == kept.sum()
    np.testing.assert_allclose(coef[1:], want[1:], rtol=1e-9)
    assert residual == pytest.approx(rest[0], rel=1e-9)


def test_folds_share_the_shift_and_add_up(counted):
    frame, read, *_ = counted
    parts = gram_by(frame, ["a"], F.col("y"), group=F.pmod("row_id", F.lit(3)))
    assert read.value == 4000
    assert sorted(parts) == [0, 1, 2]
    total = parts[0] + parts[1] + parts[2]
    np.testing.assert_allclose(total.coefficients()[0], gram(frame, ["a"], F.col("y")).coefficients()[0], rtol=1e-9)


def test_correlations_are_one_pass(counted):
    frame, read, a, b, y = counted
    r, n = pairwise_moments(frame, ["a", "b", "y"])
    assert read.value == 4000
    kept = ~np.isnan(b)
    assert r[0, 1] == pytest.approx(np.corrcoef(a[kept], b[kept])[0, 1], abs=1e-10)
    assert r[0, 2] == pytest.approx(np.corrcoef(a, y)[0, 1], abs=1e-10)
    assert n[0, 1] == kept.sum() and n[0, 2] == len(a)


def test_a_constant_column_and_forbidden_rows(counted):
    frame, *_ = counted
    with pytest.raises(ValueError, match="constant"):
        gram(frame, ["one"], F.col("y")).coefficients()
    with pytest.raises(ValueError, match="^1 odd rows"):
        gram(frame, ["a"], F.col("y"), forbidden=F.col("row_id") == 7, complaint="odd rows")
    assert gram_by(frame.where("row_id < 0"), ["a"], F.col("y")) == {}
