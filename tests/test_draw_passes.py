"""Rows meet the draws once, evenly dealt, and a level is drawn once for its rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from understory.functions.links import log_gamma_array, log_gamma_sum
from understory.functions.noise import LEVEL, normals
from understory.operators import predict
from understory.operators.design import Formula
from understory.operators.fit import Fit, fixed_effect_draws
from understory.plans import models, plot_share

LINE = Formula("y", ("x1",), (), (("g",),))


def line(family="bernoulli"):
    return Fit(LINE, family, np.array([0.2, -0.5]), np.eye(2) * 0.01, 1.0, 100)


def test_rows_in_one_partition_are_dealt_to_all(spark):
    """Empty partitions beside a full one don't count as dealt."""
    full = spark.range(900).coalesce(1).select(F.col("id").alias("row_id"), (F.col("id") / 900).alias("x1"), F.lit("a").alias("g"))
    frame = full.unionByName(spark.range(0, 40, 1, 40).where("id < 0").select(F.col("id").alias("row_id"), F.lit(0.0).alias("x1"), F.lit("a").alias("g")))
    rows = predict._rows(frame, line(), None, 8000, ["row_id"], {}, None, ["row_id"])
    held = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) == 900
    assert max(held) <= 2 * 900 / spark.sparkContext.defaultParallelism


def test_explained_variance_is_kept(spark):
    """A summary reads it several times; the rows meet the draws once."""
    frame = spark.range(200).select(F.col("id").alias("row_id"), (F.col("id") / 200).alias("x1"), (F.col("id") % 2).cast("double").alias("y"))
    fitted = Fit(Formula("y", ("x1",)), "bernoulli", np.array([0.2, -0.5]), np.eye(2) * 0.01, 1.0, 200)
    r2 = predict.bayes_r2(frame, fitted, fixed_effect_draws(spark, fitted, n=50))
    assert r2.count() == 50
    assert "MapInArrow" not in r2._jdf.queryExecution().toString()


def test_residuals_for_space_meet_the_draws_once(spark, monkeypatch):
    columns = [(F.col("id") % (7 + k) / 10).alias(c) for k, c in enumerate(models.CLIMATE)]
    at = [(F.lit(-157.0) + F.col("id") / 1000).alias("Long_Dec"), F.lit(21.0).alias("Lat_Dec"), F.lit("0").alias("Island"), F.lit("1").alias("Plot_Area")]
    rows = spark.range(60).select(F.col("id").cast("string").alias("row_id"), *columns, *at, ((F.col("id") % 9 + 1) / 11).alias("AlienAbund_Prop"))
    formula = models.ABUNDANCE_SHARE.formula
    fitted = Fit(formula, "beta", np.full(5, 0.1), np.eye(5) * 0.01, 3.0, 60)
    met, plain = spark.sparkContext.accumulator(0), plot_share.residuals

    def counted(*args, **options):
        found = plain(*args, **options)

        def run(batches):
            for batch in batches:
                met.add(batch.num_rows)
                yield batch

        return found.mapInArrow(run, found.schema)

    def read_often(frame, formula):
        assert frame.count() == 60 and frame.agg(F.count("rac")).scalar() is not None and len(frame.select("rac").collect()) == 60
        return plot_share.ZeroOneFit(0.0, None, fitted), None

    monkeypatch.setattr(plot_share, "residuals", counted)
    monkeypatch.setattr(plot_share, "fit_zero_one", read_often)
    share = plot_share.ShareFit(fitted, rows, fixed_effect_draws(spark, fitted, n=40), None)
    plot_share.fit_with_space(rows, share, 40)
    assert met.value == 60


def test_a_level_is_drawn_once_for_its_rows(monkeypatch):
    numbers, levels = np.arange(8000), np.repeat(np.arange(300) * 7919, 5)
    rng = np.random.default_rng(3)
    x, mean, error = rng.normal(size=1500), rng.normal(size=300)[levels // 7919], rng.random(300)[levels // 7919]
    batch = pa.table({"__key": np.arange(1500), "__trials": np.ones(1500), "__x0": x, "__key0": levels, "__mean0": mean, "__error0": error}).to_batches()[0]
    beta, drawn = rng.normal(size=(8000, 2)), []
    monkeypatch.setattr(predict, "normals", lambda keys, *more: (drawn.append(len(keys)), normals(keys, *more))[1])
    for part, _, _, eta, _ in predict._chunks(batch, numbers, beta, 1):
        i = part.start
        want = beta[:, 0] + beta[:, 1] * x[i] + mean[i] + error[i] * normals(levels[i : i + 1], numbers, 1, LEVEL)[0]
        np.testing.assert_allclose(eta[0], want, atol=1e-12)
    assert sum(drawn) == 300


def test_rows_of_many_levels_lie_side_by_side(spark):
    frame = spark.range(3000).select(F.col("id").alias("row_id"), F.lit(0.1).alias("x1"), (F.col("id") % 500).cast("string").alias("g"))
    effects = spark.range(500).select(
        F.lit("g").alias("grp"), F.col("id").cast("string").alias("level"), F.lit(0.1).alias("estimate"), F.lit(0.2).alias("est_error"), F.lit(0.3).alias("group_sd")
    )
    rows = predict._rows(frame, line(), effects, 8000, ["row_id"], {}, None, ["row_id"])
    places = rows.rdd.glom().map(lambda p: [r["__key0"] for r in p]).collect()
    assert sum(map(len, places)) == 3000
    assert all(p == sorted(p) for p in places)


@pytest.mark.parametrize("n", [2, 40, 8000])
def test_summary_of_truth_values(n):
    y = np.random.default_rng(n).random((9, n)) < np.array([0, 0.01, 0.025, 0.03, 0.5, 0.9, 0.97, 0.98, 1])[:, None]
    for found, want in zip(predict._summary(y), (y.mean(1), y.std(1, ddof=1), np.quantile(y.astype(float), [0.025, 0.975], axis=1))):
        np.testing.assert_allclose(found, want, atol=1e-12)


def test_beta_density_next_to_the_ends():
    eta = np.array([[-40.0, -3.0, 0.0, 3.0, 40.0]])
    y = np.array([[0.3]])
    a, b = 5.0 / (1.0 + np.exp(-eta)), 5.0 / (1.0 + np.exp(eta))
    np.testing.assert_allclose(log_gamma_sum(a, b), log_gamma_array(a) + log_gamma_array(b), rtol=1e-12)
    want = log_gamma_array(np.array(5.0)) - log_gamma_array(a) - log_gamma_array(b) + (a - 1) * np.log(y) + (b - 1) * np.log1p(-y)
    np.testing.assert_allclose(predict.Response("beta", 5.0).log_density(y, eta, np.ones(1)), want, rtol=1e-12)
