"""Summaries sort tails only, generators are made once, ordered rows come in tasks of bounded size, small tables are broadcast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from understory.operators import mixed, predict
from understory.operators.design import Formula
from understory.operators.fit import Fit
from understory.plans import models, plot_share


@pytest.mark.parametrize("spread", [0.2, 1.0, 3.0])
def test_skewed_rows_are_not_sorted_whole(monkeypatch, spread):
    """A lower tail may lie less than a deviation and a half from the mean."""
    y = np.exp(spread * np.random.default_rng(7).normal(size=(20, 8000)))
    want = np.quantile(y, [0.025, 0.975], axis=1)
    sizes, plain = [], np.sort
    monkeypatch.setattr(np, "sort", lambda a, *more, **options: (sizes.append(np.size(a)), plain(a, *more, **options))[1])
    _, _, bounds = predict._summary(y)
    assert sum(sizes) < y.size / 8
    np.testing.assert_allclose(bounds, want, rtol=1e-12)


@pytest.mark.parametrize("odd", [np.nan, np.inf, -np.inf])
@pytest.mark.parametrize("n", [2, 40, 1024, 8000])
def test_bounds_of_rows_with_values_that_are_not_finite(odd, n):
    rng = np.random.default_rng(n)
    y = np.where(rng.random((30, n)) < 0.03, odd, rng.normal(size=(30, n)))
    with np.errstate(all="ignore"):
        found, rows = predict._summary(y)[2], np.sort(y, axis=1)
        for k, p in enumerate((0.025, 0.975)):
            at = (n - 1) * p
            low, part = int(at), at - int(at)
            a, b = rows[:, low], rows[:, min(low + 1, n - 1)]
            np.testing.assert_array_equal(found[k], a + (b - a) * part)


@pytest.mark.parametrize("family", ["beta", "binomial"])
def test_rows_share_a_generator_and_have_their_own_numbers(monkeypatch, family):
    eta, keys = np.random.default_rng(1).normal(size=(5, 300)), np.array([3, -(10**15), 2**62, -(2**62), 3])
    trials, mu = np.array([1.0, 4.0, 9.0, 20.0, 1.0]), 1.0 / (1.0 + np.exp(-eta))
    want = []
    for i, key in enumerate(keys.tolist()):
        rng = np.random.Generator(np.random.Philox(key=[1, key & predict.FULL]))
        want.append(rng.beta(mu[i] * 6.0, (1.0 - mu[i]) * 6.0) if family == "beta" else rng.binomial(int(trials[i]), mu[i]) / trials[i])
    made, plain = [], np.random.Philox
    monkeypatch.setattr(np.random, "Philox", lambda **options: (made.append(1), plain(**options))[1])
    found = predict.Response(family, 6.0).simulated(eta.copy(), keys, np.arange(300), 1, trials)
    assert len(made) == 1
    np.testing.assert_array_equal(found, np.array(want))


def test_tasks_that_sort_grow_in_number_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(predict, "TASK_ROWS", 20)
    model = Fit(Formula("y", ("x1",), (), (("g",),)), "bernoulli", np.array([0.2, -0.5]), np.eye(2) * 0.01, 1.0, 100)
    frame = spark.range(3000).select(F.col("id").alias("row_id"), F.lit(0.1).alias("x1"), (F.col("id") % 500).cast("string").alias("g"))
    effects = spark.range(500).select(
        F.lit("g").alias("grp"), F.col("id").cast("string").alias("level"), F.lit(0.1).alias("estimate"), F.lit(0.2).alias("est_error"), F.lit(0.3).alias("group_sd")
    )
    held = predict._rows(frame, model, effects, 8000, ["row_id"], {}, None, ["row_id"]).rdd.glom().map(len).collect()
    assert sum(held) == 3000
    assert len(held) >= 3000 / 20 and max(held) <= 3 * 20


def test_levels_of_a_step_are_broadcast(spark, monkeypatch):
    plans, plain = [], mixed.solve_mixed

    def watched(frame, *more, **options):
        plans.append(frame._jdf.queryExecution().analyzed().toString())
        return plain(frame, *more, **options)

    monkeypatch.setattr(mixed, "solve_mixed", watched)
    x1, g = (F.col("id") * 7919) % 600 / 600, F.col("id") % 6
    rows = spark.range(600).select(x1.alias("x1"), g.cast("string").alias("g"), (0.02 + F.col("id") * 31 % 17 / 60 + g * 0.08 + x1 * 0.2).alias("y"))
    mixed.fit_mixed(rows, Formula("y", ("x1",), (), (("g",),)), "beta")
    assert len(plans) > 1
    assert all("strategy=broadcast" in plan for plan in plans[1:])


def test_share_rows_keep_what_the_models_use(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(plot_share, "fit_share", lambda rows, *more: seen.append(rows.columns))
    monkeypatch.setattr(plot_share, "fit_with_space", lambda rows, *more: seen.append(rows.columns))
    names = ["PlotID", "row_id", "Long_Dec", "Lat_Dec", "Island", "Plot_Area", "AlienSppN_Prop", "AlienAbund_Prop", *models.CLIMATE]
    wide = spark.range(3).select(*[F.col("id").cast("double").alias(c) for c in [*names, "MAPs", "Elev_m", "Native_SppN"]])
    monkeypatch.setattr(plot_share, "prepare_plots", lambda *more: wide)
    monkeypatch.setattr(plot_share, "model_rows", lambda table: table)
    plot_share.run(wide, wide, "unused")
    assert len(seen) == 3
    assert all(set(columns) == set(names) - {"PlotID"} for columns in seen)


def test_rows_of_crossed_predictions_are_made_once(spark, monkeypatch):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    area, plot, island, kind = F.col("id") % 4, F.col("id") % 24, F.col("id") % 3, F.col("id") % 5
    x1, x2 = F.col("id") * 7919 % 600 / 600, F.col("id") * 104729 % 599 / 599
    y = 0.02 + F.col("id") * 31 % 17 / 60 + area * 0.05 + island * 0.04 + kind * 0.03 + plot * 0.004 + x1 * 0.1 + x2 * 0.05
    texts = [c.cast("string").alias(n) for c, n in ((area, "Plot_Area2"), (plot, "PlotID"), (island, "Island"), (kind, "species"))]
    rows = spark.range(600).select(F.col("id").alias("row_id"), x1.alias("x1"), x2.alias("x2"), (F.col("id") * 13 % 7 / 7).alias("x3"), F.col("id").cast("double").alias("urgent"), y.alias("y"), *texts)
    monkeypatch.setattr(registry, "obs", lambda *more: rows.mapInArrow(count, rows.schema))
    assert registry.crossed_predictions(spark, "unused").count() == 600
    assert made.value == 600
