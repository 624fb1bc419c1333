import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from understory.operators import mixed
from understory.operators.design import Formula, design
from understory.operators.fit import fit

GROUPS = (("area",), ("area", "plot"), ("island",))
FORMULA = Formula("y", ("a", "b"), (), GROUPS)


@pytest.fixture(scope="module")
def rows():
    """Two predictors, plots within areas, islands crossed with both."""
    rng = np.random.default_rng(11)
    n = 900
    area, plot, island = rng.integers(0, 6, n), rng.integers(0, 12, n), rng.integers(0, 9, n)
    a, b = rng.normal(50, 3, n), rng.normal(0, 1, n) + 0.2 * area
    effect = rng.normal(0, 1.0, 6)[area] + rng.normal(0, 0.7, (6, 12))[area, plot] + rng.normal(0, 0.8, 9)[island]
    eta = 0.3 * (a - 50) - 0.5 * b + effect
    return {
        "row_id": np.arange(n), "area": area, "plot": plot, "island": island, "a": a, "b": b,
        "y": 2.0 + eta + rng.normal(0, 0.5, n), "hit": (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float),
    }


def table(spark, rows, formula=FORMULA):
    import pandas as pd

    return design(spark.createDataFrame(pd.DataFrame(rows)), formula)


def dense(rows, y, weight, within, between, formula=FORMULA):
    """Coefficients, covariance and effects from the full matrices."""
    x = np.column_stack([np.ones(len(y)), *[rows[t] for t in formula.main]])
    keys = [np.array([":".join(str(rows[c][i]) for c in g) for i in range(len(y))]) for g in formula.groups]
    blocks, names, spread = [], [], []
    for g, key, v in zip(formula.group_names, keys, between):
        levels = np.unique(key)
        blocks.append((key[:, None] == levels).astype(float))
        names += [(g, level) for level in levels]
        spread += [v] * len(levels)
    z, spread = np.hstack(blocks), np.array(spread)
    cov = (z * spread) @ z.T + np.diag(within / weight)
    inverse = np.linalg.inv(cov)
    information = x.T @ inverse @ x
    coef = np.linalg.solve(information, x.T @ inverse @ y)
    effects = spread * (z.T @ inverse @ (y - x @ coef))
    return coef, np.linalg.inv(information), dict(zip(names, effects))


@pytest.mark.parametrize("small", [0, mixed.SMALL])
def test_crossed_and_nested_effects_equal_the_dense_solution(spark, rows, small, monkeypatch):
    monkeypatch.setattr(mixed, "SMALL", small)
    fitted = mixed.fit_mixed(table(spark, rows), FORMULA, "gaussian")
    within, between = fitted.fixed.scale**2, [fitted.group_sd[g] ** 2 for g in FORMULA.group_names]
    assert 0.1 < within < 0.4 and all(v > 0.1 for v in between)
    coef, cov, effects = dense(rows, rows["y"], np.ones(900), within, between)
    np.testing.assert_allclose(fitted.fixed.coef, coef, rtol=1e-7)
    np.testing.assert_allclose(fitted.fixed.cov, cov, rtol=1e-6, atol=1e-12)
    found = {(r["grp"], r["level"]): r["estimate"] for r in fitted.effects.collect()}
    assert found.keys() == effects.keys()
    for key, value in effects.items():
        assert found[key] == pytest.approx(value, abs=1e-7)
    assert 0 < fitted.residual <= mixed.TOLERANCE
    assert fitted.effects.agg(F.max("residual")).first()[0] == fitted.residual


def test_weights(spark, rows):
    weight = 0.5 + rows["island"] / 4
    frame = table(spark, rows | {"w": weight}, FORMULA).join(spark.createDataFrame([(int(i), float(w)) for i, w in zip(rows["row_id"], weight)], "row_id long, w double"), "row_id")
    s = mixed.solve_mixed(frame, FORMULA, F.col("y"), F.col("w"))
    coef, cov, effects = dense(rows, rows["y"], weight, s.within, s.between)
    np.testing.assert_allclose(s.coef, coef, rtol=1e-7)
    np.testing.assert_allclose(s.cov, cov, rtol=1e-6, atol=1e-12)


def test_moments_of_one_factor_are_those_of_an_analysis_of_variance(spark, rows):
    formula = Formula("y", (), (), (("island",),))
    s = mixed.solve_mixed(table(spark, rows, formula), formula, F.col("y"))
    y, g = rows["y"], rows["island"]
    n = np.bincount(g)
    means = np.bincount(g, y) / n
    within = ((y - means[g]) ** 2).sum() / (len(y) - len(n))
    between = ((n * (means - y.mean()) ** 2).sum() - (len(n) - 1) * within) / (len(y) - (n**2).sum() / len(y))
    assert s.within == pytest.approx(within) and s.between[0] == pytest.approx(between)


def test_a_logit_fit_is_a_fixed_point_of_quasi_likelihood(spark, rows):
    formula = Formula("hit", ("a", "b"), (), (("area", "plot"), ("island",)))
    fitted = mixed.fit_mixed(table(spark, rows, formula), formula, "bernoulli")
    found = {(r["grp"], r["level"]): r["estimate"] for r in fitted.effects.collect()}
    offset = np.array([found["area:plot", f"{a}:{p}"] + found["island", str(i)] for a, p, i in zip(rows["area"], rows["plot"], rows["island"])])
    eta = fitted.fixed.coef[0] + rows["a"] * fitted.fixed.coef[1] + rows["b"] * fitted.fixed.coef[2] + offset
    mu = 1 / (1 + np.exp(-eta))
    weight = mu * (1 - mu)
    between = [fitted.group_sd[g] ** 2 for g in formula.group_names]
    coef, cov, _ = dense(rows, eta + (rows["hit"] - mu) / weight, weight, 1.0, between, formula)
    error = np.sqrt(np.diag(cov))
    assert np.all(np.abs(fitted.fixed.coef - coef) < 1e-3 * error)
    # The levels explain what the fixed terms alone leave, so slopes are steeper than without them.
    alone = fit(table(spark, rows, formula), formula, "bernoulli")
    assert fitted.fixed.coef[1] > alone.coef[1] > 0


def test_a_factor_without_variance_and_missing_levels(spark, rows):
    rng = np.random.default_rng(2)
    free = rows | {"noise": rng.integers(0, 3, 900)}
    frame = table(spark, free).join(spark.createDataFrame([(int(i), None if n == 2 else str(n)) for i, n in zip(rows["row_id"], free["noise"])], "row_id long, noise string"), "row_id")
    formula = Formula("y", ("a",), (), (("noise",), ("island",)))
    fitted = mixed.fit_mixed(frame, formula, "gaussian")
    levels = fitted.effects.where("grp = 'noise'").collect()
    assert {r["level"] for r in levels} == {"0", "1", None}
    if fitted.group_sd["noise"] == 0:
        assert all(r["estimate"] == 0 and r["est_error"] == 0 for r in levels)


def test_folds_equal_fits_without_them(spark, rows):
    formula = Formula("y", ("a", "b"), (), (("area", "plot"), ("island",)))
    frame = table(spark, rows, formula)
    got = {r["row_id"]: r for r in mixed.kfold_points(frame, formula, "gaussian", F.pmod("row_id", F.lit(4)).cast("int"), 4).collect()}
    assert len(got) == 900
    fold = rows["row_id"] % 4
    for f in (0, 3):
        fitted = mixed.fit_mixed(frame.where(F.pmod("row_id", F.lit(4)) != f), formula, "gaussian")
        at = {(r["grp"], r["level"]): (r["estimate"], r["est_error"]) for r in fitted.effects.collect()}
        for i in np.flatnonzero(fold == f):
            levels = [at.get(("area:plot", f"{rows['area'][i]}:{rows['plot'][i]}"), (0.0, fitted.group_sd["area:plot"])), at[("island", str(rows["island"][i]))]]
            mean = fitted.fixed.coef @ [1, rows["a"][i], rows["b"][i]] + sum(m for m, _ in levels)
            sd = math.sqrt(fitted.fixed.scale**2 + sum(e * e for _, e in levels))
            want = -0.5 * ((rows["y"][i] - mean) / sd) ** 2 - math.log(sd) - 0.5 * math.log(2 * math.pi)
            assert got[i]["elpd"] == pytest.approx(want, abs=1e-6) and got[i]["fold"] == f


def test_folds_of_a_logit_fit(spark, rows):
    formula = Formula("hit", ("a",), (), (("island",),))
    frame = table(spark, rows, formula)
    got = mixed.kfold_points(frame, formula, "bernoulli", F.pmod("row_id", F.lit(2)).cast("int"), 2)
    fitted = mixed.fit_mixed(frame.where("row_id % 2 <> 1"), formula, "bernoulli")
    at = {r["level"]: r["estimate"] for r in fitted.effects.collect()}
    for r in got.where("fold = 1 and row_id < 50").collect():
        i = r["row_id"]
        mu = 1 / (1 + math.exp(-(fitted.fixed.coef @ [1, rows["a"][i]] + at[str(rows["island"][i])])))
        assert r["elpd"] == pytest.approx(math.log(mu if rows["hit"][i] else 1 - mu), abs=1e-6)


def test_errors(spark, rows):
    frame = table(spark, rows)
    with pytest.raises(ValueError, match="grouping"):
        mixed.solve_mixed(frame, Formula("y", ("a",)), F.col("y"))
    with pytest.raises(ValueError, match="support"):
        mixed.fit_mixed(frame.withColumn("y", -F.abs("y")), FORMULA, "lognormal")


def test_inflation_without_levels_is_the_classical_one(spark, rows):
    frame = table(spark, rows)
    plain = fit(frame, Formula("y", ("a", "b")), "gaussian")
    r = np.corrcoef(rows["a"], rows["b"])[0, 1]
    for _, value in mixed.vif_rows(plain):
        assert value == pytest.approx(1 / (1 - r * r))
    grouped = dict(mixed.vif_rows(mixed.fit_mixed(frame, FORMULA, "gaussian").fixed))
    assert all(math.isfinite(v) and v >= 1 for v in grouped.values())


def test_few_levels_beside_a_large_factor_need_no_iteration(spark, rows, monkeypatch):
    """72 plots are too many for the driver here, 15 areas and islands aren't: the plots are taken out exactly."""
    monkeypatch.setattr(mixed, "SMALL", 256)
    taken = []
    whole = mixed._eliminate
    monkeypatch.setattr(mixed, "_eliminate", lambda *a: taken.append(a[2]) or whole(*a))
    fitted = mixed.fit_mixed(table(spark, rows), FORMULA, "gaussian")
    assert taken == [1]
    within, between = fitted.fixed.scale**2, [fitted.group_sd[g] ** 2 for g in FORMULA.group_names]
    coef, cov, effects = dense(rows, rows["y"], np.ones(900), within, between)
    np.testing.assert_allclose(fitted.fixed.coef, coef, rtol=1e-9)
    np.testing.assert_allclose(fitted.fixed.cov, cov, rtol=1e-7, atol=1e-12)
    found = {(r["grp"], r["level"]): r["estimate"] for r in fitted.effects.collect()}
    assert found.keys() == effects.keys()
    for key, value in effects.items():
        assert found[key] == pytest.approx(value, abs=1e-9)
