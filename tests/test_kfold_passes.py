"""Fits that leave a fold out read their rows once, whatever the family; the prepared rows are made once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from understory.operators import fit
from understory.operators.design import Formula
from understory.plans import species_model

FORMULA = Formula("y", ("a", "b"))


def thirds():
    return F.pmod("row_id", F.lit(3)).cast("int")


def counting(df):
    """The same rows, and how many of them were read so far."""
    read = df.sparkSession.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    return df.mapInArrow(count, df.schema), read


@pytest.fixture()
def rows(spark):
    """Shares with one term away from zero; every ninth row lacks a term, one has no response."""
    rng = np.random.default_rng(3)
    n = 3000
    a, b = rng.normal(20.0, 1.0, n), rng.normal(0, 1, n)
    mu = 1 / (1 + np.exp(-(0.4 * (a - 20.0) - 0.3 * b - 0.2)))
    y = np.clip(rng.beta(8 * mu, 8 * (1 - mu)), 1e-6, 1 - 1e-6)
    b[::9] = np.nan
    table = pa.table({"row_id": np.arange(n), "a": a, "b": b, "y": pa.array(y, mask=np.arange(n) == 4)})
    return spark.createDataFrame(table).repartitionByRange(4, "row_id")


@pytest.mark.parametrize("family", ["beta", "lognormal"])
def test_folds_are_fitted_in_one_reading(rows, family):
    frame, read = counting(rows)
    points = fit.kfold_points(frame, FORMULA, family, thirds(), 3)
    assert read.value == 3000
    found = {r["row_id"]: r for r in points.collect()}
    known = [i for i in range(3000) if i % 9 and i != 4]
    assert sorted(found) == known
    # By a fit of the other folds alone.
    for f in range(3):
        alone = fit.fit(rows.where(thirds() != f), FORMULA, family)
        held = rows.where((thirds() == f) & (F.col("row_id") < 60)).withColumn("eta", alone.eta())
        for r in held.collect():
            if r["row_id"] in found:
                y = np.array([r["y"]])
                want = fit._log_density(family, y, np.array([r["eta"]]), np.array([alone.scale]))[0]
                assert found[r["row_id"]]["elpd"] == pytest.approx(want, abs=1e-6)
                assert found[r["row_id"]]["fold"] == f


def test_errors_of_the_folds_remain(rows):
    with pytest.raises(ValueError, match="^1 responses of y are outside the support of beta"):
        fit.kfold_points(rows.withColumn("y", F.when(F.col("row_id") == 10, 1.5).otherwise(F.col("y"))), FORMULA, "beta", thirds(), 3)
    # A response outside the support doesn't count where a term is missing.
    odd = rows.withColumn("y", F.when(F.col("row_id") == 9, -1.0).otherwise(F.col("y")))
    for family in ("beta", "lognormal"):
        assert fit.kfold_points(odd, FORMULA, family, thirds(), 3).count() == 3000 - 334 - 1
    with pytest.raises(ValueError, match="constant"):
        fit.kfold_points(rows.withColumn("a", F.lit(2.0)), FORMULA, "beta", thirds(), 3)


def test_species_rows_are_made_once(spark, tmp_path):
    names = ["PlotID", "Island", "Plot_Area", "PDmeasure", "MAT", "MAP", "Elev_m", "AridInd", "VPD", "HII", "HFP", "SubstrateAge_range", "PD_stand", "WD_diff_lrr", "WD_wt_diff_lrr", "maxDBH_diff_lrr", "tip_label", "maxDBH_wt_diff_lrr", "SM_diff_lrr", "SM_wt_diff_lrr"]
    text = {"PlotID", "Island", "PDmeasure", "tip_label"}
    made = [tuple(("MDWNC" if n == "PDmeasure" else f"{n}{i}") if n in text else float(i + k * k % 7) for k, n in enumerate(names)) for i in range(40)]
    local, read = counting(spark.createDataFrame(made, ", ".join(f"{n} {'string' if n in text else 'double'}" for n in names)))
    assert species_model.prepare_species(local, f"{tmp_path}/rows").count() == 40
    assert read.value == 40
