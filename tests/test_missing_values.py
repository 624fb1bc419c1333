"""Rules for missing values, zeros and types that differ from Spark's defaults."""

import math

import pytest
from pyspark.sql import functions as F

from understory.functions.nulls import gt0, match_join, n_distinct_na, safe_ln, share, sum_na
from understory.operators import prepare, transform
from understory.operators.draws import long_draws

NAN = float("nan")


def one(df):
    return df.first()[0]


def test_sum_with_a_missing_value_is_missing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0)], "k string, x double")
    got = {r["k"]: r["s"] for r in df.groupBy("k").agg(sum_na("x").alias("s")).collect()}
    assert got == {"a": None, "b": 5.0}


def test_distinct_count_counts_missing_once(spark):
    df = spark.createDataFrame([("a",), (None,), (None,), ("b",)], "x string")
    assert one(df.agg(n_distinct_na("x"))) == 3


def test_positive_filter_drops_nan_and_null(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (None,), (0.0,)], "x double")
    assert [r[0] for r in df.where(gt0("x")).collect()] == [1.0]


def test_null_keys_match_in_joins(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2), ("b", 3)], "k string, v int")
    right = spark.createDataFrame([(None,), ("a",)], "k string")
    assert sorted(r["v"] for r in match_join(left, right, ["k"], "left_semi").collect()) == [1, 2]


def test_division_and_log_without_finite_result_are_null(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 2.0), (0.0, 2.0)], "x double, y double")
    assert [r[0] for r in df.select(share("x", "y")).collect()] == [None, -0.5, 0.0]
    assert [r[0] for r in df.select(safe_ln("x")).collect()] == [0.0, None, None]


def test_complete_cases_drop_nan_and_null(spark):
    df = spark.createDataFrame([(1.0, "a"), (NAN, "a"), (1.0, None)], "x double, k string")
    assert prepare.complete_cases(df).count() == 1


def test_scores_skip_missing_and_constants_are_null(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0), (NAN, 5.0)], "x double, c double")
    rows = transform.zscores(df, {"x": "xs", "c": "cs"}).collect()
    assert [rows[0]["xs"], rows[1]["xs"]] == pytest.approx([-math.sqrt(0.5), math.sqrt(0.5)])
    assert rows[2]["xs"] is None and all(r["cs"] is None for r in rows)


def test_scores_come_before_the_alien_filter(spark):
    columns = ["MAP", "MAT", "Elev_m", "AridInd", "VPD", "HII", "HFP", "SubstrateAge_range"]
    rows = [(f"p{i}", 100.0, a, *[float(i + 1)] * 8) for i, a in enumerate([0.0, 1.0, 2.0])]
    schema = "PlotID string, Plot_Area double, Alien_abundance double, " + ", ".join(f"{c} double" for c in columns)
    got = transform.plot_predictors(spark.createDataFrame(rows, schema)).orderBy("PlotID").collect()
    assert [r["MATs"] for r in got] == pytest.approx([0.0, 1.0])
    assert [r["AridInds"] for r in got] == pytest.approx([0.0, -1.0])


def test_unpivot_drops_missing_values(spark):
    wide = spark.createDataFrame(
        [(1, 1, 1, 0.5, None), (1, 2, 2, NAN, 2.0)],
        "chain int, iteration int, draw int, b_a double, `b_a:b` double",
    )
    assert sorted((r["terms"], r["value"]) for r in long_draws(wide).collect()) == [("b_a", 0.5), ("b_a:b", 2.0)]


PLOT_SCHEMA = (
    "Island string, PlotID string, Native_Status string, SPP_CODE3A string, Abundance_ha double, Plot_Area double"
)


def plots(spark, rows):
    return spark.createDataFrame(rows, PLOT_SCHEMA)


EDGE_PLOTS = [
    ("i", "both", "alien", "a1", 2.0, 10.0), ("i", "both", "native", "n1", 6.0, 10.0),
    ("i", "both", "native", None, 0.0, 10.0), ("i", "both", "other", "o1", 9.0, 10.0),
    ("i", "no_alien", "native", "n1", 1.0, 20.0),
    ("i", "zero_native", "native", "n1", 0.0, 10.0), ("i", "zero_native", "alien", "a1", 1.0, 10.0),
    ("i", "missing", "native", "n1", None, 10.0), ("i", "missing", "native", "n2", 1.0, 10.0),
    ("i", "null_species", "alien", None, 1.0, 10.0), ("i", "null_species", "alien", "a1", 1.0, 10.0),
    ("i", "null_species", "native", "n1", 2.0, 10.0),
    ("i", "two_sizes", "alien", "a1", 1.0, 10.0), ("i", "two_sizes", "native", "n1", 1.0, 30.0),
    ("i", "two_islands", "alien", "a1", 1.0, 10.0), ("j", "two_islands", "native", "n1", 3.0, 10.0),
    ("i", None, "alien", "a1", 1.0, 10.0), ("i", None, "native", "n1", 1.0, None),
]


def test_fused_summary_equals_the_separate_steps(spark):
    df = plots(spark, EDGE_PLOTS)
    kept = prepare.keep_native_plots(df)
    steps = match_join(
        prepare.abundance_shares(kept), prepare.richness_shares(kept), ["Island", "PlotID"], "left"
    )
    fused = prepare.plot_summary(df)
    want = sorted(map(str, steps.select(*fused.columns).collect()))
    assert sorted(map(str, fused.collect())) == want


def test_missing_alien_is_null_in_abundance_and_zero_in_richness(spark):
    got = {r["PlotID"]: r for r in prepare.plot_summary(plots(spark, EDGE_PLOTS)).collect()}
    assert got["no_alien"]["Alien_abundance"] is None and got["no_alien"]["Alien_SppN"] == 0
    assert got["null_species"]["Alien_SppN"] == 2
    assert got["both"]["AlienAbund_Prop"] == 0.25
    assert not {"zero_native", "missing"} & set(got)


def test_two_sizes_or_two_environments_fan_out(spark):
    env_schema = (
        "PlotIDn string, Long_Dec double, Lat_Dec double, newMAT double, newMAP double, newElev double, "
        "newVPD double, newPET double, newAridInd double, HFP double, HII double, SubstrateAge_range double, "
        "SubstrateAge_code string"
    )
    env = spark.createDataFrame(
        [(p, *[v] * 11, "x") for p, v in [("both", 1.0), ("both", 1.0), ("both", 2.0), ("two_sizes", 1.0)]],
        env_schema,
    )
    df = plots(spark, EDGE_PLOTS)
    for build in (prepare.alien_native, prepare.alien_native_stepwise):
        ids = sorted(r["PlotID"] for r in build(df, env).collect())
        assert ids == ["both", "both", "two_sizes", "two_sizes"]
    with pytest.raises(ValueError):
        prepare.assert_unique(prepare.alien_native(df, env), ["PlotID"])


def test_area_text_becomes_a_number_rounded_half_even(spark):
    df = spark.createDataFrame([("0.125",), ("100.0",), ("x",)], "a string")
    got = df.select(F.bround(F.expr("try_cast(a as double)"), 2).alias("a")).collect()
    assert [r["a"] for r in got] == [0.12, 100.0, None]
