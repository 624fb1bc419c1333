import numpy as np
from pyspark.sql import functions as F

from understory.operators import sketch
from understory.sources import tables


def test_stored_pieces_merge_to_the_whole(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [("a" if i % 3 else "b", i % 5, None if i % 400 == 0 else int(v), float(x)) for i, (v, x) in enumerate(zip(rng.integers(0, 5000, 30_000), rng.normal(size=30_000)))]
    df = spark.createDataFrame(rows, "g string, piece int, v long, x double")
    tables.write_table(sketch.distinct_sketches(df, ["g", "piece"], "v"), f"{tmp_path}/d")
    tables.write_table(sketch.quantile_sketches(df, ["g", "piece"], "x"), f"{tmp_path}/q")
    stored = tables.read_table(spark, f"{tmp_path}/d")
    assert stored.count() == 10
    found = {r["g"]: r["distinct"] for r in sketch.merged_distinct(stored, ["g"]).collect()}
    for g in "ab":
        exact = len({r[2] for r in rows if r[0] == g})
        assert abs(found[g] - exact) <= 4 * sketch.DISTINCT_ERROR * exact
    every = sketch.merged_distinct(stored, []).first()[0]
    assert abs(every - 5001) <= 4 * sketch.DISTINCT_ERROR * 5001
    probs = {"low": 0.025, "mid": 0.5, "high": 0.975}
    for r in sketch.merged_quantiles(tables.read_table(spark, f"{tmp_path}/q"), ["g"], probs).collect():
        x = np.sort([row[3] for row in rows if row[0] == r["g"]])
        for name, p in probs.items():
            assert abs(np.searchsorted(x, r[name]) / len(x) - p) <= 2 * sketch.RANK_ERROR


def test_missing_values_and_empty_tables(spark):
    df = spark.createDataFrame([("a", None, None), ("a", "x", float("nan")), ("a", "", 1.0)], "g string, v string, x double")
    assert sketch.merged_distinct(sketch.distinct_sketches(df, ["g"], "v"), ["g"]).first()["distinct"] == 3
    assert sketch.merged_quantiles(sketch.quantile_sketches(df, ["g"], "x"), ["g"], {"m": 0.5}).first()["m"] == 1.0
    assert sketch.quantile_sketches(df.where(F.lit(False)), ["g"], "x").count() == 0
