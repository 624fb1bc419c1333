"""Reading and writing of survey and model tables."""

import pytest

from understory.session import scratch_path, scratch_root
from understory.sources import schema, tables


def test_missing_values_survive_delimited_text(spark, tmp_path):
    rows = [("i", "p", "native", "n1", 1.5, 100.0), ("i", "p", None, None, None, 100.0)]
    path = str(tmp_path / "plots")
    tables.write_delimited(spark.createDataFrame(rows, schema.PLOT_SPECIES), path)
    got = tables.read_delimited(spark, path, schema.PLOT_SPECIES)
    assert got.schema.simpleString() == schema.PLOT_SPECIES.simpleString()
    assert {tuple(r) for r in got.collect()} == set(rows)


def test_text_with_a_given_separator(spark, tmp_path):
    path = tmp_path / "tree.csv"
    path.write_text("parent;child;length\nroot;a;NA\nroot;b;0.5\n")
    got = tables.read_delimited(spark, str(path), schema.TREE_EDGES, sep=";")
    assert {tuple(r) for r in got.collect()} == {("root", "a", None), ("root", "b", 0.5)}


def test_fit_tables_are_named(spark, tmp_path):
    one = spark.range(3)
    tables.save_fit({"terms": one}, str(tmp_path))
    assert tables.load_fit(spark, str(tmp_path), ("terms",))["terms"].count() == 3
    with pytest.raises(ValueError):
        tables.save_fit({"plot": one}, str(tmp_path))


def test_scratch_paths_are_new_and_below_the_checkpoint_folder(spark):
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second and first.startswith(scratch_root(spark))
    assert spark.sparkContext.getCheckpointDir()
