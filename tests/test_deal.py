"""Shuffles over large tables have as many partitions as their rows need."""

import pytest
from pyspark.sql import functions as F

from understory.operators import prepare
from understory.sources import sample_views
from understory.sources.sample_views import PARTITIONS_KEY, TASK_BYTES_KEY, UNSET, deal, view


@pytest.fixture()
def clean(spark):
    yield spark
    deal(spark, 0)
    spark.conf.unset(PARTITIONS_KEY)


def test_a_task_gets_a_bounded_share_of_the_rows(clean, folder, monkeypatch):
    spark = clean
    monkeypatch.setattr(sample_views, "ROWS_PER_TASK", 200)
    monkeypatch.setattr(sample_views, "TASK_BYTES", "1k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
    try:
        plots = view(spark, folder, "plot_species")
        rows = plots.count()
        held = [r["count"] for r in prepare.plot_summary(plots).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert rows > 8 * 200
    assert len(held) > 8


def test_small_tables_and_the_sessions_own_number_are_left_alone(clean, folder):
    spark = clean
    own = spark.conf.get("spark.sql.shuffle.partitions")
    view(spark, folder, "plot_species")
    assert spark.conf.get(PARTITIONS_KEY, UNSET) == UNSET
    deal(spark, 100_000_000)
    assert spark.conf.get(PARTITIONS_KEY) == "200"
    assert spark.conf.get("spark.sql.shuffle.partitions") == own
    view(spark, folder, "plot_species")
    assert spark.conf.get(PARTITIONS_KEY, UNSET) == UNSET
    assert spark.conf.get(TASK_BYTES_KEY, sample_views.TASK_BYTES_DEFAULT) == sample_views.TASK_BYTES_DEFAULT
    spark.conf.set(PARTITIONS_KEY, "11")
    deal(spark, 100_000_000)
    assert spark.conf.get(PARTITIONS_KEY) == "11"
