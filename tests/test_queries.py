"""Every registered query against its SQL, or for rows where SQL cannot state it."""

import pytest

import __spark_entry__ as registry
from check_queries import differences


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_equals_its_sql(spark, duck, folder, name):
    assert differences(spark, duck, folder, name) is None


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry_has_rows(spark):
    assert registry.entry(spark).limit(1).count() == 1
