"""Opt-in mergeable sketches: distinct counts and quantiles with a stated error.

A sketch is a column of bytes, one row per group and piece of the data (a day, a load, a
file). Pieces are sketched once, stored as a table like any other, and merged whenever
groups of them are asked for; new pieces don't touch the old ones. The exact forms are
``prepare.status_richness`` and ``rank.quantiles``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from understory.functions.nulls import as_col, nan_to_null

#: Logarithm of the registers of a distinct count, and its standard error.
REGISTERS = 12
DISTINCT_ERROR = 1.04 / math.sqrt(1 << REGISTERS)
#: Size of a quantile sketch, and how far the rank of its answer may be from the one asked for, 99 times in a hundred.
ITEMS, RANK_ERROR = 800, 0.005


def distinct_sketches(df: DataFrame, keys: list[str], value: str | Column) -> DataFrame:
    """``keys`` and ``sketch`` of the distinct values; a missing value is one more value."""
    seen = F.coalesce(F.concat(F.lit("="), as_col(value).cast("string")), F.lit("-"))  # a sketch passes over empty text
    return df.groupBy(*keys).agg(F.hll_sketch_agg(seen, F.lit(REGISTERS)).alias("sketch"))


def merged_distinct(sketches: DataFrame, keys: list[str], name: str = "distinct") -> DataFrame:
    """Estimated distinct values of each group of stored sketches, ``DISTINCT_ERROR`` being the relative standard error."""
    return sketches.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))


def quantile_sketches(df: DataFrame, keys: list[str], value: str | Column) -> DataFrame:
    """``keys`` and ``sketch`` of the values that aren't missing; groups without one have no row."""
    staged = df.select(*keys, nan_to_null(value).alias("value")).where("value is not null")
    return staged.groupBy(*keys).agg(F.kll_sketch_agg_double("value", F.lit(ITEMS)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, keys: list[str], probs: dict[str, float]) -> DataFrame:
    """Estimated quantiles of each group of stored sketches: ``{name: probability}``; their ranks are ``RANK_ERROR`` off at most, 99 times in a hundred."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", F.lit(ITEMS)).alias("sketch"))
    return merged.select(*keys, *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(n) for n, p in probs.items()])
