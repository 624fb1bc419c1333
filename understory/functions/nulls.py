"""Missing-value rules of the source analyses, where Spark's defaults differ.

A sum or a distinct count treats a missing value as a value, a comparison drops
both null and NaN, and a division or logarithm without a finite result is null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def as_col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sum_na(x: str | Column) -> Column:
    """Sum that is null as soon as one value of the group is null."""
    x = as_col(x)
    return F.when(F.count(x) == F.count(F.lit(1)), F.sum(x))


def n_distinct_na(x: str | Column) -> Column:
    """Distinct count in which null is one more value."""
    x = as_col(x)
    return F.count_distinct(x) + F.coalesce(F.max(x.isNull().cast("int")), F.lit(0))


def gt0(x: str | Column) -> Column:
    """``x > 0`` that is false, not true, for NaN."""
    x = as_col(x).cast("double")
    return (x > 0) & ~F.isnan(x)


def nan_to_null(x: str | Column) -> Column:
    """NaN read as missing, for aggregates that skip missing values."""
    x = as_col(x).cast("double")
    return F.when(~F.isnan(x), x)


def share(part: str | Column, whole: str | Column) -> Column:
    return F.try_divide(as_col(part), as_col(whole))


def safe_ln(x: str | Column) -> Column:
    """Natural logarithm, null where the argument is not positive."""
    x = as_col(x)
    return F.when(x > 0, F.ln(x))


def null_to_zero(x: str | Column) -> Column:
    return F.coalesce(as_col(x), F.lit(0))


def match_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on equal keys where a null key matches a null key."""
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") if k in keys else F.col(k) for k in right.columns]
    )
    on = reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys]
    )
    joined = left.join(renamed, on, how)
    return joined.drop(*[f"__{k}" for k in keys]) if how == "left" or how == "inner" else joined
