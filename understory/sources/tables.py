"""Reading and writing survey tables and fitted-model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from understory.sources.schema import TREE_EDGES

FIT_TABLES = ("frame", "terms", "draws")


def read_delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """Delimited text with a header row; ``NA`` marks a missing value."""
    return spark.read.csv(path, schema=schema, sep=sep, header=True, nullValue="NA", nanValue="NaN")


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").csv(path, sep=sep, header=True, nullValue="NA")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """Phylogeny as an edge table ``(parent, child, length)``."""
    if path.endswith(".csv"):
        return read_delimited(spark, path, TREE_EDGES)
    return spark.read.parquet(path).select("parent", "child", "length")


def save_fit(tables: dict[str, DataFrame], path: str) -> None:
    """Write the tables of one fitted model below ``path``."""
    unknown = set(tables) - set(FIT_TABLES)
    if unknown:
        raise ValueError(f"not a table of a fit: {sorted(unknown)}")
    for name, df in tables.items():
        write_table(df, f"{path}/{name}")


def load_fit(spark: SparkSession, path: str, names: tuple[str, ...] = FIT_TABLES) -> dict[str, DataFrame]:
    return {name: read_table(spark, f"{path}/{name}") for name in names}
