"""The corpus pipeline: five stages, each an operator of ``understory.llm`` over all that the one before kept.

A stage takes (session, documents, data folder) and returns a DataFrame. ``run`` writes
what a stage returns as Parquet to the shared folder and hands the next stage the
table read back. All but the last return the columns of ``documents``.

Every stage takes null ids, texts and hosts, empty and very long texts, repeated
rows, empty tables and columns beyond those of ``documents`` as its operator states;
those columns go along unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from understory.llm import bpe, decontaminate, jaccard, line_dedup, quality
from understory.session import scratch_path, ship_package


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that too many documents of their source share.

    Null texts, and texts of fewer than twenty words, go.
    """
    return quality.keep_good(docs)


def line_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later occurrences of repeated three-line windows; those of which no line is left go."""
    return line_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates."""
    ship_package(spark)
    return jaccard.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within the edit budget."""
    ship_package(spark)
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, token ids and their number, their number and what they decode to, for every document that is left."""
    ship_package(spark)
    coded = bpe.tokenize(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", bpe.n_tokens(F.col("ids")).alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_windows),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("token ids", token_ids),
]

#: SQL can express neither the chosen paths' classes nor the edit matching over whole tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch_path(spark, name.replace(" ", "-"))
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
