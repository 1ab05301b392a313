"""The corpus pipeline: quality rules, exact and near deduplication, mixing and packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; `run` writes what a stage returns as
Parquet in the shared folder and gives the next stage what it reads back. All stages but the last return the columns of
documents. The pipeline counts as part of the subpackage textloom.llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import exact_dedup, mixing, near_dedup, packing, quality_rules
from textloom.llm.common import drop_table, read, scratch, temporary_tables
from textloom.sources.tables import dealt

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the adaptive quality rules."""
    return quality_rules.kept_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup.kept_documents(docs, keep="max")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return near_dedup.kept_documents(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences."""
    return packing.packed(docs)


STAGES: list[tuple[str, Stage]] = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixture), ("packing", packing_stage)]

#: No SQL: near duplicates and packing aren't expressible; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = dealt(read(spark, sf_dir, "documents")), None
    for name, stage in STAGES:
        path = scratch(spark, name)
        with temporary_tables(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = dealt(spark.read.schema(made.schema).parquet(path))
        if last:
            drop_table(spark, last)
        last = path
    return spark.read.schema(made.schema).parquet(path)
