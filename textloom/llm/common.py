"""Helpers that the corpus operators share: tables, Arrow batches and salting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.shared import BROADCAST_ROWS, HOT_ROWS, TASK_ROWS, drop_scratch, drop_table, hot_join, scratch, shared_dir, small, small_batches, temporary_tables, written

__all__ = ["BROADCAST_ROWS", "HOT_ROWS", "TASK_ROWS", "WORD", "drop_scratch", "drop_table", "hot_join", "read", "salted_join", "scratch", "shared_dir", "small", "small_batches", "temporary_tables", "text_or_empty", "written"]

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def salted_join(many: DataFrame, one: DataFrame, keys: list[str], rows: Column, each: int = 512) -> DataFrame:
    """Inner join of many rows a key with one row a key; a key of many rows is dealt over rows/each salts.

    ``rows`` (a column of both sides) says how many rows the key has in ``many``; ``__spread`` of ``many`` picks the salt.
    """
    n = F.greatest(F.ceil(rows / F.lit(float(each))), F.lit(1)).cast("int")
    left = many.withColumn("__salt", F.pmod(F.col("__spread"), n.cast("long")).cast("int")).drop("__spread")
    right = one.withColumn("__salt", F.explode(F.sequence(F.lit(0), n - 1)))
    return left.join(right, [*keys, "__salt"]).drop("__salt")
