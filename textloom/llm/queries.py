"""The queries of the corpus operators, each with production parameters over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import chat, conversation_repair, embedding_dedup, exact_dedup, html_extract, license_scan, mixing, near_dedup, packing, periodic_runs, quality_bayes, quality_rules, url_filter
from textloom.llm.common import read
from textloom.sources.tables import dealt

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_bayes.classify(dealt(read(spark, sf_dir, "documents")), read(spark, sf_dir, "labels"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(dealt(read(spark, sf_dir, "documents")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(dealt(read(spark, sf_dir, "documents")))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op4(spark, read(spark, sf_dir, "conversations"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(dealt(read(spark, sf_dir, "pages")))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(read(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(dealt(read(spark, sf_dir, "documents")))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op10(read(spark, sf_dir, "documents"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_dedup(read(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.periodic_runs(dealt(read(spark, sf_dir, "documents")), prepare=periodic_runs.made_periodic)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.op13(read(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality_bayes, op2_quality_rules, op3_license_scan, op4_chat_format, op5_html_extract, op6_exact_dedup, op7_near_dedup, op8_url_filter, op9_packing, op10_mixing, op11_embedding_dedup, op12_periodic_runs, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": quality_rules.oracle_sql(), "op8_url_filter": url_filter.oracle_sql(), "op3_license_scan": license_scan.oracle_sql(), "op4_chat_format": chat.ORACLE_SQL, "op6_exact_dedup": exact_dedup.ORACLE_SQL, "op10_mixing": mixing.ORACLE_SQL, "op11_embedding_dedup": embedding_dedup.ORACLE_SQL, "op13_conversation_repair": conversation_repair.oracle_sql()}
