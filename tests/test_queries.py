"""Every query against its SQL on the smallest driver tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from textloom.plans import queries as core
from textloom.sources.tables import TABLES


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_equals_sql(spark, con, sf_dir, name):
    df = core.queries()[name](spark, sf_dir)
    rel = con.sql(core.oracle_sql()[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_queries_without_sql_return_every_document(spark, sf_dir, name):
    assert core.queries()[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
    assert set(core.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_knn_plan_shuffles_answers_only(spark, sf_dir):
    plan = core.queries()["knn_topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in plan


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = core.queries()["bert_encode"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
