"""The pipeline's stages against plain versions, and the registry."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F
from tests.llm.test_dedup import edited, near_by_hand
from tests.llm.test_quality import clean, figures_by_hand

import __spark_entry__ as entry
import corpus_pipeline
from textloom.llm import common

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=1, n=90):
    r = random.Random(seed)
    rows = []

    def add(text):
        rows.append((len(rows), text, r.choice(["en", "de", None]), r.choice(["s1", "s1", "s2", None]), len(text or "")))

    for i in range(n):
        words = clean(r, r.randrange(30, 90)).split()
        add(" ".join(words))
        if i % 6 == 0:
            add(rows[-1][1])
        if i % 7 == 0:
            add(" ".join(edited(words, r, 0.01)))
        if i % 9 == 0:
            add(" ".join(w + "###" for w in words))
    for text in (None, "", "short text", "again " * 50):
        add(text)
    return rows


def test_stages(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, COLUMNS)
    step = lambda k, d: corpus_pipeline.STAGES[k][1](spark, d, "")
    kept = step(0, docs).cache()
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    for i, text, *_ in rows:
        f = figures_by_hand(text)
        good = f[0] >= 20 and 100 * f[5] <= 30 * f[0] and "#" not in (text or "") and not (text or "").startswith("again")
        assert (i in ids) == good, (i, text)

    once = step(1, kept).cache()
    last = {}
    for i, text, *_ in rows:
        if i in ids:
            last[text] = i
    assert once.columns == docs.columns and {r["doc_id"] for r in once.collect()} == set(last.values())

    apart = step(2, once).cache()
    left = [(r[0], r[1]) for r in rows if r[0] in set(last.values())]
    assert apart.columns == docs.columns and {r["doc_id"] for r in apart.collect()} == set(near_by_hand(left).values())

    mixed = step(3, apart).cache()
    assert mixed.columns == docs.columns
    words = lambda d: sum(len(r["text"].split()) for r in d.collect())
    assert 1.3 * words(apart) < words(mixed) <= 1.5 * words(apart)
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2

    packed = step(4, mixed).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed.collect()}
    used: dict = {}
    for r in packed:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 2048


def test_run_is_its_stages(spark, tmp_path):
    spark.createDataFrame(documents(2, 40), COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    at = f"{common.shared_dir(spark)}/textloom".removeprefix("file://")
    before = set(os.listdir(at)) if os.path.exists(at) else set()
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {x.split("-")[0] for x in set(os.listdir(at)) - before} == {"packing"}  # only the last stage's table stays
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    key = lambda r: (r["doc_id"], r["start"], r["ids_crc32"])
    assert sorted(map(key, whole.collect())) == sorted(map(key, docs.collect()))


def test_stages_on_nothing(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert any(x.startswith(f"op{n}_") for x in names)


@pytest.mark.parametrize("name", ["op2_quality_rules", "op3_license_scan", "op4_chat_format", "op6_exact_dedup", "op8_url_filter", "op10_mixing", "op11_embedding_dedup", "op13_conversation_repair"])
def test_operators_equal_sql(spark, sf_dir, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(rel.columns)
    assert sorted(repr(tuple(r[c] for c in rel.columns)) for r in got.collect()) == sorted(map(repr, rel.fetchall()))


def test_registered_near_dedup_by_hand(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = entry.queries()["op7_near_dedup"](spark, sf_dir).collect()
    assert {r["doc_id"]: r["class_id"] for r in got} == near_by_hand(rows)


def test_registered_packing_by_hand(spark, sf_dir):
    import zlib

    import numpy as np
    import public_tokenizers as files
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(files.path("byte_bpe_50k.json"))
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(r["doc_id"], p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = entry.queries()["op9_packing"](spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    places: dict = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        held.sort()
        assert all(a + n == b for (a, n), (b, _) in zip([(0, 0), *held], held, strict=False)) and sum(n for _, n in held) <= 2048
    assert len(places) <= -(-sum(n for *_, n, _ in want) // 2048) + 1


@pytest.mark.parametrize(("name", "table"), [("op1_quality_bayes", "documents"), ("op5_html_extract", "pages")])
def test_operators_return_every_row(spark, sf_dir, name, table):
    assert entry.queries()[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
