"""The incremental vector store."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from textloom.operators import embed
from textloom.operators.vector_store import VectorStore
from textloom.operators.wordpiece import BertTokenizer
from textloom.streaming import stream


@pytest.fixture
def embedder(spark):
    return embed.Embedder(BertTokenizer(spark, {c: 103 + i for i, c in enumerate("abcdefgh")}, max_length=8), embed.HashBackend(4), model_id="m")


@pytest.fixture
def store(spark, tmp_path):
    return VectorStore(spark, str(tmp_path / "store"), "doc_id long")


def batch(spark, rows):
    return spark.createDataFrame([(*r, *[False] * (3 - len(r)), "x") for r in rows], "doc_id long, text string, deleted boolean, digest string").repartition(2)


def state(store, model="m", version=None):
    return {r["doc_id"]: (r["digest"], r["embedding"] and list(r["embedding"]), r["embedded_in"], r["stale"]) for r in store.state(model, version).collect()}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_unchanged_texts_are_embedded_once(spark, store, embedder):
    docs = batch(spark, [(i, "abcdefgh"[i % 7]) for i in range(40)])
    first = store.apply(docs, embedder.embed, "m")
    assert (first.version, first.changed, first.embedded) == (1, 40, 7)
    assert store.apply(docs, embedder.embed, "m").embedded == 0
    assert store.apply(docs, embedder.embed, "other").embedded == 7
    direct = {r["doc_id"]: list(r["embedding"]) for r in embedder.embed(docs).collect()}
    now = state(store)
    assert {k: v[1] for k, v in now.items()} == direct and all(v[2] == 1 and not v[3] for v in now.values())


def test_only_what_runs_is_given_to_the_model(spark, store, embedder):
    seen = []

    def counted(rows):
        seen.append(sorted(r["text"] for r in rows.collect()))
        return embedder.embed(rows)

    store.apply(batch(spark, [(1, "a"), (2, "b"), (3, "a")]), counted, "m")
    store.apply(batch(spark, [(1, "c"), (2, "b"), (4, "a")]), counted, "m")
    store.apply(batch(spark, []), counted, "m")
    assert seen == [["a", "b"], ["c"], []]


def test_changes_and_deletions(spark, store, embedder):
    store.apply(batch(spark, [(1, "a"), (2, "b"), (3, None), (4, ""), (5, "e")]), embedder.embed, "m")
    store.apply(batch(spark, [(1, "c"), (2, None, True), (9, None, True), (None, "a")]), embedder.embed, "m")
    now = state(store)
    assert {k: (v[0], v[2], v[3]) for k, v in now.items()} == {1: (digest("c"), 2, False), 3: (None, None, False), 4: (digest(""), 1, False), 5: (digest("e"), 1, False)}
    store.apply(batch(spark, [(2, "b"), (5, "e", True), (5, "a"), (5, "d")]), embedder.embed, "m")
    now = state(store)
    assert now[2][2] == 1 and now[2][0] == digest("b")  # it came back, its vector was there
    assert now[5][0] == digest("d")  # a text before a deletion, the greatest text
    assert sorted(state(store, version=1)) == [1, 2, 3, 4, 5] and state(store, version=1)[1][0] == digest("a")


def test_stale_for_another_model(spark, store, embedder):
    store.apply(batch(spark, [(1, "a"), (2, "b")]), embedder.embed, "old")
    store.apply(batch(spark, [(2, "b"), (3, None)]), embedder.embed, "new")
    assert [r[0] for r in store.stale_keys("new").collect()] == [1]
    assert {k: v[2] for k, v in state(store, "new").items()} == {1: None, 2: 2, 3: None}


def test_a_failed_batch_is_not_seen(spark, store, embedder):
    store.apply(batch(spark, [(1, "a")]), embedder.embed, "m")

    def broken(rows):
        raise RuntimeError("no model")

    with pytest.raises(RuntimeError):
        store.apply(batch(spark, [(1, "b"), (2, "c")]), broken, "m")
    assert store.snapshot().version == 1 and sorted(state(store)) == [1] and state(store)[1][0] == digest("a")
    assert store.apply(batch(spark, [(2, "c")]), embedder.embed, "m").version == 2


def test_compaction_keeps_the_state(spark, store, embedder, tmp_path):
    for rows in ([(i, "abcdefgh"[i % 8]) for i in range(20)], [(i, None, True) for i in range(0, 20, 2)], [(1, "h"), (30, "gh")]):
        store.apply(batch(spark, rows), embedder.embed, "m")
    before = state(store)
    after = store.compact()
    assert state(store) == before and len(after.keys) == len(after.vectors) == 1
    assert {r["digest"] for r in store.vectors().collect()} == {v[0] for v in before.values()}
    assert store.vacuum() == 5  # three batches of keys, and two of vectors, as the second one had none
    assert state(store) == before
    with pytest.raises(ValueError, match="no version 1"):
        store.snapshot(1)


def test_a_text_of_many_keys_is_one_vector(spark, store, embedder, monkeypatch):
    monkeypatch.setattr("textloom.sources.shared.HOT_ROWS", 10)
    store.apply(spark.range(500).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "a").otherwise(F.concat(F.lit("b"), "id")).alias("text")), embedder.embed, "m")
    now = state(store)
    assert len(now) == 500 and sum(v[0] == digest("a") for v in now.values()) == 167 and not any(v[3] for v in now.values())
    assert store.vectors().where(F.col("digest") == digest("a")).count() == 1


def test_an_empty_store(spark, store):
    assert store.snapshot().version == 0 and state(store) == {} and store.vacuum() == 0


def test_streams_feed_the_store(spark, store, embedder, tmp_path):
    for i, rows in enumerate(([(1, "a"), (2, "b")], [(1, "c"), (2, None, True), (3, "a")])):
        batch(spark, rows).select("doc_id", "text", "deleted").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = stream.files(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema)
        live.writeStream.foreachBatch(stream.into_store(store, embedder.embed, "m")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
        assert store.snapshot().version == i + 1
    assert {k: (v[0], v[2]) for k, v in state(store).items()} == {1: (digest("c"), 2), 3: (digest("a"), 1)}
