"""Archives, files of any size and system, ordered objects and model files."""

from __future__ import annotations

import hashlib
import json
import zipfile

import numpy as np
import pytest
from pyarrow import fs as arrow
from pyspark.sql import functions as F

from tests.test_models import tiny_onnx
from textloom.operators import catalog as C
from textloom.operators import embed
from textloom.operators.wordpiece import BertTokenizer
from textloom.sources import archive, files, tables


def packed(path, members, **options):
    with zipfile.ZipFile(path, "w", compression=zipfile.ZIP_DEFLATED) as z:
        z.mkdir("texts")
        for name, content in members.items():
            z.writestr(name, content, **options)
    return str(path)


def members_of(spark, path, **options):
    archive.register(spark)
    return spark.read.format("zip_members").options(**options).load(path)


def test_members_are_dealt_over_tasks(spark, tmp_path):
    members = {f"texts/{i:04d}.txt": f"text {i} " * (i % 50 + 1) for i in range(1000)}
    members |= {"texts/empty.txt": "", "texts/ü.txt": "é", "other/note.md": "x"}
    path = packed(tmp_path / "corpus.zip", members)
    rows = members_of(spark, path, partitions="6").withColumn("task", F.spark_partition_id())
    got = rows.collect()
    assert {r["member"]: bytes(r["content"]).decode() for r in got} == members
    assert all(r["error"] is None and r["archive"] == path and r["size"] == len(r["content"]) for r in got)
    shares = [r["count"] for r in rows.groupBy("task").count().collect()]
    assert 5 <= len(shares) <= 7 and max(shares) < 400
    assert members_of(spark, path, member="texts/00*.txt").count() == 100
    assert members_of(spark, path, member="none*").count() == 0


def test_damaged_members_are_told(spark, tmp_path):
    path = packed(tmp_path / "a.zip", {f"{i}": bytes([i]) * 500 + str(i).encode() for i in range(6)})
    with zipfile.ZipFile(path) as z:
        at = {i.filename: i.header_offset for i in z.infolist()}
    raw = bytearray(open(path, "rb").read())
    raw[at["1"] : at["1"] + 4] = b"none"  # a header
    raw[at["2"] + 33] ^= 0xFF  # content
    whole = bytes(raw)
    open(path, "wb").write(whole)
    with zipfile.ZipFile(tmp_path / "b.zip", "w", compression=zipfile.ZIP_BZIP2) as z:
        z.writestr("bz", "content " * 50)
    got = {r["member"]: (r["content"] and bytes(r["content"]), r["error"]) for r in members_of(spark, f"{path},{tmp_path / 'b.zip'}").collect()}
    assert got["1"] == (None, "its header is damaged") and got["2"][0] is None and ("checksum" in got["2"][1] or "decompressed" in got["2"][1])
    assert got["bz"] == (None, "its compression method 12 is unknown")
    assert all(got[str(i)] == (bytes([i]) * 500 + str(i).encode(), None) for i in (0, 3, 4, 5))
    with open(path, "rb") as f:
        stretch = archive.directory(f)[0]
    locked = archive.Member(**{**stretch.__dict__, "flags": 1})
    with open(path, "rb") as f, pytest.raises(ValueError, match="encrypted"):
        archive.decoded(f, locked)
    with pytest.raises(Exception, match="zip"):
        (tmp_path / "no.zip").write_bytes(b"no archive")
        members_of(spark, str(tmp_path / "no.zip")).collect()


def test_archives_of_a_table(spark, tmp_path):
    rows = spark.createDataFrame([(f"n{i}", bytes([i]) * i, 1) for i in range(30)] + [("none", None, 1), (None, b"x", 1)], "name string, content binary, archive int").repartition(2)
    table = archive.packed(rows, members=4)
    assert table.count() == 8
    got = {r["member"]: bytes(r["content"]) for r in archive.unpacked(table, "archive").collect()}
    assert got == {f"n{i}": bytes([i]) * i for i in range(30)} | {"none": b""}
    odd = spark.createDataFrame([("a", b"no archive"), ("b", None)], "path string, content binary")
    assert sorted((r["archive"], r["member"], r["error"][:16]) for r in archive.unpacked(odd).collect()) == [("a", None, "it is no archive"), ("b", None, "it is no archive")]
    path = packed(tmp_path / "x.zip", {"a": "b"})
    assert [bytes(r["content"]) for r in archive.unpacked(spark.read.format("binaryFile").load(path)).collect()] == [b"b"]


def test_archives_are_loaded_once(tmp_path):
    source = tmp_path / "from"
    source.mkdir()
    path = packed(source / "c.zip", {"a": "b"})
    url, digest = f"file://{path}", files.digest(path)
    got = archive.cached(url, str(tmp_path / "cache"))
    assert got == str(tmp_path / "cache" / "c.zip") and files.digest(got) == digest
    packed(source / "c.zip", {"a": "other"})
    assert files.digest(archive.cached(url, str(tmp_path / "cache"))) == digest  # it is there
    assert files.digest(archive.cached(url, str(tmp_path / "cache"), files.digest(path))) != digest  # not this one
    with pytest.raises(C.FetchError):
        archive.cached(f"file://{tmp_path}/none.zip", str(tmp_path / "cache"))


def test_files_beyond_the_readers_limit_are_hashed(spark, tmp_path):
    """2.2 GB, mostly a hole; the binary reader gives up at 2 GB."""
    size = 2_200_000_000
    (tmp_path / "in").mkdir()
    with open(tmp_path / "in" / "large", "wb") as f:
        f.truncate(size)
        f.seek(size - 3)
        f.write(b"end")
    (tmp_path / "in" / "little").write_bytes(b"x")
    h = hashlib.sha256()
    zeros = bytes(1 << 24)
    left = size - 3
    while left:
        h.update(zeros[: min(left, len(zeros))])
        left -= min(left, len(zeros))
    h.update(b"end")
    got = {r["name"]: (r["size"], r["sha256"]) for r in C.file_digests(spark, str(tmp_path / "in"), chunked=True).collect()}
    assert got == {"large": (size, h.hexdigest()), "little": (1, hashlib.sha256(b"x").hexdigest())}


def test_files_of_another_system_are_hashed(spark, tmp_path):
    """Workers see the folder as the root of a system of its own, where Spark's path means something else."""
    inner = tmp_path / "store" / str(tmp_path).lstrip("/")
    inner.mkdir(parents=True)
    (tmp_path / "f").write_bytes(b"here")
    (inner / "f").write_bytes(b"there")
    other = arrow.SubTreeFileSystem(str(tmp_path / "store"), arrow.LocalFileSystem())
    plain = C.file_digests(spark, str(tmp_path / "f"), chunked=True).first()["sha256"]
    assert plain == hashlib.sha256(b"here").hexdigest()
    assert C.file_digests(spark, str(tmp_path / "f"), chunked=True, filesystem=other).first()["sha256"] == hashlib.sha256(b"there").hexdigest()
    assert files.read_verified("f", hashlib.sha256(b"there").hexdigest(), arrow.SubTreeFileSystem(str(inner), arrow.LocalFileSystem())) == b"there"
    with pytest.raises(ValueError, match="checksum mismatch"):
        files.read_verified(f"file://{tmp_path}/f", "00")
    assert files.exists(f"file:{tmp_path}/f") and not files.exists(str(tmp_path)) and not files.exists(str(tmp_path / "none"))


def test_one_ordered_object_from_many_tasks(spark, tmp_path):
    values = {f"key {i * 7919 % 997:03d}": f"text {i}\n\"{chr(0x20AC)}\" \\   {chr(7)}" for i in range(997)} | {"": "", "ü": None, "z\n": "last"}
    rows = spark.createDataFrame(list(values.items()), "key string, text string")
    more = rows.unionByName(spark.createDataFrame([("", None), (None, "x")], "key string, text string")).repartition(5)
    tables.write_json_object(more, str(tmp_path / "parts"), partitions=7)
    parts = sorted(p.name for p in (tmp_path / "parts").glob("part-*"))
    assert len(parts) >= 6
    tables.joined(spark, str(tmp_path / "parts"), str(tmp_path / "one.json"))
    assert (tmp_path / "one.json").read_text(encoding="utf-8") == tables.sorted_json(rows) + "\n"
    assert json.loads((tmp_path / "one.json").read_text(encoding="utf-8")) == values
    for n, only in enumerate((rows.limit(0), rows.where("key = 'ü'"))):
        tables.write_json_object(only, str(tmp_path / f"few{n}"))
        tables.joined(spark, str(tmp_path / f"few{n}"), str(tmp_path / f"few{n}.json"))
        assert (tmp_path / f"few{n}.json").read_text(encoding="utf-8") == tables.sorted_json(only) + "\n"


def test_models_are_read_where_they_are_used(spark, tmp_path):
    """By address and digest: a worker reads the file at its first text and keeps it for other tasks."""
    table = np.random.default_rng(2).normal(size=(110, 6)).astype(np.float32)
    at = tmp_path / "m" / "model.onnx"
    at.parent.mkdir()
    at.write_bytes(tiny_onnx(table))
    digest = hashlib.sha256(at.read_bytes()).hexdigest()
    rows = spark.createDataFrame([(i, "hello world") for i in range(40)], "id int, text string").repartition(8)
    tokenizer = BertTokenizer(spark, {"hello": 103, "world": 104}, max_length=8)
    made = embed.Embedder(tokenizer, embed.OnnxBackend(f"file://{at}", 6, sha256=digest)).embed(rows)
    assert len({tuple(r["embedding"]) for r in made.collect()}) == 1
    with pytest.raises(Exception, match="checksum mismatch"):
        embed.Embedder(tokenizer, embed.OnnxBackend(str(at), 6, sha256="0" * 64)).embed(rows).collect()
    # a plan without texts needs no model
    nothing = embed.Embedder(tokenizer, embed.OnnxBackend(str(tmp_path / "none"), 6)).embed(spark.createDataFrame([(1, None)], "id int, text string"))
    assert nothing.first()["embedding"] is None


def test_specs_are_loaded_by_address(spark, tmp_path):
    table = np.random.default_rng(3).normal(size=(110, 4)).astype(np.float32)
    folder = tmp_path / "m"
    folder.mkdir()
    (folder / "onnx.bin").write_bytes(tiny_onnx(table))
    (folder / "vocab.bin").write_bytes("\n".join(["[PAD]", *[f"[unused{i}]" for i in range(1, 100)], "[UNK]", "[CLS]", "[SEP]", "hello"]).encode())
    sums = {k: C.ModelFile(f"https://example.invalid/{k}.bin", files.digest(str(folder / f"{k}.bin"))) for k in ("onnx", "vocab")}
    own = C.ModelSpec("m", sums, dimensions=4, tokenizer_family="bert", validated=True)
    loaded = embed.Embedder.load(spark, cache_dir=f"file://{tmp_path}", spec=own, catalog=C.Catalog((own,)))
    v = np.array(loaded.embed(spark.createDataFrame([("hello",)], "text string")).first()["embedding"])
    mean = table[[101, 103, 102]].mean(axis=0)
    assert v == pytest.approx(mean / np.linalg.norm(mean), abs=1e-6)


def test_whole_texts_reach_workers_in_small_batches(spark, tmp_path):
    from textloom.operators import charsmap, unigram

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.range(3).select(F.col("id").alias("doc_id"), F.lit("hello").alias("text"))
    tokens = F.struct(*[F.array(F.lit(1).cast("long")).alias(k) for k in ("input_ids", "attention_mask", "token_type_ids")])
    blob = charsmap.build({"…": "..."})
    for use in (
        lambda: tables.write_json_object(rows, str(tmp_path / "object"), "doc_id"),
        lambda: embed.infer(rows.select(F.struct("doc_id").alias("row"), tokens.alias("tokens")), embed.HashBackend(2)),
        lambda: BertTokenizer(spark, {"hello": 103}),
        lambda: unigram.XlmrTokenizer(spark, {"h": (4, -1.0)}, blob),
        lambda: charsmap.normalizer(spark, blob),
    ):
        spark.conf.set(key, "10000")
        use()
        assert spark.conf.get(key) == "500"
