"""Catalog, model files, embedding, ranking and stored vectors."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import catalog as C
from textloom.operators import embed, ranking
from textloom.operators.wordpiece import BertTokenizer
from textloom.sources import tables
from textloom.streaming import stream


def spec(files: dict[str, bytes], **fields) -> C.ModelSpec:
    made = {k: C.ModelFile(f"https://example.invalid/{k}.bin", hashlib.sha256(b).hexdigest()) for k, b in files.items()}
    return C.ModelSpec(**({"id": "m", "files": made, "dimensions": 4, "tokenizer_family": "bert", "validated": True} | fields))


def test_lookup():
    catalog = C.Catalog()
    assert catalog.lookup().id == "bge-small-en-v1.5" and catalog.lookup().dimensions == 384
    assert catalog.lookup("multilingual-e5-small").prefix("query") == "query: "
    assert [m.id for m in catalog.all()] == ["bge-small-en-v1.5", "multilingual-e5-small", "placeholder-model"]
    with pytest.raises(ValueError, match="bge-small-en-v1.5, multilingual-e5-small, placeholder-model"):
        catalog.lookup("none-such")
    with pytest.raises(C.UnvalidatedModelError, match="placeholder-model"):
        catalog.lookup("placeholder-model")
    assert catalog.is_known("placeholder-model") and not catalog.is_known("none-such")
    assert catalog.is_allowed(spec({}, id="placeholder-model")) and not catalog.is_allowed(spec({}))
    with pytest.raises(ValueError, match="kind"):
        catalog.lookup().prefix("other")


@pytest.mark.parametrize(("family", "said"), [(None, "null"), ("gpt", "'gpt'")])
def test_family(family, said):
    with pytest.raises(ValueError, match=said):
        C.family_of(spec({}, tokenizer_family=family))
    assert C.family_of(spec({}, tokenizer_family="xlmr")) == "xlmr"
    with pytest.raises(ValueError, match="dimensions"):
        C.dimensions_of(spec({}, dimensions=None))


def test_files_are_verified(spark, tmp_path):
    files = {"onnx": b"model" * 1000, "vocab": b"words"}
    s = spec(files)
    folder = tmp_path / "m"
    folder.mkdir()
    with pytest.raises(Exception, match="missing|PATH_NOT_FOUND|onnx"):
        C.resolve(spark, s, str(tmp_path))
    for k, b in files.items():
        (folder / f"{k}.bin").write_bytes(b)
    assert {k: p.rsplit("/", 1)[-1] for k, p in C.resolve(spark, s, str(tmp_path)).items()} == {"onnx": "onnx.bin", "vocab": "vocab.bin"}
    chunked = {r["name"]: r["sha256"] for r in C.file_digests(spark, str(folder), chunked=True).collect()}
    assert chunked == {f"{k}.bin": hashlib.sha256(b).hexdigest() for k, b in files.items()}
    (folder / "vocab.bin").write_bytes(b"other")
    with pytest.raises(ValueError, match=r"checksum mismatch.*SHA-256.*" + s.files["vocab"].sha256):
        C.resolve(spark, s, str(tmp_path))
    (folder / "extra.bin").write_bytes(b"x")
    manifest = spark.createDataFrame([("onnx.bin", s.files["onnx"].sha256.upper()), ("vocab.bin", s.files["vocab"].sha256), ("gone.bin", "00")], "name string, sha256 string")
    status = {r["name"]: r["status"] for r in C.verified(manifest, C.file_digests(spark, str(folder))).collect()}
    assert status == {"onnx.bin": "ok", "vocab.bin": "mismatch", "gone.bin": "missing", "extra.bin": "extra"}


def test_models_are_fetched_once_and_verified(tmp_path):
    files = {"onnx": b"model" * 500_000, "vocab": b"words"}
    source = tmp_path / "from"
    source.mkdir()
    for k, b in files.items():
        (source / f"{k}.bin").write_bytes(b)
    made = {k: C.ModelFile((source / f"{k}.bin").as_uri(), hashlib.sha256(b).hexdigest()) for k, b in files.items()}
    s = C.ModelSpec(id="placeholder-model", files=made)  # registered, though not validated
    seen, root = [], tmp_path / "cache"
    got = C.ensure(s, str(root), progress=lambda *a: seen.append(a))
    assert {k: open(p, "rb").read() for k, p in got.items()} == files and sorted(p.name for p in (root / s.id).iterdir()) == ["onnx.bin", "vocab.bin"]
    assert [x for x in seen if x[0] == "onnx"][-1] == ("onnx", 2_500_000, 2_500_000) and len(seen) >= 4

    (source / "onnx.bin").unlink()  # what is there needn't be fetched; what is damaged is
    (root / s.id / "vocab.bin").write_bytes(b"damaged")
    seen.clear()
    assert C.ensure(s, str(root), progress=lambda *a: seen.append(a)) == got and [x[0] for x in seen] == ["vocab"]
    assert (root / s.id / "vocab.bin").read_bytes() == b"words"

    (source / "vocab.bin").write_bytes(b"other")
    (root / s.id / "vocab.bin").unlink()
    with pytest.raises(ValueError, match="checksum mismatch.*vocab.bin has SHA-256.*" + made["vocab"].sha256):
        C.ensure(s, str(root))
    (root / s.id / "onnx.bin").unlink()
    with pytest.raises(C.FetchError, match="onnx.bin"):
        C.ensure(s, str(root))
    assert list((root / s.id).iterdir()) == []  # no part stays
    with pytest.raises(ValueError, match="not registered"):
        C.ensure(spec(files), str(root))


def test_models_over_http(tmp_path):
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/vocab.txt" else 503)
            self.send_header("Content-Length", "5")
            self.end_headers()
            self.wfile.write(b"words")

        def log_message(self, *a): ...

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        at = f"http://127.0.0.1:{server.server_port}"
        got = C.fetch(C.ModelFile(f"{at}/vocab.txt", hashlib.sha256(b"words").hexdigest()), str(tmp_path / "x" / "vocab.txt"))
        assert open(got, "rb").read() == b"words"
        with pytest.raises(C.FetchError, match=f"{at}/other.*503"):
            C.fetch(C.ModelFile(f"{at}/other", "00"), str(tmp_path / "x" / "other"))
    finally:
        server.shutdown()


def _field(number: int, value: bytes | int) -> bytes:
    """A field of a protocol buffer: numbers as they are, all else with its length."""

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def tiny_onnx(table: np.ndarray) -> bytes:
    """A model whose hidden state is a row of the table for each token id. Numbers of fields and types are fixed by the format."""

    def tensor(name: str, kind: int, dims: list[bytes]) -> bytes:
        shape = b"".join(_field(1, d) for d in dims)
        return _field(1, name.encode()) + _field(2, _field(1, _field(1, kind) + _field(2, shape)))

    open_ = [_field(2, b"n"), _field(2, b"t")]
    node = _field(1, b"table") + _field(1, b"input_ids") + _field(2, b"last_hidden_state") + _field(4, b"Gather")
    weights = b"".join(_field(1, n) for n in table.shape) + _field(2, 1) + _field(8, b"table") + _field(9, table.astype("<f4").tobytes())
    inputs = b"".join(_field(11, tensor(n, 7, open_)) for n in ("input_ids", "attention_mask", "token_type_ids"))
    graph = _field(1, node) + _field(2, b"g") + _field(5, weights) + inputs + _field(12, tensor("last_hidden_state", 1, [*open_, _field(1, table.shape[1])]))
    return _field(1, 8) + _field(7, graph) + _field(8, _field(1, b"") + _field(2, 13))


def test_onnx_model(spark, tmp_path):
    table = np.random.default_rng(2).normal(size=(110, 6)).astype(np.float32)
    (tmp_path / "model.onnx").write_bytes(tiny_onnx(table))
    model = embed.Embedder(BertTokenizer(spark, {"hello": 103, "world": 104}, max_length=16), embed.OnnxBackend(str(tmp_path / "model.onnx"), 6), model_id="tiny")
    got = {r["id"]: r["embedding"] for r in model.embed(spark.createDataFrame([(1, "hello world"), (2, ""), (3, None)], "id int, text string")).collect()}
    for i, ids in ((1, [101, 103, 104, 102]), (2, [101, 102])):
        mean = table[ids].mean(axis=0)
        assert got[i] == pytest.approx((mean / np.linalg.norm(mean)).tolist(), abs=1e-6)
    assert got[3] is None


def test_load_checks_before_any_plan(spark, tmp_path):
    with pytest.raises(ValueError, match="model_path or cache_dir"):
        embed.Embedder.load(spark)
    with pytest.raises(FileNotFoundError, match="no such model asset"):
        embed.Embedder.load(spark, model_path=str(tmp_path / "model.onnx"))
    with pytest.raises(ValueError, match="not registered"):
        embed.Embedder.load(spark, cache_dir=str(tmp_path), spec=spec({}))
    with pytest.raises(C.UnvalidatedModelError):
        embed.Embedder.load(spark, cache_dir=str(tmp_path), spec=C.MODELS[2])


def test_stale_vectors(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, model_id string")
    assert sorted(r["id"] for r in C.stale(rows, "a").collect()) == [2, 3]


def embedder(spark, **options):
    return embed.Embedder(BertTokenizer(spark, {"hello": 103, "world": 104}, max_length=8), embed.HashBackend(4), model_id="hash", **options)


def test_embed(spark):
    rows = spark.createDataFrame([(1, "hello"), (2, None), (3, ""), (4, "hello world " * 9)], "id int, text string")
    got = {r["id"]: r for r in embedder(spark).embed(rows).collect()}
    backend = embed.HashBackend(4)
    ids = np.array([[101, 103, 102]])
    want = embed.unit(embed.pool(backend.run(ids, ids, ids)[0], np.ones(3, int)))
    assert got[1]["embedding"] == pytest.approx(want.tolist(), abs=1e-7) and not got[1]["truncated"] and got[1]["model_id"] == "hash"
    assert got[2]["embedding"] is None and got[4]["truncated"]
    assert all(abs(sum(x * x for x in got[i]["embedding"]) - 1) < 1e-5 for i in (1, 3, 4))
    with_prefix = {r["id"]: r["embedding"] for r in embedder(spark, document_prefix="world ").embed(rows).collect()}
    assert with_prefix[3] != got[3]["embedding"] and with_prefix[1] != got[1]["embedding"]
    with pytest.raises(ValueError, match="kind"):
        embedder(spark).embed(rows, kind="other")


def test_backend_is_opened_and_closed(spark, tmp_path):
    class Noisy(embed.HashBackend):
        def open(self):
            (tmp_path / "open").touch()

        def run(self, *a):
            raise RuntimeError("broken")

        def close(self):
            (tmp_path / "closed").touch()

    broken = embed.Embedder(BertTokenizer(spark, {}, max_length=8), Noisy(4))
    with pytest.raises(Exception, match="broken"):
        broken.embed(spark.createDataFrame([("x",)], "text string")).collect()
    assert (tmp_path / "open").exists() and (tmp_path / "closed").exists()


def test_wrong_dimensions(spark):
    class Wide(embed.HashBackend):
        def run(self, *a):
            return embed.HashBackend(9).run(*a)

    with pytest.raises(Exception, match="9 dimensions, not 4"):
        embed.Embedder(BertTokenizer(spark, {}, max_length=8), Wide(4)).embed(spark.createDataFrame([("x",)], "text string")).collect()


@pytest.mark.parametrize("block", [3, 1024])
def test_knn_equals_full_ranking(spark, block):
    r = np.random.default_rng(5)
    v = [(i, [float(np.float32(x)) for x in r.normal(size=6)]) for i in range(40)]
    v += [(40 + i, v[i][1]) for i in range(5)]  # ties
    d = spark.createDataFrame(v, "did long, d array<float>").repartition(3)
    q = spark.createDataFrame(v[:7], "qid long, q array<float>")
    full = ranking.rank(ranking.scored(q, d), 10).collect()
    fast = ranking.knn(q, d, 10, block=block).collect()
    key = lambda x: (x["qid"], x["rank"], x["did"], x["score"])
    assert sorted(map(key, full)) == sorted(map(key, fast))


def test_half_up():
    from decimal import ROUND_HALF_UP, Decimal

    r = np.random.default_rng(3)
    x = np.concatenate([r.uniform(-2, 2, 3000), r.integers(-2_000_000, 2_000_000, 500) / 1e6 + 5e-7, [0.0, -0.0, 1e-9, 0.0000005, -0.0000015, 1.0, 123456789.1234565]])
    want = [float(Decimal(repr(float(v))).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for v in x]
    assert ranking.half_up(x).tolist() == want
    assert np.isnan(ranking.half_up(np.array([np.nan]))[0]) and ranking.half_up(np.array([np.inf]))[0] == np.inf


def test_vector_store(spark, tmp_path):
    rows = spark.createDataFrame([(1, "m", [0.5, -1.0, 0.0])], "id int, model_id string, embedding array<float>")
    tables.write_vectors(rows, str(tmp_path / "v"))
    back = tables.read_vectors(spark, str(tmp_path / "v")).first()
    assert back["model_id"] == "m" and back["embedding"] == pytest.approx([0.5, -1, 0], abs=0.004)


def test_json_corpus(spark, tmp_path):
    rows = spark.createDataFrame([("b", "zwei"), ("a", "één")], "key string, text string")
    (tmp_path / "c.json").write_text(tables.sorted_json(rows), encoding="utf-8")
    assert (tmp_path / "c.json").read_text(encoding="utf-8").index('"a"') < (tmp_path / "c.json").read_text(encoding="utf-8").index('"b"')
    assert {r["key"]: r["text"] for r in tables.text_corpus(spark, str(tmp_path / "c.json")).collect()} == {"a": "één", "b": "zwei"}
    tables.write_sorted_json(rows, str(tmp_path / "out"))
    assert [r["key"] for r in spark.read.json(str(tmp_path / "out")).orderBy("key").collect()] == ["a", "b"]


def test_streams(spark, tmp_path):
    r = np.random.default_rng(1)
    v = [(i, [float(np.float32(x)) for x in r.uniform(-1, 1, 4)]) for i in range(30)]
    source = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    live = stream.files(spark, str(tmp_path / "in"), source.schema)
    stream.drain(stream.quantised(live), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["vec_id"]: r["sq8"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["vec_id"]: r["sq8"] for r in stream.quantised(source).collect()}
    assert got == want

    candidates = source.select(F.col("vec_id").alias("did"), F.col("embedding").alias("d"))
    find, seen = stream.nearest(None, candidates, 3), []
    queries = live.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    queries.writeStream.foreachBatch(lambda b, i: seen.extend(find(b, i).collect())).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination()
    assert len(seen) == 90


def test_texts_of_a_length_are_run_together(spark):
    """The same vectors in the same order, with a fraction of the padding."""
    r = np.random.default_rng(6)
    lengths = r.integers(1, 60, size=300)
    rows = spark.createDataFrame([(i, " ".join("ab"[(i + k) % 2] for k in range(n))) for i, n in enumerate(lengths.tolist())] + [(-1, None), (-2, "")], "id int, text string").coalesce(1)

    class Counted(embed.HashBackend):
        def run(self, ids, mask, types):
            assert len(ids) <= 32 and ids.shape == mask.shape == types.shape and mask.sum(axis=1).max() == ids.shape[1]
            return super().run(ids, mask, types)

    made = embed.Embedder(BertTokenizer(spark, {"a": 103, "b": 104}, max_length=64), Counted(4)).embed(rows).collect()
    assert [x["id"] for x in made] == [*range(300), -1, -2]
    one = embed.HashBackend(4)
    for x in made:
        if x["text"] is None:
            assert x["embedding"] is None
            continue
        ids = np.array([[101, *[103 + "ab".index(w) for w in x["text"].split()], 102]])
        mask = np.ones_like(ids)
        assert x["embedding"] == embed.unit(embed.pool(one.run(ids, mask, mask)[0], mask[0])).tolist()
    came = [np.arange(len(lengths))[i : i + 32] for i in range(0, len(lengths), 32)]
    before, after = embed.padding(lengths, came), embed.padding(lengths, embed.batches_by_length(lengths, 32))
    print("padded tokens", before, "as they came,", after, "by length")
    assert after < before / 5
