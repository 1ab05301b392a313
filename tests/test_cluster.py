"""On two executors that share nothing with the driver but one folder: models by address, tiles, the vector store and archives."""

from __future__ import annotations

import hashlib
import importlib.util
import os
import subprocess
import sys
import zipfile
from pathlib import Path

import numpy as np
import pytest

from tests.conftest import ROOT
from tests.test_models import tiny_onnx

PROGRAM = '''
import sys
import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from textloom.operators import embed, ranking
from textloom.operators.vector_store import VectorStore
from textloom.operators.wordpiece import BertTokenizer
from textloom.sources import archive

shared, digest = sys.argv[1:]
conf = {"spark.executor.memory": "700m", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.checkpoint.dir": f"file://{shared}/tables", "spark.driver.host": "127.0.0.1"}
spark = SparkSession.builder.master("local-cluster[2,1,700]").config(map=conf).getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
rows = spark.range(40).repartition(4).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hello").otherwise("hello world").alias("text"))

model = embed.Embedder(BertTokenizer(spark, {"hello": 103, "world": 104}, max_length=8), embed.OnnxBackend(f"file://{shared}/model.onnx", 6, sha256=digest))
store = VectorStore(spark, f"file://{shared}/store", "doc_id long")
print("EMBEDDED", store.apply(rows, model.embed, "m").embedded, store.apply(rows, model.embed, "m").embedded)
state = store.state("m")
print("STALE", state.where("stale").count(), "VECTORS", state.select("embedding").distinct().count())

ranking.BROADCAST_BYTES = 0
v = spark.range(200).select("id", F.array(*[F.sin(F.col("id") * k).cast("float") for k in range(1, 5)]).alias("v"))
q, d = v.where("id < 50").select(F.col("id").alias("qid"), F.col("v").alias("q")), v.select(F.col("id").alias("did"), F.col("v").alias("d"))
near = ranking.knn(q, d, 3, block=16)
full = ranking.ranked(ranking.scored(q, d, block=16)).where("rank <= 3")
print("RANKS", near.count(), near.join(full, ["qid", "did", "rank"]).count())

archive.register(spark)
print("MEMBERS", spark.read.format("zip_members").option("partitions", 4).load(f"file://{shared}/corpus.zip").where("error is null").count())
spark.stop()
'''


def test_executors_share_one_folder_only(tmp_path):
    shared = tmp_path / "shared"
    shared.mkdir()
    (shared / "model.onnx").write_bytes(tiny_onnx(np.random.default_rng(1).normal(size=(110, 6)).astype(np.float32)))
    with zipfile.ZipFile(shared / "corpus.zip", "w", compression=zipfile.ZIP_DEFLATED) as z:
        for i in range(50):
            z.writestr(f"{i}.txt", f"text {i} " * 20)
    home = tmp_path / "home"  # executors work in folders below Spark's home
    (home / "work").mkdir(parents=True)
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(home), "PYTHONPATH": str(ROOT), "PYSPARK_PYTHON": sys.executable, "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "PYSPARK_SUBMIT_ARGS": "--driver-memory 1g pyspark-shell"}
    digest = hashlib.sha256((shared / "model.onnx").read_bytes()).hexdigest()
    done = subprocess.run([sys.executable, "-c", PROGRAM, str(shared), digest], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=400, check=False)
    said = [x for x in done.stdout.splitlines() if x.split(" ")[0] in ("EMBEDDED", "STALE", "RANKS", "MEMBERS")]
    if not said and "local-cluster" in done.stderr:
        pytest.skip("no local cluster here")
    assert said == ["EMBEDDED 2 0", "STALE 0 VECTORS 2", "RANKS 150 150", "MEMBERS 50"], done.stderr[-3000:]
    left = [p for p in (home / "work").rglob("*") if p.is_file() and p.suffix not in (".jar", "") and p.stat().st_size > 1_000_000]
    assert left == []  # no model or table stays in an executor's own folder
