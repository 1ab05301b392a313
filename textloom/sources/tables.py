"""Sources and sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import sq8
from textloom.sources import files
from textloom.sources.shared import small_batches

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """The rows over all cores, if their source has splits for less than half of them, as small files do: for work that costs more than
    moving the rows. Large sources have more splits; their rows stay where they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    splits = rows._jdf.queryExecution().toRdd().getNumPartitions()
    return rows if 2 * splits > cores else rows.repartition(cores)


def text_corpus(spark: SparkSession, path: str, key: str = "key") -> DataFrame:
    """(key, text) of a JSON file that maps keys to texts. The file is configuration: it is read as a whole."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string, string>")).alias(key, "text"))


def write_vectors(vectors: DataFrame, path: str, *, key: str = "id", mode: str = "errorifexists") -> None:
    """vectors(key, model_id, embedding) as (key, model_id, sq8): a byte a dimension."""
    vectors.select(key, "model_id", sq8.to_binary(sq8.quantise(F.col("embedding"))).alias("sq8")).write.mode(mode).parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(path)
    return stored.withColumn("embedding", sq8.dequantise(sq8.from_binary(F.col("sq8")))).drop("sq8")


def write_sorted_json(rows: DataFrame, path: str, key: str = "key", value: str = "text") -> None:
    """JSON lines in order of the key."""
    rows.select(key, value).orderBy(key).write.json(path)


def write_json_object(rows: DataFrame, path: str, key: str = "key", value: str = "text", partitions: int | None = None) -> None:
    """One pretty object in order of its keys, of any size, as fragments: files of a folder that make the object if they are put together in the order of
    their names (`joined`). Keys are dealt by ranges, and each task writes its own; which key opens the object and which closes it is asked before.
    Of a key's values the greatest counts; null keys are left out."""
    small_batches(rows.sparkSession)  # values are whole texts
    one = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("k")).agg(F.max(F.col(value).cast("string")).alias("v"))
    first, last = one.agg(F.min("k"), F.max("k")).first()
    if first is None:
        one.sparkSession.createDataFrame([("{}",)], "value string").coalesce(1).write.text(path)
        return

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, v in zip(batch["k"].to_pylist(), batch["v"].to_pylist(), strict=True):
                own = f"  {json.dumps(k, ensure_ascii=False)}: {json.dumps(v, ensure_ascii=False)}"
                out.append(("{\n" if k == first else "") + own + ("\n}" if k == last else ","))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    dealt_out = one.repartitionByRange(partitions, "k") if partitions else one.repartitionByRange("k")
    dealt_out.sortWithinPartitions("k").mapInArrow(lines, "value string").write.text(path)


def joined(spark: SparkSession, folder: str, path: str) -> None:
    """A folder's fragments in one file, for readers that want one: copied a chunk at a time, whatever their size. Both on a file system that Arrow opens."""
    names = sorted(r["path"] for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path").collect())  # a row a fragment
    fs, at = files.located(path)
    with fs.open_output_stream(at, compression=None) as out:
        for name in names:
            for part in files.chunks(name):
                out.write(part)


def sorted_json(rows: DataFrame, key: str = "key", value: str = "text") -> str:
    """One pretty object in order of its keys, for small fixtures."""
    return json.dumps({r[0]: r[1] for r in rows.select(key, value).orderBy(key).collect()}, indent=2, ensure_ascii=False)
