"""The operators are stateless, so they run on streams as they do on tables; ranking is a stream-static join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from textloom.functions import sq8
from textloom.operators import ranking
from textloom.operators.vector_store import Embed, VectorStore


def files(spark: SparkSession, path: str, schema: StructType, glob: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)


def quantised(vectors: DataFrame, key: str = "vec_id") -> DataFrame:
    return vectors.select(key, sq8.quantise(F.col("embedding")).alias("sq8"))


def nearest(queries: DataFrame, candidates: DataFrame, k: int) -> Callable[[DataFrame, int], DataFrame]:
    """For foreachBatch: the k nearest static candidates(did, d) of each streamed query(qid, q)."""
    return lambda batch, _=0: ranking.knn(batch, candidates, k)


def drain(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append", partition_by: list[str] | None = None) -> None:
    """Writes all that is there and stops."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (writer.partitionBy(*partition_by) if partition_by else writer).format("parquet").start(path).awaitTermination()


def into_store(store: VectorStore, embed: Embed, model_id: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch of (key, text) or (key, text, deleted) becomes a snapshot of the store. A batch that comes again after a failure changes
    nothing, as its texts have been embedded."""

    def apply(batch: DataFrame, _: int = 0) -> None:
        store.apply(batch, embed, model_id)

    return apply
