"""Vectors of a corpus that changes: what is the same is never embedded twice.

A vector is addressed by its model and the SHA-256 of its text. A batch says which keys have which text now, or are gone; only texts whose
address the store doesn't have are embedded. Keys are a log: a batch's keys are written beside the earlier ones, and the latest counts. A snapshot
is a small manifest that names the folders of keys and vectors it is made of; it comes into being when its file gets its name, after all
that it names was written, so readers see a batch whole or not at all, what a failed batch has written isn't seen, and earlier snapshots stay readable until
`vacuum`. One batch is applied at a time.

Results: a null text is a key without a vector, an empty one a text like others. Of a key's rows in one batch a text counts before a deletion, and of texts the
greatest one. Rows without a key are left out.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.shared import drop_table, hot_join, written

#: (digest, text) to (digest, embedding)
Embed = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Snapshot:
    version: int = 0
    keys: list[str] = field(default_factory=list)
    vectors: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Applied:
    version: int
    changed: int
    embedded: int


class VectorStore:
    """A store below a path of any file system that Spark writes to; ``key`` names and types the keys, as in "doc_id long"."""

    def __init__(self, spark: SparkSession, path: str, key: str = "key string"):
        self.spark, self.path = spark, path.rstrip("/")
        self.key, self.kind = key.split()

    # ---- snapshots

    def _manifests(self) -> DataFrame | None:
        try:
            found = self.spark.read.schema("version long, keys array<string>, vectors array<string>").option("recursiveFileLookup", "true").json(f"{self.path}/manifests")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return found

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The latest snapshot, or an earlier one."""
        found = self._manifests()
        row = None if found is None else found.where(F.lit(version is None) | (F.col("version") == version)).orderBy(F.desc("version")).first()
        if row is None and version:
            raise ValueError(f"the store has no version {version}")
        return Snapshot() if row is None else Snapshot(row["version"], list(row["keys"] or []), list(row["vectors"] or []))

    def _publish(self, snapshot: Snapshot) -> None:
        line = self.spark.createDataFrame([(json.dumps(asdict(snapshot)),)], "value string").coalesce(1)
        line.write.mode("errorifexists").text(f"{self.path}/manifests/v{snapshot.version:09d}")

    def _folder(self, kind: str, version: int) -> str:
        return f"{kind}/v{version:09d}-{uuid.uuid4().hex[:12]}"

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        reader = self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], schema)

    def _keys(self, snapshot: Snapshot) -> DataFrame:
        return self._read(snapshot.keys, f"{self.key} {self.kind}, digest string, deleted boolean, version long")

    def vectors(self, snapshot: Snapshot | None = None) -> DataFrame:
        """(model_id, digest, embedding, version): version is that of the batch that embedded the text."""
        return self._read((snapshot or self.snapshot()).vectors, "model_id string, digest string, embedding array<float>, version long")

    def _live(self, snapshot: Snapshot) -> DataFrame:
        """(key, digest) of the keys that there are."""
        latest = F.max_by(F.struct("digest", "deleted"), "version").alias("now")
        return self._keys(snapshot).groupBy(self.key).agg(latest).where("not now.deleted").select(self.key, "now.digest")

    # ---- what it is for

    def apply(self, batch: DataFrame, embed: Embed, model_id: str) -> Applied:
        """Takes batch(key, text) or batch(key, text, deleted) in as one new snapshot. Texts that the model has not embedded yet are."""
        before = self.snapshot()
        version = before.version + 1
        gone = F.coalesce(F.col("deleted").cast("boolean"), F.lit(False)) if "deleted" in batch.columns else F.lit(False)
        rows = batch.where(F.col(self.key).isNotNull()).select(F.col(self.key).cast(self.kind).alias(self.key), F.when(~gone, F.col("text").cast("string")).alias("text"), gone.alias("deleted"))
        rows = written(rows.withColumn("digest", F.sha2(F.encode("text", "UTF-8"), 256)), "batch")
        best = F.max(F.struct(~F.col("deleted"), "text", "digest", "deleted")).alias("best")
        repeated = rows.groupBy(self.key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if not repeated.isEmpty():
            rows = written(rows.groupBy(self.key).agg(best).select(self.key, "best.text", "best.deleted", "best.digest"), "batch")
        keys, vectors = self._folder("keys", version), self._folder("vectors", version)
        rows.select(self.key, "digest", "deleted", F.lit(version).cast("long").alias("version")).write.parquet(f"{self.path}/{keys}")
        # the digests are unique before they are compared, so that a text of many rows is one row
        wanted = rows.where("digest is not null").groupBy("digest").agg(F.first("text").alias("text"))
        have = self.vectors(before).where(F.col("model_id") == model_id).select("digest")
        made = embed(wanted.join(have, "digest", "left_anti")).select(F.lit(model_id).alias("model_id"), "digest", F.col("embedding").cast("array<float>").alias("embedding"), F.lit(version).cast("long").alias("version"))
        made.write.parquet(f"{self.path}/{vectors}")
        embedded = self._read([vectors], "digest string").count()
        self._publish(Snapshot(version, [*before.keys, keys], [*before.vectors, *([vectors] if embedded else [])]))
        return Applied(version, rows.count(), embedded)

    def state(self, model_id: str, version: int | None = None) -> DataFrame:
        """(key, digest, embedding, embedded_in, stale) of every key of a snapshot. stale: it has a text that the model has not embedded."""
        snapshot = self.snapshot(version)
        live = written(self._live(snapshot), "live")
        uses = live.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n"))
        own = self.vectors(snapshot).where(F.col("model_id") == model_id).select("digest", "embedding", F.col("version").alias("embedded_in"))
        # a text may be that of a third of all keys
        found = written(own.join(uses, "digest"), "used-vectors")
        joined = hot_join(live, found, "digest", "n", F.xxhash64(self.key), how="left")
        return joined.select(self.key, "digest", "embedding", "embedded_in", (F.col("digest").isNotNull() & F.col("embedded_in").isNull()).alias("stale"))

    def stale_keys(self, model_id: str) -> DataFrame:
        """Keys whose texts a batch must bring again for this model to have all vectors."""
        return self.state(model_id).where("stale").select(self.key)

    def compact(self) -> Snapshot:
        """A snapshot of the same state: one folder of keys without those that are gone, and one of the vectors that some key uses."""
        before = self.snapshot()
        version = before.version + 1
        keys, vectors = self._folder("keys", version), self._folder("vectors", version)
        self._live(before).select(self.key, "digest", F.lit(False).alias("deleted"), F.lit(version).cast("long").alias("version")).write.parquet(f"{self.path}/{keys}")
        used = self._read([keys], "digest string").where("digest is not null").distinct()
        self.vectors(before).join(used, "digest", "left_semi").select("model_id", "digest", "embedding", "version").write.parquet(f"{self.path}/{vectors}")
        after = Snapshot(version, [keys], [vectors])
        self._publish(after)
        return after

    def vacuum(self, keep: int = 1) -> int:
        """Deletes what only snapshots before the latest ``keep`` ones need, and these snapshots; returns how many folders went."""
        found = self._manifests()
        every = [] if found is None else found.orderBy(F.desc("version")).collect()  # a row a batch since the last vacuum
        kept = {f for r in every[:keep] for f in (*r["keys"], *r["vectors"])}
        old = {f for r in every[keep:] for f in (*r["keys"], *r["vectors"])} - kept
        for r in every[keep:]:
            drop_table(self.spark, f"{self.path}/manifests/v{r['version']:09d}")
        for f in old:
            drop_table(self.spark, f"{self.path}/{f}")
        return len(old)
