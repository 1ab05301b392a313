"""Model catalog as typed rows, its checks, and the verification of model files."""

from __future__ import annotations

import hashlib
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.tokens import FAMILIES
from textloom.sources.files import CHUNK_BYTES, digest


@dataclass(frozen=True)
class ModelFile:
    url: str
    sha256: str

    @property
    def name(self) -> str:
        return self.url.rsplit("/", 1)[-1]


@dataclass(frozen=True)
class ModelSpec:
    id: str
    files: dict[str, ModelFile]
    dimensions: int | None = None
    tokenizer_family: str | None = None
    query_prefix: str | None = None
    document_prefix: str | None = None
    validated: bool = False

    def prefix(self, kind: str) -> str | None:
        if kind not in ("document", "query"):
            raise ValueError(f"kind must be 'document' or 'query', not {kind!r}")
        return self.document_prefix if kind == "document" else self.query_prefix


class UnvalidatedModelError(NotImplementedError):
    """The model is registered, but not validated for production."""


_HUB = "https://huggingface.co"
# The registered models, where their files are published, and the digests of these.
MODELS: tuple[ModelSpec, ...] = (
    ModelSpec(
        id="bge-small-en-v1.5",
        files={
            "onnx": ModelFile(f"{_HUB}/BAAI/bge-small-en-v1.5/resolve/main/onnx/model.onnx", "828e1496d7fabb79cfa4dcd84fa38625c0d3d21da474a00f08db0f559940cf35"),
            "vocab": ModelFile(f"{_HUB}/BAAI/bge-small-en-v1.5/resolve/main/vocab.txt", "07eced375cec144d27c900241f3e339478dec958f92fddbc551f295c992038a3"),
        },
        dimensions=384,
        tokenizer_family="bert",
        validated=True,
    ),
    ModelSpec(
        id="multilingual-e5-small",
        files={
            "onnx": ModelFile(f"{_HUB}/intfloat/multilingual-e5-small/resolve/main/onnx/model.onnx", "ca456c06b3a9505ddfd9131408916dd79290368331e7d76bb621f1cba6bc8665"),
            "vocab": ModelFile(f"{_HUB}/intfloat/multilingual-e5-small/resolve/main/tokenizer.json", "0b44a9d7b51c3c62626640cda0e2c2f70fdacdc25bbbd68038369d14ebdf4c39"),
        },
        dimensions=384,
        tokenizer_family="xlmr",
        query_prefix="query: ",
        document_prefix="passage: ",
        validated=True,
    ),
    ModelSpec(
        id="placeholder-model",
        files={
            "onnx": ModelFile("https://example.invalid/placeholder/model.onnx", "0" * 64),
            "vocab": ModelFile("https://example.invalid/placeholder/vocab.txt", "0" * 64),
        },
        dimensions=0,
    ),
)
DEFAULT_MODEL = "bge-small-en-v1.5"


@dataclass
class Catalog:
    """Lookups happen on the driver, before a plan is built; the relational forms are for joins."""

    models: tuple[ModelSpec, ...] = MODELS
    _by_id: dict[str, ModelSpec] = field(init=False, repr=False)

    def __post_init__(self) -> None:
        self._by_id = {m.id: m for m in self.models}

    def all(self) -> list[ModelSpec]:
        return list(self.models)

    def is_known(self, model_id: str) -> bool:
        return model_id in self._by_id

    def is_allowed(self, spec: ModelSpec) -> bool:
        """Registered, validated or not."""
        return self.is_known(spec.id)

    def lookup(self, model_id: str = DEFAULT_MODEL) -> ModelSpec:
        if model_id not in self._by_id:
            raise ValueError(f"no model {model_id!r} is registered; there are: {', '.join(self._by_id)}")
        spec = self._by_id[model_id]
        if not spec.validated:
            raise UnvalidatedModelError(f"model {model_id!r} is registered, but not validated for production use yet")
        return spec

    def rows(self, spark: SparkSession) -> DataFrame:
        schema = "position int, id string, dimensions int, tokenizer_family string, query_prefix string, document_prefix string, validated boolean"
        return spark.createDataFrame([(i, m.id, m.dimensions, m.tokenizer_family, m.query_prefix, m.document_prefix, m.validated) for i, m in enumerate(self.models)], schema)

    def files(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(m.id, k, f.url, f.sha256, f.name) for m in self.models for k, f in m.files.items()], "id string, key string, url string, sha256 string, name string")

    def permitted(self, wanted: DataFrame, column: str = "model_id") -> DataFrame:
        """Rows of registered models."""
        return wanted.join(F.broadcast(self.rows(wanted.sparkSession).select(F.col("id").alias(column))), column, "left_semi")

    def refused(self, wanted: DataFrame, column: str = "model_id") -> DataFrame:
        return wanted.join(F.broadcast(self.rows(wanted.sparkSession).select(F.col("id").alias(column))), column, "left_anti")


def family_of(spec: ModelSpec) -> str:
    if spec.tokenizer_family not in FAMILIES:
        said = "null (missing)" if spec.tokenizer_family is None else repr(spec.tokenizer_family)
        raise ValueError(f"model {spec.id!r} has tokenizer family {said}; known are {', '.join(FAMILIES)}")
    return spec.tokenizer_family


def dimensions_of(spec: ModelSpec) -> int:
    if not spec.dimensions or spec.dimensions < 0:
        raise ValueError(f"model {spec.id!r} has no dimensions")
    return spec.dimensions


def stale(vectors: DataFrame, model_id: str) -> DataFrame:
    """Vectors of another model, or of none that is known: they must be made anew."""
    return vectors.where(~F.col("model_id").eqNullSafe(F.lit(model_id)))


def file_digests(spark: SparkSession, root: str, *, chunked: bool = False, filesystem: FileSystem | None = None) -> DataFrame:
    """(path, name, size, sha256) of the files below a folder; the reader passes over empty ones. chunked: streams them in workers, a chunk at a time, for files
    beyond 2 GB; their file system must then be one that Arrow opens, or be given (its paths are then the ones that Spark lists, without their scheme and host)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    if not chunked:
        return files.select("path", name.alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path in batch["path"].to_pylist():
                digests.append(digest(urlparse(path).path if filesystem else path, filesystem))
            yield pa.RecordBatch.from_arrays([batch["path"], batch["size"], pa.array(digests)], names=["path", "size", "sha256"])

    out = files.select("path", F.col("length").alias("size")).mapInArrow(run, "path string, size long, sha256 string")
    return out.select("path", name.alias("name"), "size", "sha256")


def verified(manifest: DataFrame, found: DataFrame, key: str = "name") -> DataFrame:
    """(key, expected, actual, status) of manifest(key, sha256) against found(key, sha256): ok, mismatch, missing or extra."""
    a = manifest.select(key, F.col("sha256").alias("expected"))
    b = found.select(key, F.col("sha256").alias("actual"))
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.lower("expected") == F.lower("actual"), "ok").otherwise("mismatch")
    return a.join(b, key, "full_outer").withColumn("status", status)


class FetchError(OSError):
    """A file's address gives no content."""


def fetch(file: ModelFile, path: str, progress: Callable[[int, int | None], None] | None = None) -> str:
    """Streams a file to ``path`` and hashes it on the way: into path.part first, which gets its name only if the digest is right and
    is deleted otherwise (any will do if none is expected). progress is told the bytes received and, if known, their total. Addresses: http, https and file."""
    part, h, received = f"{path}.part", hashlib.sha256(), 0
    os.makedirs(os.path.dirname(path), exist_ok=True)
    try:
        try:
            with urllib.request.urlopen(file.url) as source, open(part, "wb") as out:
                total = source.headers.get("Content-Length")
                while chunk := source.read(CHUNK_BYTES):
                    out.write(chunk)
                    h.update(chunk)
                    received += len(chunk)
                    if progress:
                        progress(received, None if total is None else int(total))
        except urllib.error.HTTPError as e:
            raise FetchError(f"{file.url}: HTTP status {e.code}") from e
        except urllib.error.URLError as e:
            raise FetchError(f"{file.url}: {e.reason}") from e
        if file.sha256 and h.hexdigest() != file.sha256.lower():
            raise ValueError(f"checksum mismatch: {path} has SHA-256 {h.hexdigest()}, expected {file.sha256}")
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return path


def ensure(spec: ModelSpec, root: str, *, catalog: Catalog | None = None, progress: Callable[[str, int, int | None], None] | None = None) -> dict[str, str]:
    """Paths of a registered model's files below root/id, on the driver. Files that are there with the right digest are used; those that
    are missing or damaged are fetched."""
    if not (catalog or Catalog()).is_allowed(spec):
        raise ValueError(f"model {spec.id!r} is not registered")
    out = {}
    for key, f in spec.files.items():
        path = os.path.join(root, spec.id, f.name)
        if not os.path.exists(path) or digest(path) != f.sha256.lower():
            fetch(f, path, progress and (lambda n, total, key=key: progress(key, n, total)))
        out[key] = path
    return out


def resolve(spark: SparkSession, spec: ModelSpec, root: str) -> dict[str, str]:
    """Paths of a model's files below root/id. Raises if one is missing or has another digest."""
    state = {r["name"]: r for r in file_digests(spark, f"{root.rstrip('/')}/{spec.id}").collect()}  # a model's few files
    out = {}
    for key, f in spec.files.items():
        if f.name not in state:
            raise FileNotFoundError(f"{spec.id}: {f.name} is missing below {root}")
        if state[f.name]["sha256"] != f.sha256.lower():
            raise ValueError(f"checksum mismatch: {state[f.name]['path']} has SHA-256 {state[f.name]['sha256']}, expected {f.sha256}")
        out[key] = state[f.name]["path"]
    return out
