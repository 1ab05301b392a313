"""Embedding: prefix, tokenise, infer, pool and normalise, in Arrow batches. Hidden states never leave the worker."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators.catalog import DEFAULT_MODEL, Catalog, ModelSpec, UnvalidatedModelError, dimensions_of, family_of, resolve
from textloom.operators.unigram import XlmrTokenizer, load_pieces
from textloom.operators.wordpiece import BertTokenizer, load_vocabulary
from textloom.sources.files import exists, read_verified
from textloom.sources.shared import small_batches

KINDS = ("document", "query")


class ModelTokenizer(Protocol):
    """Anything that turns a text column into a column of input_ids, attention_mask, token_type_ids and truncated."""

    max_length: int

    def encode(self, text: Column) -> Column: ...


class Backend(Protocol):
    """Inference in a worker. It is pickled to the worker and opened there once a task; sessions are never shipped."""

    dimensions: int

    def open(self) -> None: ...

    def run(self, input_ids: np.ndarray, attention_mask: np.ndarray, token_type_ids: np.ndarray) -> np.ndarray:
        """float32 [batch, tokens, dimensions]"""
        ...

    def close(self) -> None: ...


class HashBackend:
    """A stand-in model for tests and oracles: integer arithmetic on token id and dimension. It shows that the plumbing is
    right and says nothing about meaning."""

    def __init__(self, dimensions: int = 16):
        self.dimensions = dimensions

    def open(self) -> None: ...

    def run(self, input_ids: np.ndarray, attention_mask: np.ndarray, token_type_ids: np.ndarray) -> np.ndarray:
        d = np.arange(self.dimensions, dtype=np.int64)
        return (((input_ids[:, :, None] * 31 + d * 17) % 2003) / 1001.0 - 1.0).astype(np.float32)

    def close(self) -> None: ...


class OnnxBackend:
    """An ONNX model file, by onnxruntime. Only its address goes to the workers (a path or address as in `files`, that all of them reach): a worker reads it
    when the first text comes, compares its SHA-256 if one is expected, and keeps the session for later tasks. Nothing is stored on its host."""

    def __init__(self, path: str, dimensions: int, threads: int = 1, sha256: str | None = None):
        self.path, self.dimensions, self.threads, self.sha256 = path, dimensions, threads, sha256
        self._session = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_session": None}

    def open(self) -> None: ...

    def _opened(self):
        """The worker's session for this file. A file that is replaced under its address must come with its digest to be seen."""
        key = self.path, self.sha256, self.threads
        if key not in _sessions:
            import onnxruntime

            content = read_verified(self.path, self.sha256)
            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = self.threads
            _sessions.clear()  # a worker has one model at a time
            _sessions[key] = onnxruntime.InferenceSession(content, options, providers=["CPUExecutionProvider"])
        return _sessions[key]

    def run(self, input_ids: np.ndarray, attention_mask: np.ndarray, token_type_ids: np.ndarray) -> np.ndarray:
        self._session = self._session or self._opened()
        (hidden,) = self._session.run(["last_hidden_state"], {"input_ids": input_ids, "attention_mask": attention_mask, "token_type_ids": token_type_ids})
        if hidden.dtype != np.float32:
            raise TypeError(f"the model gives {hidden.dtype}, not float32")
        return hidden

    def close(self) -> None:
        self._session = None


#: Sessions of a worker.
_sessions: dict[tuple, object] = {}


def pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked mean of [tokens, dimensions] in single precision and token order; zeros if no token counts."""
    on = hidden[mask == 1]
    return on.sum(axis=0, dtype=np.float32) / np.float32(len(on)) if len(on) else np.zeros(hidden.shape[1], np.float32)


def unit(v: np.ndarray) -> np.ndarray:
    total = 0.0
    for x in v.tolist():
        total += x * x
    return v if total == 0 else (v.astype(np.float64) / np.sqrt(total)).astype(np.float32)


def batches_by_length(lengths: np.ndarray, batch: int) -> list[np.ndarray]:
    """Places of texts in batches of texts about as long, so that little padding is run. Of equal lengths the order stays."""
    order = np.argsort(lengths, kind="stable")
    return [order[at : at + batch] for at in range(0, len(order), batch)]


def padding(lengths: np.ndarray, batches: list[np.ndarray]) -> int:
    """Tokens that batches run beyond those of their texts."""
    return int(sum(len(b) * max(1, lengths[b].max()) - lengths[b].sum() for b in batches if len(b)))


def infer(rows: DataFrame, backend: Backend, *, batch: int = 32) -> DataFrame:
    """rows(row struct, tokens struct) with embedding array<float>. Texts are run ``batch`` at a time, cut to the longest of
    them: padding beyond it has no weight. A task's Arrow batch of rows is a window in which texts are ordered by their tokens before
    they are run, so that those of a batch are about as long; rows come out in the order they came in."""
    small_batches(rows.sparkSession)  # a row holds three numbers for each of max_length tokens
    kind = rows.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend.open()
        try:
            for b in batches:
                tokens = b["tokens"]
                there = np.nonzero(np.asarray(tokens.is_valid()))[0]
                vectors = np.zeros((b.num_rows, backend.dimensions), np.float32)
                given = tokens.drop_null()
                ids, mask, types = (np.asarray(given.field(k).flatten(), np.int64).reshape(len(given), -1) if len(given) else None for k in ("input_ids", "attention_mask", "token_type_ids"))
                lengths = mask.sum(axis=1) if len(given) else np.zeros(0, np.int64)
                for part in batches_by_length(lengths, batch):
                    n = max(1, int(lengths[part].max()))
                    hidden = backend.run(ids[part, :n], mask[part, :n], types[part, :n])
                    if hidden.shape[2] != backend.dimensions:
                        raise ValueError(f"the model gives {hidden.shape[2]} dimensions, not {backend.dimensions}")
                    for j, i in enumerate(part):
                        vectors[there[i]] = unit(pool(hidden[j], mask[i, :n]))
                offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * backend.dimensions)
                made = pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()), mask=tokens.is_null())
                yield pa.RecordBatch.from_arrays([b["row"], made], names=["row", "embedding"])
        finally:
            backend.close()

    return rows.mapInArrow(run, f"row {kind}, embedding array<float>")


class Embedder:
    """embed(): DataFrame in, DataFrame out."""

    def __init__(self, tokenizer: ModelTokenizer, backend: Backend, *, model_id: str = DEFAULT_MODEL, document_prefix: str | None = None, query_prefix: str | None = None):
        self.tokenizer, self.backend, self.model_id = tokenizer, backend, model_id
        self.prefixes = {"document": document_prefix, "query": query_prefix}

    @property
    def dimensions(self) -> int:
        return self.backend.dimensions

    def embed(self, rows: DataFrame, text_col: str = "text", *, kind: str = "document") -> DataFrame:
        """The rows with embedding (null for a null text), truncated and model_id; columns of these names give way."""
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {KINDS}, not {kind!r}")
        keep = [c for c in rows.columns if c not in ("embedding", "truncated", "model_id")]
        encoded = self.tokenizer.encode(T.with_prefix(F.col(text_col), self.prefixes[kind]))
        source = rows.select(F.struct(*keep).alias("row"), encoded.alias("tokens"))
        whole = source.select(F.struct("row", F.col("tokens.truncated").alias("truncated")).alias("row"), "tokens")
        return infer(whole, self.backend).select("row.row.*", "embedding", "row.truncated", F.lit(self.model_id).alias("model_id"))

    @classmethod
    def load(cls, spark: SparkSession, *, model_path: str | None = None, cache_dir: str | None = None, spec: ModelSpec | None = None, catalog: Catalog | None = None, max_length: int = 512) -> Embedder:
        """From model_path (vocab.txt beside it; the spec or default gives the identity) or the verified files of a spec below cache_dir.

        Everything is checked before a plan is built: arguments, registration, validation, family, dimensions, files."""
        if model_path is None and cache_dir is None:
            raise ValueError("model_path or cache_dir must be given")
        catalog = catalog or Catalog()
        if spec is None:
            spec = catalog.lookup(DEFAULT_MODEL)
        elif catalog.is_known(spec.id) and not spec.validated:
            raise UnvalidatedModelError(f"model {spec.id!r} is not validated for production use")
        family, dimensions = family_of(spec), dimensions_of(spec)
        if model_path is not None:
            paths = {"onnx": model_path, "vocab": f"{model_path.rpartition('/')[0] or '.'}/vocab.txt"}
        else:
            if not catalog.is_allowed(spec):
                raise ValueError(f"model {spec.id!r} is not registered")
            paths = resolve(spark, spec, cache_dir)
        for p in paths.values():
            require_asset(p)
        if family == "bert":
            tokenizer: ModelTokenizer = BertTokenizer(spark, load_vocabulary(paths["vocab"]), max_length=max_length)
        else:
            tokenizer = XlmrTokenizer(spark, *load_pieces(paths["vocab"]), max_length=max_length)
        digest = None if model_path is not None else spec.files["onnx"].sha256
        return cls(tokenizer, OnnxBackend(paths["onnx"], dimensions, sha256=digest), model_id=spec.id, document_prefix=spec.document_prefix, query_prefix=spec.query_prefix)


def require_asset(path: str) -> str:
    if not exists(path):
        raise FileNotFoundError(f"no such model asset: {path}")
    return path
