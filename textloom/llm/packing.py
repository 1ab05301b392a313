"""Best-fit packing of token pieces under a vector of capacities.

Every piece takes a vector from its sequence: its tokens, one document and its attention cost (length squared). All
three follow from the length, so the plan needs only the histogram of lengths (at most ``capacity`` rows, whatever the
corpus): lengths in decreasing order go to the open sequence that the score picks among those with room in every
dimension, groups of sequences with the same content being handled at once. The plan says for each length which ranks
go where, and pieces find their place by their rank among the pieces of the same length, which is counted within
salted parts of a length and added up; a length has a part for every ``PART_ROWS`` of its pieces, so no task sees all pieces of
a common length.

With ``documents`` and ``attention`` unset these capacities are as wide as the tokens allow and only break ties between sequences; set,
every sequence keeps within all three.

Defined results: a null text is empty and packs its end token alone; repeated ids are packed as pieces of their own;
an empty table gives an empty result; other columns never matter.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import small_batches, text_or_empty, written

SEQUENCE, END = 2048, 0
#: What tokens, documents and attention weigh in the score.
WEIGHTS = (1.0, 0.01, 0.01)
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Words of more characters go to the first library, whose time does not grow with their square.
LONG_WORD = 1000
#: Pieces of a length that one task ranks.
PART_ROWS = 20_000
#: Ids that one output batch holds at most (but for the last text's).
BATCH_IDS = 1_000_000


@cache
def encoder(tokenizer: str = TOKENIZER, ranks: str | None = RANKS):
    """text -> ids as the tokenizer file gives them (add_special_tokens=False; a text that spells one of the file's added tokens
    holds that token). ``ranks`` is the same vocabulary for a faster library, used for texts below U+0250 without very long words
    and added tokens, where both are known (and tested) to agree."""
    import public_tokenizers as files
    from tokenizers import Tokenizer

    @cache
    def slow() -> Tokenizer:
        return Tokenizer.from_file(files.path(tokenizer))

    one = lambda text: slow().encode(text, add_special_tokens=False).ids
    if not ranks:
        return one
    import tiktoken

    with open(files.path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(files.path(tokenizer), encoding="utf-8") as f:
        added = [t["content"] for t in json.load(f)["added_tokens"]]
    fast = tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def agrees(text: str) -> bool:
        return not text or max(text) < "ɐ" and max(map(len, text.split(" "))) <= LONG_WORD and not any(t in text for t in added)

    return lambda text: fast(text) if agrees(text) else one(text)


def cut(n: int, capacity: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: all full, but the first may be shorter."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE, end: int = END, tokenizer: str = TOKENIZER, ranks: str | None = RANKS) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian unsigned 32-bit) of every document, its end token included."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks)
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            out, held = [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.array([*encode(text.as_py()), end], "<u4")
                out += [(doc_id.as_py(), p, s, n, ids[s : s + n].tobytes()) for p, (s, n) in enumerate(cut(len(ids), capacity))]
                held += len(ids)
                if held >= BATCH_IDS:
                    yield _piece_batch(out, id_type)
                    out, held = [], 0
            if out:
                yield _piece_batch(out, id_type)

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def _piece_batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    types = [id_type, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids"])


@dataclass
class Slot:
    """Pieces of one length in sequences of one content: per sequence ``each`` of them from ``offset`` on."""

    length: int
    first_rank: int
    n: int
    first_sequence: int
    each: int
    offset: int


def plan(histogram: dict[int, int], *, tokens: int = SEQUENCE, documents: int | None = None, attention: int | None = None, weights: tuple[float, float, float] = WEIGHTS, score: str = "norm") -> tuple[list[Slot], int]:
    """Slots for every length, and the number of sequences.

    score: "norm" picks the sequence with the smallest weighted norm of the residual after placing, "dot" the one with
    the largest weighted dot product of demand and residual, both in shares of the capacities.
    """
    if score not in ("norm", "dot"):
        raise ValueError(f"score must be 'norm' or 'dot', not {score!r}")
    cap = np.array([tokens, documents or tokens, attention or tokens * tokens], np.float64)
    w = np.asarray(weights, np.float64)
    size = 1024
    residual, many, content = np.zeros((size, 3)), np.zeros(size, np.int64), []

    def put(res: np.ndarray, n: int, what: tuple) -> None:
        nonlocal residual, many
        if len(content) == len(many):
            residual, many = np.vstack([residual, np.zeros_like(residual)]), np.concatenate([many, np.zeros_like(many)])
        residual[len(content)], many[len(content)] = res, n
        content.append(what)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        item = np.array([length, 1, length * length], np.float64)
        if (item > cap).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities {cap}")
        while left > 0:
            k = len(content)
            fits = np.nonzero((many[:k] > 0) & (residual[:k] >= item).all(axis=1))[0]
            if len(fits):
                r = residual[fits]
                s = ((((r - item) / cap) ** 2) * w).sum(axis=1) if score == "norm" else -((r * item / cap**2) * w).sum(axis=1)
                g = int(fits[np.argmin(s)])
                res, m, what = residual[g].copy(), int(many[g]), content[g]
            else:
                g, res, m, what = -1, cap, left, ()
            each = min(int((res // item).min()), left)
            used = min(m, left // each)
            if g >= 0:
                many[g] -= used
            put(res - each * item, used, (*what, (length, each)))
            left -= used * each
    slots: list[Slot] = []
    ranks: dict[int, int] = {}
    sequences = 0
    for n, what in zip(many, content, strict=False):
        if n == 0:
            continue
        offset = 0
        for length, each in what:
            start = ranks.get(length, 0)
            slots.append(Slot(length, start, int(n) * each, sequences, each, offset))
            ranks[length] = start + int(n) * each
            offset += length * each
        sequences += int(n)
    return slots, sequences


def ranked(rows: DataFrame, by: str, order: list[str], salt: Column, salts: Column) -> DataFrame:
    """rows with ``__rank`` (from 0) within each value of ``by``, counted in salted parts and added up."""
    parts = rows.withColumn("__part", F.pmod(salt, salts))
    counts = parts.groupBy(by, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(by).orderBy("__part")) - F.col("__n")
    counts = counts.select(by, "__part", before.alias("__before"))
    within = F.row_number().over(Window.partitionBy(by, "__part").orderBy(*order)) - 1
    return parts.withColumn("__within", within).join(counts, [by, "__part"]).withColumn("__rank", F.col("__within") + F.col("__before")).drop("__part", "__within", "__before")


def pack(rows: DataFrame, *, id_col: str = "doc_id", piece_col: str = "piece", length_col: str = "length", **capacities) -> DataFrame:
    """rows (read more than once: a written table) with sequence_id and offset. Options: see `plan`."""
    spark = rows.sparkSession
    histogram = {r[0]: r[1] for r in rows.groupBy(length_col).count().collect()}  # a row a length
    slots, _ = plan(histogram, **capacities)
    table = spark.createDataFrame([(s.length, s.first_rank, s.first_rank + s.n, s.first_sequence, s.each, s.offset) for s in slots], "__length long, __from long, __to long, __sequence long, __each long, __offset long")
    parts = spark.createDataFrame([(k, -(-n // PART_ROWS)) for k, n in histogram.items()], "__of long, __parts long")
    dealt = rows.join(F.broadcast(parts), F.col(length_col) == F.col("__of"))
    at = ranked(dealt, length_col, [id_col, piece_col], F.xxhash64(id_col, piece_col), F.col("__parts"))
    # the plan is bounded by the number of lengths, not by the corpus
    placed = at.join(F.broadcast(table), (F.col(length_col) == F.col("__length")) & (F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
    nth = F.col("__rank") - F.col("__from")
    return placed.withColumn("sequence_id", F.col("__sequence") + F.floor(nth / F.col("__each"))).withColumn("offset", F.col("__offset") + nth % F.col("__each") * F.col("__length")).select(*rows.columns, "sequence_id", "offset")


def packed(docs: DataFrame, *, capacity: int = SEQUENCE, documents: int | None = None, attention: int | None = None, weights: tuple[float, float, float] = WEIGHTS, score: str = "norm", **options) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    rows = pieces(docs, capacity=capacity, **options).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(written(rows, "pieces"), tokens=capacity, documents=documents, attention=attention, weights=weights, score=score)
