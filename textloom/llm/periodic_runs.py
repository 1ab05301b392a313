"""Periodic run detection: every maximal stretch of words that repeats with a period, and texts without the repetition.

The runs theorem: each run has a Lyndon root that is the longest Lyndon word at its place under the words' order or the
opposite one. The longest Lyndon word at i ends before the next smaller value of the inverse suffix array (the next larger one
for the opposite order, as an end mark makes no suffix a prefix of another). A root is extended to both sides by longest common
extensions: minima over the LCP array of the text and of the text read backwards, from sparse tables. All of it is done in numpy on
many texts at once, each with an end mark of its own, in Arrow batches: nothing is shuffled.

A run of `shortest` words or more, twice its period at least, has a stretch of `shortest` // 2 words that comes twice. Texts without
one have no runs, and need no suffix array.

Results: null or empty texts have no words, no runs, and the digests of nothing. Rows are judged one by one, so repeated rows
and ids give equal rows; an empty table gives an empty result, and other columns are ignored. A text's arrays take some hundred bytes a word.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import small_batches

#: Words of the shortest run, and words that are handled at once (a longer text is handled alone).
SHORTEST, CHUNK_WORDS = 12, 200_000


def suffix_ranks(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse suffix array and LCP array (at the place of the latter of two neighbours) by prefix doubling. What stands at the end of a
    text must come nowhere else, and no text's symbols in another."""
    n = len(symbols)
    at = np.arange(n)
    order = np.argsort(symbols, kind="stable")
    new = np.r_[True, symbols[order][1:] != symbols[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0))
    levels, k = [], 1
    while True:
        tied = np.nonzero(np.bincount(rank, minlength=n)[rank] > 1)[0]
        if not len(tied):
            break
        levels.append((tied.astype(np.int32), rank[tied].astype(np.int32)))
        first, second = rank[tied], rank[tied + k]
        order = np.lexsort((second, first))
        tied, first, second = tied[order], first[order], second[order]
        group = np.r_[True, first[1:] != first[:-1]]
        own = group | np.r_[True, second[1:] != second[:-1]]
        place = np.arange(len(tied))
        rank[tied] = first + np.maximum.accumulate(np.where(own, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        k *= 2
    suffix = np.empty(n, np.int64)
    suffix[rank] = at
    a, b, lcp = suffix[:-1].copy(), suffix[1:].copy(), np.zeros(n, np.int32)
    for j in reversed(range(len(levels))):
        same = -1 - at
        same[levels[j][0]] = levels[j][1]
        step = (same[a] == same[b]).astype(np.int64) << j
        a, b, lcp[1:] = a + step, b + step, lcp[1:] + step
    return rank, lcp


def minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: at level k the smallest of 2^k values from each place on."""
    table, k = [values], 1
    while 2 * k <= len(values):
        table.append(np.minimum(table[-1][:-k], table[-1][k:]))
        k *= 2
    return table


def common(rank: np.ndarray, table: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of the suffixes i and j, which differ."""
    lo, hi = np.minimum(rank[i], rank[j]) + 1, np.maximum(rank[i], rank[j]) + 1
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    out = np.zeros(len(i), np.int64)
    for k in np.unique(level):
        on = level == k
        out[on] = np.minimum(table[k][lo[on]], table[k][hi[on] - (1 << int(k))])
    return out


def next_smaller(values: np.ndarray) -> np.ndarray:
    """The next place of a smaller value, or the length: each place leaps over what its next place is known to leap over."""
    n = len(values)
    padded, next_ = np.r_[values, -1], np.minimum(np.arange(1, n + 2), n)
    open_ = np.arange(n)
    while len(open_ := open_[padded[next_[open_]] > padded[open_]]):
        next_[open_] = next_[next_[open_]]
    return next_[:n]


def runs(symbols: np.ndarray, text: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """(start, length, period) of all runs of texts that stand one after another, each with an end mark; text says which one a symbol is of."""
    n = len(symbols)
    rank, lcp = suffix_ranks(symbols)
    table = minima(lcp)
    last = np.searchsorted(text, text, side="right") - 1
    i = np.arange(n)
    ends = np.stack([next_smaller(rank), next_smaller(n - 1 - rank)])
    start, end = np.concatenate([i, i]), ends.ravel()
    inside = end < last[start]
    start, end = start[inside], end[inside]
    ahead = common(rank, table, start, end)
    del rank, lcp, table
    # backwards the end marks must come after the texts again
    first = np.searchsorted(text, text, side="left")
    back = np.where(i == last, i, first + last - 1 - i)
    rank, lcp = suffix_ranks(symbols[back])
    table = minima(lcp)
    behind = np.zeros(len(start), np.int64)
    more = np.nonzero(start > first[start])[0]
    behind[more] = common(rank, table, back[start[more] - 1], back[end[more] - 1])
    period = end - start
    length = behind + period + ahead
    fits = (length >= 2 * period) & (length >= shortest)
    return np.unique(np.stack([(start - behind)[fits], length[fits], period[fits]], axis=1), axis=0)


def repeats(ids: np.ndarray, text: np.ndarray, width: int, texts: int) -> np.ndarray:
    """Whether a text has a stretch of so many words twice (by hash: sometimes said of one without)."""
    if len(ids) < width:
        return np.zeros(texts, bool)
    h = text[: len(ids) - width + 1].astype(np.uint64)
    for k in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[k : len(ids) - width + 1 + k].astype(np.uint64)
        h ^= h >> np.uint64(29)
    h = h[text[: len(h)] == text[width - 1 :]]
    own = text[: len(ids) - width + 1][text[: len(ids) - width + 1] == text[width - 1 :]]
    order = np.argsort(h, kind="stable")
    twice = h[order][1:] == h[order][:-1]
    out = np.zeros(texts, bool)
    out[own[order][1:][twice]] = True
    return out


def all_runs(words: list[list[bytes]], shortest: int = SHORTEST) -> list[np.ndarray]:
    """The runs of each of some texts, given as words: rows (start, length, period) by start, then period."""
    none = np.zeros((0, 3), np.int64)
    lengths = np.array([len(w) for w in words], np.int64)
    text = np.repeat(np.arange(len(words)), lengths)
    if not len(text):
        return [none] * len(words)
    ids = pa.array([x for w in words for x in w], pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    wanted = repeats(ids, text, max(1, shortest // 2), len(words))
    if not wanted.any():
        return [none] * len(words)
    ids, text = ids[wanted[text]], text[wanted[text]]
    # an end mark, smaller than its text's words, after each text
    which = np.nonzero(wanted)[0]
    marked = np.concatenate([text, which])
    order = np.argsort(marked, kind="stable")
    marked, symbols = marked[order], np.concatenate([ids + 1, np.zeros(len(which), np.int64)])[order]
    found = runs(marked * (symbols.max() + 1) + symbols, marked, shortest)
    begins = np.searchsorted(marked, marked[found[:, 0]])
    of = marked[found[:, 0]]
    found[:, 0] -= begins
    order = np.lexsort((found[:, 2], found[:, 0], of))
    found, of = found[order], of[order]
    edges = np.searchsorted(of, np.arange(len(words) + 1))
    return [found[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def collapsed(words: list[bytes], found: np.ndarray) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not len(found):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return [w for w, d in zip(words, np.cumsum(change), strict=False) if not d]


def made_periodic(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's test texts: of every tenth hash of an id, the end of the text repeats a stretch of it."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def described(doc_id: int | None, words: list[bytes], found: np.ndarray) -> tuple:
    rows = found.tolist()
    longest = min(rows, key=lambda r: (-r[1], r[0], r[2])) if rows else None
    best = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in rows)
    return (doc_id, len(rows), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, found))).hexdigest())


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, prepare: Callable[[list[bytes], int | None], list[bytes]] | None = None) -> DataFrame:
    """One row per document: doc_id, n_runs, the longest run (start, length, period, exponent_milli; nulls without runs), and digests of all
    runs and of the text that is left when each run keeps its first period. `prepare` may change a text's words before."""
    small_batches(docs.sparkSession)

    def solved(ids: list, words: list[list[bytes]]) -> pa.RecordBatch:
        rows = [described(*x) for x in zip(ids, words, all_runs(words, shortest), strict=True)]
        kinds = [pa.int64()] * 6 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, total = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
                own = (text.as_py() or "").encode().split()  # bytes are split at the six ASCII white-space characters
                own = prepare(own, doc_id) if prepare else own
                if ids and total + len(own) > CHUNK_WORDS:
                    yield solved(ids, words)
                    ids, words, total = [], [], 0
                ids.append(doc_id)
                words.append(own)
                total += len(own)
        if ids:
            yield solved(ids, words)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def collapsed_documents(docs: DataFrame, *, text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """docs with texts in which every run keeps its first period only; texts without runs stay as they are, others have their words joined by one space."""
    small_batches(docs.sparkSession)
    schema = docs.schema
    at = schema.names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch[at].to_pylist()
            for i, text in enumerate(texts):
                words = (text or "").encode().split()
                found = all_runs([words], shortest)[0]
                if len(found):
                    texts[i] = b" ".join(collapsed(words, found)).decode()
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, schema)
