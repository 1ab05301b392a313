"""Unigram tokenisation: the segmentation of the largest sum of piece scores."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions.tokens import XLMR, assembled, check_length
from textloom.operators import charsmap
from textloom.sources.files import read_verified
from textloom.sources.shared import small_batches

#: An unknown character scores this much less than the worst piece.
UNKNOWN_PENALTY = 10.0
#: Segments that a worker remembers, and characters that these have together at most.
MEMO, MEMO_CHARS = 100_000, 1_000_000
#: Characters of the texts that are solved together, and of a segment that is solved beside others.
CHUNK_CHARS, BESIDE = 300_000, 48


class Unigram:
    """pieces: piece to (id, score). Unknown characters that touch become one unknown id. Of equal sums the one whose last piece is longest.

    An automaton over all pieces finds every arc of a text's lattice in one pass: at each character the pieces that end there, the longest first.
    The best path is then read from left to right. The lattice is that of the whole text, so pieces may reach over the starts of words."""

    def __init__(self, pieces: dict[str, tuple[int, float]], unknown: int = XLMR.unknown):
        self.unknown = unknown
        self.unknown_score = min((s for _, s in pieces.values()), default=0.0) - UNKNOWN_PENALTY
        self._arcs = _automaton((p, (len(p), i, s)) for p, (i, s) in pieces.items() if p)
        # pieces with a word's start inside: only these reach from one word into another
        self._across = _automaton((p, len(p)) for p in pieces if T.METASPACE in p[1:])
        # the same for many segments at once: longer pieces by an automaton that gives their place in these tables, single characters by code point
        listed = [(p, i, x) for p, (i, x) in pieces.items() if p]
        self._lengths, self._ids, self._scores = (np.array(x, k) for x, k in zip(zip(*[(len(p), i, x) for p, i, x in listed], strict=True) if listed else ([], [], []), (np.int64, np.int64, np.float64), strict=True))
        self._longer = _automaton((p, at) for at, (p, _, _) in enumerate(listed) if len(p) > 1)
        self._single = np.full(0x110000, -1, np.int32)
        for at, (p, _, _) in enumerate(listed):
            if len(p) == 1:
                self._single[ord(p)] = at
        self._forget()

    def _forget(self) -> None:
        self._memo, self._memo_chars = {}, 0
        self._pool, self._first, self._size = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, text: str) -> list[int]:
        """By the lattice of the text, in one piece."""
        n = len(text)
        best, back = [0.0] * (n + 1), [(0, 0)] * (n + 1)
        arcs = iter(self._arcs.iter(text)) if self._arcs else iter(())
        at, arc = next(arcs, (n, None))
        for end in range(n):
            top, way = float("-inf"), None
            while at == end:
                length, piece, score = arc
                start = end + 1 - length
                if best[start] + score > top:
                    top, way = best[start] + score, (start, piece)
                at, arc = next(arcs, (n, None))
            if best[end] + self.unknown_score > top:
                top, way = best[end] + self.unknown_score, (end, self.unknown)
            best[end + 1], back[end + 1] = top, way
        out, at = [], n
        while at:
            at, piece = back[at]
            if not (piece == self.unknown and out and out[-1] == self.unknown):
                out.append(piece)
        return out[::-1]

    def segments(self, text: str) -> list[str]:
        """The text, cut where a word starts that no piece found in it reaches into: the best path has a node at such a place, so each segment can be
        solved by itself."""
        if not self._across:
            first, *rest = text.split(T.METASPACE)
            return [first, *[T.METASPACE + x for x in rest]] if first else [T.METASPACE + x for x in rest]
        starts = np.flatnonzero(_code_points(text) == ord(T.METASPACE))
        found = np.fromiter(chain.from_iterable(self._across.iter(text)), np.int64).reshape(-1, 2)
        if len(found):
            # a place is inside pieces if more of them begin before it than end before it
            begun = np.searchsorted(np.sort(found[:, 0] + 1 - found[:, 1]), starts, "left")
            starts = starts[begun == np.searchsorted(np.sort(found[:, 0]), starts, "left")]
        cuts = [0, *[i for i in starts.tolist() if i], len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]

    def text_ids(self, text: str) -> list[int]:
        """As `ids`, with segments that recur solved once. A segment's sums start at nothing, so what stands before it doesn't tell equal sums apart
        by the rounding of theirs."""
        return self.texts_ids([text])[0].tolist() if text else []

    def texts_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """`text_ids` of many texts, one after another, and how many each has."""
        parts, counts = [], []
        for text in texts:
            own = self.segments(text)
            parts += own
            counts.append(len(own))
        new = list(set(parts) - self._memo.keys())
        if len(self._memo) + len(new) > MEMO or self._memo_chars + sum(map(len, new)) > MEMO_CHARS:
            self._forget()
            new = list(set(parts))
        if new:
            ids, size = self._solved(new)
            self._memo.update(zip(new, range(len(self._memo), len(self._memo) + len(new)), strict=True))
            self._memo_chars += sum(map(len, new))
            self._first = np.concatenate([self._first, len(self._pool) + np.cumsum(size) - size])
            self._pool, self._size = np.concatenate([self._pool, ids]), np.concatenate([self._size, size])
        at = np.fromiter(map(self._memo.__getitem__, parts), np.int64, len(parts))
        size = self._size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        out = self._pool[np.repeat(self._first[at] - ends[:-1], size) + np.arange(ends[-1])]
        text_ends = ends[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        # unknown ids that touch over a cut are one
        twice = np.zeros(len(out), bool)
        twice[1:] = (out[1:] == self.unknown) & (out[:-1] == self.unknown)
        twice[text_ends[text_ends < len(out)]] = False
        gone = np.concatenate([[0], np.cumsum(twice)])
        return out[~twice], np.diff(text_ends - gone[text_ends])

    def _solved(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """`ids` of each part, one after another, and how many each has. Parts are solved beside one another, a character of all of them at a time."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        long = np.flatnonzero(lengths > BESIDE)
        order = np.argsort(-lengths, kind="stable")[len(long) :]
        if not len(order):
            return _listed([self.ids(p) for p in parts])
        lengths = lengths[order]
        whole = "".join([parts[i] for i in order])
        first = np.cumsum(lengths) - lengths
        part = np.repeat(np.arange(len(order)), lengths)
        at = self._single[_code_points(whole)]
        if len(self._scores):
            single = np.where(at < 0, -np.inf, self._scores[at])
            kind = np.where(at < 0, self.unknown, self._ids[at])
        else:
            single, kind = np.full(len(whole), -np.inf), np.full(len(whole), self.unknown)
        back = np.ones(len(whole), np.int64)
        found = np.fromiter(chain.from_iterable(self._longer.iter(whole) if self._longer else ()), np.int64).reshape(-1, 2)
        found = found[found[:, 0] + 1 - self._lengths[found[:, 1]] >= first[part[found[:, 0]]]]
        end, piece = found.T
        # pieces that end at a place follow one another from the shortest to the longest, so that of equal sums the longest stays
        by = np.lexsort((self._lengths[piece], end))
        end, piece = end[by], piece[by]
        turn = np.arange(len(end)) - np.searchsorted(end, end)
        key = (end - first[part[end]]) * (len(whole) + 1) + turn
        by = np.argsort(key, kind="stable")
        end, piece, key = end[by], piece[by], key[by]
        groups = np.append(np.flatnonzero(np.diff(key, prepend=-1)), len(key)).tolist()
        when = [int(key[g]) // (len(whole) + 1) for g in groups[:-1]]
        best = np.zeros(len(whole) + len(order))  # a part has a node more than characters
        node = np.arange(len(whole)) + part
        group = 0
        for t in range(int(lengths[0])):
            n = int(np.searchsorted(-lengths, -t, "left"))  # parts that are longer
            here = first[:n] + t
            before = best[node[here]]
            known, other = before + single[here], before + self.unknown_score
            worse = other > known
            top = np.where(worse, other, known)
            kind[here[worse]] = self.unknown
            best[node[here] + 1] = top
            while group < len(when) and when[group] == t:
                ends, ways = end[groups[group] : groups[group + 1]], piece[groups[group] : groups[group + 1]]
                total = best[node[ends] + 1 - self._lengths[ways]] + self._scores[ways]
                on = total >= best[node[ends] + 1]
                ends, ways = ends[on], ways[on]
                best[node[ends] + 1], kind[ends], back[ends] = total[on], self._ids[ways], self._lengths[ways]
                group += 1
        last = np.zeros(len(whole), bool)
        left, at = lengths.copy(), first.copy()
        while len(left):
            ends = at + left - 1
            last[ends] = True
            left = left - back[ends]
            at, left = at[left > 0], left[left > 0]
        kept, part = kind[last], part[last]
        twice = np.zeros(len(kept), bool)
        twice[1:] = (kept[1:] == self.unknown) & (kept[:-1] == self.unknown) & (part[1:] == part[:-1])
        kept, part = kept[~twice], part[~twice]
        size = np.zeros(len(parts), np.int64)
        size[order] = np.bincount(part, minlength=len(order))
        # back to the order of the parts
        rest = [self.ids(parts[i]) for i in long]
        size[long] = [len(x) for x in rest]
        out, starts = np.zeros(int(size.sum()), np.int64), np.cumsum(size) - size
        own = size[order]
        out[np.repeat(starts[order] - (np.cumsum(own) - own), own) + np.arange(len(kept))] = kept
        for i, x in zip(long, rest, strict=True):
            out[starts[i] : starts[i] + len(x)] = x
        return out, size


def _listed(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in found], np.int64)
    return np.fromiter(chain.from_iterable(found), np.int64, int(size.sum())), size


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _automaton(entries: Iterable[tuple[str, object]]):
    """Over keys with their values; None for no keys."""
    import ahocorasick

    made = ahocorasick.Automaton()
    for key, value in entries:
        made.add_word(key, value)
    if not len(made):
        return None
    made.make_automaton()
    return made


#: Models of a worker, by the broadcast they came with: loaded once a worker, not once a task.
_loaded: dict[str, tuple[Unigram, charsmap.Charsmap]] = {}


def _model(shared: Broadcast) -> tuple[Unigram, charsmap.Charsmap]:
    key = shared.value[2]
    if key not in _loaded:
        _loaded.clear()  # a worker works with one at a time
        _loaded[key] = Unigram(shared.value[0]), charsmap.Charsmap(shared.value[1])
    return _loaded[key]


def pieces_of_json(text: str) -> tuple[dict[str, tuple[int, float]], bytes]:
    """Pieces and character map of a tokenizer file's text: an id is a piece's place."""
    return {p: (i, float(s)) for i, (p, s) in enumerate(json.loads(text)["model"]["vocab"])}, charsmap.from_tokenizer_json(text)


def load_pieces(path: str) -> tuple[dict[str, tuple[int, float]], bytes]:
    return pieces_of_json(read_verified(path).decode("utf-8"))


class XlmrTokenizer:
    """Columns of token ids and model input. A text too long keeps its head and loses the end sentinel. A text goes to Python once:
    map, spaces, metaspace and pieces are one function there, whose model is made once a worker."""

    def __init__(self, spark: SparkSession, pieces: dict[str, tuple[int, float]], blob: bytes, *, max_length: int = 512):
        self.max_length = check_length(max_length)
        small_batches(spark)  # a batch of whole texts should take some MB
        self._normalize = charsmap.normalizer(spark, blob)
        shared = spark.sparkContext.broadcast((pieces, blob, uuid.uuid4().hex))

        def split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            model, normal = _model(shared)

            def solved(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                chunk, chars = [], 0
                for text in texts:
                    chunk.append(T.escaped(normal.normalize(text)))
                    chars += len(chunk[-1])
                    if chars >= CHUNK_CHARS:
                        yield model.texts_ids(chunk)
                        chunk, chars = [], 0
                yield model.texts_ids(chunk)

            for texts in batches:
                values, sizes = zip(*solved(x.as_py() or "" for x in texts), strict=True)
                offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)), mask=texts.is_null())

        self._split = split

    def normalize(self, text: Column) -> Column:
        return charsmap.tokenization_form(self._normalize, text)

    def content_ids(self, text: Column) -> Column:
        return F.arrow_udf(self._split, "array<long>")(text)

    def whole_ids(self, text: Column) -> Column:
        """Ids with both sentinels, neither cut nor padded: what a parity corpus expects."""
        start, end = (F.array(F.lit(x).cast("long")) for x in (XLMR.start, XLMR.end))
        return F.concat(start, self.content_ids(text), end)

    def encode(self, text: Column) -> Column:
        return assembled(self.content_ids(text), XLMR, self.max_length)
