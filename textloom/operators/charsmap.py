"""Precompiled character maps: a double-array trie over UTF-8 with a table of replacements.

The blob is a little-endian 32-bit length, that many bytes of trie units, and a table of replacements that end in NUL.
Fixed values of the format: a unit's bit 8 says that a leaf follows, bits 0-7 (and 31) are the label, bits 10-30 the offset,
shifted by 8 more if bit 9 is set; a leaf's lower 31 bits are its value, an offset into the table.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.sources.shared import small_batches

#: Grapheme clusters of so many bytes or more are looked up by code point only.
CLUSTER_BYTES = 6
#: Pieces that a map remembers, and characters of the longest one that it does.
PIECES, PIECE_CHARS = 50_000, 64
_PIECE = re.compile(r"\A[^ ]+| [^ ]*")


class CharsmapError(ValueError):
    """A blob, or the file around it, is not in the format."""


class Charsmap:
    """Normalises text by the longest entry of the map. Works on any blob; a damaged trie gives fewer matches, not errors."""

    def __init__(self, blob: bytes):
        if len(blob) < 4:
            raise CharsmapError("the character map is shorter than its 4-byte header")
        size = int.from_bytes(blob[:4], "little")
        if size % 4 or size + 4 > len(blob):
            raise CharsmapError(f"the trie of {size} bytes is cut off or not a multiple of 4 (blob: {len(blob)} bytes)")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.table = blob[4 + size :]
        self._memo: dict[str, str | None] = {}
        self._pieces: dict[str, str] = {}
        # an entry that is found has its last character there: texts, and pieces of them, that have none of these stay as they are
        keys = self._keys()
        last = None if keys is None else {k[-1] for k in keys}
        self._last = None if not last else re.compile(f"[{''.join(map(re.escape, sorted(last)))}]")
        self._idle = last == set()
        self._touched = re.compile(rf"(?:\A| )[^ {self._last.pattern[1:-1]}]*{self._last.pattern}[^ ]*") if last and " " not in last else None

    def _keys(self, most: int = 1 << 18) -> list[str] | None:
        """All entries; None if there are too many, or damaged ones."""
        units, labels, found = np.array(self.units, np.int64), np.arange(1, 256), []
        step = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        todo, nodes = [(int(step(units[0])), b"")] if len(units) else [], 0
        while todo:
            at, key = todo.pop()
            spots = at ^ labels
            there = spots < len(units)
            there[there] = units[spots[there]] & 0x800000FF == labels[there]
            for spot, label in zip(spots[there].tolist(), labels[there].tolist(), strict=True):
                nodes += 1
                if nodes > most or len(key) > 200:
                    return None
                base = spot ^ int(step(units[spot]))
                if base < len(units):
                    if units[spot] & 0x100:
                        found.append(key + bytes([label]))
                    todo.append((base, key + bytes([label])))
        try:
            return [k.decode("utf-8") for k in found]
        except UnicodeDecodeError:
            return None

    def leaves(self, key: bytes) -> list[int]:
        """Values of all entries that are prefixes of key, shortest first; a NUL ends the key."""
        units, found = self.units, []
        if not units:
            return found
        step = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        at = step(units[0])
        for byte in key:
            at ^= byte
            if byte == 0 or at >= len(units) or units[at] & 0x800000FF != byte:
                break
            unit = units[at]
            at ^= step(unit)
            if at >= len(units):
                break
            if unit & 0x100:
                found.append(units[at] & 0x7FFFFFFF)
        return found

    def replacement(self, chunk: str) -> str | None:
        """What the longest entry that starts the chunk maps to; the rest of the chunk is lost. None without an entry."""
        if chunk not in self._memo:
            values = self.leaves(chunk.encode("utf-8", "surrogatepass"))
            if len(self._memo) > 50_000:
                self._memo.clear()
            self._memo[chunk] = self.table[values[-1] :].split(b"\0", 1)[0].decode("utf-8") if values else None
        return self._memo[chunk]

    def _clusters(self, text: str) -> str:
        import regex

        out = []
        for cluster in text if text.isascii() and "\r" not in text else regex.findall(r"\X", text):
            whole = self.replacement(cluster) if len(cluster.encode("utf-8", "surrogatepass")) < CLUSTER_BYTES else None
            if whole is not None:
                out.append(whole)
            else:
                out += [c if (r := self.replacement(c)) is None else r for c in cluster]
        return "".join(out)

    def normalize(self, text: str) -> str:
        """By pieces that start at a space, since clusters do, unless a character that joins what follows stands before it;
        pieces recur, so each is looked up once."""
        import regex

        if self._idle or self._last and not self._last.search(text):
            return text
        if self._touched and (text.isascii() or not regex.search(r"\p{GCB=Prepend} ", text)):
            return self._touched.sub(self._piece, text)
        out = []
        for piece in _PIECE.findall(text):
            done = self._pieces.get(piece)
            if done is None:
                if not piece.isascii() and regex.search(r"\p{GCB=Prepend}$", piece):
                    return self._clusters(text)
                done = self._kept(piece)
            out.append(done)
        return "".join(out)

    def _piece(self, m: re.Match) -> str:
        piece = m[0]
        done = self._pieces.get(piece)
        return self._kept(piece) if done is None else done

    def _kept(self, piece: str) -> str:
        done = self._clusters(piece)
        if len(piece) <= PIECE_CHARS:
            if len(self._pieces) >= PIECES:
                self._pieces.clear()
            self._pieces[piece] = done
        return done


def from_tokenizer_json(text: str) -> bytes:
    """The blob of a tokenizer file: normalizer.normalizers[type = Precompiled].precompiled_charsmap."""
    steps = (json.loads(text).get("normalizer") or {}).get("normalizers") or []
    entry = next((s for s in steps if s.get("type") == "Precompiled"), None)
    if entry is None:
        raise CharsmapError("the tokenizer file has no Precompiled normalizer")
    blob = entry.get("precompiled_charsmap")
    if not isinstance(blob, str):
        raise CharsmapError("the Precompiled normalizer has no precompiled_charsmap")
    return base64.b64decode(blob)


def build(entries: dict[str, str]) -> bytes:
    """A blob of the given entries, placed node by node where all of a node's children find free units: the first free unit that
    serves the first child decides. Units below ``low`` are all taken, so that maps of many thousand entries are built quickly."""
    table, where = bytearray(), {}
    for value in dict.fromkeys(entries.values()):
        where[value] = len(table)
        table += value.encode() + b"\0"
    tree: dict = {}
    for key, value in entries.items():
        node = tree
        for byte in key.encode():
            node = node.setdefault(byte, {})
        node[None] = where[value]
    units, used, bases, low = {0: 0}, {0}, set(), 1

    def place(at: int, node: dict) -> None:
        nonlocal low
        labels = [0 if b is None else b for b in node]
        while low in used:
            low += 1
        spot = low
        # the children lie at (at ^ base) ^ label; an offset of 21 bits is stored as it is. No two nodes share at ^ base, or one would have the other's children
        while spot in used or not 0 < (base := at ^ spot ^ labels[0]) < 1 << 21 or at ^ base in bases or any(((at ^ base) ^ b) in used for b in labels):
            spot += 1
        bases.add(at ^ base)
        units[at] |= base << 10
        if None in node:
            units[at] |= 0x100
        spots = {b: (at ^ base) ^ (0 if b is None else b) for b in node}
        used.update(spots.values())
        for b, child in spots.items():
            units[child] = (node[None] | 1 << 31) if b is None else b
        for b, child in spots.items():
            if b is not None:
                place(child, node[b])

    place(0, tree)
    dense = np.zeros(max(units) + 257, "<u4")
    for at, unit in units.items():
        dense[at] = unit
    return len(dense.tobytes()).to_bytes(4, "little") + dense.tobytes() + bytes(table)


def normalizer(spark: SparkSession, blob: bytes):
    """Column -> Column by the map; the blob is broadcast (its size is fixed) and parsed once a worker."""
    Charsmap(blob)  # errors show when the plan is built
    small_batches(spark)
    shared = spark.sparkContext.broadcast(blob)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        charsmap = Charsmap(shared.value)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else charsmap.normalize(t))

    return lambda text: F.pandas_udf(run, "string")(text)


def tokenization_form(normalize, text: Column) -> Column:
    """Map, then runs of spaces, then metaspace."""
    return T.metaspace(T.collapse_spaces(normalize(text)))
