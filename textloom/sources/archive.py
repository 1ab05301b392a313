"""Zip archives as tables: spark.read.format("zip_members").load(path), after `register`.

A planner reads an archive's central directory and deals its members over partitions of about the same number of bytes, in the order in which they
lie in the file; a task then reads and decodes its own stretch, one member at a time. Columns: archive, member, size, content, and error, which says why a
member has no content (damaged, encrypted, of an unknown method); one bad member doesn't fail the others. Folders are left out.

Options: path (an archive, or several with commas between; addresses as in `files`), partitions (of all archives; 8), member (a pattern as of file
names, *.txt).
"""

from __future__ import annotations

import fnmatch
import io
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from textloom.operators.catalog import ModelFile, fetch
from textloom.sources import files

SCHEMA = "archive string, member string, size long, content binary, error string"
#: Bytes of members after which a batch of rows goes to Spark.
BATCH_BYTES = 8_000_000
# Fixed values of the format: the size and signature of a member's own header, where the lengths of its name and extra field are, the flag of encryption.
HEADER_BYTES, HEADER_MARK, HEADER_LENGTHS, ENCRYPTED = 30, b"PK\x03\x04", 26, 1


@dataclass(frozen=True)
class Member:
    name: str
    offset: int
    packed: int
    size: int
    crc: int
    method: int
    flags: int


@dataclass
class Stretch(InputPartition):
    archive: str
    members: list[Member]

    def __init__(self, archive: str, members: list[Member]):
        super().__init__(archive)
        self.archive, self.members = archive, members


def directory(f: IO[bytes]) -> list[Member]:
    """The members of an open archive, in the order in which they lie there."""
    with zipfile.ZipFile(f) as z:
        found = [Member(i.filename, i.header_offset, i.compress_size, i.file_size, i.CRC, i.compress_type, i.flag_bits) for i in z.infolist() if not i.is_dir()]
    return sorted(found, key=lambda m: m.offset)


def stretches(archive: str, members: list[Member], parts: int) -> list[Stretch]:
    """Runs of members of about the same packed bytes (a member counts its header as well)."""
    total, out, own, held = sum(m.packed + HEADER_BYTES for m in members), [], [], 0
    for m in members:
        own.append(m)
        held += m.packed + HEADER_BYTES
        if held >= total / parts:
            out.append(Stretch(archive, own))
            own, held = [], 0
    return [*out, Stretch(archive, own)] if own else out


def decoded(f: IO[bytes], m: Member) -> bytes:
    """A member's content, or a ValueError that says what is wrong with it."""
    if m.flags & ENCRYPTED:
        raise ValueError("it is encrypted")
    f.seek(m.offset)
    head = f.read(HEADER_BYTES)
    if len(head) < HEADER_BYTES or head[:4] != HEADER_MARK:
        raise ValueError("its header is damaged")
    name, extra = struct.unpack_from("<HH", head, HEADER_LENGTHS)
    f.seek(m.offset + HEADER_BYTES + name + extra)
    packed = f.read(m.packed)
    if len(packed) < m.packed:
        raise ValueError("the archive ends within it")
    if m.method == zipfile.ZIP_STORED:
        content = packed
    elif m.method == zipfile.ZIP_DEFLATED:
        try:
            content = zlib.decompress(packed, -zlib.MAX_WBITS)
        except zlib.error as e:
            raise ValueError(f"it can't be decompressed: {e}") from e
    else:
        raise ValueError(f"its compression method {m.method} is unknown")
    if len(content) != m.size or zlib.crc32(content) != m.crc:
        raise ValueError("its content has another checksum")
    return content


def packed(rows: DataFrame, name: str = "name", content: str = "content", *, members: int = 1000) -> DataFrame:
    """(archive, content) of rows(name, content): zip archives of up to so many members each, made where the rows lie. For a table of archives, which
    `unpacked` reads; rows without a name are left out, and null content is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, members):
                part, made = batch.slice(at, members), io.BytesIO()
                with zipfile.ZipFile(made, "w", compression=zipfile.ZIP_DEFLATED) as z:
                    for n, c in zip(part["n"].to_pylist(), part["c"].to_pylist(), strict=True):
                        z.writestr(zipfile.ZipInfo(n), c or b"", compress_type=zipfile.ZIP_DEFLATED)
                yield pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4().hex}.zip"]), pa.array([made.getvalue()])], names=["archive", "content"])

    named = rows.where(F.col(name).isNotNull())
    return named.select(F.col(name).cast("string").alias("n"), F.col(content).cast("binary").alias("c")).mapInArrow(run, "archive string, content binary")


def unpacked(archives: DataFrame, name: str = "path", content: str = "content") -> DataFrame:
    """The members of archives that are a column of bytes, as of the binary reader, which reads every file system that Spark does: the columns of the source.
    An archive whose directory can't be read is one row without a member."""

    def rows_of(archive: str, raw: bytes | None) -> Iterator[tuple]:
        f = io.BytesIO(raw or b"")
        try:
            found = directory(f)
        except zipfile.BadZipFile as e:
            yield archive, None, None, None, f"it is no archive: {e}"
            return
        for m in found:
            try:
                yield archive, m.name, m.size, decoded(f, m), None
            except ValueError as e:
                yield archive, m.name, m.size, None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, raw in zip(batch["a"].to_pylist(), batch["c"], strict=True):
                yield from _batches(rows_of(archive, raw.as_py()))

    return archives.select(F.col(name).cast("string").alias("a"), F.col(content).alias("c")).mapInArrow(run, SCHEMA)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    kinds, own, held = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()], [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own, strict=True), kinds, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    for r in rows:
        own.append(r)
        held += r[2] or 0
        if held >= BATCH_BYTES:
            yield batch()
            own, held = [], 0
    if own:
        yield batch()


class ZipMembers(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("the option path names no archive")
        self.paths = [p.strip() for p in options["path"].split(",") if p.strip()]
        self.parts, self.pattern = max(1, int(options.get("partitions", "8"))), options.get("member", "*")

    def partitions(self) -> list[Stretch]:
        def members(path: str) -> list[Member]:
            with files.open_seekable(path) as f:
                return directory(f)

        found = [(p, [m for m in members(p) if fnmatch.fnmatchcase(m.name, self.pattern)]) for p in self.paths]
        total = max(1, sum(m.packed + HEADER_BYTES for _, ms in found for m in ms))
        out = [s for p, ms in found if ms for s in stretches(p, ms, max(1, round(self.parts * sum(m.packed + HEADER_BYTES for m in ms) / total)))]
        return out or [Stretch(self.paths[0], [])]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        def rows(f: IO[bytes]) -> Iterator[tuple]:
            for m in partition.members:
                try:
                    yield partition.archive, m.name, m.size, decoded(f, m), None
                except ValueError as e:
                    yield partition.archive, m.name, m.size, None, str(e)

        with files.open_seekable(partition.archive) as f:
            yield from _batches(rows(f))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZipMembers)


def cached(url: str, folder: str, sha256: str = "") -> str:
    """The path below a folder of an archive that is loaded there if it isn't there yet; with a digest, if that one isn't."""
    path = os.path.join(folder, url.rsplit("/", 1)[-1])
    if os.path.exists(path) and (not sha256 or files.digest(path) == sha256.lower()):
        return path
    return fetch(ModelFile(url, sha256), path)
