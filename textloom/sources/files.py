"""Streams of files wherever workers run: a local or mounted path, or the address of a file system that Arrow opens (hdfs, s3, gs, abfs, file)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import IO

import pyarrow.fs as arrow

#: Bytes that are read and hashed at a time.
CHUNK_BYTES = 1 << 20


def located(path: str, filesystem: arrow.FileSystem | None = None) -> tuple[arrow.FileSystem, str]:
    """The file system of a path, and the path there. Spark writes local paths with one or three slashes."""
    if filesystem is not None:
        return filesystem, path
    if path.startswith("file:"):
        path = re.sub("^file:/*", "/", path)
    return arrow.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]+://", path, re.I) else (arrow.LocalFileSystem(), path)


def open_stream(path: str, filesystem: arrow.FileSystem | None = None) -> IO[bytes]:
    fs, at = located(path, filesystem)
    return fs.open_input_stream(at, compression=None)


def open_seekable(path: str, filesystem: arrow.FileSystem | None = None) -> IO[bytes]:
    fs, at = located(path, filesystem)
    return fs.open_input_file(at)


def exists(path: str, filesystem: arrow.FileSystem | None = None) -> bool:
    fs, at = located(path, filesystem)
    return fs.get_file_info(at).type == arrow.FileType.File


def chunks(path: str, filesystem: arrow.FileSystem | None = None) -> Iterator[bytes]:
    with open_stream(path, filesystem) as f:
        while part := f.read(CHUNK_BYTES):
            yield part


def digest(path: str, filesystem: arrow.FileSystem | None = None) -> str:
    """SHA-256 of a file of any size; a chunk of it is held at a time."""
    h = hashlib.sha256()
    for part in chunks(path, filesystem):
        h.update(part)
    return h.hexdigest()


def read_verified(path: str, sha256: str | None = None, filesystem: arrow.FileSystem | None = None) -> bytes:
    """A file's content, hashed as it comes; another digest than the one expected is an error."""
    h, parts = hashlib.sha256(), []
    for part in chunks(path, filesystem):
        h.update(part)
        parts.append(part)
    if sha256 and h.hexdigest() != sha256.lower():
        raise ValueError(f"checksum mismatch: {path} has SHA-256 {h.hexdigest()}, expected {sha256}")
    return b"".join(parts)
