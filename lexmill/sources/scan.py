"""Files under a folder as a Spark data source, hidden ones included.

``spark.read.format("lexmill_scan").load(root)`` lists the folder, folder by folder (one
that can't be listed has no files), deals the files to partitions by their bytes, and reads
each in pieces of 1 MiB: its hash and its encoding need no more memory than that, whatever
its size. A file that can't be read is a row with status ``io_error`` instead of a failed job.

``root`` is a path or URI that pyarrow.fs opens, from the driver and from the executors.
"""

from __future__ import annotations

import codecs
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Formats by extension, and folders that are never scanned: fixed values of the raw contract.
FORMATS = {".tsv": "tsv", ".json": "json", ".jsonl": "jsonl", ".html": "html"}
SKIPPED = ["target", "__pycache__", ".pytest_cache", ".git"]
BOM = b"\xef\xbb\xbf"
PIECE = 1 << 20
#: A partition takes files up to so many bytes and so many files, and one file at least.
PARTITION_BYTES, PARTITION_FILES = 128 << 20, 2000

MANIFEST = "relative_path string, byte_size bigint, sha256 string, extension string, detected_format string, encoding_status string, file_status string, schema_version string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; ``file:/x`` counts as ``file:///x``."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def extension(name: str) -> str:
    """The last suffix of a name, lower-cased; none for names that only start or end with the dot."""
    stem, dot, last = name.rsplit("/", 1)[-1].rpartition(".")
    return f".{last}".lower() if dot and stem.strip(".") and last else ""


def listing(root: str) -> Iterator[tuple[str, str, int]]:
    """(relative path, path, size) of the files under ``root``, but for the skipped folders."""
    system, base = opened(root)
    base = base.rstrip("/")
    local = isinstance(system, fs.LocalFileSystem)
    waiting = [base]
    while waiting:
        folder = waiting.pop()
        try:
            infos = system.get_file_info(fs.FileSelector(folder))
        except OSError:
            continue
        for f in infos:
            name = f.path[len(base) + 1 :]
            if f.base_name in SKIPPED:
                continue
            if f.type == fs.FileType.Directory:
                if not (local and os.path.islink(f.path)):
                    waiting.append(f.path)
            elif f.type == fs.FileType.File:
                yield name, f.path, f.size or 0


def pieces(system: fs.FileSystem, path: str, start: int = 0, end: int | None = None) -> Iterator[bytes]:
    """The bytes of a file from ``start`` to ``end``, piece by piece."""
    with system.open_input_file(path) as file:
        file.seek(start)
        left = None if end is None else end - start
        while left is None or left > 0:
            data = file.read(PIECE if left is None else min(PIECE, left))
            if not data:
                return
            if left is not None:
                left -= len(data)
            yield data


def digest(parts: Iterator[bytes]) -> tuple[int, str, bool, bool]:
    """(bytes, sha256 in hex, starts with a byte order mark, is UTF-8) of pieces, in constant memory."""
    sha, decoder, size, head, good = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")(), 0, b"", True
    for data in parts:
        sha.update(data)
        size += len(data)
        if len(head) < 3:
            head = (head + data)[:3]
        if good:
            try:
                decoder.decode(data)
            except UnicodeDecodeError:
                good = False
    if good:
        try:
            decoder.decode(b"", True)
        except UnicodeDecodeError:
            good = False
    return size, sha.hexdigest(), head == BOM, good


def entry(system: fs.FileSystem, name: str, path: str) -> tuple:
    """The manifest row of a file."""
    ext = extension(name)
    kind = FORMATS.get(ext, "unknown")
    try:
        size, sha, bom, good = digest(pieces(system, path))
    except OSError:
        return name, 0, "sha256:" + hashlib.sha256(b"").hexdigest(), ext, kind, "empty", "io_error", "file-manifest-entry-v1"
    encoding = "empty" if not size else "invalid_utf8" if not good else "utf8_bom" if bom else "utf8"
    status = "empty" if not size else "unsupported" if kind == "unknown" else "encoding_error" if not good else "ok"
    return name, size, f"sha256:{sha}", ext, kind, encoding, status, "file-manifest-entry-v1"


@dataclass
class Files(InputPartition):
    """Names and paths of some files."""

    files: list


class ScanReader(DataSourceReader):
    def __init__(self, root: str, without: str | None):
        self.root, self.without = root, without

    def partitions(self) -> list[InputPartition]:
        system, _ = opened(self.root)
        skip = None if self.without is None else opened(self.without)[1]
        out, held, size = [], [], 0
        for name, path, n in sorted(listing(self.root)):
            if path == skip:
                continue
            if held and (size + n > PARTITION_BYTES or len(held) >= PARTITION_FILES):
                out.append(Files(held))
                held, size = [], 0
            held.append((name, path))
            size += n
        return [*out, Files(held)]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = opened(self.root)
        for name, path in partition.files:
            yield entry(system, name, path)


class ScanSource(DataSource):
    """``load(root)``; option ``without``: a file that is left out, such as the manifest that is being written."""

    @classmethod
    def name(cls) -> str:
        return "lexmill_scan"

    def schema(self) -> str:
        return MANIFEST

    def reader(self, schema) -> DataSourceReader:
        return ScanReader(self.options["path"], self.options.get("without"))


def scan(spark: SparkSession, root: str, without: str | None = None) -> DataFrame:
    """The manifest of ``root``, in order of the relative paths."""
    spark.dataSource.register(ScanSource)
    reader = spark.read.format("lexmill_scan")
    return (reader.option("without", without) if without else reader).load(root).orderBy("relative_path")
