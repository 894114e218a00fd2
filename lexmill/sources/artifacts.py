"""Artifacts: canonical lines in a fixed order as one file, with its SHA-256.

The lines are range-partitioned and sorted by many tasks and written by a data source with
a two-phase commit: each task writes a file of its own into a staging folder, and only the
driver's commit, which knows the attempts that count, names the parts in order. One task
then streams the parts, in constant memory, into the artifact and its hash: SHA-256 runs
through the lines one after another, so nothing but that pass is sequential.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .scan import PIECE, opened


@dataclass
class Part(WriterCommitMessage):
    """A file written by the task attempt of a partition."""

    partition: int
    name: str
    lines: int


class LineWriter(DataSourceArrowWriter):
    """Writes ``line`` of each row, in order; ``commit`` leaves parts ``part-000000`` and on in the folder, and the number of lines beside them."""

    def __init__(self, path: str):
        self.path, self.staging = path.rstrip("/"), f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        context = TaskContext.get()
        system, folder = opened(self.staging)
        system.create_dir(folder, recursive=True)
        name, lines = f"{context.partitionId()}-{context.taskAttemptId()}", 0
        with system.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for batch in iterator:
                body = batch.column("line").to_pylist()
                lines += len(body)
                out.write("".join(x + "\n" for x in body).encode())
        return Part(context.partitionId(), name, lines)

    def commit(self, messages: list) -> None:
        system, folder = opened(self.staging)
        _, target = opened(self.path)
        kept = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        system.create_dir(folder, recursive=True)
        for n, m in enumerate(kept):
            system.move(f"{folder}/{m.name}", f"{folder}/part-{n:06d}")
        for f in system.get_file_info(fs.FileSelector(folder)):
            if not f.base_name.startswith("part-"):  # of attempts that don't count
                system.delete_file(f.path)
        with system.open_output_stream(f"{folder}/_parts.json", compression=None) as out:
            out.write(json.dumps({"lines": sum(m.lines for m in kept), "parts": len(kept)}).encode())
        if system.get_file_info(target).type == fs.FileType.Directory:
            system.delete_dir(target)
        system.move(folder, target)

    def abort(self, messages: list) -> None:
        system, folder = opened(self.staging)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class LineSink(DataSource):
    """``df.write.format("lexmill_lines").mode("overwrite").save(path)`` of a table with the column ``line``."""

    @classmethod
    def name(cls) -> str:
        return "lexmill_lines"

    def schema(self) -> str:
        return "line string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        system, target = opened(self.options["path"])
        if not overwrite and system.get_file_info(target).type != fs.FileType.NotFound:
            raise FileExistsError(self.options["path"])
        return LineWriter(self.options["path"])


def _joined(parts: str, path: str):
    """Streams the parts in order into ``path``; one row with its hash, bytes and lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            system, folder = opened(parts)
            target = opened(path)[1]
            sha, size = hashlib.sha256(), 0
            held = f"{target}.{TaskContext.get().taskAttemptId()}"
            with system.open_output_stream(held, compression=None) as out:
                for f in sorted(system.get_file_info(fs.FileSelector(folder)), key=lambda f: f.base_name):
                    if not f.base_name.startswith("part-"):
                        continue
                    with system.open_input_file(f.path) as file:
                        while data := file.read(PIECE):
                            sha.update(data)
                            size += len(data)
                            out.write(data)
            system.move(held, target)
            with system.open_input_file(f"{folder}/_parts.json") as file:
                lines = json.loads(file.read())["lines"]
            yield pa.RecordBatch.from_arrays([pa.array(["sha256:" + sha.hexdigest()]), pa.array([size]), pa.array([lines])], names=["sha256", "bytes", "lines"])

    return run


def write_artifact(df: DataFrame, line: Column, order: list, path: str) -> dict:
    """The rows' ``line`` in ``order`` (ties: by line) as the file ``path`` -> its sha256, bytes and lines."""
    spark = df.sparkSession
    spark.dataSource.register(LineSink)
    parts = f"{path}.parts"
    df.select(*order, line.alias("line")).orderBy(*order, "line").select("line").write.format("lexmill_lines").mode("overwrite").save(parts)
    row = spark.range(1).coalesce(1).mapInArrow(_joined(parts, path), "sha256 string, bytes bigint, lines bigint").first()
    system, folder = opened(parts)
    system.delete_dir(folder)
    return row.asDict()
