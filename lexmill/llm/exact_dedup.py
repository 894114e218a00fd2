"""Exact duplicates by deterministic block naming.

A normalised text is cut into blocks of fixed size. Equal blocks meet in one
partition, are sorted there, and get an integer name: partition number and rank.
Then neighbouring names are named in pairs, again and again, until each text has
one name. Two texts of the same number of blocks have the same last name if and
only if they are equal: names stand for compared bytes, not for hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import _SPACE, blocks

BLOCK = 4096  #: bytes of a block
#: The rows of a class, those without a doc_id last.
_ROWS = pa.list_(pa.struct([("no_id", pa.bool_()), ("doc_id", pa.int64()), ("row", pa.int64())]))
_ROWS_DDL = "array<struct<no_id:boolean,doc_id:long,row:long>>"


def normalised(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of white space becomes one space; bytes and offsets again."""
    space = _SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    at = off[:-1][off[:-1] < len(data)]
    keep[at] = True
    total = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return np.where(space, np.uint8(0x20), data)[keep], total[off]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of each distinct text of a batch; its rows' doc_ids ride on the first block."""
    base, n = TaskContext.get().partitionId() << 36, 0
    for batch in batches:
        classes: dict[bytes, list] = {}
        for i, j, data, off in blocks(batch.column("text")):
            flat, at = normalised(data, off)
            raw = flat.tobytes()
            for k, (doc, row) in enumerate(zip(*(batch.column(c).slice(i, j - i).to_pylist() for c in ("doc_id", "row")))):
                classes.setdefault(raw[at[k] : at[k + 1]], []).append({"no_id": doc is None, "doc_id": doc, "row": row})
        out: list[tuple] = []
        for text, ids in classes.items():
            count = max(1, -(-len(text) // BLOCK))
            for p in range(count):
                out.append((base + n, count, p, text[p * BLOCK : (p + 1) * BLOCK], None if p else ids, None if p else hashlib.sha256(text).hexdigest()))
            n += 1
        cols = list(zip(*out)) or [()] * 6
        types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), _ROWS, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["cls", "count", "pos", "block", "ids", "sha"])


def _naming(keys: list[str], kept: list[str]):
    """Names runs of equal keys in a sorted partition by partition number and rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, last = TaskContext.get().partitionId() << 40, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                c = batch.column(k)
                new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
            head = [batch.column(k)[0].as_py() for k in keys]
            new[0] = last is not None and head != last
            names = rank + np.cumsum(new)
            rank, last = int(names[-1]), [batch.column(k)[batch.num_rows - 1].as_py() for k in keys]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(names)], names=[*kept, "name"])

    return run


def _named(rows: DataFrame, keys: list[str], kept: str) -> DataFrame:
    names = [x.split()[0] for x in kept.split(", ")]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_naming(keys, names), f"{kept}, name long")


def exact_duplicates(docs: DataFrame, row: str | None = None) -> DataFrame:
    """``docs(doc_id long, text string, ...)`` -> ``doc_id, keep_id, group_size, kept, text_sha256``, one row per input row.

    Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` becomes one
    space; of equal texts the row with the smallest doc_id stays, exactly one a group.
    ``row`` names a column of unique longs that settles ties of doc_id; it comes back as
    a further column ``row``. Without it ties are settled by the place in the input.

    Edge cases: a null text counts as empty; empty texts are equal to each other. Null
    doc_ids come after all others: one stays only if its whole group has none else,
    and keep_id is then null. Of rows that repeat doc_id and text exactly one is kept.
    Other columns are ignored, whatever their names. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    cut = docs.select("doc_id", "text", number.alias("row")).mapInArrow(_cut, f"cls long, count int, pos int, block binary, ids {_ROWS_DDL}, sha string")
    most = F.max("count")
    first = scratch.save(_named(cut, ["block"], f"cls long, count int, pos int, ids {_ROWS_DDL}, sha string"), most=most)
    done = first.where("count = 1").select("cls", "count", "name")
    level = first.where("count > 1").select("cls", "count", F.col("count").alias("width"), "pos", "name")
    used, most = [first], first.facts["most"] or 1
    while most > 1:
        pairs = level.groupBy("cls", "count", "width", F.expr("pos div 2").cast("int").alias("pos")).agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        named = scratch.save(_named(pairs.withColumn("width", F.expr("(width + 1) div 2").cast("int")), ["a", "b"], "cls long, count int, width int, pos int"))
        used.append(named)
        done = done.unionByName(named.where("width = 1").select("cls", "count", "name"))
        level, most = named.where("width > 1"), -(-most // 2)
    classes = first.where("pos = 0").select("cls", "ids", "sha").join(done, "cls")
    groups = classes.groupBy("count", "name").agg(F.min(F.array_min("ids")).alias("stays"), F.sum(F.size("ids")).cast("long").alias("group_size"))
    out = classes.join(groups, ["count", "name"]).select(F.explode("ids").alias("own"), "stays", "group_size", "sha")
    out = scratch.save(out.select("own.doc_id", F.col("stays.doc_id").alias("keep_id"), "group_size", (F.col("own") == F.col("stays")).alias("kept"), F.col("sha").alias("text_sha256"), "own.row"))
    scratch.drop(*used)
    return out.drop("row") if row is None else out
