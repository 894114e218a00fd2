"""JSON arrays of any size, cut into their elements by many tasks.

A file is dealt in ranges of bytes. One pass indexes each range without knowing what lies
before it: whether its quotes flip the state "inside a string", and for both states at its
start how far the depth of brackets moves and how many commas lie at each relative depth.
Running sums over a file's ranges then give every range its true state, its depth, and the
number of elements before it. A second pass cuts each range's elements; one that runs on
into later ranges is read on by the task in whose range it starts.

The result is that of a parser of the whole file: a file with anything that is no JSON
gives no element at all, but one error.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scan import BOM, opened

RANGE_BYTES = 8 << 20

_QUOTE, _SLASH, _COMMA = ord('"'), ord("\\"), ord(",")
_MARKS = np.zeros(256, bool)
_MARKS[[_QUOTE, _COMMA, *b"[]{}"]] = True
_STEP = np.zeros(256, np.int64)
_STEP[list(b"[{")] = 1
_STEP[list(b"]}")] = -1
_BLANK = b" \t\n\r"


def marks(data: np.ndarray, slashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, bytes, quotes before each) of the quotes, commas and brackets of a range.

    Quotes behind an odd run of backslashes are left out; ``slashes`` of them lie right before the range.
    """
    at = np.flatnonzero(_MARKS[data])
    what = data[at]
    slash = data == _SLASH
    edges = np.flatnonzero(np.diff(np.concatenate([[False], slash, [False]])))
    starts, ends = edges[0::2].astype(np.int64), edges[1::2]
    if len(starts) and starts[0] == 0:
        starts[0] = -slashes
    elif slashes:
        starts, ends = np.concatenate([[-slashes], starts]), np.concatenate([[0], ends])
    if len(ends):
        run = np.minimum(np.searchsorted(ends, at), len(ends) - 1)
        escaped = (ends[run] == at) & ((ends[run] - starts[run]) % 2 == 1) & (what == _QUOTE)
        at, what = at[~escaped], what[~escaped]
    quotes = np.cumsum(what == _QUOTE)
    return at, what, quotes


def _slashes_before(file, start: int) -> int:
    """Backslashes right before byte ``start``."""
    n = 0
    while start - n > 0:
        size = min(4096, start - n)
        file.seek(start - n - size)
        data = file.read(size)
        own = len(data) - len(data.rstrip(b"\\"))
        n += own
        if own < size:
            break
    return n


_INDEX = "name string, start bigint, marked boolean, flips int, moves array<bigint>, commas array<map<bigint,bigint>>"
_INDEX_SCHEMA = pa.schema([("name", pa.string()), ("start", pa.int64()), ("marked", pa.bool_()), ("flips", pa.int32()), ("moves", pa.list_(pa.int64())), ("commas", pa.list_(pa.map_(pa.int64(), pa.int64())))])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for name, path, start, end in zip(*(batch.column(c).to_pylist() for c in ("name", "path", "start", "end"))):
            system, own = opened(path)
            with system.open_input_file(own) as file:
                slashes = _slashes_before(file, start)
                file.seek(start)
                _, what, quotes = marks(np.frombuffer(file.read(end - start), np.uint8), slashes)
            moves, commas = [], []
            for inside in (0, 1):
                outer = what[(quotes + inside) % 2 == 0]
                outer = outer[outer != _QUOTE]
                depth = np.cumsum(_STEP[outer])
                levels, counts = np.unique(depth[outer == _COMMA], return_counts=True)
                moves.append(int(depth[-1]) if len(depth) else 0)
                commas.append(list(zip(levels.tolist(), counts.tolist())))
            row = {"name": name, "start": start, "marked": len(what) > 0, "flips": int((what == _QUOTE).sum() % 2), "moves": moves, "commas": commas}
            yield pa.RecordBatch.from_pylist([row], schema=_INDEX_SCHEMA)


def ranges(files: DataFrame, size: int = RANGE_BYTES) -> DataFrame:
    """``files(name, path, byte_size)`` -> its ranges ``name, path, byte_size, start, end``, one after another."""
    n = F.greatest(F.lit(1), F.ceil(F.col("byte_size") / size)).cast("long")
    rows = files.select("name", "path", "byte_size", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k"))
    return rows.select("name", "path", "byte_size", (F.col("k") * size).alias("start"), F.least((F.col("k") + 1) * size, F.col("byte_size")).alias("end"))


def states(dealt: DataFrame) -> DataFrame:
    """The ranges with what holds at their starts: ``inside`` (a string), ``depth``, ``before`` (top-level commas ahead) and ``begun`` (anything but blanks ahead)."""
    ahead = Window.partitionBy("name").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    rows = dealt.mapInArrow(_indexed, _INDEX).withColumn("begun", F.coalesce(F.bool_or("marked").over(ahead), F.lit(False)))
    rows = rows.withColumn("inside", F.pmod(F.coalesce(F.sum("flips").over(ahead), zero), F.lit(2)).cast("int"))
    rows = rows.withColumn("depth", F.coalesce(F.sum(F.get("moves", F.col("inside"))).over(ahead), zero))
    own = F.coalesce(F.try_element_at(F.get("commas", F.col("inside")), 1 - F.col("depth")), zero)
    rows = rows.withColumn("before", F.coalesce(F.sum(own).over(ahead), zero))
    return dealt.join(rows.select("name", "start", "inside", "depth", "before", "begun"), ["name", "start"])


class _Cutter:
    """Cuts one range: yields (ordinal, bytes of the element), and raises ValueError where the file can't be an array."""

    def __init__(self, file, byte_size: int, start: int, end: int, inside: int, depth: int, before: int, begun: bool):
        self.file, self.byte_size, self.start, self.end = file, byte_size, start, end
        self.inside, self.depth, self.before, self.begun = inside, depth, before, begun

    def __iter__(self) -> Iterator[tuple[int, bytes]]:
        """Delimiters are the opening bracket, top-level commas, and the closing bracket; an element is named by the one before it."""
        at, slashes, held, number = self.start, _slashes_before(self.file, self.start), None, None
        inside, depth, commas, begun = self.inside, self.depth, self.before, self.begun
        while at < self.byte_size and (at < self.end or held is not None):
            self.file.seek(at)
            stop = self.end if at < self.end else min(self.byte_size, at + RANGE_BYTES)
            data = self.file.read(stop - at)
            view = np.frombuffer(data, np.uint8)
            places, what, quotes = marks(view, slashes)
            outer = ((quotes + inside) % 2 == 0) & (what != _QUOTE)
            places, kind = places[outer], what[outer]
            depths = depth + np.cumsum(_STEP[kind])
            top = ((kind == _COMMA) & (depths == 1)) | ((_STEP[kind] == 1) & (depths == 1)) | ((_STEP[kind] == -1) & (depths <= 0))
            begin = 0
            blank_from = 0 if depth == 0 else None  # bytes outside the array must be blank
            for p, k, d in zip(places[top].tolist(), kind[top].tolist(), depths[top].tolist()):
                if at + p >= self.end and held is None:
                    return
                if k == _COMMA or d == 0:
                    if held is not None:
                        held.append(data[begin:p])
                        yield number, b"".join(held)
                        held = None
                        if at + p >= self.end:
                            return
                if k == _COMMA:
                    commas += 1
                    held, number, begin = [], commas, p + 1
                elif d == 1:
                    self._blank(data[blank_from or 0 : p], at + (blank_from or 0))
                    if chr(k) != "[" or begun:
                        raise ValueError("no array, or a second one")
                    held, number, begin, blank_from, begun = [], 0, p + 1, None, True
                elif d == 0:
                    if chr(k) != "]":
                        raise ValueError("no array")
                    blank_from = p + 1
                else:
                    raise ValueError("a bracket too many")
            if blank_from is not None:
                self._blank(data[blank_from:], at + blank_from)
            if held is not None:
                held.append(data[begin:])
            tail = len(data) - len(data.rstrip(b"\\"))
            slashes = tail + (slashes if tail == len(data) else 0)
            inside = (inside + int(quotes[-1] if len(quotes) else 0)) % 2
            depth = int(depths[-1]) if len(depths) else depth
            at = stop
        if held is not None:
            raise ValueError("the array isn't closed")

    def _blank(self, data: bytes, at: int) -> None:
        """``data`` from byte ``at`` on lies outside the array: only blanks may, and a byte order mark at the file's start."""
        if at < len(BOM):
            self.file.seek(0)
            if self.file.read(len(BOM)) == BOM:
                data = data[len(BOM) - at :]
        if data.strip(_BLANK):
            raise ValueError("bytes outside the array")


def _values(file, row: dict) -> Iterator[tuple[int, object, bool]]:
    """(ordinal, value, is the error) of the elements that start in a range."""
    try:
        for number, data in _Cutter(file, *(row[c] for c in ("byte_size", "start", "end", "inside", "depth", "before", "begun"))):
            if number == 0 and not data.strip(_BLANK):
                yield -1, None, False  # nothing between the brackets: right only where no comma follows
                continue
            yield number, json.loads(data.decode()), False
    except ValueError:
        yield -2, None, True


def elements(states_: DataFrame, make: Callable[[str, int, object], dict], schema: str, arrow: pa.Schema, rows: int = 2000) -> DataFrame:
    """One row ``make(name, ordinal, value)`` for each element, and rows with ordinal -1 (a blank before the first comma or the end) or -2 (an error) of ``make(name, ordinal, None)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, own = opened(row["path"])
                held: list[dict] = []
                with system.open_input_file(own) as file:
                    for number, value, _ in _values(file, row):
                        held.append(make(row["name"], number, value))
                        if len(held) >= rows:
                            yield pa.RecordBatch.from_pylist(held, schema=arrow)
                            held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return states_.mapInArrow(run, schema)


def starts_with_bracket(path: str) -> bool:
    """Whether the first byte that isn't blank (nor a byte order mark) opens an array."""
    system, own = opened(path)
    with system.open_input_file(own) as file:
        first = True
        while data := file.read(1 << 16):
            data = (data.removeprefix(BOM) if first else data).lstrip(_BLANK)
            first = False
            if data:
                return data[:1] == b"["
    return False


def spread(spark: SparkSession, dealt: DataFrame) -> DataFrame:
    """The ranges over as many tasks as there are cores or shuffle partitions: their rows weigh nothing, their work does."""
    return dealt.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
