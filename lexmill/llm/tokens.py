"""Exact tokens of Arrow text columns: words as dictionary codes, by NumPy on the raw UTF-8 bytes.

Which bytes belong to words is given by a table over the 256 byte values; as only ASCII
bytes separate words, working on bytes equals working on characters. A-Z are lower-cased
and nothing else is changed. Codes stand for the words themselves, so counts of codes
are exact; no hash of a word decides anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .words import text_buffers

#: Bytes of text that a task works on at once; one longer document is worked on alone.
CHUNK_BYTES = 8 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the byte values in any of the ranges, ends included."""
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


@dataclass(frozen=True)
class Tokens:
    """The words of a run of texts: their codes, the dictionary the codes point to, their texts' numbers, and their places in ``data``."""

    codes: np.ndarray
    dictionary: pa.Array
    doc: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray


def tokens(column: pa.Array, solid: np.ndarray) -> Tokens:
    """Longest runs of bytes that are true in ``solid``, in order, lower-cased; none crosses a text's end. Null counts as empty."""
    data, off = text_buffers(column)
    data, off = data[off[0] : off[-1]], off - off[0]
    inside = solid[data]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, ends = edges[0::2], edges[1::2]
    inner = np.unique(off[1:-1])
    inner = inner[(inner > 0) & (inner < len(data))]
    cut = inner[inside[inner - 1] & inside[inner]]
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    kept = _LOWER[data[inside]]
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(kept)])
    coded = words.dictionary_encode()
    return Tokens(coded.indices.to_numpy().astype(np.int64), coded.dictionary, np.searchsorted(off, starts, "right") - 1, starts, ends, data)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in runs of about ``limit`` bytes of ``column`` and at most ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    size = n = 0

    def merged() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        i = 0
        _, off = text_buffers(batch.column(column))
        while i < batch.num_rows:
            j = int(np.searchsorted(off, off[i] + max(1, limit - size), "left"))
            j = min(max(j, i + 1), batch.num_rows, i + rows - n)
            held.append(batch.slice(i, j - i))
            size, n, i = size + int(off[j] - off[i]), n + j - i, j
            if size >= limit or n >= rows:
                yield merged()
                held, size, n = [], 0, 0
    if held:
        yield merged()
