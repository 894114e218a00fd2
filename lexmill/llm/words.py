"""Vectorised words and shingles of Arrow text columns (NumPy on the raw UTF-8 bytes).

A word is a longest run of bytes outside ``[\\x20\\x09-\\x0D]``; A-Z are lower-cased
and nothing else is changed. Both rules touch ASCII bytes only, so working on
UTF-8 bytes equals working on characters. A word is represented by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer document forms its own block.
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.Generator(np.random.PCG64(20240607))
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_C5 = np.uint64(0xBF58476D1CE4E5B9)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, BLOCK_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0], _powers[1]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null counts as empty."""
    a = pc.fill_null(column, "").cast(pa.large_string())
    _, off, data = a.buffers()
    offsets = np.frombuffer(off, np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows of about ``limit`` bytes."""
    data, off = text_buffers(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document the index of its first word (with the end)."""
    n = len(data)
    solid = ~_SPACE[data]
    edge = np.empty(n + 1, bool)
    edge[1:n] = solid[1:] != solid[:-1]
    edge[0] = n > 0 and solid[0]
    edge[n] = n > 0 and solid[n - 1]
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    inner = np.unique(offsets[1:-1])
    inner = inner[(inner > 0) & (inner < n)]
    cut = inner[solid[inner - 1] & solid[inner]] if len(inner) else inner
    if len(cut):  # a word that would run on from one document into the next
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, lower-cased."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):  # pieces of whole words, so that one long document needs no long tables
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + BLOCK_BYTES, "right")))
        s, e = starts[i:j] - at, ends[i:j] - at
        up, down = _power_tables(int(e[-1]) + 1)
        total = np.zeros(int(e[-1]) + 1, np.uint64)
        np.cumsum(_VALUE[data[at : at + e[-1]]] * up[: e[-1]], out=total[1:])
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbouring words (over document ends too; callers leave those out)."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    m = len(words) - n + 1
    h = np.full(m, n, np.uint64)
    for k in range(n):
        h = (h + words[k : k + m]) * _C5
        h ^= h >> np.uint64(29)
    return mix(h)


def shingle_sets(words: np.ndarray, first: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct n-word shingle hashes of each document; fewer words: the whole sequence as one; none: empty."""
    grams = ngram_hashes(words, n)
    out = []
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
        if hi - lo >= n:
            s = np.sort(grams[lo : hi - n + 1])
            if len(s) > 1:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                s = s[keep]
            out.append(s)
        else:
            out.append(ngram_hashes(words[lo:hi], hi - lo) if hi > lo else np.zeros(0, np.uint64))
    return out
