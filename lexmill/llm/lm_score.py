"""Language-model scores from a log-frequency Bloom filter.

Counting: each task counts its words and word pairs with NumPy and sends sorted
(hash, count) runs, dealt by ranges of the hash, to where each range is merged; what is
sent grows with the corpus, and so does the number of ranges. A count c becomes level
1 + floor(log_b c); the filter stores (n-gram, 1), ..., (n-gram, level), so a level is
read back by probing 1, 2, ... until the first miss, up to the range's highest one. Each
range becomes one segment of the filter, with BITS bits for each entry at every size.

Scoring: filter and exact word counts of at most BROADCAST_BYTES are broadcast. Beyond it
the probes go to the filter: each block of texts sends its distinct n-grams, by range,
to the segment of that range and gets levels and counts back. Both ways read the same
segments and give the same scores.

Model: words have absolutely discounted counts, the discounted mass is the chance of
the one unknown word; pairs are smoothed towards words,
    p(w | v) = (c(v, w) + KAPPA p(w)) / (c(v) + KAPPA).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import blocks, mix, word_hashes, word_spans

RANGES = 1024  #: ranges of hashes at least
RANGE_BYTES = 64 << 20  #: bytes of training text for each range at most
BITS, PROBES = 9, 5  #: bits of the filter for each entry, hash functions
WORD_BASE, PAIR_BASE = 1.1, 1.5
KAPPA = 200.0
BROADCAST_BYTES = 256 << 20
#: Pairs that a task gathers before it sends them, and entries that are merged at once: 16 bytes each while they are sorted.
TASK_PAIRS = 1_000_000

_END = np.uint64(0x5851F42D4C957F2D)
_START = np.uint64(0x14057B7EF767814F)


_SHIFT = np.uint64(64 - RANGES.bit_length() + 1)


def _range(keys: np.ndarray, ranges: int = RANGES) -> np.ndarray:
    """The range of each hash: its leading bits. ``ranges`` is a power of two, at least RANGES."""
    return keys >> (_SHIFT - np.uint64((ranges // RANGES).bit_length() - 1))


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes with one end token after each document, hashes of (word before, word), offsets by document)."""
    starts, ends, first = word_spans(data, off)
    words, n = word_hashes(data, starts, ends), len(off) - 1
    at = first + np.arange(n + 1)
    out = np.full(at[-1], _END, np.uint64)
    place = np.ones(at[-1], bool)
    place[at[1:] - 1] = False
    out[place] = words
    before = np.empty_like(out)
    before[1:] = out[:-1]
    before[at[:-1]] = _START
    return out, mix(before * np.uint64(0x9E3779B97F4A7C15) + out), at


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their number, or the sum of their counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[at], np.diff(np.r_[at, len(keys)])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[at], np.add.reduceat(counts, at)


def _binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """Binary values: the items of ``data`` from each place in ``at`` to the next."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * data.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _runs(kind: int, keys: np.ndarray, counts: np.ndarray, ranges: int) -> pa.RecordBatch:
    """One row for each range: its sorted hashes and their counts."""
    where = _range(keys, ranges)
    at = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(keys) else np.zeros(0, np.int64)
    rows, cut = where[at].astype(np.int32), np.r_[at, len(keys)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), kind, np.int32)), pa.array(rows), _binary(keys, cut), _binary(counts.astype("<u4"), cut)], names=["kind", "range", "keys", "counts"])


def _parts(batch: pa.RecordBatch, rows: int = 128) -> Iterator[pa.RecordBatch]:
    """A batch in copies of few rows, so that neither side holds much of it at once."""
    for k in range(0, batch.num_rows, rows):
        yield batch.take(pa.array(range(k, min(batch.num_rows, k + rows)), pa.int64()))


def _count(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        n = 0
        for batch in batches:
            for _, _, data, off in blocks(batch.column("text")):
                words, pairs, _ = tokens(data, off)
                held[0].append(words)
                held[1].append(pairs)
                n += len(pairs)
                if n >= TASK_PAIRS:
                    for kind in (0, 1):
                        yield from _parts(_runs(kind, *_summed(np.concatenate(held[kind])), ranges))
                    held, n = [[], []], 0
        if n:
            for kind in (0, 1):
                yield from _parts(_runs(kind, *_summed(np.concatenate(held[kind])), ranges))

    return run


def levels(counts: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(base) + 1e-9).astype(np.int64)


def level_counts(base: float, most: int = 400) -> np.ndarray:
    """The count that a level stands for: the mean of the whole numbers in it; levels without any repeat the one before."""
    low, high = base ** np.arange(most), base ** np.arange(1, most + 1)
    a, b = np.ceil(low - 1e-9), np.ceil(high - 1e-9) - 1
    out = np.where(b >= a, (a + b) / 2, 0.0)
    for k in range(1, most):
        out[k] = out[k] or out[k - 1]
    return np.r_[0.0, out]


def _places(keys: np.ndarray, level: int, words: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """For (key, level): one 64-bit word of a filter of so many words, and its PROBES bits in that word."""
    h = mix(keys + np.uint64((level * 0x632BE59BD9B4E019) & (2**64 - 1)))
    place = ((h >> np.uint64(32)) * np.asarray(words, np.uint64)) >> np.uint64(32)
    bits = np.zeros(len(keys), np.uint64)
    for i in range(PROBES):
        bits |= np.uint64(1) << ((h >> np.uint64(6 * i)) & np.uint64(63))
    return place.astype(np.int64), bits


def segment(keys: np.ndarray, level: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The filter of one range, as 64-bit words; all bits of an entry are in one of them, so a probe is one read."""
    words = int(level.sum()) * bits // 64 + 1
    out = np.zeros(words, np.uint64)
    for k in range(1, int(level.max(initial=0)) + 1):
        place, mask = _places(keys[level >= k], k, words)
        np.bitwise_or.at(out, place, mask)
    return out


_BASE = (WORD_BASE, PAIR_BASE)
_SEGMENT = "kind int, range int, keys binary, counts binary, filter binary, n long, total long, once long, twice long, size long, highest int, quantised double"


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All runs of a (kind, range) become one row with its segment; rows come sorted by both."""
    now, held, n = None, [], 0

    def flush() -> pa.RecordBatch:
        keys, counts = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        kind, where = now
        level = levels(counts, _BASE[kind])
        exact = [keys.tobytes(), counts.astype("<i8").tobytes()] if kind == 0 else [None, None]  # of pairs only the filter is kept
        own = segment(keys, level)
        row = [kind, where, *exact, own.tobytes(), len(keys), int(counts.sum()), int((counts == 1).sum()), int((counts == 2).sum()), own.nbytes, int(level.max()), float(level_counts(_BASE[kind])[level].sum())]
        types = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), *[pa.int64()] * 5, pa.int32(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], names=[x.split()[0] for x in _SEGMENT.split(", ")])

    for batch in batches:
        for k, r, a, b in zip(batch.column("kind").to_pylist(), batch.column("range").to_pylist(), batch.column("keys"), batch.column("counts")):
            if now != (k, r):
                if now:
                    yield flush()
                now, held, n = (k, r), [], 0
            held.append((np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), "<u4").astype(np.int64)))
            n += len(held[-1][0])
            if n > TASK_PAIRS and len(held) > 1 and n > 2 * len(held[0][0]):
                held = [_summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))]
                n = len(held[0][0])
    if now:
        yield flush()


class Filter:
    """Segments of one kind of n-gram, by range of the hash: their sizes in words, and their words one behind the other."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray | bytes, base: float, highest: int | np.ndarray | None = None):
        self.sizes, self.words, self.table = sizes, np.frombuffer(words, np.uint64), level_counts(base)
        self.starts = np.r_[0, np.cumsum(sizes)[:-1]]
        # the highest stored level of each range: beyond it all hits are false
        self.highest = np.broadcast_to(np.asarray(len(self.table) - 1 if highest is None else highest), sizes.shape)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Stored levels, by repeated membership probes."""
        where = _range(keys, len(self.sizes)).astype(np.int64) if len(self.sizes) > 1 else np.zeros(len(keys), np.int64)
        sizes, starts, highest = self.sizes[where], self.starts[where], self.highest[where]
        level = np.zeros(len(keys), np.int64)
        at, k = np.flatnonzero((sizes > 0) & (highest > 0)), 0
        while len(at):
            k += 1
            place, mask = _places(keys[at], k, sizes[at])
            at = at[(self.words[starts[at] + place] & mask) == mask]
            level[at] = k
            at = at[highest[at] > k]
        return level

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The counts that the levels stand for."""
        return self.table[self.levels(keys)]


def _exact(known: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The counts of ``keys`` among the sorted ``known`` ones; 0 for others."""
    if not len(known):
        return np.zeros(len(keys), np.int64)
    found = np.searchsorted(known, keys)
    found[found == len(known)] = 0
    return np.where(known[found] == keys, counts[found], 0)


@dataclass(frozen=True)
class Model:
    """What the scores need besides counts: tokens, distinct words, discount, quantised tokens, training texts."""

    n: int
    v: int
    discount: float
    total: float
    starts: int

    def scored(self, words: np.ndarray, at: np.ndarray, which: np.ndarray, level: np.ndarray, exact: np.ndarray, pair_level: np.ndarray) -> list[np.ndarray]:
        """(n_tokens, n_known, base_score, score) of each text: its tokens' distinct words ``which`` with level and exact count, and its pairs' levels."""
        c = level_counts(WORD_BASE)[level]
        unknown = self.discount * self.v / self.total if self.v else 1.0
        p = np.where(c > 0, (c - self.discount) / self.total, unknown)[which]
        c, exact = c[which], exact[which]
        before = np.r_[0.0, c[:-1]]
        before[at[:-1]] = self.starts
        pair = np.where(c > 0, np.minimum(level_counts(PAIR_BASE)[pair_level], before), 0)
        logp = np.log10((pair + KAPPA * p) / (before + KAPPA))
        base = np.log10((exact + 0.5) / (self.n + 0.5 * (self.v + 1)))
        return [np.diff(at), np.add.reduceat((exact > 0).astype(np.int64), at[:-1]), np.add.reduceat(base, at[:-1]), np.add.reduceat(logp, at[:-1])]


_SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def _rows(ids: pa.Array, scores: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, *map(pa.array, scores)], names=[x.split()[0] for x in _SCORES.split(", ")])


def _broadcast_scores(held, model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters, known, counts = held.value
        for batch in batches:
            for i, j, data, off in blocks(batch.column("text")):
                words, pairs, at = tokens(data, off)
                unique, which = np.unique(words, return_inverse=True)
                yield _rows(batch.column("doc_id").slice(i, j - i), model.scored(words, at, which, filters[0].levels(unique), _exact(known, counts, unique), filters[1].levels(pairs)))

    return run


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in numbered blocks of bounded bytes."""
    n = TaskContext.get().partitionId() << 36
    for batch in batches:
        for i, j, _, _ in blocks(batch.column("text")):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, n)), *(batch.column(c).slice(i, j - i) for c in ("doc_id", "text"))], names=["block", "doc_id", "text"])
            n += 1


def _together(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows of each value of ``key`` as one batch; they come together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        values = batch.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1), batch.num_rows] if batch.num_rows else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if held and held[0].column(key)[0].as_py() != values[a]:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def _distinct(texts: pa.Array) -> tuple:
    """(words, pairs, at, distinct words, which, distinct pairs, which) of a block of texts."""
    every, at, n = [[], []], [np.zeros(1, np.int64)], 0
    for _, _, data, off in blocks(texts):
        words, pairs, own = tokens(data, off)
        every[0].append(words), every[1].append(pairs), at.append(own[1:] + n)
        n += len(words)
    words, pairs = (np.concatenate(x) for x in every)
    return words, np.concatenate(at), *np.unique(words, return_inverse=True), *np.unique(pairs, return_inverse=True)


def _probes(ranges: int):
    """For each block, kind and range one row of distinct n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _together(batches, "block"):
            _, _, words, _, pairs, _ = _distinct(batch.column("text"))
            for kind, keys in enumerate((words, pairs)):
                rows = _runs(kind, keys, np.zeros(len(keys)), ranges)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows.num_rows, batch.column("block")[0].as_py())), *rows.columns[:3]], names=["block", "kind", "range", "keys"])

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Levels and exact counts of each probe's n-grams: a range's segment comes first, its probes behind it, which are answered together."""
    now = own = None

    def answer(blocks_: list[int], keys: list[np.ndarray]) -> pa.RecordBatch:
        every, at = np.concatenate([np.zeros(0, np.uint64), *keys]), np.r_[0, np.cumsum([len(k) for k in keys], dtype=np.int64)]
        level = own[0].levels(every) if own else np.zeros(len(every), np.int64)
        exact = _exact(own[1], own[2], every) if own else level
        kind, where = now
        counts = _binary(exact.astype("<i8"), at) if kind == 0 else pa.nulls(len(keys), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(blocks_, pa.int64()), pa.array([kind] * len(keys), pa.int32()), pa.array([where] * len(keys), pa.int32()), _binary(level.astype("<i8"), at), counts], names=["block", "kind", "range", "levels", "counts"])

    for batch in batches:
        ids, held = [], []
        for kind, where, block, keys, counts, words, highest in zip(*(batch.column(c) for c in ("kind", "range", "block", "keys", "counts", "filter", "highest"))):
            here, block, keys = (kind.as_py(), where.as_py()), block.as_py(), np.frombuffer(keys.as_py() or b"", np.uint64)
            if here != now:
                if held:
                    yield answer(ids, held)
                now, own, ids, held = here, None, [], []
            if block is None:
                flat = np.frombuffer(words.as_py(), np.uint64)
                own = Filter(np.array([len(flat)]), flat, _BASE[here[0]], highest.as_py()), keys, np.frombuffer(counts.as_py() or b"", "<i8")
            else:
                ids.append(block), held.append(keys)
        if held:
            yield answer(ids, held)


def _joined_scores(model: Model):
    """Scores of blocks: a block's answers come first, by kind and range, its texts behind them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _together(batches, "block"):
            kind = batch.column("kind").to_pylist()
            texts = pa.array([k for k, x in enumerate(kind) if x is None])
            words, at, _, which, _, which_pair = _distinct(batch.column("text").take(texts))
            level, pair_level = (np.concatenate([np.frombuffer(b.as_py(), "<i8") for b, x in zip(batch.column("levels"), kind) if x == k]) for k in (0, 1))
            exact = np.concatenate([np.frombuffer(b.as_py(), "<i8") for b, x in zip(batch.column("counts"), kind) if x == 0])
            yield _rows(batch.column("doc_id").take(texts), model.scored(words, at, which, level, exact, pair_level[which_pair]))

    return run


def _segments(scratch: Scratch, training: DataFrame, ranges: int) -> DataFrame:
    """One row for each (kind, range) with n-grams; its ``facts`` have the sums over both kinds."""
    counted = training.mapInArrow(_count(ranges), "kind int, range int, keys binary, counts binary")
    merged = counted.repartition("kind", "range").sortWithinPartitions("kind", "range").mapInArrow(_merge, _SEGMENT)
    sums = {f"{c}{k}": F.sum(F.when(F.col("kind") == k, F.col(c)).otherwise(0)) for k in (0, 1) for c in ("n", "total", "once", "twice", "size", "quantised")}
    return scratch.save(merged, **sums)


def _held(segments: DataFrame, ranges: int) -> tuple:
    """Filters of both kinds, and the sorted words with their exact counts. Of at most the bytes that may be broadcast."""
    filters = []
    for kind in (0, 1):
        sizes, highest = np.zeros(ranges, np.int64), np.zeros(ranges, np.int64)
        table = segments.where(F.col("kind") == kind).select("range", "filter", "keys", "counts", "highest").toArrow().sort_by("range")
        parts = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("filter")]
        sizes[table.column("range").to_numpy()] = [len(x) for x in parts]
        highest[table.column("range").to_numpy()] = table.column("highest").to_numpy()
        filters.append(Filter(sizes, np.concatenate([np.zeros(0, np.uint64), *parts]), _BASE[kind], highest))
        if kind == 0:
            known, counts = (np.concatenate([np.zeros(0, t), *(np.frombuffer(x.as_py(), t) for x in table.column(c))]) for c, t in (("keys", np.uint64), ("counts", "<i8")))
    return filters, known, counts


def lm_scores(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per input row.

    Learned from all texts whose crc32(doc_id as text) mod 5 is not 1; score is the
    model's log10 probability of the text's words and its end.

    Edge cases: a null text counts as empty: one token, the end. A null doc_id gives
    held_out null and is not learned from. Repeated rows count as often as they occur.
    Without training texts each token has base 1 / 1 and the score is 0. Extra columns
    are ignored. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    training = docs.where(fold != 1).select("text")
    starts, size = training.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = RANGES
    while ranges * RANGE_BYTES < size:
        ranges *= 2
    segments = _segments(scratch, training, ranges)
    f = segments.facts
    n, v = f["total0"] or 0, f["n0"] or 0
    discount = min(0.9, (f["once0"] or 0) / max(1, (f["once0"] or 0) + 2 * (f["twice0"] or 0)) or 0.5) if v else 0.0
    model = Model(n, v, discount, f["quantised0"] or 1.0, starts)

    if (f["size0"] or 0) + (f["size1"] or 0) + 16 * v <= broadcast_bytes:
        held = spark.sparkContext.broadcast(_held(segments, ranges))
        scored, used = docs.select("doc_id", "text").mapInArrow(_broadcast_scores(held, model), _SCORES), [segments]
    else:
        held = None
        texts = scratch.save(docs.select("doc_id", "text").mapInArrow(_blocked, "block long, doc_id long, text string"))
        probes = texts.mapInArrow(_probes(ranges), "block long, kind int, range int, keys binary")
        meet = segments.select("kind", "range", "keys", "counts", "filter", "highest").unionByName(probes, allowMissingColumns=True)
        meet = meet.repartition("kind", "range").sortWithinPartitions("kind", "range", F.col("block").asc_nulls_first())
        answers = scratch.save(meet.mapInArrow(_answered, "block long, kind int, range int, levels binary, counts binary"))
        whole = answers.unionByName(texts, allowMissingColumns=True)
        whole = whole.repartition("block").sortWithinPartitions("block", F.col("kind").asc_nulls_last(), "range")
        scored, used = whole.mapInArrow(_joined_scores(model), _SCORES), [segments, texts, answers]
    out = scratch.save(scored.select("doc_id", (fold == 1).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score"))
    scratch.drop(*used)
    if held is not None:
        held.destroy()  # the result is written: workers need not hold it any longer
    return out
