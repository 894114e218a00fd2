"""Phrase collocations by Apriori passes.

Level by level: a pass over all texts counts the phrases of k words, but only those
whose two overlapping phrases of k - 1 words are frequent. The frequent ones of a level
are broadcast as a filter of at most FILTER_BYTES: 16 bits for each, or fewer once the
bound is reached. The filter knows every frequent phrase and takes a few others for
frequent; these are counted like the rest and fall to the exact threshold, so its size
changes the work and never the result. Tasks count exact word codes and send one row for
each phrase of a chunk; phrases are summed by their text, in Spark.

Scoring: each candidate is cut after its first 1, 2, ... words and looks its parts' counts
up in the level tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .tokens import byte_table, chunks, tokens
from .words import mix, text_buffers, word_hashes

FILTER_BYTES = 32 << 20
CHUNK_BYTES = 2 << 20  #: bytes of text that are counted together; some 50 times as much is held meanwhile
SEGMENT_WORDS = 1 << 12  #: 64-bit words of the filter that are merged and sent as one row

_BLANK = byte_table((0x09, 0x09), (0x20, 0x20))
_CUT = byte_table((0x0A, 0x0D), *((ord(c), ord(c)) for c in ".,;:!?"))
_WORD = ~(_BLANK | _CUT)
_C = np.uint64(0xD6E8FEB86659FD93)


def _lang(column: pa.Array) -> pa.DictionaryArray:
    return pc.fill_null(column.cast(pa.string()), "und").dictionary_encode()


def _hashes(strings: pa.Array) -> np.ndarray:
    data, off = text_buffers(strings)
    return word_hashes(data, off[:-1], off[1:]) if len(strings) else np.zeros(0, np.uint64)


def _names(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """64-bit names of phrases, from the hashes of the language and of the words in order."""
    h = lang
    for w in words:
        h = (h ^ w) * _C
        h = h ^ (h >> np.uint64(32))
    return mix(h)


class Filter:
    """A set of names in ``2^b`` 64-bit words; a name's three bits are all in one word."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, len(words).bit_length() - 1

    def places(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.zeros(len(names), np.uint64)
        for k in range(3):
            mask |= np.uint64(1) << ((names >> np.uint64(6 * k)) & np.uint64(63))
        return (names >> np.uint64(64 - self.bits)).astype(np.int64), mask

    def add(self, names: np.ndarray) -> None:
        place, mask = self.places(names)
        np.bitwise_or.at(self.words, place, mask)

    def has(self, names: np.ndarray) -> np.ndarray:
        place, mask = self.places(names)
        return (self.words[place] & mask) == mask


def _marked(k: int, words: int):
    """Each task's filter of its phrases of ``k`` words, as segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(np.zeros(words, np.uint64))
        for chunk in chunks(batches, "phrase"):
            lang = _lang(chunk.column("lang"))
            found = tokens(chunk.column("phrase"), ~_BLANK)
            each = _hashes(found.dictionary)[found.codes].reshape(-1, k)
            own.add(_names(_hashes(lang.dictionary)[lang.indices.to_numpy()], list(each.T)))
        for s, segment in enumerate(own.words.reshape(-1, min(words, SEGMENT_WORDS))):
            if segment.any():
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([segment.tobytes()], pa.binary())], names=["segment", "bits"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each segment, of all tasks' bits; a segment's rows come together."""
    now, own = None, None
    for batch in batches:
        for s, bits in zip(batch.column("segment").to_pylist(), batch.column("bits")):
            bits = np.frombuffer(bits.as_py(), np.uint64)
            if s == now:
                own = own | bits
                continue
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["segment", "bits"])
            now, own = s, bits
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["segment", "bits"])


def _filter(grams: DataFrame, k: int, scratch: Scratch, limit: int) -> Filter:
    """The filter of a level's frequent phrases; at most ``limit`` bytes reach the driver."""
    words = 1 << max(6, min(math.ceil(math.log2(max(1, grams.facts["n"] / 4))), (limit // 8).bit_length() - 1))
    parts = scratch.save(grams.select("lang", "phrase").mapInArrow(_marked(k, words), "segment int, bits binary"))
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merged, "segment int, bits binary").toArrow()
    scratch.drop(parts)
    out = np.zeros((-(-words // SEGMENT_WORDS), min(words, SEGMENT_WORDS)), np.uint64)
    for s, bits in zip(merged.column("segment").to_pylist(), merged.column("bits")):
        out[s] = np.frombuffer(bits.as_py(), np.uint64)
    return Filter(out.reshape(-1))


def _count(k: int, held):
    """(lang, phrase of k words, occurrences) of each chunk of texts; for k = 1 also each language's words, with phrase null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, limit=CHUNK_BYTES):
            t, lang = tokens(chunk.column("text"), _WORD), _lang(chunk.column("lang"))
            n, size = len(t.codes), max(1, len(t.dictionary))
            if n < k:
                continue
            code = lang.indices.to_numpy().astype(np.int64)[t.doc]
            at = np.arange(n)
            if k > 1:
                cuts = np.concatenate([[0], np.cumsum(_CUT[t.data], dtype=np.int32)])
                follows = (t.doc[1:] == t.doc[:-1]) & (cuts[t.starts[1:]] == cuts[t.ends[:-1]])
                hashes, langs = _hashes(t.dictionary)[t.codes], _hashes(lang.dictionary)[code]
                m = n - k + 2  # phrases of k - 1 words that may start anywhere
                known = held.value.has(_names(langs[:m], [hashes[i : m + i] for i in range(k - 1)]))
                good = known[:-1] & known[1:]
                for i in range(k - 1):
                    good &= follows[i : i + len(good)]
                at = np.flatnonzero(good)
            key = code[at]
            for i in range(k - 1):
                key = np.unique(key * size + t.codes[at + i], return_inverse=True)[1].reshape(-1)
            _, first, counts = np.unique(key * size + t.codes[at + k - 1], return_index=True, return_counts=True)
            first = at[first]
            words = [t.dictionary.take(pa.array(t.codes[first + i])) for i in range(k)]
            phrase = (pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if k > 1 else words[0]).cast(pa.string())
            rows = [(lang.dictionary.take(pa.array(code[first])), phrase, counts)]
            if k == 1:
                every = np.bincount(code, minlength=len(lang.dictionary))
                rows.append((lang.dictionary, pa.nulls(len(every), pa.string()), every))
            for x in rows:
                out = pa.RecordBatch.from_arrays([x[0], x[1], pa.array(x[2].astype(np.int64))], names=["lang", "phrase", "n"])
                for i in range(0, out.num_rows, 20_000):
                    yield out.slice(i, 20_000)

    return run


def _words(first: int, number: int) -> Column:
    """Words of the space-joined phrase, from the 0-based ``first`` one."""
    return F.array_join(F.slice(F.split("phrase", " "), first + 1, number), " ")


def _scored(k: int, levels: list[DataFrame]) -> DataFrame:
    """Candidates of k words with the lowest-scoring of their cuts."""
    out = levels[k].withColumnRenamed("n", "a")
    for cut in range(1, k):
        left = levels[cut].select("lang", F.col("phrase").alias("left"), F.col("n").alias(f"l{cut}"))
        right = levels[k - cut].select("lang", F.col("phrase").alias("right"), F.col("n").alias(f"r{cut}"))
        out = out.withColumn("left", _words(0, cut)).join(left, ["lang", "left"]).drop("left")
        out = out.withColumn("right", _words(cut, k - cut)).join(right, ["lang", "right"]).drop("right")
    # exact in 38 digits: counts stay below 10^16
    score = lambda cut: F.expr(f"cast((cast(1000000 as decimal(7,0)) * cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast(l{cut} as decimal(19,0)) * cast(r{cut} as decimal(19,0))) as bigint)")
    cuts = [F.struct(score(c).alias("score"), F.lit(c).alias("cut"), F.col(f"l{c}").alias("l"), F.col(f"r{c}").alias("r")) for c in range(1, k)]
    best = F.array_min(F.array(*cuts))
    return out.select("lang", "phrase", "a", best.alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, first: int = 2000, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """``docs(text, lang, ...)`` -> ``lang, rank, phrase, a, l, r, n, score``: each language's ``first`` best phrases of 2 to ``longest`` words.

    A-Z are lower-cased; texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and these
    into words ``[^\\x20\\x09]+``; n is the language's word occurrences, a the phrase's
    occurrences inside pieces, overlaps included, at least ``least``. Cutting a phrase in
    two gives l and r, the parts' occurrences, and floor(1000000 a a / (l r)); the lowest
    score counts, at a tie the earliest cut. A phrase goes when a longer candidate that
    contains it has at least ``inside`` percent of its occurrences. Order: score and a
    descending, phrase ascending by bytes.

    Edge cases: a null text counts as empty, a null lang as ``und``, an empty lang is a
    language; repeated rows count as often as they occur; doc_id isn't read, so it may be
    null. Extra columns are ignored. A table without phrases gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    texts = docs.select("text", "lang")
    levels: list[DataFrame] = [None]
    totals, used, held = None, [], None
    for k in range(1, longest + 1):
        counted = texts.mapInArrow(_count(k, held), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        level = scratch.save(counted.where(F.col("phrase").isNull() | (F.col("n") >= least)))
        used.append(level)
        if held is not None:
            held.destroy()
        if k == 1:
            totals = level.where("phrase is null").select("lang", F.col("n").alias("total"))
        levels.append(level.where("phrase is not null"))
        levels[k].facts = level.facts
        if k < longest:
            held = docs.sparkSession.sparkContext.broadcast(_filter(levels[k], k, scratch, filter_bytes))
    found = None
    for k in range(longest, 1, -1):
        own = scratch.save(_scored(k, levels))
        used.append(own)
        kept = own
        for longer in range(k + 1, longest + 1):
            parts = levels[longer].select("lang", F.col("n").alias("more"), F.explode(F.array(*(_words(i, k) for i in range(longer - k + 1)))).alias("phrase"))
            kept = kept.join(parts.groupBy("lang", "phrase").agg(F.max("more").alias("more")), ["lang", "phrase"], "left")
            kept = kept.where(F.col("more").isNull() | (100 * F.col("more") < inside * F.col("a"))).drop("more")
        found = kept if found is None else found.unionByName(kept)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each part first: with so many parts neither a part nor their best together are more than sqrt(first * candidates) rows
    parts = F.pmod(F.xxhash64("phrase"), F.lit(max(1, math.isqrt(sum(x.facts["n"] for x in levels[2:]) // first))))
    found = found.withColumn("part", parts).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= first)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    out = scratch.save(ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score"))
    scratch.drop(*used)
    return out
