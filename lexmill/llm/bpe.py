"""Byte-level BPE encoding and decoding with overlapping chunks.

Short documents are encoded where they are read. Long ones are cut into chunks that
overlap; each chunk is pre-tokenised on its own, and neighbours are stitched at the
first boundary that both have in the overlap, where the two streams of pre-tokens
have resynchronised. The spans between stitches are encoded, in any task, and the
documents' ids are the spans' ids in order. Decoding concatenates the tokens' bytes.

A stitch never follows white space, so that a span pre-tokenises alone as it does
within its document (the pattern looks ahead only at white space).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

CHUNK, OVERLAP = 32_768, 1_024  #: characters


class Codec:
    """Encodes and decodes by a table of ranks, each match of the pattern separately."""

    def __init__(self, ranks_file: bytes, pattern: str):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks_file.splitlines() if x)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(pattern)
        tokens = sorted(ranks, key=ranks.get)
        size = max(ranks.values()) + 1
        self.lengths = np.zeros(size, np.int64)
        self.lengths[[ranks[t] for t in tokens]] = [len(t) for t in tokens]
        self.starts = np.zeros(size + 1, np.int64)
        np.cumsum(self.lengths, out=self.starts[1:])
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.bytes[np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()

    def boundaries(self, text: str, complete: bool) -> list[int]:
        """Ends of the pre-tokens; without the one that touches the end of a text that goes on."""
        ends = [m.end() for m in self.pieces.finditer(text)]
        return ends if complete else [e for e in ends if e < len(text)]


@lru_cache(2)
def codec(ranks_file: bytes, pattern: str) -> Codec:
    return Codec(ranks_file, pattern)


def chunks(text: str, size: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Pieces that start every ``size`` characters and reach ``overlap`` into the next."""
    return [text[k : k + size + overlap] for k in range(0, max(1, len(text)), size)]


def stitch(c: Codec, piece: str, size: int, overlap: int) -> int | None:
    """Where in ``piece`` the next chunk takes over: the first boundary that both have, not after white space."""
    following = {size + b for b in c.boundaries(piece[size:], False)}
    for b in c.boundaries(piece, False):
        if b in following and not piece[b - 1].isspace():
            return b
    return None


def _first_pass(file, pattern: str, size: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, row = codec(file.value, pattern), TaskContext.get().partitionId() << 36
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                row, text = row + 1, text or ""
                if len(text) <= size:
                    ids = c.encode(text)
                    out.append((row, doc, None, 1, None, None, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
                else:
                    parts = chunks(text, size, overlap)
                    for k, p in enumerate(parts):
                        cut = stitch(c, p, size, overlap) if k + 1 < len(parts) else len(p)
                        out.append((row, doc, k, len(parts), p, cut, None, None, None))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string()]
            for a in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out[a : a + 1000]), types)], names=["row", "doc_id", "chunk", "chunks", "piece", "cut", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _spans(file, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(file.value, pattern)
        for batch in batches:
            ids = [c.encode(p[a:b]).astype("<u4").tobytes() for p, a, b in zip(*(batch.column(k).to_pylist() for k in ("piece", "from_", "cut")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in ("row", "doc_id", "chunk")), pa.array(ids, pa.binary())], names=["row", "doc_id", "chunk", "ids"])

    return run


def _whole(file, pattern: str, size: int):
    """Documents without a stitch somewhere: their chunks, in order, make the text again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, now, parts = codec(file.value, pattern), None, []

        def flush() -> pa.RecordBatch:
            ids = c.encode("".join(parts)).astype("<u4").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([0], pa.int32()), pa.array([ids], pa.binary())], names=["row", "doc_id", "chunk", "ids"])

        for batch in batches:
            for row, doc, k, n, p in zip(*(batch.column(x).to_pylist() for x in ("row", "doc_id", "chunk", "chunks", "piece"))):
                if now and now[0] != row:
                    yield flush()
                    parts = []
                now = (row, doc)
                parts.append(p if k + 1 == n else p[:size])
        if now:
            yield flush()

    return run


def _digests(file, pattern: str):
    """Ids of each document's spans, in order, to one row; only digests are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, now, n, sha, back = codec(file.value, pattern), None, 0, None, None
        done: list[tuple] = []
        for batch in batches:
            for row, doc, ids in zip(*(batch.column(x).to_pylist() for x in ("row", "doc_id", "ids"))):
                if now is None or now[0] != row:
                    if now:
                        done.append((now[1], n, sha.hexdigest(), back.hexdigest()))
                    now, n, sha, back = (row, doc), 0, hashlib.sha256(), hashlib.sha256()
                n += len(ids) // 4
                sha.update(ids)
                back.update(c.decode(np.frombuffer(ids, "<u4")))
        if now:
            done.append((now[1], n, sha.hexdigest(), back.hexdigest()))
        cols = list(zip(*done)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, [pa.int64(), pa.int64(), pa.string(), pa.string()])], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``docs(doc_id long, text string, ...)`` -> ``doc_id, n_tokens, ids_sha256, decoded_sha256``, one row per input row.

    The ids are those of the ranks in ``ranks_path`` (read on the driver and broadcast,
    under 1 MB), each match of ``pattern`` separately, no special tokens.

    Edge cases: a null text counts as empty: 0 tokens and the digests of nothing. Null
    and repeated doc_ids are kept as they are, one row each. A document with an
    overlap in which no stitch is found is encoded in one task. Other columns are
    ignored, whatever their names. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "bpe")
    with open(ranks_path, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())
    names = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    first = scratch.save(docs.select("doc_id", "text").mapInArrow(_first_pass(file, pattern, size, overlap), f"row long, doc_id long, chunk int, chunks int, piece string, cut int, {names[13:]}"))
    short, long = first.where("chunk is null").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"), first.where("chunk is not null")
    loose = long.where("cut is null").select("row").distinct()
    tight = long.join(loose, "row", "left_anti")
    before = tight.where("chunk + 1 < chunks").select("row", (F.col("chunk") + 1).alias("chunk"), (F.col("cut") - size).alias("from_"))
    spans = tight.join(before, ["row", "chunk"], "left").withColumn("from_", F.coalesce("from_", F.lit(0)))
    kind = "row long, doc_id long, chunk int, ids binary"
    encoded = spans.select("row", "doc_id", "chunk", "piece", "from_", "cut").mapInArrow(_spans(file, pattern), kind)
    whole = long.join(loose, "row").repartition("row").sortWithinPartitions("row", "chunk").select("row", "doc_id", "chunk", "chunks", "piece").mapInArrow(_whole(file, pattern, size), kind)
    joined = encoded.unionByName(whole).repartition("row").sortWithinPartitions("row", "chunk").mapInArrow(_digests(file, pattern), names)
    return scratch.save(short.unionByName(joined))
