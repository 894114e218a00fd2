"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of the benchmark's words over all documents give their idf.
2. The benchmark's items are cut into passages of PASSAGE words; a randomised SVD of
   their TF-IDF matrix (range finder with power rounds, each a distributed product
   over the passages, then the small factor) gives a latent space of RANK dimensions
   for words, the leading singular directions.
3. One pass over the documents: each window of two passages' length, moved by one
   passage, is folded into the latent space and compared with all passages by cosine,
   in blocks of matrix products. A window near a passage is a candidate, and so is one
   that reaches far enough in the passage's direction, whatever else it holds.
   Each run of RUN words that document and item share gives a candidate too, so that
   no copy depends on the projection.
4. A candidate is confirmed in the same task: the longest common subsequence of the
   item's words and the words around the window must cover COVER of the item, and the
   item's answer (its last ANSWER_SHARE) must be covered as well. Paraphrases with
   changed, dropped or inserted words keep most of the sequence; chance matches don't.

What is broadcast and what the driver holds grows with the benchmark (the stated query
set), not with the documents, and is bounded: a benchmark of more than PART_WORDS distinct
words or PART_PASSAGES passages is searched in parts, each with a space of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, small_batches
from .words import blocks, ngram_hashes, word_hashes, word_spans

PASSAGE = 16  #: words
RANK, OVERSAMPLE, POWER = 192, 16, 2
COSINE = 0.75
#: The part of a passage's latent length that a window must reach in its direction.
MASS = 0.4
#: The part of it that makes a window a candidate without regard to the window's other words.
SHARE = 0.7
RUN = 5  #: words that a document and an item share, as a candidate; no item has fewer
#: Words in more than this share of all documents are stop words: weight 0, but for the
#: rarest quarter of each item's words. They count in step 4.
MAX_DF = 0.1
COVER, ANSWER_SHARE, ANSWER_COVER = 0.6, 0.25, 0.5
#: A part of the benchmark: at RANK 192, its words' and passages' vectors take some 40 MB each.
PART_WORDS, PART_PASSAGES = 50_000, 50_000
CELLS = 4 << 20  #: numbers in the result of one matrix product: windows times passages


def _words(text: pa.Array) -> list[np.ndarray]:
    out = []
    for _, _, data, off in blocks(text):
        starts, ends, first = word_spans(data, off)
        words = word_hashes(data, starts, ends)
        out += [words[a:b] for a, b in zip(first[:-1], first[1:])]
    return out


def _document_frequency(vocabulary):
    """Sums over a task of: for each benchmark word, the documents that hold it; and all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        df, n = np.zeros(len(known), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for i, j, data, off in blocks(batch.column("text")):
                starts, ends, first = word_spans(data, off)
                at = _lookup(known, word_hashes(data, starts, ends))
                doc = np.repeat(np.arange(j - i), np.diff(first))
                key = np.unique((doc * len(known) + at)[at >= 0])
                df += np.bincount(key % len(known), minlength=len(known))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[n, df[at]])], names=["word", "df"])

    return run


def _lookup(known: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Index of each word among the sorted known ones, or -1."""
    at = np.searchsorted(known, words)
    at[at == len(known)] = 0
    return np.where(known[at] == words, at, -1)


def passages(words: np.ndarray) -> list[np.ndarray]:
    """Runs of PASSAGE words; the last one ends with the text."""
    if len(words) <= PASSAGE:
        return [words]
    starts = [*range(0, len(words) - PASSAGE, PASSAGE), len(words) - PASSAGE]
    return [words[s : s + PASSAGE] for s in starts]


def runs(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the items' runs of RUN words, and the item that holds each."""
    grams = [np.unique(ngram_hashes(w, RUN)) for w in items]
    held, holder = np.concatenate(grams), np.repeat(np.arange(len(items)), [len(g) for g in grams])
    order = np.argsort(held, kind="stable")
    return held[order], holder[order]


def _shared_runs(words: np.ndarray, first: np.ndarray, grams: np.ndarray, holders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, item) of each run of RUN words in one document that an item holds."""
    own = ngram_hashes(words, RUN)
    doc_end = np.repeat(first[1:], np.diff(first))[: len(own)]
    lo = np.searchsorted(grams, own)
    at = np.flatnonzero((grams[np.minimum(lo, len(grams) - 1)] == own) & (np.arange(len(own)) + RUN <= doc_end))
    n = np.searchsorted(grams, own[at], "right") - lo[at]
    return np.repeat(at, n), holders[np.repeat(lo[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _product(space):
    """Partial sums of A'(A X) over the benchmark's passages: one row for each word that a task has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, idf, x = space.value
        met, total = np.zeros(len(known), np.int64) - 1, np.zeros((0, x.shape[1]))
        for batch in batches:
            for item in batch.column("words"):
                words = _lookup(known, np.frombuffer(item.as_py(), np.uint64))
                fresh = np.setdiff1d(words, np.flatnonzero(met >= 0))
                met[fresh] = np.arange(len(total), len(total) + len(fresh))
                total = np.concatenate([total, np.zeros((len(fresh), x.shape[1]))])
                for at in passages(words):
                    weight = idf[at]
                    np.add.at(total, met[at], weight[:, None] * (weight @ x[at])[None, :])
        at = np.flatnonzero(met >= 0)
        for k in range(0, len(at), 1000):
            some = at[k : k + 1000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([total[m].tobytes() for m in met[some]], pa.binary())], names=["word", "row"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each word: the sum of its rows, which come together."""
    now, held = None, None
    for batch in batches:
        for word, row in zip(batch.column("word").to_pylist(), batch.column("row").to_pylist()):
            if word == now:
                held = held + np.frombuffer(row)
                continue
            if now is not None:
                yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([held.tobytes()], pa.binary())], names=["word", "row"])
            now, held = word, np.frombuffer(row)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([held.tobytes()], pa.binary())], names=["word", "row"])


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    masks: dict[int, int] = {}
    for k, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = masks.get(w)
        if m is not None:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def covered(item: list[int], around: list[int], cover: float) -> float:
    """The share of the item in the region, where item and answer are covered enough; else 0."""
    got = lcs(item, around) / len(item)
    answer = item[-max(1, round(len(item) * ANSWER_SHARE)) :]
    return got if got >= cover and lcs(answer, around) >= ANSWER_COVER * len(answer) else 0.0


def _folded(weighted: np.ndarray, at: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Sum of the word vectors of each cell: the words that have one, slot by slot."""
    out = np.zeros((len(cell), weighted.shape[1]), np.float32)
    place = np.flatnonzero(at >= 0)
    row = np.searchsorted(cell, place, "right") - 1
    slot = np.arange(len(place)) - np.searchsorted(row, row)
    for k in range(int(slot.max(initial=-1)) + 1):
        some = slot == k
        out[row[some]] += weighted[at[place[some]]]
    return out


def _search(model, cover: float):
    """What is found: the input's columns but for the text, then item_id and coverage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        known, idf, latent, queries, owner, items, ids = (m[k] for k in ("known", "idf", "latent", "queries", "owner", "items", "ids"))
        grams, holders = m["grams"], m["holders"]
        weighted = (idf[:, None] * latent).astype(np.float32)
        mass = m["mass"]
        least = MASS * mass[mass > 0].min(initial=np.inf)
        heavy = np.r_[idf > 0, False]
        inside = [set(x) for x in items]
        windows = max(1, CELLS // queries.shape[1])
        for batch in batches:
            docs, who, share = [], [], []
            for i, j, data, off in blocks(batch.column("text"), 1 << 20):
                starts, ends, first = word_spans(data, off)
                words = word_hashes(data, starts, ends)
                if not len(words):
                    continue
                at = _lookup(known, words)
                at[~heavy[at]] = -1
                # cells of PASSAGE words that never cross a document's end
                cells = [np.arange(a, b, PASSAGE) for a, b in zip(first[:-1], first[1:])]
                cell_doc = np.repeat(np.arange(j - i), [len(c) for c in cells])
                cell = np.concatenate(cells)
                folded = _folded(weighted, at, cell)
                same = np.r_[cell_doc[1:] == cell_doc[:-1], False]
                folded[:-1] += folded[1:] * same[:-1, None]
                length = np.linalg.norm(folded, axis=1)
                worth = np.flatnonzero(length >= least)
                hits: dict[tuple[int, int], list[int]] = {}
                for s in range(0, len(worth), windows):
                    some = worth[s : s + windows]
                    dots = folded[some] @ queries
                    w, q = np.nonzero((dots >= np.minimum(SHARE * mass, np.maximum(COSINE * length[some][:, None], MASS * mass))) & (mass > 0))
                    for x, y in zip(some[w].tolist(), owner[q].tolist()):
                        hits.setdefault((int(cell_doc[x]), y), []).append(int(cell[x]))
                place, held = _shared_runs(words, first, grams, holders)
                if len(place):
                    x = np.searchsorted(cell, place, "right") - 1
                    x, held = np.unique(np.stack([x, held]), axis=1)
                    for d, y, p in zip(cell_doc[x].tolist(), held.tolist(), cell[x].tolist()):
                        hits.setdefault((d, y), []).append(p)
                best: dict[tuple[int, int], float] = {}
                for (d, y), places in hits.items():
                    item = items[y]
                    n, end = len(item), int(first[d + 1])
                    reach = n + n // 2
                    done = -1
                    for p in sorted(set(places)):
                        if p <= done:
                            continue
                        lo, hi = max(int(first[d]), p - reach), min(end, p + 2 * PASSAGE + reach)
                        region = words[lo:hi].tolist()
                        if sum(x in inside[y] for x in region) >= cover * n:
                            last = max(lo, hi - reach)
                            for a in (*range(lo, last, max(1, n // 4)), last):
                                got = covered(item, words[a : min(hi, a + reach)].tolist(), cover)
                                if got > best.get((d, y), 0.0):
                                    best[d, y] = got
                        done = p + PASSAGE // 2
                for (d, y), got in best.items():
                    docs.append(i + d), who.append(ids[y]), share.append(got)
            at = pa.array(docs, pa.int64())
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in kept), pa.array(who, pa.int64()), pa.array(share, pa.float64())], names=[*kept, "item_id", "coverage"])

    return run


def _parts(benchmark: DataFrame) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(item_ids, their words) of bounded parts of the benchmark's items of at least RUN words."""
    ids, items, words, places = [], [], set(), 0
    for r in benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        for own in _words(pa.array([r.text])):
            if len(own) < RUN:
                continue
            if items and (len(words.union(own.tolist())) > PART_WORDS or places + len(passages(own)) > PART_PASSAGES):
                yield ids, items
                ids, items, words, places = [], [], set(), 0
            ids.append(r.item_id), items.append(own), words.update(own.tolist())
            places += len(passages(own))
    if items:
        yield ids, items


def singular_space(table: DataFrame, known: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The leading singular values of the matrix A of ``table(words)``'s passages by ``known`` words, greatest first, and their right singular vectors.

    A random basis is turned towards the range of A' by power steps; B = A Q is then
    factored by its small Gram matrix B'B = Q'(A'A Q). At most RANK values come back,
    fewer where A has no more.
    """
    spark = table.sparkSession

    def product(x: np.ndarray) -> np.ndarray:
        space = spark.sparkContext.broadcast((known, idf, x))
        sums = table.mapInArrow(_product(space), "word long, row binary").repartition("word").sortWithinPartitions("word").mapInArrow(_added, "word long, row binary")
        total = np.zeros(x.shape)
        for word, row in sums.toLocalIterator():
            total[word] = np.frombuffer(bytes(row))
        space.destroy()
        return total

    rank = min(RANK + OVERSAMPLE, len(known))
    basis = np.linalg.qr(np.random.default_rng(11).standard_normal((len(known), rank)))[0]
    for _ in range(POWER + 1):
        basis = np.linalg.qr(product(basis))[0]
    gram = basis.T @ product(basis)
    squares, turn = np.linalg.eigh((gram + gram.T) / 2)
    leading = np.argsort(-squares)[:RANK]
    leading = leading[squares[leading] > 1e-12 * squares.max(initial=0.0)]
    return np.sqrt(squares[leading]), basis @ turn[:, leading]


def _model(docs: DataFrame, ids: list, items: list[np.ndarray]):
    """The broadcast search model of one part of the benchmark."""
    spark = docs.sparkSession
    known = np.unique(np.concatenate(items))
    vocabulary = spark.sparkContext.broadcast(known)
    df, n = np.zeros(len(known)), 0
    with small_batches(spark):
        for word, count in docs.select("text").mapInArrow(_document_frequency(vocabulary), "word long, df long").groupBy("word").agg(F.sum("df")).collect():
            if word < 0:
                n = count
            else:
                df[word] = count
    vocabulary.destroy()
    stop = df > MAX_DF * n
    for words in items:  # an item's rarest words count, however common they are
        own = np.unique(_lookup(known, words))
        stop[own[np.argsort(df[own], kind="stable")[: max(4, len(own) // 4)]]] = False
    idf = np.where(stop, 0.0, np.log((n + 1) / (df + 0.5)).clip(0.1))

    table = spark.createDataFrame([(w.tobytes(),) for w in items], "words binary").repartition(max(1, min(spark.sparkContext.defaultParallelism, len(items) // 100)))
    latent = singular_space(table, known, idf)[1]

    queries, owner, mass = [], [], []
    for k, words in enumerate(items):
        for p in passages(words):
            at = _lookup(known, p)
            v = (idf[at][:, None] * latent[at]).sum(0)
            mass.append(np.linalg.norm(v))
            queries.append((v / max(1e-9, mass[-1])).astype(np.float32))
            owner.append(k)
    grams, holders = runs(items)
    return spark.sparkContext.broadcast({
        "grams": grams, "holders": holders, "known": known, "idf": idf, "latent": latent.astype(np.float32), "queries": np.ascontiguousarray(np.array(queries).T),
        "mass": np.array(mass, np.float32), "owner": np.array(owner), "items": [w.tolist() for w in items], "ids": ids,
    })


def contaminated(docs: DataFrame, benchmark: DataFrame, cover: float = COVER, row: str | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)``, ``benchmark(item_id, text, ...)`` -> ``doc_id, item_id, coverage``: documents that hold an item or a paraphrase.

    coverage is the share of the item's words, in order, that the document holds in a
    stretch of one and a half times the item's length. ``row`` names a column of longs of
    ``docs`` that comes back as a further column ``row``.

    Edge cases: null and empty texts match nothing, on either side. Items under five
    words match nothing: chance alone repeats them. Repeated rows are searched each on
    their own and give a row each. Equal items each give a row. An empty benchmark or
    an empty table gives an empty result. Extra columns are ignored.
    """
    scratch, out = Scratch(docs.sparkSession, "leaks"), None
    rows = docs.select("doc_id", *([] if row is None else [F.col(row).alias("row")]), "text")
    names = ["doc_id", "item_id", "coverage", *([] if row is None else ["row"])]
    kind = f"doc_id long, {'' if row is None else 'row long, '}item_id long, coverage double"
    for ids, items in _parts(benchmark):
        model = _model(docs, ids, items)
        found = scratch.save(rows.mapInArrow(_search(model, cover), kind))
        model.destroy()
        out = found if out is None else out.unionByName(found)
    return (docs.sparkSession.createDataFrame([], kind) if out is None else out).select(names)
