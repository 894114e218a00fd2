"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of whole texts come from one vectorised pass. Small trees are grown on a
bounded sample of labelled rows; every path from a root becomes a conjunctive rule;
a logistic regression with an L1 penalty keeps few of them; the rules that stay are
compiled into Column expressions, so scoring is plain Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch
from .words import blocks, word_hashes, word_spans

#: Labelled rows that the fit uses at most, those with the smallest hash of doc_id.
FIT_ROWS = 20_000
TREES, DEPTH, CUTS, PENALTY, STEPS = 40, 3, 16, 0.002, 300

#: Byte classes of the statistics: fixed values.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "stop": b".,;:?",
    "bang": b"!",
    "symbol": b"#$%&*|<>=+@^~_\\/{}[]",
    "line": b"\n",
}
#: In front of the statistics' column names, so that no other column's name clashes with them.
MARK = "quality statistic: "
STATISTICS = ["n_bytes", "n_words", "word_length", "distinct_words", "top_word", "line_words", "repeated_lines", *_CLASSES]


def _masks() -> dict[str, np.ndarray]:
    masks = {}
    for name, chars in _CLASSES.items():
        masks[name] = np.zeros(256, np.uint8)
        masks[name][list(chars)] = 1
    return masks


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut to blocks of bounded bytes, with the statistics of their column ``text`` instead of it."""
    masks = _masks()
    for batch in batches:
        for i, j, data, off in blocks(batch.column("text")):
            n = np.diff(off)
            starts, ends, first = word_spans(data, off)
            words, count = word_hashes(data, starts, ends), np.diff(first)
            some = np.maximum(count, 1)

            def summed(values: np.ndarray, at: np.ndarray) -> np.ndarray:
                total = np.zeros(len(values) + 1, np.int64)
                np.cumsum(values, out=total[1:])
                return total[at[1:]] - total[at[:-1]]

            stat = {"n_bytes": np.log1p(n), "n_words": np.log1p(count), "word_length": summed(ends - starts, first) / some}
            distinct, top, again = np.zeros(len(n)), np.zeros(len(n)), np.zeros(len(n))
            breaks = np.flatnonzero(data == 0x0A)
            line_of = np.searchsorted(breaks, starts)
            for k in range(len(n)):
                if count[k]:
                    w = words[first[k] : first[k + 1]]
                    _, c = np.unique(w, return_counts=True)
                    distinct[k], top[k] = len(c) / np.sqrt(count[k]), c.max() / count[k]
                    lines = line_of[first[k] : first[k + 1]]
                    heads = np.flatnonzero(np.r_[True, lines[1:] != lines[:-1]])
                    keys = np.add.reduceat(w * np.uint64(0x9E3779B97F4A7C15), heads)
                    again[k] = 1 - len(np.unique(keys)) / len(keys)
            stat |= {"distinct_words": distinct, "top_word": top, "repeated_lines": again}
            for name, m in masks.items():
                stat[name] = summed(m[data], off) / np.maximum(n, 1)
            stat["line_words"] = np.log1p(count / (1 + summed(masks["line"][data], off)))
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in kept), *(pa.array(stat[s].astype(np.float64)) for s in STATISTICS)], names=[*kept, *(f"{MARK}{s}" for s in STATISTICS)])


@dataclass(frozen=True)
class Rules:
    """bias + sum of weights of the rules that hold; a rule is [(statistic, above, cut), ...]."""

    bias: float
    rules: list[tuple[list[tuple[str, bool, float]], float]]

    def score(self) -> Column:
        total = F.lit(self.bias)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for name, above, cut in conditions:
                holds = holds & ((F.col(MARK + name) > cut) if above else (F.col(MARK + name) <= cut))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _paths(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Every path of one tree grown on a bootstrap of rows and a subset of statistics."""
    rows = rng.integers(0, len(y), min(len(y), 4000))
    cols = rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
    out: list[tuple] = []

    def grow(at: np.ndarray, path: tuple) -> None:
        if path:
            out.append(path)
        p = y[at].mean() if len(at) else 0
        if len(path) == DEPTH or len(at) < 20 or p in (0, 1):
            return
        best = None
        for c in cols:
            v = x[at, c]
            for cut in np.unique(np.quantile(v, np.linspace(0.02, 0.98, CUTS), method="lower")):
                low = v <= cut
                n = low.sum()
                if 5 <= n <= len(at) - 5:
                    a, b = y[at[low]].mean(), y[at[~low]].mean()
                    gini = n * a * (1 - a) + (len(at) - n) * b * (1 - b)
                    if best is None or gini < best[0]:
                        best = (gini, c, float(cut), low)
        if best and best[0] < len(at) * p * (1 - p) * 0.999:
            _, c, cut, low = best
            grow(at[low], (*path, (int(c), False, cut)))
            grow(at[~low], (*path, (int(c), True, cut)))

    grow(rows, ())
    return out


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Rules:
    """Rules from trees, weighted by L1-penalised logistic regression (accelerated proximal gradient)."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1)
        return Rules(float(np.log(share / (1 - share))), [])
    rng = np.random.default_rng(seed)
    rules = list(dict.fromkeys(p for _ in range(TREES) for p in _paths(x, y, rng)))

    def holds(path: tuple) -> np.ndarray:
        out = np.ones(len(y), bool)
        for c, above, cut in path:
            out &= (x[:, c] > cut) if above else (x[:, c] <= cut)
        return out

    a = np.stack([holds(p) for p in rules], 1).astype(np.float32)
    centre = a.mean(0)
    a -= centre
    step = 4.0 / (np.linalg.norm(a.T @ a / len(y), 2) + 1)
    w = z = np.zeros(len(rules), np.float32)
    bias = zb = float(np.log(y.mean() / (1 - y.mean())))
    t = 1.0
    for _ in range(STEPS):
        g = 1 / (1 + np.exp(-(a @ z + zb))) - y
        v = z - step * (a.T @ g.astype(np.float32)) / len(y)
        new, new_bias = np.sign(v) * np.maximum(np.abs(v) - step * PENALTY, 0), zb - step * float(g.mean())
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, zb = new + (t - 1) / after * (new - w), new_bias + (t - 1) / after * (new_bias - bias)
        w, bias, t = new, new_bias, after
    kept = [(sorted({(STATISTICS[c], above, cut) for c, above, cut in p}), float(v)) for p, v in zip(rules, w) if abs(v) > 1e-4]
    return Rules(float(bias - float(w @ centre)), kept)


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with the statistics of its column ``text`` in that one's place, in one pass."""
    kept = [f for f in docs.schema.fields if f.name != "text"]
    return docs.mapInArrow(_statistics, T.StructType([*kept, *(T.StructField(f"{MARK}{s}", T.DoubleType()) for s in STATISTICS)]))


def _fold() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))


def fitted(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Rules:
    """Rules learnt from the labelled rows outside of the held-out fold: from at most FIT_ROWS, those with the smallest hash of doc_id.

    Where there are more, a threshold on the hash leaves about a fifth more than are
    needed before any rows are sorted, so that tasks send no more than these to the driver.
    """
    known = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("quality")).where(_fold() != 0)
    rows = docs.select("doc_id", "text").join(known, "doc_id")
    n, rank = rows.count(), F.xxhash64("doc_id")
    if n > FIT_ROWS:
        share = 1.2 * FIT_ROWS / n
        near = rows.where(rank.cast("double") < -(2.0**63) + share * 2.0**64)
        rows = near if share < 1 and near.count() >= FIT_ROWS else rows
    stats = [f"{MARK}{s}" for s in STATISTICS]
    sample = scratch.save(statistics(rows).select("doc_id", "quality", *stats))
    sample = sample.orderBy(rank, "doc_id", *(F.col(f"`{s}`") for s in stats), "quality").limit(FIT_ROWS).toPandas()
    return fit(sample[stats].to_numpy(np.float64), sample["quality"].to_numpy(np.float64))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, row: str | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)``, ``labels(doc_id, quality, ...)`` -> ``doc_id, held_out, score, predicted``, one row per input row.

    Only labels with crc32(doc_id as text) mod 5 <> 0 are learned from, at most FIT_ROWS
    of them. score estimates the chance of label 1; predicted is 1 where it is at least
    ``threshold``. Inputs of the score are statistics of the text alone. ``row`` names a
    column of ``docs`` that comes back as a further column ``row``.

    Edge cases: null and empty texts have statistics 0 and are scored like any other.
    A null doc_id gives held_out null. Null labels are not learned from; a doc_id with
    several labels, or a repeated one, gives several learning rows. Without both labels
    the score is their smoothed share. Other columns are ignored. An empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    model = fitted(docs, labels, scratch)
    more = [] if row is None else [F.col(row).alias("row")]
    out = statistics(docs.select("doc_id", "text", *more)).select("doc_id", (_fold() == 0).alias("held_out"), model.score().alias("score"), *(["row"] if more else []))
    predicted = F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")
    return scratch.save(out.select("doc_id", "held_out", "score", predicted, *(["row"] if more else [])))
