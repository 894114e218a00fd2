"""Connected components of an edge table by alternating large-star and small-star rounds.

First each task joins its own edges to stars around their smallest nodes, so that what
is left is a forest a task, whatever the number of edges. Forests of few edges are joined
in one task: rounds of many small jobs would cost the driver threads, plans and records of
tasks. Larger ones take rounds: each is joins on small rows, written to the shared folder;
nothing of the graph comes to the driver but the count and the sum of hashes of the round's
edges, taken while they are written. The rounds end when a round changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Edges that a task holds at most before it sends their forest on.
TASK_EDGES = 1_000_000
#: Forests of up to this number of edges, all tasks' together, are joined in one task (under TASK_EDGES); beyond it in rounds.
ONE_TASK_EDGES = 200_000


class Union:
    """Disjoint sets of integers; each has its smallest member as root."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        top = x
        while (up := self.above.get(top, top)) != top:
            top = up
        while (up := self.above.get(x, x)) != top:  # the path becomes short
            self.above[x] = top
            x = up
        return top

    def join(self, a: int, b: int) -> bool:
        """Whether the two were apart."""
        a, b = self.root(a), self.root(b)
        if a != b:
            self.above[max(a, b)] = min(a, b)
        return a != b


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets = Union()

    def held() -> pa.RecordBatch:
        rows = [(x, sets.root(x)) for x in list(sets.above)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], names=["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist()):
            sets.join(u, v)
        if len(sets.above) > TASK_EDGES:
            yield held()
            sets = Union()
    yield held()


def stars(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(u, v)`` -> saved ``(node, component)``: the smallest reachable node, for every node but those that are it.

    Loops and repeated edges are allowed; nulls are not. An empty table gives an empty one.
    """
    check = {"h": F.sum(F.xxhash64("node", "component").cast("decimal(38,0)"))}
    trees = scratch.save(edges.select("u", "v").mapInArrow(_forest, "u long, v long"))
    names = F.col("u").alias("node"), F.col("v").alias("component")
    if trees.facts["n"] <= ONE_TASK_EDGES:
        now = scratch.save(trees.coalesce(1).mapInArrow(_forest, "u long, v long").select(*names))
        scratch.drop(trees)
        return now
    now = scratch.save(trees.select(*names).distinct(), **check)
    scratch.drop(trees)
    while now.facts["n"]:
        down = now.select(F.col("node").alias("u"), F.col("component").alias("v"))
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.save(small.select(F.col("u").alias("node"), F.col("v").alias("component")), **check)
        scratch.drop(now)
        same, now = after.facts == now.facts, after
        if same:
            break
    return now


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """As ``stars``, with a row for every node that has an edge to another."""
    found = stars(edges, scratch)
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
