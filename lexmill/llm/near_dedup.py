"""Near-duplicate detection with MinHash bands and Odd sketches.

Plan
1. One pass over the texts gives each row its shingle count, a 128-bit name of its
   word sequence, MinHash band keys and an Odd sketch: every MinHash value (position,
   value) flips one bit of a short bitmap. The population count of the XOR of two
   bitmaps estimates the size of the symmetric difference of the two samples, hence
   the similarity, most precisely where similarity is high.
2. Equal word sequences collapse to a class with one row as its node; thousands of
   copies cost one row afterwards.
3. Band buckets give candidates in stars, never all pairs: each node meets three hubs
   of its bucket, and sketches discard the hopeless pairs. Each node's best hub is
   confirmed on full shingle sets; then, of the pairs whose ends are still in different
   components, each node's best one for each component.
4. What no star has settled is compared block by block, in tasks of bounded bytes:
   components that sketches bring together meet on full sets, but for pairs inside the
   largest one of each cluster; nodes of one bucket whose clusters differ meet on
   sketches, and survivors are confirmed on full sets. Only links that join two
   components come out. So no link between two components inside any bucket is left
   untested.
5. Components come from alternating star rounds on the confirmed links: the first on
   nodes, the later ones on components only.

Chance to miss a link of similarity s: (1 - s**ROWS)**BANDS, under 1e-6 at 0.85 and
under 1e-4 at 0.8, plus the sketch filter's margin.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Union, stars
from .scratch import Scratch, numbered
from .words import blocks, mix, shingle_sets, word_hashes, word_spans

WORDS = 5  #: words of a shingle
BANDS, ROWS = 24, 5
SKETCH_BITS = 512
#: Sketch estimates below (threshold - MARGIN) are discarded: five standard errors at 0.85 (0.034), four and a half at 0.8 (0.038).
MARGIN = 0.17
#: Each bucket's hubs are the least of its nodes after a flip of bits: one order for all buckets, so that a group
#: of copies has one star, then two orders that differ from bucket to bucket.
FLIPS = (None, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)
#: Bytes of the rows that one task compares with each other at once, half of them of either side.
PART_BYTES = 32 << 20
#: What a row counts for at least, so that a part compares at most some thousand rows with as many.
ROW_BYTES = 4096
#: Up to this number of pairs, the ids of their nodes are broadcast (8 bytes each) to pick their texts; beyond it they are shuffled.
BROADCAST_IDS = 1_000_000

K = BANDS * ROWS
_rng = np.random.Generator(np.random.PCG64(17))
_XOR = _rng.integers(0, 1 << 32, K, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, K, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """K minimum values of each non-empty set, one row a set."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), K), np.uint32)
    for k in range(K):
        y = x ^ _XOR[k]
        y *= _MUL[k]
        out[:, k] = np.minimum.reduceat(y, starts)
    return out


def _band_keys(mins: np.ndarray) -> np.ndarray:
    m = mins.reshape(len(mins), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(mins), BANDS)).copy()
    for r in range(ROWS):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + m[:, :, r])
    return h.view(np.int64)


def odd_sketches(mins: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmaps of the (position, value) pairs, as 64-bit words."""
    n, k = mins.shape
    place = mix(mins.astype(np.uint64) + (np.arange(k, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    odd = np.bincount((place.astype(np.int64) + np.arange(n)[:, None] * bits).ravel(), minlength=n * bits) & 1
    return np.packbits(odd.astype(np.uint8).reshape(n, bits), axis=1).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in blocks(batch.column("text")):
            starts, ends, first = word_spans(data, off)
            words = word_hashes(data, starts, ends)
            sets = shingle_sets(words, first, WORDS)
            sizes = np.array([len(s) for s in sets], np.int64)
            names = [hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first[:-1], first[1:])]
            full = np.flatnonzero(sizes)
            bands, sketches = [None] * (j - i), [None] * (j - i)
            if len(full):
                mins = _minhashes([sets[x] for x in full])
                for x, b, s in zip(full, _band_keys(mins), odd_sketches(mins)):
                    bands[x], sketches[x] = b, s
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").slice(i, j - i), batch.column("doc_id").slice(i, j - i), pa.array(sizes), pa.array(names, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                names=["row", "doc_id", "n_shingles", "name", "bands", "sketch"],
            )


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in blocks(batch.column("text")):
            starts, ends, first = word_spans(data, off)
            sets = shingle_sets(word_hashes(data, starts, ends), first, WORDS)
            sketches = list(odd_sketches(_minhashes(sets)))
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(sketches, pa.list_(pa.int64()))], names=["node", "shingles", "sketch"])


def _similar(x: np.ndarray, y: np.ndarray, permille: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    if len(short) * 1000 < permille * len(long):
        return False
    at = np.searchsorted(long, short)
    at[at == len(long)] = 0
    both = int(np.count_nonzero(long[at] == short))
    return 1000 * both >= permille * (len(x) + len(y) - both)


def _linked(permille: int):
    """Keeps the pairs whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            keep = [k for k in range(batch.num_rows) if _similar(np.frombuffer(a[k].as_buffer(), np.uint64), np.frombuffer(b[k].as_buffer(), np.uint64), permille)]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("u", "v")], names=["u", "v"])

    return run


def _estimate(a: str, b: str):
    """Similarity estimated from two Odd sketches (saturated ones count as 0)."""
    words = SKETCH_BITS // 64
    odd = sum((F.bit_count(F.element_at(a, i + 1).bitwiseXOR(F.element_at(b, i + 1))) for i in range(words)), F.lit(0))
    return F.when(odd * 2 < SKETCH_BITS, 1 + F.log(1 - 2 * odd / F.lit(float(SKETCH_BITS))) * (SKETCH_BITS / 2) / (2 * K)).otherwise(0.0)


def _sets(docs: DataFrame, nodes: DataFrame, small: bool) -> DataFrame:
    """(node, shingles, sketch) of the rows in ``nodes(node)``, all with words."""
    ids = nodes.select(F.col("node").alias("row"))
    texts = docs.select("row", "text").join(F.broadcast(ids) if small else ids, "row", "left_semi")
    return texts.mapInArrow(_set_rows, "node long, shingles binary, sketch array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, scratch: Scratch, permille: int) -> DataFrame:
    """The pairs (u, v) that are links on full sets."""
    with_sets = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    return scratch.save(with_sets.select("u", "v", "a", "b").mapInArrow(_linked(permille), "u long, v long"))


def _labelled(df: DataFrame, parts: DataFrame, node: str, label: str) -> DataFrame:
    """``df`` with the component of its column ``node``; a node without one is its own."""
    return df.join(parts.select(F.col("node").alias(node), F.col("component").alias(label)), node, "left").withColumn(label, F.coalesce(label, node))


def _absorbed(parts: DataFrame, found: DataFrame) -> DataFrame:
    """``parts`` after ``found``, which has components of components."""
    deeper = _labelled(parts, found, "component", "top").select("node", F.col("top").alias("component"))
    return deeper.unionByName(found.join(parts.select("node"), "node", "left_anti"))


def _blocks(named: DataFrame, held: DataFrame) -> DataFrame:
    """The rows of ``named(group, node, label, size)`` with what ``held(node, sketch, shingles)`` has of them, dealt to tasks that compare them.

    The nodes of a group's largest label needn't meet each other. Its other nodes, in
    chunks, meet all its nodes, in blocks; a part is one chunk and one block, each of about
    half of PART_BYTES by the sum of sizes.
    """
    labels = named.groupBy("group", "label").agg(F.sum("size").alias("size"))
    groups = labels.groupBy("group").agg(F.max_by("label", F.struct("size", "label")).alias("usual"), F.sum("size").alias("all"), (F.sum("size") - F.max("size")).alias("rest"))
    counts = groups.where("rest > 0").select("group", "usual", *(F.ceil(F.col(c) * 2 / PART_BYTES).cast("int").alias(n) for c, n in (("rest", "n_chunks"), ("all", "n_blocks"))))
    dealt = named.join(counts, "group").join(held, "node")
    chunk, block = (F.pmod(F.xxhash64("node", F.lit(i)), n).cast("int") for i, n in ((1, F.col("n_chunks")), (2, F.col("n_blocks"))))
    every = [F.sequence(F.lit(0), F.col(n) - 1) for n in ("n_blocks", "n_chunks")]
    asks = F.when(F.col("label") != F.col("usual"), F.transform(every[0], lambda i: F.struct(chunk.alias("chunk"), i.alias("block"), F.lit(True).alias("probe"))))
    part = F.concat(F.coalesce(asks, F.array().cast("array<struct<chunk:int,block:int,probe:boolean>>")), F.transform(every[1], lambda i: F.struct(i.alias("chunk"), block.alias("block"), F.lit(False).alias("probe"))))
    parted = dealt.select("group", F.explode(part).alias("p"), "node", "label", "sketch", "shingles").select("group", "p.*", "node", "label", "sketch", "shingles")
    return parted.repartition("group", "chunk", "block").sortWithinPartitions("group", "chunk", "block")


def _part_links(permille: int, low: float, exact: bool):
    """Pairs (u, v) of different labels that pass the sketches, and with ``exact`` the full sets, of which only those that join two labels."""

    def links(rows: list[tuple]) -> list[tuple[int, int]]:
        probes, held = [r for r in rows if r[3]], [r for r in rows if not r[3]]
        if not probes or not held:
            return []
        joined = Union()
        sketches, labels = np.array([r[6] for r in held], np.int64), np.array([r[5] for r in held])
        out = []
        for p in probes:
            odd = np.bitwise_count((sketches ^ np.array(p[6], np.int64)).view(np.uint64)).sum(1, dtype=np.float64)
            near = np.where(odd * 2 < SKETCH_BITS, 1 + np.log(np.maximum(1e-9, 1 - 2 * odd / SKETCH_BITS)) * (SKETCH_BITS / 2) / (2 * K), 0.0)
            at = np.flatnonzero((near >= low) & (labels != p[5]))
            for k in at[np.argsort(-near[at], kind="stable")]:
                if not exact:
                    out.append((min(p[4], held[k][4]), max(p[4], held[k][4])))
                elif joined.root(p[5]) != joined.root(held[k][5]) and _similar(p[7], held[k][7], permille):
                    joined.join(p[5], held[k][5])
                    out.append((p[5], held[k][5]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def flush() -> pa.RecordBatch:
            found = links(rows)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], names=["u", "v"])

        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(7)]
            sets = batch.column(7)
            for i, r in enumerate(zip(*cols)):
                if r[:3] != key:
                    if rows:
                        yield flush()
                    key, rows = r[:3], []
                rows.append((*r, np.frombuffer(sets[i].as_py() or b"", np.uint64)))
        if rows:
            yield flush()

    return run


def _candidates(classes: DataFrame, scratch: Scratch, low: float) -> tuple[DataFrame, DataFrame]:
    """Members (key, node) of the shared buckets that hold pairs without a hub, and pairs (node, hub, near) that pass the sketches."""
    rows = classes.select(F.explode("bands").alias("key"), "node")
    flips = [F.lit(0).cast("long") if f is None else F.col("key").bitwiseXOR(F.lit(f)) for f in FLIPS]
    shared = rows.groupBy("key").agg(F.count("*").alias("held"), *(F.min(F.col("node").bitwiseXOR(f)).alias(f"least{i}") for i, f in enumerate(flips))).where("held > 1")
    hubs = F.array_distinct(F.array(*(F.col(f"least{i}").bitwiseXOR(f) for i, f in enumerate(flips))))
    members = scratch.save(rows.join(shared.select("key", "held", hubs.alias("hubs")), "key"))
    pairs = members.select("node", F.explode("hubs").alias("hub")).where("node <> hub").distinct()
    sketches = classes.select(F.col("node"), "sketch")
    pairs = pairs.join(sketches, "node").join(sketches.select(F.col("node").alias("hub"), F.col("sketch").alias("hub_sketch")), "hub")
    near = scratch.save(pairs.select("node", "hub", _estimate("sketch", "hub_sketch").alias("near")).where(F.col("near") >= low))
    return members, near


def near_duplicates(docs: DataFrame, similarity: float = 0.8, row: str | None = None) -> DataFrame:
    """``docs(doc_id long, text string, ...)`` -> ``doc_id, n_shingles, component_id, kept``, one row per input row.

    Documents are linked when the Jaccard similarity of their sets of distinct 5-word
    shingles is at least ``similarity`` (compared as integers in thousandths).
    component_id is the smallest doc_id reachable over links, kept tells whether it is
    the row's own. ``row`` names a column of unique longs that tell the rows of a saved
    table apart; with it two more columns follow, ``row`` and ``stays``: of each component
    exactly one row stays, the one with the smallest doc_id, then row. Without it the
    rows are numbered first.
    Other columns of ``docs`` are ignored, whatever their names.

    Edge cases: a null, empty or all-white text has n_shingles 0 and its own doc_id
    as component_id, is linked with nothing and stays. A text under five words is one
    shingle, its whole sequence. Rows with a null doc_id link like others; component_id
    is null, and kept false, only where all their component's doc_ids are null. Rows
    that repeat a doc_id are documents of their own, each with all its links.
    Equal similarity to the threshold links. An empty table gives an empty one.
    """
    spark, permille = docs.sparkSession, round(similarity * 1000)
    scratch = Scratch(spark, "near")
    low = similarity - MARGIN
    if row is None:
        docs = numbered(docs.select("doc_id", "text"), scratch)
    else:
        docs = docs.select("doc_id", "text", F.col(row).alias("row"))
    sig = scratch.save(docs.mapInArrow(_signatures, "row long, doc_id long, n_shingles long, name binary, bands array<long>, sketch array<long>"))

    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")  # nulls come last
    classes = sig.where("n_shingles > 0").groupBy("name").agg(F.min(first).alias("least"), F.min_by(F.struct("n_shingles", "bands", "sketch"), first).alias("kept"))
    classes = scratch.save(classes.select("name", F.col("least.row").alias("node"), "least", "kept.*"))
    members, near = _candidates(classes, scratch, low)
    ends = near.select("node").unionByName(near.select(F.col("hub").alias("node"))).distinct()
    sets = scratch.save(_sets(docs, ends, near.facts["n"] <= BROADCAST_IDS))
    used = [sig, classes, members, near, sets]

    def kept(table: DataFrame) -> DataFrame:
        used.append(table)
        return table

    def grown(edges: DataFrame) -> DataFrame:
        """``parts`` after more links, given from component to component."""
        found = kept(stars(edges, scratch))
        return kept(scratch.save(_absorbed(parts, found))) if found.facts["n"] else parts

    def between(links: DataFrame, u: str, v: str) -> DataFrame:
        """Pairs of nodes as pairs of their components, where these differ."""
        return _labelled(_labelled(links.select(F.col(u).alias("x"), F.col(v).alias("y")), parts, "x", "u"), parts, "y", "v").where("u <> v")

    best = F.max_by("hub", F.struct("near", -F.col("hub"))).alias("v")
    parts = kept(stars(kept(_confirmed(near.groupBy(F.col("node").alias("u")).agg(best), sets, scratch, permille)), scratch))
    apart = _labelled(_labelled(near, parts, "node", "x"), parts, "hub", "y").where("x <> y")
    parts = grown(between(kept(_confirmed(apart.groupBy(F.col("node").alias("u"), "y").agg(best).select("u", "v"), sets, scratch, permille)), "u", "v"))

    # clusters: components that sketches bring together
    before, clusters = parts, kept(stars(between(near, "node", "hub"), scratch))
    sizes = classes.select("node", F.greatest(F.col("n_shingles") * 8, F.lit(ROW_BYTES)).alias("size"))
    if clusters.facts["n"]:
        tops = clusters.unionByName(clusters.select(F.col("component").alias("node"), "component").distinct())
        named = _labelled(sets.select("node"), parts, "node", "label").join(tops.select(F.col("node").alias("label"), F.col("component").alias("group")), "label")
        named = kept(scratch.save(named.join(sizes, "node")))
        parts = grown(kept(scratch.save(_blocks(named, sets).mapInArrow(_part_links(permille, low, True), "u long, v long"))))

    # a bucket's pairs without a hub, where sketches have not brought its nodes together
    wide = members.where(F.col("held") >= F.size("hubs") + 2).select("node", F.col("key").alias("group"))
    wide = _labelled(_labelled(wide, before, "node", "of"), clusters, "of", "label").select("node", "group", "label")
    mixed = wide.groupBy("group").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a < b")
    named = kept(scratch.save(wide.join(mixed.select("group"), "group", "left_semi").withColumn("size", F.lit(ROW_BYTES).cast("long"))))
    if named.facts["n"]:
        rows = _blocks(named, classes.select("node", "sketch", F.lit(None).cast("binary").alias("shingles")))
        across = kept(scratch.save(rows.mapInArrow(_part_links(permille, low, False), "u long, v long").distinct()))
        if across.facts["n"]:
            ends = across.select(F.col("u").alias("node")).unionByName(across.select(F.col("v").alias("node"))).distinct()
            more = kept(scratch.save(_sets(docs, ends, across.facts["n"] <= BROADCAST_IDS)))
            parts = grown(between(kept(_confirmed(across, more, scratch, permille)), "u", "v"))

    named = _labelled(classes.select("name", "node", "least"), parts, "node", "label")
    tops = named.groupBy("label").agg(F.min("least").alias("top"))
    whole = kept(scratch.save(named.join(tops, "label").select("name", "top")))
    some = F.col("n_shingles") > 0
    out = sig.select("doc_id", "n_shingles", "row", "name").join(whole, "name", "left")
    out = out.select("doc_id", "n_shingles", F.when(some, F.col("top.doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "row", (~some | (F.col("top.row") == F.col("row"))).alias("stays"))
    out = out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"), "row", "stays")
    out = scratch.save(out)
    scratch.drop(*used)
    return out.drop("row", "stays") if row is None else out
