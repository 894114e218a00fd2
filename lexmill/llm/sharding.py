"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a row's hash. It starts from byte
counts of all rows for each prefix; a bucket over the byte limit splits on its next
bit, and only that one, until each bucket fits. Counts are summed map-side by prefix,
so neither rows nor hashes meet in one place; the directory's size is bounded by the
number of shards, not of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch, numbered

LIMIT_BYTES = 64 << 20  #: bytes of a shard's texts
#: Bits that the directory looks deeper at once than full buckets would need.
SPARE_BITS = 3
#: Directory entries up to this number are broadcast (under 32 bytes each); beyond it they are shuffled.
BROADCAST_ENTRIES = 1_000_000


def _prefix(bits) -> object:
    """The leading ``bits`` bits of the hash, as a number."""
    return F.expr(f"case when {bits} = 0 then 0L else shiftrightunsigned(hash, 64 - {bits}) end")


def shards(docs: DataFrame, limit: int = LIMIT_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``doc_id, n_bytes, shard, depth, page``, one row per input row; ``carry`` names further columns that stay.

    shard is the bucket's hash prefix in binary (empty: one bucket holds all), depth
    its length. The texts of a (shard, page) have at most ``limit`` bytes, except where
    one row alone has more: that row has a shard of its own. The hash is of doc_id and text.

    Edge cases: a null text has 0 bytes; null doc_ids are hashed like others. Rows equal in
    doc_id and text can't be told apart by any bit: when their bucket is too large at
    full depth, it goes on in pages, numbered from 0, as overflow buckets do (the rows
    of other buckets have page 0). Extra columns are ignored. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    rows = scratch.save(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.xxhash64("doc_id", "text").alias("hash"), *carry))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = 0
    bits = min(62, max(1, math.ceil(math.log2(max(1, total / limit))) + SPARE_BITS))
    buckets, full, used = None, None, [rows]
    while True:
        inside = rows.withColumn("top", _prefix(depth))
        if full is not None:
            inside = inside.join(full.select("top"), "top", "left_semi")
        cells = inside.groupBy(_prefix(bits).alias("cell")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"), F.min("hash").alias("h0"), F.max("hash").alias("h1"))
        # every cell with its ancestors; the shallowest that fits is its bucket
        up = cells.select("cell", "bytes", "n", "h0", "h1", F.explode(F.sequence(F.lit(depth), F.lit(bits))).alias("d")).withColumn("up", F.expr(f"shiftrightunsigned(cell, {bits} - d)"))
        sums = up.groupBy("d", "up").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"), F.min("h0").alias("h0"), F.max("h1").alias("h1"))
        fits = sums.where((F.col("bytes") <= limit) | (F.col("n") == 1) | (F.col("h0") == F.col("h1"))).select("d", "up", (F.col("bytes") > limit).alias("over"), "n")
        found = up.select("cell", "d", "up").join(fits, ["d", "up"]).groupBy("cell").agg(F.min(F.struct("d", "over", "n")).alias("b"))
        table = scratch.save(cells.select("cell").join(found, "cell", "left").select(F.lit(bits).alias("bits"), "cell", F.col("b.d").alias("d"), F.coalesce(F.col("b.over") & (F.col("b.n") > 1), F.lit(False)).alias("over")))
        used.append(table)
        settled = table.where("d is not null")
        buckets = settled if buckets is None else buckets.unionByName(settled)
        full = table.where("d is null").select(F.col("cell").alias("top"))
        if not full.limit(1).count():
            break
        depth, bits = bits, min(64, bits + 8)
    out, steps = None, sorted(r[0] for r in buckets.select("bits").distinct().collect())
    small = buckets.count() <= BROADCAST_ENTRIES
    for b in steps:
        entries = buckets.where(F.col("bits") == b).select("cell", "d", "over")
        hit = rows.withColumn("cell", _prefix(b)).join(F.broadcast(entries) if small else entries, "cell").drop("cell")
        out = hit if out is None else out.unionByName(hit)
    if out is None:
        out = rows.withColumn("d", F.lit(0)).withColumn("over", F.lit(False))
    shard = F.expr("substr(lpad(bin(hash), 64, '0'), 1, d)")
    plain = out.where("not over").withColumn("page", F.lit(0))
    paged = _paged(out.where("over"), limit, scratch, carry)
    out = scratch.save(plain.unionByName(paged).select("doc_id", "n_bytes", shard.alias("shard"), F.col("d").alias("depth"), "page", *carry))
    scratch.drop(*used)
    return out


def _paged(rows: DataFrame, limit: int, scratch: Scratch, carry: tuple[str, ...] = ()) -> DataFrame:
    """Equal rows of buckets that no bit splits, dealt to pages of at most ``limit`` bytes.

    The rows are numbered without meeting in one task: each partition counts its rows of
    each hash, and numbers them behind those of the partitions before it.
    """
    rows = scratch.save(rows.withColumn("part", F.spark_partition_id()).withColumn("n", F.monotonically_increasing_id()))
    if not rows.facts["n"]:
        return rows.withColumn("page", F.lit(0)).drop("part", "n")
    firsts = rows.groupBy("hash", "part").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("hash").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = firsts.select("hash", "part", before.alias("before"))
    fit = F.greatest(F.lit(1), F.floor(limit / F.greatest("n_bytes", F.lit(1))))
    dense = rows.join(F.broadcast(firsts) if firsts.count() <= BROADCAST_ENTRIES else firsts, ["hash", "part"])
    own = F.row_number().over(Window.partitionBy("hash", "part").orderBy("n")) - 1
    return dense.select("doc_id", "n_bytes", "hash", *carry, "d", "over", F.floor((F.col("before") + own) / fit).cast("int").alias("page"))


ROW = "lexmill row"  #: names a row while its shard is looked for


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT_BYTES) -> None:
    """All rows and columns of ``docs`` as Parquet in ``path``, one folder for each shard and page.

    Rows meet their shard by their number, so null and repeated doc_ids are written as often
    as they occur. Columns named ``shard`` or ``page`` in ``docs`` are refused, for the folders have these names.
    """
    if taken := {"shard", "page", ROW} & set(docs.columns):
        raise ValueError(f"docs has columns {sorted(taken)}")
    scratch = Scratch(docs.sparkSession, "shards-written")
    rows = numbered(docs, scratch, ROW)
    assigned = shards(rows, limit, (f"`{ROW}`",)).select(f"`{ROW}`", "shard", "page")
    # names begin with a letter: the empty one, and those of digits alone, stay text when they are read back
    rows.join(assigned, ROW).drop(ROW).withColumn("shard", F.concat(F.lit("b"), "shard")).repartition("shard", "page").write.partitionBy("shard", "page").parquet(path)
    scratch.close()
