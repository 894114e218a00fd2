"""Stratified samples of a stream: each stratum's least ranks are held as state.

Ranks are hashes of the ids, so the sample of all rows so far is made of each stratum's
least ranks, in whatever order and batches the rows come. A stratum's state is its number of
rows and its ``target_size`` least ranks with their records: no quota is larger. Quotas are
shared out when the sample is read, from the populations held.

Before the state each task keeps its own least ranks of every stratum, so that a stratum of
a third of all rows sends few of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import hash_rank
from ..operators.records import FIELDS, RECORD_SCHEMA, ProcessingError, matches_filters
from ..operators.sampling import SamplePlan, allocate, stratum_key

_ROW = "stratum string, n bigint, rank_hex string, record_id string, body string"
_HELD = "population bigint, ranks array<string>, ids array<string>, bodies array<string>"
_ORDER = ["rank_hex", "record_id"]


def _least(k: int):
    """Each stratum's rows of a task's batches, cut to its ``k`` least ranks; ``n`` of the first one counts them all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, rows in batch.groupby("stratum", sort=False):
                kept = rows.sort_values(_ORDER, kind="stable").head(k)
                yield kept.assign(n=[int(rows["n"].sum()), *[0] * (len(kept) - 1)])

    return run


def _merged(k: int):
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        population, *held = state.get if state.exists else (0, [], [], [])
        now = pd.DataFrame({c: list(x) for c, x in zip([*_ORDER, "body"], held)}, dtype=object)
        for batch in batches:
            population += int(batch["n"].sum())
            now = pd.concat([now, batch[[*_ORDER, "body"]]]).sort_values(_ORDER, kind="stable").head(k)
        lists = [now[c].tolist() for c in [*_ORDER, "body"]]
        state.update((population, *lists))
        yield pd.DataFrame({"stratum": [key[0]], "population": [population], "ranks": lists[:1], "ids": lists[1:2], "bodies": lists[2:]})

    return run


def sample_stream(records: DataFrame, plan: SamplePlan, out: str, checkpoint: str) -> StreamingQuery:
    """Holds the samples of a stream of records up to date under ``out``, all rows that are there now; ``held_sample`` reads them."""
    simple = not plan.strata_keys or plan.allocation_method == "simple_random"
    rows = records.where(matches_filters(plan.filters)).select(
        (F.lit("[]") if simple else stratum_key(plan.strata_keys)).alias("stratum"), F.lit(1).cast("long").alias("n"), hash_rank(F.col("record_id"), plan.seed, plan.algorithm_version).alias("rank_hex"), "record_id",
        F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}).alias("body"),
    )
    few = rows.mapInPandas(_least(plan.target_size), _ROW)
    held = few.groupBy("stratum").applyInPandasWithState(_merged(plan.target_size), "stratum string, " + _HELD, _HELD, "update", GroupStateTimeout.NoTimeout)

    def write(batch: DataFrame, number: int) -> None:  # a batch that is repeated overwrites itself
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return held.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def held_sample(spark: SparkSession, plan: SamplePlan, out: str) -> DataFrame:
    """The records sampled from all rows so far, with ``stratum`` and ``rank_hex``, in order of their ranks."""
    newest = Window.partitionBy("stratum").orderBy(F.desc("batch"))
    strata = spark.read.parquet(out).withColumn("k", F.row_number().over(newest)).where("k = 1")
    if (strata.agg(F.sum("population")).first()[0] or 0) < plan.target_size:
        raise ProcessingError("target_exceeds_population", plan.plan_id)
    quotas = allocate(strata.select("stratum", "population"), plan)
    rows = strata.join(quotas.select("stratum", "quota"), "stratum").select("stratum", F.posexplode(F.slice(F.arrays_zip("ranks", "bodies"), F.lit(1), F.greatest(F.col("quota"), F.lit(0)).cast("int"))).alias("n", "x"))
    record = F.from_json("x.bodies", RECORD_SCHEMA)
    return rows.select(record.alias("r"), "stratum", F.col("x.ranks").alias("rank_hex")).select("r.*", "stratum", "rank_hex").orderBy(*_ORDER)
