"""Deterministic hash-ranked sampling with closed-form quotas.

Strata and quotas stay in Spark, and no step gathers the strata in one task; each
stratum's rows are ranked by hash and cut at the quota. The strata table is broadcast
by Spark itself where its size allows.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import json_string
from ..functions.text import hash_rank, is_blank, nfkc, strip
from .records import ProcessingError, field_value, fingerprint, matches_filters, record_json

METHODS = ["simple_random", "proportional", "equal", "minimum_then_proportional"]


@dataclass(frozen=True)
class SamplePlan:
    plan_id: str
    target_size: int
    seed: int = 0
    strata_keys: tuple[str, ...] = ()
    allocation_method: str = "simple_random"
    minimum_per_stratum: int = 0
    filters: dict[str, Any] = field(default_factory=dict)
    algorithm_version: str = "hash-rank-v1"
    schema_version: str = "sample-plan-v1"

    @classmethod
    def from_dict(cls, d: dict) -> SamplePlan:
        if not isinstance(d, dict) or set(d) - set(cls.__dataclass_fields__) or not {"plan_id", "target_size"} <= set(d):
            raise ProcessingError("invalid_plan", "unknown or missing keys")
        return cls(**{k: tuple(v) if k == "strata_keys" else v for k, v in d.items()})

    def __post_init__(self) -> None:
        numbers = (self.target_size, self.seed, self.minimum_per_stratum)
        if any(isinstance(x, bool) or not isinstance(x, int) for x in numbers) or not isinstance(self.plan_id, str) or not isinstance(self.filters, dict) or any(not isinstance(k, str) for k in self.strata_keys):
            raise ProcessingError("invalid_plan", "types")
        good = self.plan_id and self.target_size >= 1 and self.seed >= 0 and self.minimum_per_stratum >= 0
        if not good or self.schema_version != "sample-plan-v1" or self.allocation_method not in METHODS or len(set(self.strata_keys)) != len(self.strata_keys):
            raise ProcessingError("invalid_plan", self.plan_id)


def stratum_key(keys: tuple[str, ...]) -> Column:
    return F.to_json(F.array(*(field_value(k) for k in keys))) if keys else F.lit("[]")


#: Counts of one step of the search for the water level: what reaches the driver at once.
STEP = 1024
#: Checkpoint folder of a session in one machine that names none.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/lexmill"


#: Bytes of strata keys up to which the quotas are sent to all rows; beyond them rows and quotas meet by a shuffle.
BROADCAST_KEYS = 16 << 20


def _small(quotas: DataFrame) -> DataFrame:
    """``quotas``, marked for a broadcast where their measured size allows."""
    keys = quotas.agg(F.sum(F.octet_length("stratum") + 64)).first()[0] or 0
    return F.broadcast(quotas) if keys <= BROADCAST_KEYS else quotas


def _held(df: DataFrame) -> DataFrame:
    """``df`` as written to the session's checkpoint folder, without its lineage."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
            raise ProcessingError("no_checkpoint_folder", "spark.checkpoint.dir is unset: set it to a folder that all executors share")
        context.setCheckpointDir(folder or LOCAL_CHECKPOINTS)
    return df.checkpoint()


def _leading(rows: DataFrame, k: int, order: list[tuple[str, bool]], among: Column) -> Column:
    """Whether a row is one of the first ``k`` of those ``among``, by columns and whether they descend; no two rows tie in all.

    The rows are dealt by ranges of the order. The ranges' counts tell which one holds the
    k-th row; only that range is numbered, and its k-th row is what all are compared with.
    """
    if k <= 0:
        return F.lit(False)
    by = [F.desc(c) if down else F.asc(c) for c, down in order]
    dealt = _held(rows.where(among).select(*(c for c, _ in order)).repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    for part, n in sorted(dealt.groupBy("_part").count().collect()):  # a row a partition
        if k <= n:
            break
        k -= n
    else:
        return among
    last = dealt.where(F.col("_part") == part).withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*by))).where(F.col("_n") == k).first()
    inside = F.lit(True)
    for c, down in reversed(order):
        inside = (F.col(c) > last[c] if down else F.col(c) < last[c]) | ((F.col(c) == last[c]) & inside)
    return among & inside


def _proportional(strata: DataFrame, caps: str, target: int, out: str) -> DataFrame:
    """Largest remainder; ties by key; never above the capacity as target <= sum of capacities. Products are decimals: they may pass 64 bits."""
    total = strata.agg(F.sum(caps)).first()[0] or 0
    if not total:
        return strata.withColumn(out, F.lit(0).cast("long"))
    wide = "decimal(19,0)"
    df = strata.withColumn("_p", F.lit(target).cast(wide) * F.col(caps).cast(wide))
    df = df.withColumn("_q", F.expr(f"_p div cast({total} as {wide})"))
    df = df.withColumn("_rem", (F.col("_p") - F.col("_q").cast(wide) * F.lit(total).cast(wide)).cast("long"))
    left = target - df.agg(F.sum("_q")).first()[0]
    more = _leading(df, left, [("_rem", True), ("stratum", False)], F.lit(True))
    return df.withColumn(out, F.col("_q") + more.cast("long")).drop("_p", "_q", "_rem")


def _water_level(strata: DataFrame, target: int, total: int) -> tuple[int, int]:
    """The largest level at which all capacities cut at it sum up to the target at most, and what is left of the target then.

    Capacities are counted in up to STEP ranges, which give the sums at the ranges' ends
    exactly; the range in which the target is passed is divided again.
    """
    count, high = strata.agg(F.count("*"), F.max("population")).first()
    if target == total:
        return high, 0
    low, below, above = 0, 0, count  # below: sum of the capacities up to low; above: number of those beyond it
    while high - low > 1:
        width = -(-(high - low) // STEP)
        cell = F.expr(f"(population - {low + 1}L) div {width}L")
        cells = strata.where(F.col("population").between(low + 1, high)).groupBy(cell.alias("cell")).agg(F.sum("population").alias("held"), F.count("*").alias("n"))
        counted = {r.cell: (r.held, r.n) for r in cells.collect()}
        for j in range(STEP):
            end = min(low + width, high)
            held, n = counted.get(j, (0, 0))
            if end == high or below + held + end * (above - n) > target:
                break
            low, below, above = end, below + held, above - n
        high = end
    return low, target - below - low * above


def allocate(strata: DataFrame, plan: SamplePlan) -> DataFrame:
    """``strata(stratum, population)`` -> with ``quota``. The table has one row a stratum; it is written once, and no step gathers it in one task."""
    target = plan.target_size
    strata = _held(strata.withColumn("population", F.col("population").cast("long")))
    total = strata.agg(F.sum("population")).first()[0] or 0
    if target > total:
        raise ProcessingError("target_exceeds_population", f"{target} > {total}")
    if plan.allocation_method == "simple_random":
        return strata.withColumn("quota", F.lit(target).cast("long"))
    if plan.allocation_method == "proportional":
        return _proportional(strata, "population", target, "quota")
    if plan.allocation_method == "equal":
        level, left = _water_level(strata, target, total)
        more = _leading(strata, left, [("stratum", False)], F.col("population") > level)
        return strata.withColumn("quota", F.least("population", F.lit(level).cast("long")) + more.cast("long"))
    first = strata.withColumn("_min", F.least("population", F.lit(plan.minimum_per_stratum).cast("long")))
    needed = first.agg(F.sum("_min")).first()[0] or 0
    if needed > target:
        raise ProcessingError("infeasible_minimum", f"{needed} > {target}")
    rest = _proportional(first.withColumn("_spare", F.col("population") - F.col("_min")), "_spare", target - needed, "_more")
    return rest.withColumn("quota", F.col("_min") + F.col("_more")).select(*strata.columns, "quota")


def strata_capacity(records: DataFrame, plan: SamplePlan) -> DataFrame:
    return records.where(matches_filters(plan.filters)).groupBy(stratum_key(plan.strata_keys).alias("stratum")).agg(F.count("*").alias("population"))


def sample(records: DataFrame, plan: SamplePlan) -> DataFrame:
    """The sampled records with ``stratum`` and ``rank_hex``."""
    rows = records.where(matches_filters(plan.filters)).withColumn("stratum", stratum_key(plan.strata_keys)).withColumn("rank_hex", hash_rank(F.col("record_id"), plan.seed, plan.algorithm_version))
    if not plan.strata_keys or plan.allocation_method == "simple_random":
        if rows.limit(plan.target_size).count() < plan.target_size:
            raise ProcessingError("target_exceeds_population", plan.plan_id)
        return rows.orderBy("rank_hex", "record_id").limit(plan.target_size)
    quotas = _small(allocate(strata_capacity(records, plan), plan))
    order = Window.partitionBy("stratum").orderBy("rank_hex", "record_id")
    rows = rows.join(quotas, "stratum")
    # ranks are uniform: below this share of them a stratum has its quota but for a chance of about one in 10**9
    share = (F.col("quota") + 6 * F.sqrt("quota") + 20) / F.col("population")
    few = rows.where(F.conv(F.substring("rank_hex", 1, 13), 16, 10).cast("double") / 2.0**52 <= share)
    short = few.groupBy("stratum").agg(F.count("*").alias("n")).join(quotas.where("quota > 0"), "stratum", "right").where(F.coalesce("n", F.lit(0)) < F.col("quota"))
    rows = (rows if short.limit(1).count() else few).drop("population")
    chosen = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.col("quota"))
    return chosen.drop("_n", "quota").orderBy("rank_hex", "record_id")


def report_strata(records: DataFrame, plan: SamplePlan) -> DataFrame:
    quotas = allocate(strata_capacity(records, plan), plan)
    chosen = sample(records, plan).groupBy("stratum").agg(F.count("*").alias("selected"))
    return quotas.join(chosen, "stratum", "left").select("stratum", "population", "quota", F.coalesce("selected", F.lit(0)).alias("selected"))


def sample_report(records: DataFrame, plan: SamplePlan) -> dict:
    """The whole report of a sample: sizes, strata and the fingerprints of plan, population, chosen ids and output.

    The fingerprints are over canonical lines: the population's in order of the ids (then of file and offset), the chosen ids' in their own order, the output's by rank.
    """
    chosen = sample(records, plan)
    filtered = records.where(matches_filters(plan.filters))
    simple = not plan.strata_keys or plan.allocation_method == "simple_random"
    n = filtered.count()
    strata = [{"key": "[]", "population": n, "quota": plan.target_size, "selected": plan.target_size}] if simple else [{"key": r.stratum, "population": r.population, "quota": r.quota, "selected": r.selected} for r in report_strata(records, plan).orderBy("stratum").collect()]
    rank = ["rank_hex", "record_id"]
    return {
        "algorithm_version": plan.algorithm_version, "allocation_method": plan.allocation_method, "filtered_population_size": n, "plan_fingerprint": plan_fingerprint(plan), "plan_id": plan.plan_id,
        "population_fingerprint": fingerprint(filtered, record_json(), ["record_id", "source_file", "source_offset"]).first()[0], "population_size": records.count(), "schema_version": "sample-report-v1", "seed": plan.seed,
        "selected_id_fingerprint": fingerprint(chosen.select("record_id"), json_string(F.col("record_id")), ["record_id"]).first()[0], "output_fingerprint": fingerprint(chosen, record_json(), rank).first()[0],
        "strata": strata, "strata_keys": list(plan.strata_keys), "target_size": plan.target_size,
    }


def plan_fingerprint(plan: SamplePlan) -> str:
    return "sha256:" + hashlib.sha256(json.dumps(asdict(plan), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def risk_sample(records: DataFrame, target: int, templates: list[str], short: int = 12) -> DataFrame:
    """The riskiest records: most reasons first, then by hash."""
    text = F.col("raw_text")
    warned = field_value("metadata.parser_warnings")
    reasons = F.array_sort(
        F.array_compact(
            F.array(
                F.when(is_blank(text), "empty_body"),
                F.when((F.col("record_type") == "article") & (F.col("title").isNull() | is_blank(F.col("title"))), "missing_title"),
                F.when(F.col("event_date").isNull(), "missing_date"),
                F.when(~warned.isin("__MISSING__", "__NULL__", "", "[]", "{}", "0", "false"), "parser_warning"),
                F.when(~is_blank(text) & (F.length(strip(text)) < short), "short_text"),
                F.when(F.exists(F.array(*(F.lit(t) for t in templates)), lambda t: F.col("_view").contains(t)) if templates else F.lit(False), "known_template"),
            )
        )
    )
    rows = records.withColumn("_view", nfkc(text)).select("record_id", reasons.alias("risk_reasons")).where(F.size("risk_reasons") > 0)
    return rows.orderBy(F.desc(F.size("risk_reasons")), hash_rank(F.col("record_id"), 0, "risk-v1"), "record_id").limit(target)
