"""The whole run: scan, parse, sample, clean, optional fuzzy cleaning, manifests, cache."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.canonical import canonical_json
from ..functions.text import hash_rank
from ..operators.cleaning import CleaningConfig, clean, cleaning_events, sampled_pairs
from ..operators.fuzzy import FuzzyConfig, decision_report, decision_rows, fuzzy_clean, fuzzy_events
from ..operators.records import mergeable_fingerprint, record_json
from ..operators.sampling import SamplePlan, plan_fingerprint, risk_sample, sample, sample_report
from ..sources.artifacts import write_artifact
from ..sources.raw import ParsingConfig, parse_directory, scan_manifest
from ..sources.sinks import cache_key, read_json, write_json, write_parquet


def _config_fingerprint(*configs: object) -> str:
    body = json.dumps([asdict(c) for c in configs if c is not None], sort_keys=True, default=str)
    return "sha256:" + hashlib.sha256(body.encode()).hexdigest()


def _fingerprint(df: DataFrame) -> str:
    return json.dumps(mergeable_fingerprint(df, record_json()).first().asDict(), sort_keys=True)


def clean_to_tables(spark: SparkSession, records: DataFrame, config: CleaningConfig, out: str) -> bool:
    """Cleaned records and events as Parquet; False where the cache shows that they are there already."""
    fingerprint, settings = _fingerprint(records), _config_fingerprint(config)
    key = cache_key(config.algorithm_version, fingerprint, settings)
    held = read_json(spark, f"{out}/clean-cache.json")
    if held and held["cache_key"] == key and held["output"] == _fingerprint(spark.read.parquet(f"{out}/cleaned").drop("events")):
        return False
    write_parquet(clean(records, config), f"{out}/cleaned")
    cleaned = spark.read.parquet(f"{out}/cleaned")
    write_parquet(cleaning_events(cleaned), f"{out}/events")
    write_json(spark, {"algorithm_version": config.algorithm_version, "cache_key": key, "input_fingerprint": fingerprint, "config_fingerprint": settings, "output": _fingerprint(cleaned.drop("events")), "schema_version": "clean-cache-v1"}, f"{out}/clean-cache.json")
    return True


#: Fields of the artifacts' lines: fixed values of the contracts.
EVENT = ["record_id", "stage", "rule_id", "rule_version", "match_method", "action", "reason_code", "decision", "matched_span", "removed_chars", "score", "before_hash", "after_hash", "metrics", "algorithm_version", "schema_version"]
DECISION = ["combined_score", "components", "decision", "evidence_count", "gates", "length_ratio", "margin", "matched_span", "position", "reason_codes", "record_id", "span_end", "span_start", "template_id"]
PLACE = ("source_file", "source_offset")


def lines_of(df: DataFrame, fields: list[str] | None = None) -> Column:
    """Canonical lines of a table's ``fields``, all of them by default."""
    own = df.select(*(fields or df.columns))
    return canonical_json(F.struct(*own.columns), own.schema)


def fuzzy_artifacts(spark: SparkSession, records: DataFrame, config: FuzzyConfig, out: str, prefix: str = "") -> dict[str, str]:
    """Cleaned records, events, decisions, review queue and decision report of fuzzy cleaning under ``out``; their hashes by name."""
    names = {k: f"{prefix}{k}.jsonl" for k in ("cleaned-records", "cleaning-events", "decisions", "review-queue")}
    done = {names["cleaned-records"]: write_artifact(fuzzy_clean(records, config), record_json(), [*PLACE], f"{out}/{names['cleaned-records']}")}
    events = fuzzy_events(records, config, PLACE)
    done[names["cleaning-events"]] = write_artifact(events, lines_of(events, EVENT), [*PLACE, "seq"], f"{out}/{names['cleaning-events']}")
    decided = decision_rows(records, config, PLACE)
    for key, rows in (("decisions", decided), ("review-queue", decided.where("decision = 'review'"))):
        done[names[key]] = write_artifact(rows, lines_of(rows, DECISION), [*PLACE, "seq"], f"{out}/{names[key]}")
    hashes = {k: v["sha256"] for k, v in done.items()}
    report = decision_report(decided, config, done[names["cleaned-records"]]["lines"], hashes[names["decisions"]])
    name = f"{prefix}decision-report.json"
    return hashes | {name: write_json(spark, report, f"{out}/{name}")}


def run(spark: SparkSession, root: str, plan: SamplePlan, config: CleaningConfig, out: str, fuzzy: FuzzyConfig | None = None, fingerprints: dict[str, str] | None = None) -> dict:
    """All artifacts under ``out``; returns the run manifest, with the SHA-256 of each of them but for the risk sample.

    What later steps read is kept as Parquet in folders beside them. ``fingerprints`` are
    those of the configurations as they were given: parsing, cleaning, fuzzy.
    """
    found = scan_manifest(spark, root)
    hashes = {}

    def artifact(name: str, df: DataFrame, line: Column, order: list) -> None:
        hashes[name] = write_artifact(df, line, order, f"{out}/{name}")["sha256"]

    artifact("file-manifest.jsonl", found, lines_of(found), ["relative_path"])
    records, bad = parse_directory(spark, root)
    write_parquet(records, f"{out}/parsed")
    records = spark.read.parquet(f"{out}/parsed")
    artifact("parsed-records.jsonl", records, record_json(), [*PLACE])
    artifact("quarantine.jsonl", bad, lines_of(bad), [*PLACE, "error_code"])
    write_parquet(sample(records, plan), f"{out}/sample")
    chosen = spark.read.parquet(f"{out}/sample")
    rank = ["rank_hex", "record_id"]
    artifact("sampled-before.jsonl", chosen, record_json(), rank)
    hashes["sample-report.json"] = write_json(spark, sample_report(records, plan), f"{out}/sample-report.json")
    clean_to_tables(spark, records, config, out)
    cleaned = spark.read.parquet(f"{out}/cleaned")
    artifact("cleaned-records.jsonl", cleaned, record_json(), [*PLACE])
    events = cleaning_events(cleaned, PLACE)
    artifact("cleaning-events.jsonl", events, lines_of(events, EVENT), [*PLACE, "seq"])
    pairs = sampled_pairs(chosen, config, ("rank_hex",))
    artifact("sampled-pairs.jsonl", pairs, lines_of(pairs, ["record_id", "before", "after", "changed", "changed_characters", "rule_ids"]), rank)
    risky = risk_sample(records, 20, config.templates.markers())
    risky = risky.withColumn("o1", -F.size("risk_reasons")).withColumn("o2", hash_rank(F.col("record_id"), 0, "risk-v1"))
    write_artifact(risky, lines_of(risky, ["record_id", "risk_reasons"]), ["o1", "o2", "record_id"], f"{out}/risk-sample.jsonl")
    if fuzzy is not None:
        hashes |= {f: h for f, h in fuzzy_artifacts(spark, cleaned.drop("events"), fuzzy, out, "fuzzy-").items()}
    given = fingerprints or {}
    manifest = {
        "algorithm_version": f"pipeline-v1+{fuzzy.algorithm_version}" if fuzzy else "pipeline-v1", "cleaning_config_fingerprint": given.get("cleaning") or _config_fingerprint(config), "input_fingerprint": hashes["file-manifest.jsonl"], "outputs": hashes,
        "parsing_config_fingerprint": given.get("parsing") or _config_fingerprint(ParsingConfig()), "plan_fingerprint": plan_fingerprint(plan), "schema_version": "run-manifest-v1",
    }
    if fuzzy is not None:
        manifest["fuzzy_config_fingerprint"] = given.get("fuzzy") or _config_fingerprint(fuzzy)
    write_json(spark, manifest, f"{out}/run-manifest.json")
    return manifest
