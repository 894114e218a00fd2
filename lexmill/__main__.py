"""Command line: scan, parse, validate, profile, sample, clean, fuzzy-clean, evaluate-fuzzy, pipeline."""

from __future__ import annotations

import argparse
import hashlib
import json
import sys

from pyspark.sql import SparkSession

from .operators import cleaning, fuzzy, records, sampling
from .plans import pipeline
from .sources import artifacts, jsonl, raw, sinks


def _fingerprint(d: object) -> str:
    return "sha256:" + hashlib.sha256(raw.canonical(d).encode()).hexdigest()


def _load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _records(spark: SparkSession, path: str):
    """Records of a Parquet table, or of a JSON Lines file, which is read strictly."""
    return jsonl.read_records(spark, path) if path.endswith(".jsonl") else spark.read.parquet(path)


def _cases(spark: SparkSession, path: str):
    return jsonl.read_cases(spark, path) if path.endswith(".jsonl") else spark.read.parquet(path)


def _write(df, path: str, order: list[str]) -> None:
    """Parquet, or one file of canonical JSON Lines in the artifact's order."""
    if path.endswith(".jsonl"):
        artifacts.write_artifact(df, records.record_json() if "metadata" in df.columns else pipeline.lines_of(df), order, path)
    else:
        sinks.write_parquet(df, path)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexmill", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    for name, options in {
        "scan": ["out"], "parse": ["out"], "validate": [], "profile": [], "sample": ["plan", "out"], "clean": ["config", "out"], "fuzzy-clean": ["config", "out"],
        "evaluate-fuzzy": ["config", "out"], "pipeline": ["plan", "config", "out"],
    }.items():
        c = commands.add_parser(name)
        c.add_argument("input")
        for o in options:
            c.add_argument(f"--{o}", required=True)
        for o in ("fuzzy-config", "parsing-config", "report", "events", "nfkc-input"):
            c.add_argument(f"--{o}")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("lexmill").getOrCreate()
    try:
        if a.command == "scan":
            _write(raw.scan_manifest(spark, a.input), a.out, ["relative_path"])
        elif a.command == "parse":
            good, bad = raw.parse_directory(spark, a.input)
            _write(good, f"{a.out}/parsed", ["source_file", "source_offset"])
            _write(bad, f"{a.out}/quarantine", ["source_file", "source_offset"])
        elif a.command == "pipeline":
            given = {k: _load(f) for k, f in (("parsing", a.parsing_config), ("cleaning", a.config), ("fuzzy", a.fuzzy_config)) if f}
            if given.get("parsing", {}).get("parser_version", raw.PARSER_VERSION) != raw.PARSER_VERSION:
                raise records.ProcessingError("invalid_parsing_config", str(given["parsing"].get("parser_version")))
            pipeline.run(spark, a.input, sampling.SamplePlan.from_dict(_load(a.plan)), cleaning.CleaningConfig.from_dict(given["cleaning"]), a.out, fuzzy.FuzzyConfig.from_dict(given["fuzzy"]) if a.fuzzy_config else None, {k: _fingerprint(d) for k, d in given.items()})
        elif a.command == "validate":
            rows = _records(spark, a.input)
            wrong = None if a.input.endswith(".jsonl") else records.validate_records(rows).where("error_type is not null").first()
            if wrong:
                raise records.ProcessingError(wrong.error_type, f"record {wrong.record_id} field={wrong.error_field}")
            print(f"validated {rows.count()} records")
        elif a.command == "profile":
            rows = _records(spark, a.input)
            print(json.dumps(records.profile_totals(rows).first().asDict() | {"counts": [r.asDict() for r in records.profile(rows).orderBy("kind", "value").collect()]}, ensure_ascii=False))
        elif a.command == "sample":
            rows, plan = _records(spark, a.input), sampling.SamplePlan.from_dict(_load(a.plan))
            chosen = sampling.sample(rows, plan)
            if a.out.endswith(".jsonl"):  # the artifact's order is the ranks'
                artifacts.write_artifact(chosen, records.record_json(), ["rank_hex", "record_id"], a.out)
            else:
                sinks.write_parquet(chosen, a.out)
            if a.report:
                sinks.write_json(spark, sampling.sample_report(rows, plan), a.report)
        elif a.command == "clean":
            pipeline.clean_to_tables(spark, _records(spark, a.input), cleaning.CleaningConfig.from_dict(_load(a.config)), a.out)
        elif a.command == "fuzzy-clean":
            rows, config = _cases(spark, a.input).drop("expected", "split"), fuzzy.FuzzyConfig.from_dict(_load(a.config))
            pipeline.fuzzy_artifacts(spark, rows, config, a.out)
        else:
            d = _load(a.config)
            grid = [[fuzzy.basis_points(x) for x in d["sensitivity_grid"][k]] for k in ("auto_thresholds", "review_thresholds")]
            audited = _records(spark, a.nfkc_input) if a.nfkc_input else None
            report = fuzzy.evaluate_thresholds(_cases(spark, a.input), fuzzy.FuzzyConfig.from_dict(d), *grid, audited, d.get("nfkc_score_examples"))
            sinks.write_json(spark, report, a.out)
            print(json.dumps(report["selected_thresholds"]))
        return 0
    except records.ProcessingError as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
