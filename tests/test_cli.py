"""Every command on small files, the strict readers, the sample and threshold reports."""

import json

import pytest

from lexmill.__main__ import main
from lexmill.operators import fuzzy as Z
from lexmill.operators import records as R
from lexmill.operators import sampling as S
from lexmill.sources import jsonl
from tests.test_engine import FUZZY, records

RECORD = {
    "record_id": "r0", "dataset_id": "d", "source_file": "f", "source_offset": 0, "record_type": "article", "event_date": None, "title": None, "raw_text": "站点页头 正文内容 here", "clean_text": None, "metadata": {"k": True}, "parser_version": "p", "schema_version": "record-v1",
}
CLEANING = {
    "schema_version": "cleaning-config-v1", "algorithm_version": "deterministic-clean-v1", "rule_version": "1", "short_text_threshold": 4, "exact_templates": {"prefixes": ["站点页头"], "suffixes": [], "lines": [], "blocks": []},
    "rules": [{"rule_id": "remove_exact_templates", "priority": 1, "action": "remove", "match_method": "exact", "reason_code": "known_template"}],
}
FUZZY_JSON = {
    "algorithm_version": "fuzzy-template-clean-v1", "thresholds": {"auto": 9500, "review": 6000}, "best_match_margin": 300, "minimum_evidence_floor": 7000, "auto_minimum_evidence": 2, "candidate_limits": {"min_length": 3, "max_length": 64, "min_length_ratio": 5000},
    "protected_context_prefixes": ["本文讨论"], "character_ngram": 3, "score_weights": {"ratio": 25, "partial_ratio": 20, "token_sort": 15, "token_set": 15, "char_jaccard": 25}, "sensitivity_grid": {"auto_thresholds": [8000, 9500], "review_thresholds": [6000, 8000]},
    "nfkc_score_examples": [{"candidate": "ＡＢ：c", "template": "ab:c"}], "templates": [{"template_id": t.template_id, "canonical_text": t.canonical_text, "allowed_positions": list(t.allowed_positions), "compatible_regex": t.compatible_regex} for t in FUZZY.templates],
}


def lines(path, rows):
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r, ensure_ascii=False)) + "\n" for r in rows), encoding="utf-8")
    return str(path)


@pytest.mark.parametrize(
    ("change", "error"),
    [
        ("{", "[invalid_json] line 3 [invalid_json]"), ("[1]", "[type_error] line 3 [type_error]"), ({"title": ...}, "[missing_field] line 3 [missing_field] field=title"), ({"new": 1}, "[unexpected_field] line 3 [unexpected_field] field=new"), ({"raw_text": 5}, "[type_error] line 3 [type_error] field=raw_text"),
        ({"record_id": ""}, "[invalid_value] line 3 [invalid_value] field=record_id"), ({"source_offset": True}, "[type_error] line 3 [type_error] field=source_offset"), ({"source_offset": -1}, "[invalid_value] line 3 [invalid_value] field=source_offset"), ({"source_offset": 1.5}, "[type_error] line 3 [type_error] field=source_offset"),
        ({"record_type": "page"}, "[invalid_value] line 3 [invalid_value] field=record_type"), ({"title": 1}, "[type_error] line 3 [type_error] field=title"), ({"event_date": "2026-1-1"}, "[invalid_value] line 3 [invalid_value] field=event_date"), ({"metadata": []}, "[type_error] line 3 [type_error] field=metadata"),
        ({"schema_version": "v0"}, "[invalid_value] line 3 [invalid_value] field=schema_version"),
    ],
)
def test_strict_reader_names_line_and_field(spark, tmp_path, change, error):
    bad = change if isinstance(change, str) else {k: v for k, v in (RECORD | change).items() if v is not ...}
    path = lines(tmp_path / "r.jsonl", [RECORD, RECORD | {"record_id": "r1"}, bad, "{"])
    with pytest.raises(R.ProcessingError) as e:
        jsonl.read_records(spark, path)
    assert str(e.value) == error


def test_line_numbers_over_many_splits(spark, tmp_path):
    path = lines(tmp_path / "n.jsonl", [f"{i} {'x' * (i % 50)}" for i in range(1, 3000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert all(r.value.split(" ")[0] == str(r.line) for r in jsonl.numbered_lines(spark, path).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


CASE = {"record_type": "article", "event_date": None, "case_family": "f"}
CASES = [
    CASE | {"case_id": f"{split}-{k}", "split": split, "input_text": text, "expected_decision": want}
    for split in ("calibration", "holdout")
    for k, (text, want) in enumerate([("平台公告:内容仅供参考\n真实正文", "applied"), ("平台公吿:内容仅供参考\n真实正文", "review"), ("别的\n真实正文", "skipped")])
]


def test_case_reader_and_threshold_report(spark, tmp_path):
    path = lines(tmp_path / "c.jsonl", [*CASES, RECORD])
    cases = jsonl.read_cases(spark, path)
    assert sorted((r.record_id, r.source_offset, r.expected or "") for r in cases.collect())[:2] == [("calibration-0", 0, "applied"), ("calibration-1", 1, "review")]
    report = Z.evaluate_thresholds(cases, FUZZY, [8000, 9500], [6000, 8000])
    assert report["selected_thresholds"] == {"auto": 9500, "review": 8000} and report["golden_case_count"] == 6 and len(report["sensitivity"]) == 3
    assert report["holdout_metrics"]["review_capture"] == 1.0 and report["holdout_metrics"]["confusion_matrix"]["applied"]["applied"] == 1
    with pytest.raises(R.ProcessingError) as e:
        jsonl.read_cases(spark, lines(tmp_path / "d.jsonl", [CASES[0], {"case_id": "x"}]))
    assert str(e.value) == "[invalid_fuzzy_input] line 2: missing case fields"


def test_metrics_of_nothing_are_one(spark):
    got = Z.metrics(spark.createDataFrame([("skipped", "review")], "expected string, actual string"))
    assert (got["auto_precision"], got["auto_recall_basis_points"], got["review_capture"], got["meaningless_review_count"]) == (1.0, 10000, 1.0, 1)


def test_sample_report_and_order(spark):
    df = records(spark, [f"t{i}" for i in range(60)])
    plan = S.SamplePlan("p", 9, 3, ("metadata.lang", "record_type"), "proportional", filters={"metadata.lang": "en"})
    ranks = [r.rank_hex for r in S.sample(df, plan).collect()]
    report = S.sample_report(df, plan)
    assert ranks == sorted(ranks) and report["strata"][0]["selected"] == 9 and report["filtered_population_size"] == report["population_size"] == 60
    assert report == S.sample_report(df.repartition(7), plan) != S.sample_report(df, S.SamplePlan("p", 9, 4, ("metadata.lang", "record_type"), "proportional", filters={"metadata.lang": "en"}))


@pytest.mark.parametrize("plan", [{"plan_id": "p"}, {"plan_id": "p", "target_size": "3"}, {"plan_id": "p", "target_size": True}, {"plan_id": "p", "target_size": 3, "more": 1}, {"plan_id": 5, "target_size": 3}])
def test_plans_are_checked(plan):
    with pytest.raises(R.ProcessingError) as e:
        S.SamplePlan.from_dict(plan)
    assert e.value.code == "invalid_plan"


def test_all_commands(spark, tmp_path, capsys):
    raw = {"record_id": "r", "dataset_id": "d", "event_date": None, "record_type": "article", "title": None, "raw_text": "站点页头 正文", "category_signal": "c", "source_batch": "b", "synthetic": True}
    (tmp_path / "in").mkdir()
    lines(tmp_path / "in/a.jsonl", [raw | {"record_id": f"r{i}"} for i in range(5)] + ["{"])
    rows = lines(tmp_path / "rows.jsonl", [RECORD | {"record_id": f"r{i}", "source_offset": i} for i in range(6)])
    files = {n: lines(tmp_path / f"{n}.json", [d]) for n, d in {"plan": {"plan_id": "p", "target_size": 3, "schema_version": "sample-plan-v1"}, "clean": CLEANING, "fuzzy": FUZZY_JSON}.items()}
    cases, out = lines(tmp_path / "cases.jsonl", CASES), lambda n: str(tmp_path / "out" / n)
    for argv in (
        ["scan", str(tmp_path / "in"), "--out", out("files")], ["parse", str(tmp_path / "in"), "--out", out("parse")], ["validate", rows], ["profile", rows], ["sample", rows, "--plan", files["plan"], "--out", out("sample.jsonl"), "--report", out("report.json")],
        ["clean", rows, "--config", files["clean"], "--out", out("clean")], ["fuzzy-clean", cases, "--config", files["fuzzy"], "--out", out("fuzzy")],
        ["evaluate-fuzzy", cases, "--config", files["fuzzy"], "--out", out("thresholds.json"), "--nfkc-input", rows], ["pipeline", str(tmp_path / "in"), "--plan", files["plan"], "--config", files["clean"], "--fuzzy-config", files["fuzzy"], "--out", out("run")],
    ):
        assert main(argv) == 0, argv
    assert "validated 6 records" in capsys.readouterr().out
    assert spark.read.parquet(out("files")).count() == 1 and spark.read.parquet(out("parse/quarantine")).count() == 1 and spark.read.parquet(out("clean/cleaned")).where("clean_text = '正文内容 here'").count() == 6
    chosen = [json.loads(r.value) for r in spark.read.text(out("sample.jsonl")).collect()]
    assert len(chosen) == 3 and list(chosen[0]) == sorted(chosen[0]) and chosen[0]["metadata"] == {"k": True} and chosen[0]["clean_text"] is None
    held = {n: json.loads("".join(r.value for r in spark.read.text(out(n)).collect())) for n in ("report.json", "thresholds.json", "run/run-manifest.json", "run/sample-report.json")}
    assert held["report.json"]["strata"] == [{"key": "[]", "population": 6, "quota": 3, "selected": 3}] and held["thresholds.json"]["selected_thresholds"] == {"auto": 9500, "review": 8000}
    assert held["thresholds.json"]["nfkc_audit"]["score_examples"][0]["matching_view_ratio"] == 10000 and {"input_fingerprint", "parsing_config_fingerprint", "cleaning_config_fingerprint", "fuzzy_config_fingerprint", "plan_fingerprint"} <= set(held["run/run-manifest.json"])
    fuzzy = {r.record_id: r.clean_text for r in spark.read.json(out("fuzzy/cleaned-records.jsonl")).collect()}
    decided = [json.loads(x) for x in open(out("fuzzy/decisions.jsonl"), encoding="utf-8")]
    queue = [json.loads(x) for x in open(out("fuzzy/review-queue.jsonl"), encoding="utf-8")]
    report = json.load(open(out("fuzzy/decision-report.json"), encoding="utf-8"))
    assert queue == [x for x in decided if x["decision"] == "review"] and report["counts"]["review"] == len(queue) == 2 and report["record_count"] == 6
    assert len(open(out("fuzzy/cleaning-events.jsonl"), encoding="utf-8").readlines()) == len(decided)
    assert fuzzy["holdout-0"] == "真实正文" and fuzzy["holdout-1"].startswith("平台公吿")
    assert main(["validate", lines(tmp_path / "bad.jsonl", ["{"])]) == 1 and "[invalid_json] line 1" in capsys.readouterr().err


def test_python_api(spark, tmp_path):
    import lexmill

    path = lines(tmp_path / "r.jsonl", [RECORD, RECORD | {"raw_text": " "}, RECORD | {"record_id": "r1", "event_date": "2026-01-01", "title": "t"}])
    got = lexmill.profile_jsonl(path).to_dict()
    assert got == {
        "total_records": 3, "by_dataset_id": {"d": 3}, "by_record_type": {"article": 3}, "by_event_date": {"2026-01-01": 1, "<null>": 2}, "missing_title_count": 2, "missing_or_empty_body_count": 1, "unique_record_id_count": 2, "duplicate_record_id_count": 1,
        "schema_versions": {"record-v1": 3},
    }
    assert lexmill.validate_jsonl(path).schema.simpleString() == lexmill.RecordV1.simpleString()
    with pytest.raises(lexmill.ValidationError):
        lexmill.validate_jsonl(lines(tmp_path / "b.jsonl", ["{"]))
