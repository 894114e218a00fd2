"""Typed filters, exact field names, quotes in templates, private characters, repeated ids, plan sizes."""

import json

import pytest
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import cleaning as C
from lexmill.operators import fuzzy as Z
from lexmill.operators import records as R
from tests.test_engine import CONFIG, FUZZY, one, records


@pytest.mark.parametrize(
    ("wanted", "hits"),
    [(True, [0]), (False, []), ("true", [1]), (1, [2, 3]), (1.0, [2, 3]), ("1", [4]), (None, [5]), ("__NULL__", [6]), ([True, None], [0, 5]), ("__MISSING__", []), ({"a": 1}, [8])],
)
def test_filters_compare_types(spark, wanted, hits):
    values = [True, "true", 1, 1.0, "1", None, "__NULL__", ..., {"a": 1}]
    rows = [json.dumps({} if v is ... else {"k": v}) for v in values]
    df = records(spark, ["t"] * len(rows)).join(spark.createDataFrame(list(enumerate(rows)), "n long, m string"), F.col("source_offset") == F.col("n"))
    df = df.withColumn("metadata", F.col("m"))
    assert sorted(r.n for r in df.where(R.matches_filters({"metadata.k": wanted})).collect()) == hits


def test_filters_of_columns_and_unknown_names(spark):
    df = records(spark, ["a", "b"])
    n = lambda f: df.where(R.matches_filters(f)).count()
    assert [n(f) for f in ({"record_id": "1"}, {"record_id": 1}, {"source_offset": 1}, {"source_offset": "1"}, {"event_date": None}, {"id": "1"}, {"id": None}, {"metadata.a'b": 1})] == [1, 0, 1, 0, 2, 0, 0, 0]
    assert df.select(R.field_value("id"), R.field_value("string"), R.field_value("metadata.x'y")).first() == ("__MISSING__",) * 3


def test_templates_with_both_quotes_and_backslashes(spark):
    config = C.CleaningConfig(C.Templates(blocks=(("<'\"\\", "\\\"'>"),)))
    got = C.clean(records(spark, ["long enough <'\"\\ gone \\\"'> text here"]), config).first()
    assert got.clean_text == "long enough  text here"


def test_private_characters_stay(spark):
    mark, other = T.MARK, T.OTHER
    for text, want in ((f"a{mark}b", f"a{mark}b"), (f"a{mark}{other}<br>{other}b", f"a{mark}{other}\n{other}b"), (f"<p>{mark}</p>{mark}{mark}", f"{mark}\n{mark}{mark}"), (f"x<br>{mark}{other}{other}", f"x\n{mark}{other}{other}")):
        assert one(spark, T.remove_tags(F.col("a")), a=text) == want


def test_repeated_ids_keep_their_own_texts(spark):
    texts = ["平台公告:内容仅供参考\n真实正文", "别的正文\n相关推荐", "平台公告:内容仅供参考\n真实正文"]
    df = records(spark, texts).withColumn("record_id", F.lit("same"))
    for rows in (df, df.withColumn("source_offset", F.lit(1)), df.withColumn("record_id", F.lit(None).cast("string"))):
        assert sorted(r.clean_text for r in Z.fuzzy_clean(rows, FUZZY).collect()) == ["别的正文", "真实正文", "真实正文"]


def test_each_rule_is_computed_once(spark):
    plan = C.cleaning_events(C.clean(records(spark, ["<p>a</p>"]), CONFIG))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 40


def test_lines_over_parts(spark):
    text = "\r\n".join(f" {'x' * (i % 7)}y{i} " for i in range(1500)) + "\n\n last"
    got = T.with_lines(spark.createDataFrame([(text,), ("",), (None,)], "t string"), "t", 64).collect()
    assert [r.lines for r in got[1:]] == [[], []] and len(got[0].lines) == 1501
    assert all(text[x.start : x.start + len(x.value)] == x.value and x.value.strip() == x.value for x in got[0].lines)


def test_files_of_many_splits_keep_their_offsets(spark, tmp_path):
    from lexmill.sources import raw

    good = {"record_id": "r", "dataset_id": "d", "event_date": None, "record_type": "article", "title": None, "raw_text": "t", "category_signal": "c", "source_batch": "b", "synthetic": True}
    (tmp_path / "a b+c").mkdir()
    (tmp_path / "a b+c/x%20y.jsonl").write_text("".join(json.dumps(good | {"record_id": f"j{i}"}) + "\r\n" for i in range(900)))
    (tmp_path / "t.tsv").write_text("﻿" + "\t".join(raw.HEADER) + "\n" + "".join("\t".join([f"t{i}", "d", "null", "article", "null", '"x"', '"c"', "b", "true"]) + "\n" for i in range(900)))
    (tmp_path / "drift.tsv").write_text("a\tb\n" + "c\td\n" * 900)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows, bad = raw.parse_directory(spark, str(tmp_path))
        got = [(r.source_file, r.source_offset, r.record_id) for r in rows.collect()]
        assert got == [("a b+c/x%20y.jsonl", i, f"j{i}") for i in range(900)] + [("t.tsv", i, f"t{i}") for i in range(900)]
        assert [(r.source_file, r.source_offset, r.error_code) for r in bad.collect()] == [("drift.tsv", 0, "unknown_schema_drift")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_protected_prefixes_are_compared_in_the_same_form(spark):
    """A full-width colon in a protected prefix protects texts with either colon, where NFKC is on."""
    template = (Z.Template("note", "note: all of this is a notice", ("prefix", "line")),)
    texts = ["Note：  all of this is a notice\nbody", "NOTE: all of this is a notice\nbody", "note all of this is a notice\nbody"]
    for protected, kept in ((("Note：",), [0, 1]), (("note:",), [0, 1]), ((), [])):
        got = Z.fuzzy_clean(records(spark, texts), Z.FuzzyConfig(template, protected=protected, auto=9000)).collect()
        assert [int(r.record_id) for r in sorted(got, key=lambda r: r.source_offset) if r.clean_text != "body"] == kept
        assert all("protected_context" in r.decisions[0].reason_codes for r in got if int(r.record_id) in kept)


def test_matching_normalisation_of_the_configuration_is_read(spark):
    base = {"thresholds": {"auto": 9500, "review": 6000}, "best_match_margin": 300, "minimum_evidence_floor": 7000, "auto_minimum_evidence": 2, "candidate_limits": {"min_length": 3, "max_length": 64, "min_length_ratio": 5000}, "protected_context_prefixes": [], "character_ngram": 3}
    base |= {"algorithm_version": "a2", "rule_version": "r2", "score_weights": dict(T.WEIGHTS), "templates": [{"template_id": "t", "canonical_text": "ABC ： def", "allowed_positions": ["prefix"]}]}
    def view(**rules):
        config = Z.FuzzyConfig.from_dict(base | ({"matching_normalization": rules} if rules else {}))
        assert (config.algorithm_version, config.rule_version) == ("a2", "r2")
        return one(spark, config.view(F.col("a")), a="ABC ： def")

    assert view() == "abc:def" and view(nfkc=False, ascii_lower=True, collapse_whitespace=True) == "abc ： def" and view(nfkc=True, ascii_lower=False, collapse_whitespace=False) == "ABC : def"


def test_fuzzy_events_have_all_fields(spark):
    rows = Z.fuzzy_events(records(spark, ["平台公告:内容仅供参考\n真实正文\n相关推荐", "平台公吿:内容仅供参考\n真实正文"]), FUZZY).orderBy("record_id", "seq").collect()
    assert [(r.record_id, r.seq, r.reason_code, r.matched_span, r.removed_chars) for r in rows] == [("0", 0, "fuzzy_template_auto", "相关推荐", 5), ("0", 1, "fuzzy_template_auto", "平台公告:内容仅供参考", 12), ("0", 2, "fuzzy_template_skipped", "真实正文", 0), ("1", 0, "fuzzy_template_review", "平台公吿:内容仅供参考", 0), ("1", 1, "fuzzy_template_skipped", "真实正文", 0)]
    assert rows[0].before_hash != rows[0].after_hash == rows[1].before_hash and rows[1].after_hash == rows[2].before_hash == rows[2].after_hash
    assert sorted(rows[0].metrics.asDict()) == sorted([*T.SCORES, "combined", "auto_threshold", "best_match_margin", "evidence_count", "gates", "length_ratio", "margin", "position", "reason_codes", "review_threshold", "span_end", "span_start"])
    assert (rows[0].match_method, rows[0].action, rows[0].rule_version, rows[0].metrics.span_end, rows[0].metrics.gates.regex) == ("fuzzy", "remove", "1.0.0", 21, True)


def test_cases_of_one_id_are_told_apart_in_the_grid(spark):
    """Two cases share their id; each has its own text and outcome."""
    df = records(spark, ["平台公告:内容仅供参考\n真实正文", "别的\n真实正文"]).withColumn("expected", F.when(F.col("source_offset") == 0, "applied").otherwise("skipped")).withColumn("record_id", F.lit("same"))
    r = Z.threshold_grid(df, FUZZY, [9500], [6000]).first()
    assert (r.false_removals, r.applied_applied, r.skipped_skipped, r.auto_precision) == (0, 1, 1, 10000)
