"""Similarities in NumPy against plain ones, long lines, many regions, and the time they take (the former code took more than each bound)."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lexmill.functions import similarity as S
from lexmill.functions import text as T
from lexmill.operators import fuzzy as Z
from lexmill.plans.registry import FUZZY, QUERIES
from tests.test_engine import one


def plain(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def best_window(a: str, b: str) -> int:
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 0 if long else 10000
    m, least = len(short), min(plain(short, long[i : i + len(short)]) for i in range(len(long) - len(short) + 1))
    return ((m - least) * 10000 + m // 2) // m


def pairs(n: int, most: int, other: int) -> tuple[list[str], list[str]]:
    draw = random.Random(most)
    text = lambda size: "".join(draw.choices("ab é公😀", k=size))
    return [text(draw.randint(0, most)) for _ in range(n)], [text(draw.randint(0, other)) for _ in range(n)]


@pytest.mark.parametrize("few", [0, 8])
@pytest.mark.parametrize(("most", "other"), [(9, 9), (64, 64), (70, 70), (150, 60)])
def test_distances_equal_the_plain_ones(monkeypatch, most, other, few):
    a, b = pairs(60, most, other)
    monkeypatch.setattr(S, "FEW", few)
    for part in (50, 1 << 18):
        monkeypatch.setattr(S, "PART", part)
        monkeypatch.setattr(S, "WINDOWS", part)
        assert S.distances(a, b).tolist() == [plain(x, y) for x, y in zip(a, b)]
        assert S.partial_ratios(a, b).tolist() == [best_window(x, y) for x, y in zip(a, b)]


def test_nulls(spark):
    rows = [("abc", "axc"), (None, "b"), ("a", None), ("", ""), ("公告", "平台公告内容")] * 30
    got = spark.createDataFrame(rows, "a string, b string").coalesce(1).select(T.ratio(F.col("a"), F.col("b")), T.partial_ratio(F.col("a"), F.col("b")), T.token_set_ratio(F.col("a"), F.col("b")), T.char_jaccard(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(6667, 6667, 6667, 0), (None,) * 4, (None,) * 4, (10000,) * 4, (3333, 10000, 10000, 0)] * 30


def test_ngrams_of_a_long_line(spark):
    began = time.time()
    assert one(spark, T.char_jaccard(F.repeat("a", 20_000), F.lit("0123456789")), a="".join(map(str, range(10)))) == 8000 and time.time() - began < 15


def test_windows_of_a_long_line(spark):
    began = time.time()
    assert one(spark, T.partial_ratio(F.repeat("a", 30_000), F.lit("x9876543210" * 5)), a="".join(map(str, range(10)))) == 1455 and time.time() - began < 12


def test_many_regions_against_templates(spark):
    texts = spark.range(60_000).select(F.concat(F.lit("row "), "id", F.lit(" of "), F.sha2(F.col("id").cast("string"), 256)).substr(1, 64).alias("region"))
    began = time.time()
    assert sum(r["count"] for r in Z.best_templates(texts, FUZZY).groupBy("template_id").count().collect()) == 60_000 and time.time() - began < 20


def test_best_templates_are_the_best_of_all_scores(spark, monkeypatch):
    """Ties go to the smaller id, a single template's margin is its score, and small pieces change nothing."""
    monkeypatch.setattr(Z, "HELD", 7)
    same = Z.FuzzyConfig((Z.Template("z", "same text", ("line",)), Z.Template("b", "same text", ("prefix",)), Z.Template("c", "ＯＴＨＥＲ", ("line",))))
    texts = spark.createDataFrame([(t,) for t in ("same text", "other", "some text", "x", "same test", "")], "region string")
    rows = sorted(Z.scored(texts, same).collect(), key=lambda r: (r.region, -r.combined, r.template_id))
    assert len(rows) == 18
    for r in Z.best_templates(texts, same).collect():
        first, second = [x for x in rows if x.region == r.region][:2]
        assert (r.template_id, r.combined, r.margin, r.view, r.template_view, r.allowed) == (first.template_id, first.combined, first.combined - second.combined, first.view, first.template_view, first.allowed)
        assert [r[k] for k in T.SCORES] == [first[k] for k in T.SCORES]
    alone = Z.best_templates(texts, Z.FuzzyConfig(same.templates[:1])).where("region = 'same text'").first()
    assert (alone.combined, alone.margin) == (10000, 10000)


def test_many_lines_are_cut_and_compared(spark):
    """Offsets and values over many lines; the scores of whole lines go with their length."""
    texts = spark.range(8).select(F.repeat(F.concat(F.lit(" ab c "), "id", F.lit(" \r\n\n")), 300_000).alias("text"))
    began = time.time()
    r = T.with_lines(texts, "text").select(F.size("lines").alias("n"), F.element_at("lines", -1).alias("x")).agg(F.sum("n").alias("n"), F.max("x.start").alias("start"), F.max("x.value").alias("value")).first()
    assert (r.n, r.start, r.value) == (2_400_000, 11 * 299_999 + 1, "ab c 7") and time.time() - began < 20
    line, many = F.concat(F.repeat(F.lit("ab cd efg "), 40), F.col("id")), spark.range(20_000)
    began = time.time()
    for score in (T.levenshtein, T.ratio, T.token_sort_ratio, T.token_set_ratio):
        assert many.select(score(line, F.lit("the and attion to thanedble the, anea. eriner thanea.")).alias("v")).where("v is not null").count() == 20_000
    assert time.time() - began < 20


def test_nfkc_goes_to_python_in_small_batches(spark):
    """A hundred texts at once, not the ten thousand of an Arrow batch."""
    plan = spark.createDataFrame([("ＡＢ",), ("ab",), (None,)], "a string").select(T.nfkc(F.col("a")).alias("v"))
    assert [r.v for r in plan.collect()] == ["AB", "ab", None] and "BatchEvalPython" in plan._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 3, 4])
def test_scores_of_a_batch_are_those_of_its_pairs(monkeypatch, n):
    """Views shorter and longer than templates, in small blocks and parts; no pattern but the template's is prepared."""
    draw, size = random.Random(n), [0, 3, 30, 90]
    text = lambda k: "".join(draw.choices(draw.choice(("ab é公😀", "the and sch der. ")), k=draw.randint(0, k)))
    views, templates = [text(draw.choice(size)) for _ in range(80)], ["", "x", "the and sch", text(64), text(90)]
    monkeypatch.setattr(S, "WIDE", 40)
    monkeypatch.setattr(S, "BLOCK", 7)
    monkeypatch.setattr(S, "VIEWS", 900)
    for t, found in zip(templates, S.scores(views, templates, n)):
        many, words, mine = [t] * len(views), list(map(S.tokens, views)), [S.tokens(t)] * len(views)
        plain_ones = [S.ratios(views, many), S.partial_ratios(views, many), S.token_sort_ratios(words, mine), S.token_set_ratios(words, mine), S.jaccards((S.grams(v, n), S.grams(t, n)) for v in views)]
        assert found.tolist() == [x.tolist() for x in plain_ones]
    assert S.scores([], templates, n).shape == (5, 5, 0)
    monkeypatch.setattr(S, "_masks", lambda patterns, *rest: pytest.fail("a pattern a view"))
    S.scores(["der", "und er", "und der schnelle text"], ["the and sch"], n)


def records(spark, texts, **more):
    rows = [(str(i), "ds", "f", i, t, *(v[i] for v in more.values())) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(["record_id string, dataset_id string, source_file string, source_offset long, raw_text string", *(f"{k} string" for k in more)])).withColumn("clean_text", F.lit(None).cast("string"))


NOISY = ["The and attion to thanedble the, anea. Eriner thanea.\nbody one", "The and atttion to thanedble the, anea. Eriner\nbody\nAll rights reserved.", "Nciht aulihc xq für sch erüver enau sch der.\nbody\n\n x", "", "one line", "All rights reserved.", "In short\nAll rights reserved.\nAll rights reserved. And more than sixty-four characters follow here, on and on."]


def test_decisions_need_no_shuffle(spark):
    """Regions are cut once and decided beside their text: no join, no grouping of regions."""
    rows = records(spark, [*NOISY, None, NOISY[0]])
    for made in (Z.decisions(rows, FUZZY), Z.resolved(rows, FUZZY), Z.fuzzy_clean(rows, FUZZY), Z.fuzzy_events(rows, FUZZY), Z.outcomes(rows, FUZZY)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and plan.count("ArrowEvalPython") == 2
    held = {r.record_id: r for r in Z.fuzzy_clean(rows, FUZZY).collect()}
    assert len(held) == 9 and held["0"].clean_text == held["8"].clean_text == "body one" and held["0"].decisions == held["8"].decisions
    assert held["4"].decisions is None and held["3"].decisions is None and held["7"].decisions is None and held["5"].decisions[0].gates.regex
    every = [(r.record_id, r.start, r.decision) for r in Z.decisions(rows, FUZZY).collect()]
    assert every and all((k, d.start, d.decision) in every for k, r in held.items() for d in r.decisions or [])


def test_grid_is_the_outcomes_of_each_pair(spark):
    cases = records(spark, NOISY, expected=["applied", "review", "review", "skipped", "skipped", "applied", "skipped"])
    grid = Z.threshold_grid(cases, FUZZY, [8000, 9000, 9500], [1000, 6000, 8500])
    assert grid.count() == 8
    for r in grid.collect():
        made = [(x.expected, x.actual) for x in Z.outcomes(cases, Z.with_thresholds(FUZZY, r.auto, r.review)).collect()]
        assert all(r[f"{e}_{a}"] == made.count((e, a)) for e in Z.LABELS for a in Z.LABELS)


def test_matching_views_follow_the_former_expressions(spark):
    texts = [" A\t\x1cB :  c | D　\x85", "ＡＢ： ＣＤ", "İÄ ß", " x\u2003y\u180ez", "", ": |", "a\u200b b", None] * 20
    for normalise, lower, collapse in ((True, True, True), (False, True, True), (True, False, False), (False, False, True)):
        v = T.nfkc(F.col("a")) if normalise else F.col("a")
        v = F.translate(v, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if lower else v
        v = F.regexp_replace(T.strip(F.regexp_replace(v, rf"[{T.WS}]+", " ")), r" *([:|]) *", "$1") if collapse else v
        got = spark.createDataFrame([(t,) for t in texts], "a string").coalesce(1).select(v.alias("v"), T.matching_view(F.col("a"), normalise, lower, collapse).alias("w")).collect()
        assert len(got) == 160 and all(r.v == r.w for r in got)


def test_lines_are_not_shuffled(spark, tmp_path):
    """Values of lines go to the shuffle, once, and lines to Python in matching form; equal lines come out once."""
    texts = ["a b: c\nThe  end\na b: c", "The  end\n\n", "", None, "the end"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("fuzzy_partial_ratio", "fuzzy_token_set", "fuzzy_token_sort", "fuzzy_levenshtein", "fuzzy_ratio"):
        made = QUERIES[name](spark, str(tmp_path))
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(line_sha") == plan.count("Exchange") == 1 and "regexp_replace" not in plan
        assert made.count() == 3
