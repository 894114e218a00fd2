"""Rows with null or repeated doc_ids, clashing columns and large clusters, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.llm import components, near_dedup, scratch
from tests.llm.test_llm import docs, edited, prose, shingles


@pytest.mark.parametrize("seed", range(3))
def test_components_equal_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(500, 700)]
    sets = components.Union()
    for u, v in edges:
        sets.join(u, v)
    want = {x: sets.root(x) for u, v in edges if u != v for x in (u, v)}
    own = scratch.Scratch(spark, "test")
    got = components.connected_components(spark.createDataFrame(edges, "u long, v long").repartition(5), own)
    assert {r.node: r.component for r in got.collect()} == want
    assert components.connected_components(spark.createDataFrame([], "u long, v long"), own).count() == 0


@pytest.mark.parametrize("bound, tables", [(200_000, 2), (200, 2), (199, 5), (0, 5)])
def test_few_edges_are_joined_in_one_task_and_more_in_rounds(spark, monkeypatch, bound, tables):
    """A path of 201 nodes, and loops: two tables are written up to the bound, and beyond it two or more rounds."""
    monkeypatch.setattr(components, "ONE_TASK_EDGES", bound)
    edges = [(k, k + 1) for k in range(200)] + [(7, 7), (900, 900)]
    random.Random(5).shuffle(edges)
    own = scratch.Scratch(spark, "test")
    got = components.stars(spark.createDataFrame(edges, "u long, v long").repartition(4), own)
    assert sorted((r.node, r.component) for r in got.collect()) == [(k, 0) for k in range(1, 201)]
    assert own.n == tables if tables == 2 else own.n >= tables
    assert got.facts["n"] == 200


def brute(texts, ids, percent):
    """(n_shingles, smallest id of the component, or None) by row."""
    sets, joined = [shingles(t) for t in texts], components.Union()
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                joined.join(i, j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[joined.root(i)] = min(x, least.get(joined.root(i), x))
    return [(len(sets[i]), least.get(joined.root(i)) if sets[i] else ids[i], joined.root(i)) for i in range(len(texts))]


def test_near_duplicates_of_large_clusters_part_by_part(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PART_BYTES", 1 << 18)
    base = [prose(90) for _ in range(4)]
    texts = [edited(b, k) for b in base for k in (0, 1, 2, 3, 4, 5) for _ in range(14)]
    want = brute(texts, list(range(len(texts))), 85)
    got = near_dedup.near_duplicates(docs(spark, texts), 0.85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: w[:2] for i, w in enumerate(want)}


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a, b, c = prose(80), prose(80), prose(80)
    texts = [a, b, a, c, edited(b, 1), edited(c, 1), c, a, None, "", b + " "]
    ids = [1, 1, 2, 3, None, 4, None, 1, None, 7, 9]
    want = brute(texts, ids, 80)
    rows = docs(spark, texts, ids).withColumn("own", F.expr("0")).select("*")
    table = scratch.Scratch(spark, "test").save(docs(spark, texts, ids))
    for df in (rows, table):
        own = scratch.Scratch(spark, "test")
        numbered = scratch.numbered(df, own, "number")
        found = near_dedup.near_duplicates(numbered, 0.8, "number").join(numbered.select("number", "text"), F.col("row") == F.col("number")).collect()
        assert sorted((r.doc_id or 0, r.text or "", r.n_shingles, r.component_id or 0) for r in found) == sorted((x or 0, t or "", n, m or 0) for x, t, (n, m, _) in zip(ids, texts, want))
        stays = sorted((r.doc_id or 0, (r.text or "")) for r in found if r.stays)
        assert stays == sorted([(1, a), (1, b), (3, c), (0, ""), (7, "")])


def test_numbers_are_unique_and_stay(spark):
    own = scratch.Scratch(spark, "test")
    table = own.save(docs(spark, [str(i) for i in range(200)]))
    rows = scratch.numbered(table, own)
    first, again = ({r.doc_id: r.row for r in rows.repartition(n).collect()} for n in (2, 7))
    assert first == again and len(set(first.values())) == 200


@pytest.fixture
def tables(spark, tmp_path):
    good = [prose(80) for _ in range(60)]
    bad = [" ".join(w + "###" for w in prose(60).split()) for _ in range(25)]
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(85)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    item = prose(30)
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), good, bad, item


def test_stages_judge_rows_not_ids(spark, tables):
    import corpus_pipeline as p

    d, good, bad, item = tables
    leak = f"{prose(40)} {item} {prose(40)}"
    odd = [(100, bad[7]), (100, good[8]), (None, bad[1]), (None, good[9]), (None, leak), (8, leak), (8, prose(50))]
    rows = [*enumerate(good + bad), *odd]
    clash = spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], "doc_id long, text string, id long, _sha string, row long, `row number` long")

    def left(df):
        assert df.columns == clash.columns
        return sorted((r.doc_id or 0, r.text) for r in df.collect())

    after = p.quality(spark, clash, d)
    assert left(after) == sorted((i or 0, t) for i, t in rows if "###" not in t)
    after = p.exact_dedup(spark, after, d)
    assert left(after) == sorted([*enumerate(good), (8, leak), (8, odd[-1][1])])
    after = p.near_dedup(spark, after, d)
    assert len(left(after)) == 62
    assert left(p.decontamination(spark, after, d)) == sorted([*enumerate(good), (8, odd[-1][1])])
