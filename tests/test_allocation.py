"""Quotas against plain Python: random capacities, ties, products beyond 64 bits, many ranges; no plan gathers the strata."""

import random

import pytest

from lexmill.operators import records as R
from lexmill.operators import sampling as S


def largest_remainder(caps, target):
    total = sum(caps.values())
    if not total:
        return dict.fromkeys(caps, 0)
    quota = {k: target * c // total for k, c in caps.items()}
    for k in sorted(caps, key=lambda k: (-(target * caps[k] % total), k))[: target - sum(quota.values())]:
        quota[k] += 1
    return quota


def equal(caps, target):
    level = next(n for n in range(max(caps.values()), -1, -1) if sum(min(c, n) for c in caps.values()) <= target)
    quota = {k: min(c, level) for k, c in caps.items()}
    for k in sorted(k for k, c in caps.items() if c > level)[: target - sum(quota.values())]:
        quota[k] += 1
    return quota


def minimum(caps, target, least):
    base = {k: min(c, least) for k, c in caps.items()}
    more = largest_remainder({k: caps[k] - base[k] for k in caps}, target - sum(base.values()))
    return {k: base[k] + more[k] for k in caps}


def quotas(spark, caps, target, method, least=0):
    rows = spark.createDataFrame(list(caps.items()), "stratum string, population long").repartition(3)
    got = S.allocate(rows, S.SamplePlan("p", target, 0, ("dataset_id",), method, least))
    assert got.columns == ["stratum", "population", "quota"]
    return {r.stratum: r.quota for r in got.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_random_capacities(spark, monkeypatch, seed):
    monkeypatch.setattr(S, "STEP", (2, 3, 7, 1024)[seed])
    rng = random.Random(seed)
    caps = {f"s{k:03}": rng.choice((1, 1, 2, 5, rng.randint(1, 300))) for k in range((1, 2, 17, 400)[seed])}
    total = sum(caps.values())
    for target in sorted({rng.randint(1, total), total if seed else 1}):
        assert quotas(spark, caps, target, "proportional") == largest_remainder(caps, target)
        assert quotas(spark, caps, target, "equal") == equal(caps, target)
        if sum(min(c, 1) for c in caps.values()) <= target:
            assert quotas(spark, caps, target, "minimum_then_proportional", 1) == minimum(caps, target, 1)


def test_many_strata_of_one_size(spark):
    """All remainders tie: the keys' order decides, over many ranges."""
    caps = {f"größe {k:05}": 3 for k in range(5000)}
    for target in (4999, 12345):
        assert quotas(spark, caps, target, "proportional") == largest_remainder(caps, target)
        assert quotas(spark, caps, target, "equal") == equal(caps, target)


def test_products_beyond_64_bits(spark):
    caps = {"a": 4 * 10**18, "b": 10**18 + 7, "c": 3}
    target = 2 * 10**18 + 1
    assert quotas(spark, caps, target, "proportional") == largest_remainder(caps, target)
    half = (target - 3) // 2  # above "c", below "b"
    assert quotas(spark, caps, target, "equal") == {"a": half, "b": half, "c": 3}
    with pytest.raises(R.ProcessingError):
        S.allocate(spark.createDataFrame([], "stratum string, population long"), S.SamplePlan("p", 1, 0, ("dataset_id",), "equal"))


def test_samples_are_equal_with_and_without_a_broadcast(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("cast(id as string) as record_id", "case when id % 3 > 0 then 'hot' else concat('d', id % 7) end as dataset_id", "'x' as raw_text")
    plan = S.SamplePlan("p", 60, 5, ("dataset_id",), "equal")
    got = [tuple(r) for r in S.sample(rows, plan).select("record_id", "stratum").collect()]
    monkeypatch.setattr(S, "BROADCAST_KEYS", 0)
    assert got == [tuple(r) for r in S.sample(rows, plan).select("record_id", "stratum").collect()] and len(got) == 60
