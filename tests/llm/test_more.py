"""Licence texts of further families, extendible hashing against brute force, the language model against a plain one, recall of decontamination."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, licenses, lm_score, quality, sharding
from tests.llm.test_llm import TEXTS, docs, prose, words

LICENCES = {
    "SPDX-License-Identifier: MIT\nint x;": "MIT",
    "// SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0",
    "SPDX-License-Identifier: LGPL-2.1-only": "LGPL-2.1",
    "This code is released under the MIT License.": "MIT",
    " ".join(licenses.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")): "BSD-3-Clause",
    " ".join(licenses.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary")): "BSD-2-Clause",
    "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.": "LGPL-2.1",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "GPL-2.0",
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.": "MPL-2.0",
    "This is free and unencumbered software released into the public domain.": "Unlicense",
    "you may obtain a licence somewhere. the licenses are many.": "",
}


def test_licence_families(spark):
    texts = list(LICENCES)
    got = {r.doc_id: r.licenses for r in licenses.license_scan(docs(spark, [*texts, "Foo. " * 50000 + texts[3]])).collect()}
    assert [got[i] for i in range(len(texts))] == list(LICENCES.values()) and got[len(texts)] == "MIT"


@pytest.mark.parametrize("limit", [4000, 700, 150])
def test_only_oversized_buckets_split(spark, limit):
    r = random.Random(limit)
    texts = ["x" * r.randrange(0, 300) for _ in range(400)] + ["same"] * 200
    ids = [*range(400), *[9000] * 200]
    rows = docs(spark, texts, ids).withColumn("hash", F.xxhash64("doc_id", "text"))
    bits = [(format(x.hash % 2**64, "064b"), len(x.text)) for x in rows.select("hash", "text").collect()]

    def split(some, prefix):
        if sum(n for _, n in some) <= limit or len({b for b, _ in some}) <= 1:
            return [(prefix, len(some))] if some else []
        return [x for c in "01" for x in split([s for s in some if s[0][len(prefix)] == c], prefix + c)]

    got = sharding.shards(docs(spark, texts, ids), limit).collect()
    assert Counter(r.shard for r in got) == dict(split(bits, ""))
    size, n = Counter(), Counter()
    for x in got:
        size[x.shard, x.page] += x.n_bytes
        n[x.shard, x.page] += 1
    assert all(b <= limit or n[k] == 1 for k, b in size.items())


def plain_scores(texts, held):
    """Scores by dictionaries, with the same hashes, levels and filters."""
    block = lambda t: lm_score.tokens(*(lambda b: (b[2], b[3]))(next(iter(lm_score.blocks(pa.array([t]))))))
    every = [block(t) for t in texts]
    counts = [Counter(), Counter()]
    for (w, p, _), out in zip(every, held):
        if not out:
            counts[0].update(w.tolist()), counts[1].update(p.tolist())
    filters = []
    for c, base in zip(counts, (lm_score.WORD_BASE, lm_score.PAIR_BASE)):
        keys = np.array(sorted(c), np.uint64)
        level = lm_score.levels(np.array([c[k] for k in keys.tolist()]), base)
        where = (keys >> lm_score._SHIFT).astype(int)
        parts = [lm_score.segment(keys[where == r], level[where == r]) if (where == r).any() else np.zeros(0, np.uint64) for r in range(lm_score.RANGES)]
        filters.append(lm_score.Filter(np.array([len(p) for p in parts]), np.concatenate(parts), base, np.array([level[where == r].max(initial=0) for r in range(lm_score.RANGES)])))
    once, twice = (sum(v == k for v in counts[0].values()) for k in (1, 2))
    discount = min(0.9, once / max(1, once + 2 * twice) or 0.5)
    total = sum(lm_score.level_counts(lm_score.WORD_BASE)[lm_score.levels(np.array([v]), lm_score.WORD_BASE)[0]] for v in counts[0].values())
    out = []
    for w, p, _ in every:
        score, before = 0.0, float(sum(not h for h in held))
        for a, b in zip(w, p):
            c = filters[0].counts(np.array([a]))[0]
            uni = (c - discount) / total if c else discount * len(counts[0]) / total
            pair = min(filters[1].counts(np.array([b]))[0], before) if c else 0.0
            score += math.log10((pair + lm_score.KAPPA * uni) / (before + lm_score.KAPPA))
            before = c
        out.append(score)
    return out


def test_scores_equal_a_plain_model_by_either_way(spark):
    first, again = ({r.doc_id: r for r in lm_score.lm_scores(docs(spark), limit).collect()} for limit in (1 << 30, 0))
    assert first == again
    want = plain_scores([t or "" for t in TEXTS], [first[i].held_out for i in range(len(TEXTS))])
    assert all(abs(first[i].score - want[i]) < 1e-6 * max(1, abs(want[i])) for i in first)


def test_more_ranges_give_the_same_counts(spark, monkeypatch):
    before = {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in lm_score.lm_scores(docs(spark)).collect()}
    monkeypatch.setattr(lm_score, "RANGE_BYTES", 20)
    for limit in (1 << 30, 0):
        assert {r.doc_id: (r.n_known, round(r.base_score, 6)) for r in lm_score.lm_scores(docs(spark), limit).collect()} == before


def test_lm_repeated_rows_count_each_time(spark):
    texts = ["a b a", "a b a", "c"]
    ids = [1, 1, 2]
    got = lm_score.lm_scores(docs(spark, texts, ids)).collect()
    held = {r.doc_id: r.held_out for r in got}
    assert len(got) == 3 and got[0].train_tokens == sum(len(words(t)) + 1 for t, i in zip(texts, ids) if not held[i])


def changed(item, share, r):
    w = item.split(" ")
    for k in r.sample(range(len(w)), round(share * len(w))):
        w[k] = f"other{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize(("share", "least"), [(0.0, 1.0), (0.1, 0.95), (0.2, 0.9)])
def test_decontamination_recall_against_brute_force(spark, share, least):
    r = random.Random(int(share * 10))
    items = [prose(r.randint(20, 60)) for _ in range(60)]
    texts = [f"{prose(r.randint(0, 120))} {changed(t, share, r)} {prose(r.randint(0, 120))}" for t in items * 2] + [prose(150) for _ in range(30)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    number = {w: i for i, w in enumerate({w for t in [*texts, *items] for w in words(t)})}
    coded = [[number[w] for w in words(t)] for t in texts]
    want = set()
    for j, t in enumerate(items):
        item = [number[w] for w in words(t)]
        reach = len(item) + len(item) // 2
        for i, d in enumerate(coded):
            if len(set(item) & set(d)) >= decontaminate.COVER * len(set(item)) and any(decontaminate.covered(item, d[s : s + reach], decontaminate.COVER) for s in range(max(1, len(d) - reach + 1))):
                want.add((i, j))
    got = {(x.doc_id, x.item_id) for x in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got <= want and len(got) >= least * len(want) and len(want) >= 110


def test_decontamination_in_parts_finds_the_same(spark, monkeypatch):
    items = [prose(30) for _ in range(12)]
    texts = [f"{prose(50)} {t} {prose(20)}" for t in items] + [None, ""]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = sorted(map(tuple, decontaminate.contaminated(docs(spark, texts), bench).collect()))
    monkeypatch.setattr(decontaminate, "PART_PASSAGES", 5)
    assert sorted(map(tuple, decontaminate.contaminated(docs(spark, texts), bench).collect())) == want and len(want) == 12


def test_quality_of_repeated_ids_long_texts_and_a_small_sample(spark, monkeypatch):
    monkeypatch.setattr(quality, "FIT_ROWS", 120)
    good, bad = [prose(60) for _ in range(150)], [" ".join(w + "###" for w in prose(60).split()) for _ in range(150)]
    texts = [*good, *bad, "###! " * 40000, prose(20000), good[0]]
    ids = [*range(300), 400, 401, 400]
    labels = spark.createDataFrame([(i, int(i < 150), "x") for i in range(300)], "doc_id long, quality int, text string")
    got = quality.quality_scores(docs(spark, texts, ids), labels).collect()
    assert len(got) == 303 and sum(r.predicted == (r.doc_id < 150) for r in got if r.doc_id < 300) >= 297
    assert 1 in [r.predicted for r in got if r.doc_id == 400] and len({r.score for r in got if r.doc_id == 400}) == 2 and all(0 <= r.score <= 1 for r in got)


def test_shards_are_written_row_by_row(spark, tmp_path):
    """Null, repeated and clashing rows: what goes in comes out, as often, and each folder keeps to the limit."""
    texts = ["same"] * 7 + [None, "", "x" * 900, *(f"text {k} " * (k % 9) for k in range(60))]
    ids = [7, 7, 7, None, None, 8, 9, None, 1, 2, *range(100, 160)]
    df = docs(spark, texts, ids)
    sharding.write_shards(df, str(tmp_path / "out"), 300)
    back = spark.read.parquet(str(tmp_path / "out"))
    key = lambda d: Counter(tuple(r) for r in d.select("doc_id", "text", "component_id", "name", "key", "v").collect())
    assert key(back) == key(df)
    size = Counter()
    for r in back.collect():
        size[r.shard, r.page] += len((r.text or "").encode())
    assert len(size) > 5 and all(n <= 300 or n == 900 for n in size.values())
    df.write.parquet(str(tmp_path / "in"))
    sharding.write_shards(spark.read.parquet(str(tmp_path / "in")), str(tmp_path / "again"))
    again = spark.read.parquet(str(tmp_path / "again"))
    assert key(again) == key(df) and {r.shard for r in again.collect()} == {"b"}
    with pytest.raises(ValueError):
        sharding.write_shards(df.withColumn("page", df.v), str(tmp_path / "no"))


NAME = licenses.SENTENCES["bsd-name"]
BSD = " ".join(licenses.SENTENCES[k] for k in ("bsd-grant", "bsd-source", "bsd-binary"))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"{BSD} {NAME.replace('the copyright holder', 'Acme & Sons, Inc.').replace('nor the names', 'nor the names')}", "BSD-3-Clause"), (f"{BSD} {NAME.replace('the copyright holder', 'the University of Somewhere')}", "BSD-3-Clause"),
        (f"{BSD} The name of John Q Public may not be used to endorse or promote products derived from this software without specific prior written permission.", "BSD-3-Clause"), (BSD, "BSD-2-Clause"),
        ("// SPDX-License-Identifier: MIT OR Apache-2.0\n", "Apache-2.0,MIT"), ("# SPDX-License-Identifier: (MIT AND BSD-3-Clause)", "BSD-3-Clause,MIT"), ("/* SPDX-License-Identifier: GPL-2.0+ */", "GPL-2.0"), ("SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0", "GPL-2.0"),
        ("SPDX-License-Identifier: MPL-1.1", "MPL-1.1"), ("SPDX-License-Identifier: BSL-1.0", "BSL-1.0"), ("SPDX-License-Identifier: no-such-thing OR also-none", ""), ("Licensed under either of Apache License, Version 2.0 or MIT license at your option.", "Apache-2.0,MIT"),
        ("", ""), (None, ""),
    ],
)
def test_slots_and_expressions(spark, text, want):
    rows = [text, text, "Foo bar. " * 60_000 + (text or "")]
    got = licenses.license_scan(docs(spark, rows, [None, 5, 5])).collect()
    assert [r.licenses for r in got] == [want] * 3
