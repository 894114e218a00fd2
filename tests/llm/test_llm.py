import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from lexmill.llm import bpe, decontaminate, exact_dedup, licenses, lm_score, near_dedup, pii, quality, sharding, url_filter

rnd = random.Random(5)
VOCABULARY = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(600)]
WS = r"[\x20\x09-\x0D]+"


def prose(n):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def edited(text, k):
    w = text.split(" ")
    for _ in range(k):
        w[rnd.randrange(len(w))] = rnd.choice(VOCABULARY)
    return " ".join(w)


BASE = prose(120)
TEXTS = [None, "", " \n\t", "one two", "ONE  two", "a", BASE, BASE.upper(), BASE + "\n", *(edited(BASE, k) for k in (1, 1, 2, 2, 3, 5, 9)), *(prose(rnd.randint(1, 60)) for _ in range(30)), prose(9000), "Ünïcode 😀 " * 7, "x" * 40000]
SCHEMA = "doc_id long, text string, component_id string, name string, key string, v long"


def docs(spark, texts=TEXTS, ids=None):
    rows = [(i if ids is None else ids[i], t, "c", None, "k", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(t):
    low = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in re.split(WS, low) if w]


def shingles(t, n=5):
    w = words(t)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_near_duplicates_equal_brute_force(spark):
    sets = [shingles(t) for t in TEXTS]
    above = list(range(len(TEXTS)))

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for i in range(len(TEXTS)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                above[max(a, b)] = min(a, b)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs(spark), 0.85).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), root(i), root(i) == i) for i in range(len(TEXTS))}


def test_odd_sketch_estimates():
    a = np.random.default_rng(1).integers(0, 1 << 32, (1, near_dedup.K), dtype=np.uint32)
    b = a.copy()
    b[0, :12] += np.uint32(1)
    x, y = near_dedup.odd_sketches(a), near_dedup.odd_sketches(b)
    odd = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
    m = near_dedup.SKETCH_BITS
    assert abs(1 + math.log(1 - 2 * odd / m) * (m / 2) / (2 * near_dedup.K) - (1 - 12 / near_dedup.K)) < 0.04


def test_exact_duplicates(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BLOCK", 4096)
    texts = [*TEXTS, "y " * 30000 + "end", "y " * 30000 + "end ", "y  " * 30000 + "end"]
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[re.sub(WS, " ", t or "")].append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(k.encode()).hexdigest()) for k, g in groups.items() for i in g}
    got = exact_dedup.exact_duplicates(docs(spark, texts)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(texts)


def test_exact_duplicates_of_nulls_and_repeated_rows(spark):
    got = exact_dedup.exact_duplicates(docs(spark, ["a", "a", "a", "b"], [None, 4, 4, None])).collect()
    assert sum(r.kept for r in got) == 2 and {(r.keep_id, r.group_size) for r in got} == {(4, 3), (None, 1)}


RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize(("size", "overlap"), [(32768, 1024), (64, 24), (200, 8)])
def test_bpe(spark, size, overlap):
    import tiktoken

    texts = [*TEXTS[:-1], "a\n\n\n  b \t\t c" * 40, " " * 300 + "z", "don't 12345 we'll!! \r\n\r\n" * 30]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for i, t in enumerate(texts):
        ids = e.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    got = bpe.encode_decode(docs(spark, texts), RANKS, P.PATTERN, size, overlap).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want and len(got) == len(texts)


@pytest.mark.parametrize("limit", [10**6, 0])
def test_lm(spark, limit):
    token = {i: [*words(t), None] for i, t in enumerate(TEXTS)}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in token}
    c = Counter(w for i, ws in token.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in lm_score.lm_scores(docs(spark), limit).collect()}
    assert set(got) == set(token)
    for i, r in got.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in token[i])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(token[i]), sum(c[w] > 0 for w in token[i]), n)
        assert abs(base - r.base_score) < 1e-6 * abs(base) and r.score <= 0


def test_filter_has_no_false_negatives():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2))
    counts = np.random.default_rng(3).integers(1, 60, len(keys))
    where = (keys >> lm_score._SHIFT).astype(int)
    parts = {r: lm_score.segment(keys[where == r], lm_score.levels(counts[where == r], 1.5), 9).tobytes() for r in set(where.tolist())}
    f = lm_score.Filter(np.array([len(parts.get(r, b"")) // 8 for r in range(lm_score.RANGES)]), b"".join(parts.get(r, b"") for r in range(lm_score.RANGES)), 1.5)
    exact = lm_score.level_counts(1.5)[lm_score.levels(counts, 1.5)]
    got = f.counts(keys)
    assert (got >= exact).all() and (got == exact).mean() > 0.85
    fresh = np.random.default_rng(4).integers(0, 1 << 63, 20000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    assert (f.counts(fresh) > 0).mean() < 0.12


def test_filter_levels_end_at_the_highest_stored():
    keys = np.random.default_rng(6).integers(0, 1 << 63, 200, dtype=np.uint64)
    full = np.full(lm_score.RANGES, 2**64 - 1, np.uint64).tobytes()
    f = lm_score.Filter(np.ones(lm_score.RANGES, np.int64), full, 1.5, 3)
    assert (f.counts(keys) == lm_score.level_counts(1.5)[3]).all()


def test_decontamination(spark):
    items = [prose(40) for _ in range(12)] + [prose(14)]
    para = items[1].split(" ")
    for k in (3, 11, 19, 27, 33):
        para[k] = rnd.choice(VOCABULARY)
    del para[7]
    texts = [prose(200), f"{prose(90)} {items[0].upper()} {prose(70)}", f"{prose(33)}\n{' '.join(para)} {prose(50)}", items[12], None, "", prose(2000) + " " + items[5], " ".join(sorted(items[2].split(" ")))]
    bench = spark.createDataFrame([*enumerate(items), (98, None), (99, "too short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got == {(1, 0), (2, 1), (3, 12), (6, 5)}
    assert decontaminate.contaminated(docs(spark, texts), bench.where("item_id > 90")).count() == 0


def test_decontamination_finds_copies_among_other_benchmark_words(spark):
    items = [" ".join(f"w{k}x{i}" for i in range(16)) for k in range(60)]
    texts = [" ".join(items[k : k + 5]) for k in range(0, 60, 5)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(spark, texts), bench).collect()}
    assert got == {(k // 5, k) for k in range(60)}


@pytest.mark.parametrize("n", [8, 16, 40])
def test_decontamination_at_document_ends(spark, n):
    item = " ".join(f"e{i}" for i in range(n))
    texts = [" ".join([*(f"f{i}" for i in range(k)), item]) for k in range(2 * n + 1)]
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    assert {r.doc_id: r.coverage for r in decontaminate.contaminated(docs(spark, texts), bench).collect()} == dict.fromkeys(range(len(texts)), 1.0)


def test_lcs():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        out = [0]
        for j, y in enumerate(b):
            out.append(row[j] + 1 if x == y else max(row[j + 1], out[j]))
        return out

    for _ in range(100):
        a, b = ([rnd.randrange(5) for _ in range(rnd.randint(1, 20))] for _ in "ab")
        assert decontaminate.lcs(a, b) == plain(a, b)


def test_urls(spark):
    urls = ["HTTP://A.Example.COM/en/1?q#f", "http://www.example.com/en/x", "http://x.net/es/1", "http://net/fr/", "http://xnet/es/1", "http://x.org", None, "no scheme", "http://h?x://y/z", "a://b://c/d", "http://x.net/es"]
    got = {r.page_id: r for r in url_filter.url_verdicts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    assert [(got[i].host, got[i].path) for i in range(len(urls))] == [("a.example.com", "/en/1"), ("www.example.com", "/en/x"), ("x.net", "/es/1"), ("net", "/fr/"), ("xnet", "/es/1"), ("x.org", ""), ("", ""), ("", ""), ("h", ""), ("b:", "//c/d"), ("x.net", "/es")]
    assert [got[i].rule for i in range(5)] == ["example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None]
    assert [got[i].verdict for i in range(7)] == ["block", "allow", "block", "block", "allow", "allow", "allow"]


def test_url_templates_merge_and_learn(spark):
    rows = [f"http://s.net/{lang}/{k}" for lang in ("es", "fr") for k in range(40)] + [f"http://s.net/en/{k}.html" for k in range(9)]
    got = url_filter.url_verdicts(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")).collect()
    assert {r.template for r in got if r.rule} == {"/*/{n}"} and {(r.template, r.verdict) for r in got if not r.rule} == {("/en/{n}.html", "allow")}


def test_licenses(spark):
    s = licenses.SENTENCES
    texts = ["x\nReleased under the MIT License.\ny", "Foo. LICENSED under the  Apache License, Version 2.0. Bar", f"{s['bsd-grant']} {s['bsd-source']} {s['bsd-binary']}", f"{s['bsd-source']} {s['bsd-grant']}", s["mit-grant"].replace(" to use,", "\nto use,") + f"\n{s['mit-notice']}\n{s['mit-as-is']}", "All rights reserved?", "licensed", None, ""]
    got = {r.doc_id: r.licenses for r in licenses.license_scan(docs(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == ["MIT", "Apache-2.0", "BSD-2-Clause", "", "MIT", "proprietary", "", "", ""]


def test_every_known_sentence_and_rule_is_found_in_its_own_text(spark):
    names = list(licenses.SENTENCES)
    rules = [(name, rule) for name, some in licenses.RULES.items() for rule in some]
    plain = [*licenses.SENTENCES.values(), *(" ".join(licenses.SENTENCES[k] for k in rule) for _, rule in rules)]
    for texts in (plain, [re.sub(r"(\S+ \S+ \S+) ", r"\1\n", t) for t in plain]):
        got = {r.doc_id: r for r in licenses.license_scan(docs(spark, texts)).collect()}
        for i, k in enumerate(names):
            assert {re.sub(r"(apache-head|gpl-free|gpl-hope)-\d$", r"\1", x) for x in got[i].sentences.split(",")} == {k}
        for i, (name, _) in enumerate(rules, len(names)):
            assert name in got[i].licenses.split(",")


def test_quality(spark):
    good, bad = [prose(60) for _ in range(150)], [" ".join(w + "###" for w in prose(60).split()) for _ in range(50)]
    d = docs(spark, [*good, *bad, None, ""])
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_scores(d, labels).collect()}
    assert len(got) == 202 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert all(got[i].predicted == (i < 150) for i in range(200)) and {i for i, r in got.items() if r.held_out} == {i for i in got if zlib.crc32(str(i).encode()) % 5 == 0}
    assert quality.quality_scores(d, labels.limit(0)).count() == 202


def test_sharding(spark):
    for limit in (10**9, 20000, 300):
        rows = sharding.shards(docs(spark, [*TEXTS, *["same"] * 400], [*range(len(TEXTS)), *[7] * 400]), limit).collect()
        size, n = Counter(), Counter()
        for r in rows:
            size[r.shard, r.page] += r.n_bytes
            n[r.shard, r.page] += 1
            assert r.depth == len(r.shard)
        assert len(rows) == len(TEXTS) + 400 and all(b <= limit or n[k] == 1 for k, b in size.items())
        shards = {r.shard for r in rows}
        assert not any(a != b and b.startswith(a) for a in shards for b in shards)


def test_pii(spark):
    texts = ["mail Ann.B@Mail.example.com, ann.b@mail.EXAMPLE.com and 10.1.2.3.", "card 4111 1111 1111 1111 or 4111111111111111; +1 (555) 010-9999", 'password=abc12345 token = "00ffaa9911"', "Frau Musterfrau met Mr. Smith and Mrs Smith", None, "", "nothing 12", "Mr. Smith again"]
    got = {r.doc_id: r for r in pii.replace_pii(docs(spark, texts), "k").collect()}
    new = [got[i].text for i in range(len(texts))]
    assert new[4:7] == texts[4:7] and [got[i].n_mentions for i in range(8)] == [3, 3, 2, 3, 0, 0, 0, 1]
    a, b = re.findall(r"\S+@\S+?(?=[ ,])", new[0])
    assert a.lower() == b.lower() != "ann.b@mail.example.com" and a[0].isupper() and a.endswith(".com") and "10.1.2.3." not in new[0]
    spaced, plain = re.search(r"card (\S+ \S+ \S+ \S+) or (\d+);", new[1]).groups()
    digits = [int(c) for c in plain]
    assert spaced.replace(" ", "") == plain and plain[0] == "4" and sum(sum(divmod(d * 2, 10)) if k % 2 == 0 else d for k, d in enumerate(digits)) % 10 == 0
    assert re.fullmatch(r"password=[a-z]{3}\d{5}", new[2].split(" ")[0]) and "abc12345" not in new[2]
    m, f = re.search(r"Mr\. (\w+) and Mrs (\w+)", new[3]).groups()
    assert m != "Smith" and m.endswith("o") and f.endswith("a") and new[7] == f"Mr. {m} again"


def test_pii_of_letters_only_secrets(spark):
    texts = ["the password=correcthorse works", 'a token : "correcthorse" here', "the password is correct"]
    got = {r.doc_id: r for r in pii.replace_pii(docs(spark, texts), "k").collect()}
    assert [got[i].n_mentions for i in range(3)] == [1, 1, 0] and "correcthorse" not in got[0].text + got[1].text and got[2].text == texts[2]


@pytest.mark.parametrize("f", [near_dedup.near_duplicates, exact_dedup.exact_duplicates, lm_score.lm_scores, licenses.license_scan, sharding.shards, lambda d: bpe.encode_decode(d, RANKS, P.PATTERN), lambda d: pii.replace_pii(d, "k"), lambda d: decontaminate.contaminated(d, d.select(F.col("doc_id").alias("item_id"), "text")), lambda d: quality.quality_scores(d, d.select("doc_id", F.lit(1).alias("quality"))), lambda d: url_filter.url_verdicts(d.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url")))])
def test_empty_and_all_null_tables(spark, f):
    assert f(docs(spark).limit(0)).count() == 0
    nulls = docs(spark, [None, None], [None, None])
    assert f(nulls).count() in (0, 2)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    items = [prose(30) for _ in range(3)]
    good = [prose(80) for _ in range(60)]
    bad = [" ".join(w + "###" for w in prose(60).split()) for _ in range(25)]
    texts = [*good, *bad, good[3] + " ", edited(good[4], 1), f"{prose(40)} {items[1]} {prose(40)}"]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(85)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([*enumerate(items)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(60))
    odd = spark.createDataFrame([(1, "a z", "e"), (1, "a  z", "e"), (1, "b", "e"), (None, "c", "e"), (2, "a\tz", "e")], "doc_id long, text string, lang string")
    assert sorted(((r.doc_id or 0), " ".join(r.text.split())) for r in corpus_pipeline.exact_dedup(spark, odd, "").collect()) == [(0, "c"), (1, "a z"), (1, "b")]
