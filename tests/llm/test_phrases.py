"""Collocations against a plain count of every phrase."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lexmill.llm import phrases


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, longest=3, least=10, inside=50, first=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            for k in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        for p, a in candidates.items():
            score, cut = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            if not any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                found.append((-score, -a, " ".join(p).encode(), c[p[:cut]], c[p[cut:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:first], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed, n=120):
    r = random.Random(seed)
    words = ["of", "the", "New", "york", "été", "ÉTÉ", "a-b", "x\x00y", "…", "😀"] + [f"w{i}" for i in range(12)]
    fixed = ["in the end of", "New York City", "ab ab ab ab"]
    out = []
    for _ in range(n):
        text = ""
        for _ in range(r.randrange(60)):
            text += r.choice(fixed) if r.random() < 0.2 else r.choice(words)
            text += r.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ; ", "\x0b", "\xa0"])
        out.append((text, r.choice(["en", "en", "fr", None, "und", ""])))
    return out + [(None, "en"), ("", None), ("   ", "de"), ("!?", "de")]


def table(spark, rows):
    return spark.createDataFrame([(None, t, g, 1, "clash", "clash") for t, g in rows], "doc_id long, text string, lang string, n long, phrase string, total string")


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("seed, longest, least, inside, first", [(1, 3, 10, 50, 2000), (2, 3, 5, 50, 7), (3, 4, 3, 30, 40), (4, 2, 2, 50, 2000)])
def test_equals_a_plain_count(spark, seed, longest, least, inside, first):
    """With few rows wanted several parts are ranked apart."""
    rows = corpus(seed)
    assert got(phrases.collocations(table(spark, rows).repartition(5), longest, least, inside, first)) == brute(rows, longest, least, inside, first)


def test_a_full_filter_changes_nothing(spark):
    """With 64 words for hundreds of phrases nearly every phrase passes for frequent; the counts decide."""
    rows = corpus(5, 300)
    assert got(phrases.collocations(table(spark, rows), least=2, filter_bytes=512)) == brute(rows, least=2)


def test_chunks_and_hot_rows(spark):
    """One text of many words in a run of equal rows: the same counts however rows are dealt."""
    rows = [("the cat sat on the mat " * 40, "en")] * 30 + [("the cat " * 3000, "en")] + corpus(6, 20)
    want = brute(rows)
    assert got(phrases.collocations(table(spark, rows).repartition(1))) == want
    assert got(phrases.collocations(table(spark, rows).repartition(9))) == want


def test_tables_without_phrases(spark):
    assert got(phrases.collocations(table(spark, []))) == []
    assert got(phrases.collocations(table(spark, [(None, None), ("one", "en")]))) == []


def test_products_over_64_bits_are_exact(spark):
    one = spark.createDataFrame([("en", "a", 3 * 10**15 + 7), ("en", "b", 2 * 10**15 + 1)], "lang string, phrase string, n long")
    two = spark.createDataFrame([("en", "a b", 10**15 + 3)], "lang string, phrase string, n long")
    r = phrases._scored(2, [None, one, two]).first()
    assert r.score == 1000000 * (10**15 + 3) ** 2 // ((3 * 10**15 + 7) * (2 * 10**15 + 1))


def test_the_filter_knows_all_that_was_added():
    r = np.random.default_rng(1)
    names = r.integers(0, 1 << 63, 5000, dtype=np.uint64) * np.uint64(2)
    f = phrases.Filter(np.zeros(2048, np.uint64))
    f.add(names)
    assert f.has(names).all() and f.has(r.integers(0, 1 << 63, 5000, dtype=np.uint64)).mean() < 0.2
