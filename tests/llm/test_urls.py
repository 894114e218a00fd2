"""The template tree against a twin in plain Python."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lexmill.llm import url_filter as U


def ending(s):
    m = re.search(r"(\.[A-Za-z]{1,5})$", s)
    return m.group(1) if m else ""


def parsed(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    return (m.group(1).translate({c: c + 32 for c in range(65, 91)}), m.group(2)) if m else ("", "")


def ruled(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in U.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def differs(x, nx, y, ny):
    both = (x + y) / (nx + ny)
    return abs(x / nx - y / ny) > U.DIFFERS * math.sqrt(both * (1 - both) * (1 / nx + 1 / ny))


def tree(urls):
    """{(host, path): (template, purity)}"""
    hosts, out = defaultdict(Counter), {}
    for u in urls:
        host, path = parsed(u)
        hosts[host][path] += 1

    def node(host, rows, template, purity):  # rows: (path, rest, n, l, b)
        low, high = min(r[1] for r in rows), max(r[1] for r in rows)
        k = 0
        while k < min(len(low), len(high)) and low[k] == high[k]:
            k += 1
        template += low[:k]
        rows = [(p, r[k:], n, l, b) for p, r, n, l, b in rows]
        for p, r, *_ in rows:
            if low == high or not r:
                out[host, p] = ("/".join(["", *template]) if template else "", purity)
        if low == high:
            return
        groups = defaultdict(list)
        for row in rows:
            if row[1]:
                groups[row[1][0]].append(row)
        stat = {}
        for seg, some in groups.items():
            kinds = Counter()
            for _, r, n, _, _ in some:
                kinds["end" if len(r) < 2 else r[1] if r[1].startswith("{n}") else "word" + ending(r[1])] += n
            top, most = max(kinds.items(), key=lambda kv: (kv[1], kv[0]))
            stat[seg] = (sum(r[2] for r in some), sum(r[3] for r in some), sum(r[4] for r in some), top, most)
        rare = [s for s, v in stat.items() if not s.startswith("{n}") and v[0] <= U.FEW]
        name = {s: s if s.startswith("{n}") else "{s}" + ending(s) for s in stat if s.startswith("{n}") or (len(rare) >= U.MANY and s in rare)}
        alike = dict.fromkeys(name, True)
        one = {s: v for s, v in stat.items() if s not in name}
        tops = Counter()
        for v in one.values():
            tops[v[3]] += v[0]
        if one:
            usual, all_n = max(tops.items(), key=lambda kv: (kv[1], kv[0]))
            all_top = sum(v[4] for v in one.values() if v[3] == usual)
            all_l, all_b = sum(v[1] for v in one.values()), sum(v[2] for v in one.values())
            for s, (n, l, b, top, most) in one.items():
                shape = top == usual and all_n > n and not differs(most, n, all_top - most, all_n - n)
                pure = not differs(b, l, all_b - b, all_l - l) if l and all_l > l else True
                alike[s] = shape and pure
            several = sum(alike[s] for s in one) > 1
            for s in one:
                name[s] = "*" if alike[s] and several else s
        for new in set(name.values()):
            members = [s for s in name if name[s] == new]
            l, b = sum(stat[s][1] for s in members), sum(stat[s][2] for s in members)
            prior = purity if any(alike[s] for s in members) else U.PRIOR_SHARE
            inner = [(p, r[1:], n, x, y) for s in members for p, r, n, x, y in groups[s]]
            node(host, inner, template + [new], (b + U.PRIOR * prior) / (l + U.PRIOR))

    for host, paths in hosts.items():
        rows = []
        for p, n in paths.items():
            v = ruled(host, p)[1]
            rest = ["{n}" + ending(s) if re.search("[0-9]", s) else s for s in p.split("/") if s]
            rows.append((p, rest, n, n if v else 0, n if v == "block" else 0))
        node(host, rows, [], (sum(r[4] for r in rows) + U.PRIOR * U.PRIOR_SHARE) / (sum(r[3] for r in rows) + U.PRIOR))
    return out


def compare(spark, urls):
    got = U.url_verdicts(spark.createDataFrame([(i, u, "h", "t") for i, u in enumerate(urls)], "page_id long, url string, host string, template string").repartition(3)).collect()
    want = tree(urls)
    assert len(got) == len(urls)
    for r in got:
        host, path = parsed(urls[r.page_id])
        rule, verdict = ruled(host, path)
        template, purity = want[host, path]
        assert (r.host, r.path, r.rule, r.template) == (host, path, rule, template) and abs(r.rejected - purity) < 1e-9
        assert r.verdict == (verdict or ("block" if r.rejected >= 0.5 else "allow"))
    return got


def urls(seed, n=400):
    r = random.Random(seed)
    words = ["en", "de", "es", "fr", "news", "blog", "shop", "a.html", "b.html"]
    hosts = ["a.net", "b.net", "x.example.com", "c.org", "d.com", "www.example.com"]
    out = [f"http://{r.choice(hosts)}/{'/'.join(r.choice([r.choice(words), str(r.randrange(50)), f'{r.randrange(9)}.html', 'w' + 'abcdefgh'[r.randrange(8)] * r.randrange(1, 6)]) for _ in range(r.randrange(0, 5)))}" for _ in range(n)]
    return [*out, *out[:20], None, "", "no url", "http://", "http:///", "http://c.org"]


@pytest.mark.parametrize("seed", range(3))
def test_random_urls_equal_the_twin(spark, seed):
    compare(spark, urls(seed))


def test_unruled_branches_that_look_like_blocked_ones_are_blocked(spark):
    rows = [f"http://h.net/{lang}/{k}" for lang in ("es", "fr", "en", "de") for k in range(30)] + [f"http://h.net/about/{w}.html" for w in ("us", "them", "you")]
    got = compare(spark, rows)
    unruled = {(r.path.split("/")[1], r.verdict) for r in got if not r.rule}
    assert unruled == {("en", "block"), ("de", "block"), ("about", "allow")}


def test_many_rare_words_become_a_wildcard(spark):
    rows = [f"http://h.org/p/w{'abcdefghijklmnopqrstuvwxyz'[k % 26] * (1 + k // 26)}.html" for k in range(60)] + ["http://h.org/p/index.html"] * 9
    assert {r.template for r in compare(spark, rows)} == {"/p/{s}.html", "/p/index.html"}


def test_hot_host_and_deep_paths_take_few_rounds(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(U, "_passed", lambda *a, f=U._passed: calls.append(1) or f(*a))
    deep = "/".join(["s"] * 5000)
    rows = [f"http://hot.net/{'es' if k % 3 else 'en'}/{k}/x{k % 7}" for k in range(3000)] + [f"http://deep.net/{deep}/{e}" for e in ("a", "b", "c")] + [f"http://one.net/{deep}"]
    got = compare(spark, rows)
    assert len(calls) <= 5 and sum(r.host == "hot.net" for r in got) == 3000


@pytest.mark.parametrize("sf", ["0.01"])
def test_all_pages_equal_the_twin(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/sf{sf}/pages.parquet")
    got = compare(spark, [r.url for r in pages.orderBy("page_id").collect()])
    assert any(r.verdict == "block" and r.rule is None for r in got)
