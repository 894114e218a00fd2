"""URL filter: fixed rules first, then a path-template tree for each host.

The tree is built from the root with grouped aggregates only. At each node
- a segment with a digit is variable by its form and becomes a wildcard with its extension;
- literal segments with few pages each become a wildcard too, where there are many of them;
- literal segments that statistics can't tell from their siblings, neither by what follows
  below them nor, where they have labels, by their labelled purity, become ``*``;
- the others stay.
A template's purity is its share of blocked pages among labelled ones, smoothed towards
its parent's; a segment that statistics tell from its siblings starts from a fixed share
instead. The deepest template of a path decides: it is rejected where its purity is at
least one half. Labels are the verdicts of the fixed rules, so what is learnt is which
unruled branches of a host look like its ruled ones.

What all paths of a node have in common is passed in one step, and a node with one path
left is finished, so the rounds are as many as the levels at which paths part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: The fixed rules: verdict, host, path prefix.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Smoothing: so many pages with the parent's purity, or else with so large a share of blocked ones, are added to each template.
PRIOR, PRIOR_SHARE = 4.0, 0.3
#: Standard errors by which a branch's share must differ from its siblings' to stand alone.
DIFFERS = 2.0
#: Literal segments of at most FEW pages each become a wildcard where a node has at least MANY of them.
FEW, MANY = 2, 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parse_url(url: str) -> tuple[Column, Column]:
    """(host, path) of a column; both empty for null or a text without ``://``."""
    u, pattern = F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(u, pattern, 1), UPPER, LOWER), F.regexp_extract(u, pattern, 2)


def _ruled() -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path; else null."""
    rule = verdict = F.lit(None).cast("string")
    for v, host, path in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _ending(segment: Column) -> Column:
    return F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)


def _generalised(segment: Column) -> Column:
    """A segment with a digit becomes a wildcard; an extension stays."""
    return F.when(segment.rlike("[0-9]"), F.concat(F.lit("{n}"), _ending(segment))).otherwise(segment)


def _shared(a: Column, b: Column) -> Column:
    """Number of leading segments that two arrays share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    apart = F.array_position(same, False)
    return F.when(apart > 0, apart - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def _differs(x: Column, nx: Column, y: Column, ny: Column) -> Column:
    """Whether the shares x of nx and y of ny are apart by more than chance."""
    both = (x + y) / (nx + ny)
    return F.abs(x / nx - y / ny) > DIFFERS * F.sqrt(both * (1 - both) * (1 / nx + 1 / ny))


NODE = ["host", "template"]


def _passed(now: DataFrame) -> DataFrame:
    """``now`` behind what all paths of each node share; ``alone`` where a node has one path left."""
    ends = now.groupBy(NODE).agg(F.min("rest").alias("low"), F.max("rest").alias("high"))
    ends = ends.select(*NODE, _shared(F.col("low"), F.col("high")).alias("step"), (F.col("low") == F.col("high")).alias("alone"))
    rows = now.join(ends, NODE).withColumn("template", F.concat_ws("/", "template", F.slice("rest", F.lit(1), F.col("step"))))
    return rows.withColumn("rest", F.slice("rest", F.col("step") + 1, F.size("rest"))).drop("step")


def _branches(live: DataFrame) -> DataFrame:
    """(host, template, segment, name, purity) of each branch of each node."""
    below = F.get("rest", F.lit(1))
    kind = F.when(below.isNull(), "end").when(below.startswith("{n}"), below).otherwise(F.concat(F.lit("word"), _ending(below)))
    kinds = live.groupBy(*NODE, F.get("rest", F.lit(0)).alias("segment"), kind.alias("kind")).agg(F.first("purity").alias("parent"), F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    branch = kinds.groupBy(*NODE, "segment").agg(
        F.first("parent").alias("parent"), F.sum("n").alias("n"), F.sum("l").alias("l"), F.sum("b").alias("b"), F.max_by("kind", F.struct("n", "kind")).alias("top"), F.max("n").alias("in_top")
    )
    word = ~F.col("segment").startswith("{n}")
    rare = word & (F.col("n") <= FEW)
    branch = branch.withColumn("group", F.when(rare, "rare").when(word, "word").otherwise("form"))
    # sums over a node's literal branches: without the rare ones where these are many, else with them
    sums = [F.sum(F.when(F.col("group").isin(of), F.col(c)).otherwise(0)).alias(f"{c}_{mark}") for mark, of in (("few", ["word", "rare"]), ("many", ["word"])) for c in ("n", "l", "b", "in_top")]
    tops = branch.groupBy(*NODE, "top").agg(F.count_if(rare).alias("rare"), *sums)
    best = [F.max_by(c, F.struct(f"n_{mark}", "top")).alias(f"{c}_{mark}") for mark in ("few", "many") for c in ("top",)]
    best += [F.max_by(f"in_top_{mark}", F.struct(f"n_{mark}", "top")).alias(f"in_{mark}") for mark in ("few", "many")]
    node = tops.groupBy(NODE).agg(F.sum("rare").alias("rare"), *best, *(F.sum(f"{c}_{mark}").alias(f"{c}_{mark}") for mark in ("few", "many") for c in ("n", "l", "b")), *(F.max(f"n_{mark}").alias(f"most_{mark}") for mark in ("few", "many")))
    many = F.col("rare") >= MANY
    node = node.select(*NODE, many.alias("many"), *(F.when(many, F.col(f"{c}_many")).otherwise(F.col(f"{c}_few")).alias(f"all_{c}") for c in ("top", "in", "most", "l", "b")))
    one = branch.join(node, NODE)
    wild = F.when(F.col("group") == "form", F.col("segment")).when((F.col("group") == "rare") & F.col("many"), F.concat(F.lit("{s}"), _ending(F.col("segment"))))
    # literal branches against their literal siblings together
    rest_n, rest_l = F.col("all_most") - F.col("n"), F.col("all_l") - F.col("l")
    shape = (F.col("top") == F.col("all_top")) & (rest_n > 0) & ~_differs(F.col("in_top"), F.col("n"), F.col("all_in") - F.col("in_top"), F.nullif(rest_n, F.lit(0)))
    pure = F.when((F.col("l") > 0) & (rest_l > 0), ~_differs(F.col("b"), F.nullif(F.col("l"), F.lit(0)), F.col("all_b") - F.col("b"), F.nullif(rest_l, F.lit(0)))).otherwise(True)
    one = one.withColumn("wild", wild).withColumn("alike", F.col("wild").isNotNull() | F.coalesce(shape & pure, F.lit(False)))
    named = one.select(*NODE, "segment", F.coalesce("wild", F.when(F.col("alike"), "*").otherwise(F.col("segment"))).alias("name"), "parent", "l", "b", "alike")
    purity = (F.sum("b") + PRIOR * F.when(F.bool_or("alike"), F.first("parent")).otherwise(PRIOR_SHARE)) / (F.sum("l") + PRIOR)
    alone = (F.col("name") == "*") & (F.count("*") == 1)  # nothing merged with it
    merged = named.groupBy(*NODE, "name").agg(purity.alias("deeper"), F.when(alone, F.min("segment")).otherwise(F.col("name")).alias("new"))
    return named.select(*NODE, "segment", "name").join(merged, [*NODE, "name"]).select(*NODE, "segment", F.col("new").alias("name"), "deeper")


def url_verdicts(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, ...)`` -> ``page_id, host, path, rule, verdict, template, rejected``, one row per input row.

    Rules decide where one fits (the longest wins); else the template's smoothed purity:
    block if ``rejected`` is at least one half. ``template`` is the page's whole path with
    its generalised segments, ``rejected`` the purity of the deepest node of the tree that
    the path reaches; for pages under a rule, ``rejected`` is informative only.

    Edge cases: null or malformed urls have empty host and path and are judged as the
    host ''. Empty segments are skipped. Without labelled pages all is allowed.
    A path of any depth is read whole. Repeated pages count as often as they occur.
    Extra columns are ignored, whatever their names. An empty table gives an empty one.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = parse_url("url")
    rule, verdict = _ruled()
    base = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = scratch.save(base.withColumn("rule", rule).withColumn("ruled", verdict))
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("ruled").alias("labelled"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked"))
    paths = paths.withColumn("rest", F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), _generalised))
    hosts = paths.groupBy("host").agg(((F.sum("blocked") + PRIOR * PRIOR_SHARE) / (F.sum("labelled") + PRIOR)).alias("purity"))
    now = paths.join(hosts, "host").withColumn("template", F.lit(""))
    done, used = None, [rows]
    while True:
        now = scratch.save(_passed(now), left=F.count_if(~F.col("alone") & (F.size("rest") > 0)))
        used.append(now)
        ends = now.where("alone or size(rest) = 0").select("host", "path", "template", "purity")
        done = ends if done is None else done.unionByName(ends)
        if not now.facts["left"]:
            break
        live = now.where("not alone and size(rest) > 0").drop("alone").withColumn("segment", F.get("rest", F.lit(0)))
        now = live.join(_branches(live), [*NODE, "segment"])
        now = now.select("host", "path", "n", "labelled", "blocked", F.slice("rest", F.lit(2), F.size("rest")).alias("rest"), F.col("deeper").alias("purity"), F.concat_ws("/", "template", "name").alias("template"))
    judged = done.withColumnRenamed("purity", "rejected")
    out = rows.join(judged, ["host", "path"]).withColumn("verdict", F.coalesce("ruled", F.when(F.col("rejected") >= 0.5, "block").otherwise("allow")))
    out = scratch.save(out.select("page_id", "host", "path", "rule", "verdict", "template", "rejected"))
    scratch.drop(*used)
    return out
