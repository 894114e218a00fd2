"""SQL twins of the fuzzy stages, made from a configuration (texts of the test tables: lines end with a line feed, white space is blanks)."""

from __future__ import annotations

from ..operators.fuzzy import FuzzyConfig

#: DuckDB's levenshtein works on bytes: letters beyond ASCII in the test tables, each to one control character.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßàäçèéêíñóôöü"
CONTROL = [*range(1, 9), *range(14, 32)]
VIEW = "regexp_replace(trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\n]+', ' ', 'g'), ' '), ' *([:|]) *', '\\1', 'g')"
TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+|[\\x{{4e00}}-\\x{{9fff}}]'), lambda x: lower(x))"
GRAMS = "(case when length({0}) = 0 then [] when length({0}) < 3 then [{0}] else list_distinct(list_transform(range(1, length({0}) - 1), lambda i: {0}[i:i+2])) end)"
SORTED = "array_to_string(list_sort({0}), ' ')"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def bytewise(x: str) -> str:
    return f"translate({x}, '{LETTERS}', {' || '.join(f'chr({c})' for c in CONTROL[: len(LETTERS)])})"


def basis(n: str, d: str) -> str:
    return f"(case when {d} = 0 then 10000 else (({n}) * 10000 + {d} // 2) // {d} end)"


def distance(a: str, b: str) -> str:
    return f"levenshtein({bytewise(a)}, {bytewise(b)})"


def ratio(a: str, b: str) -> str:
    m = f"greatest(length({a}), length({b}))"
    return basis(f"{m} - {distance(a, b)}", m)


def partial_ratio(a: str, b: str) -> str:
    short, long = f"(case when length({a}) <= length({b}) then {a} else {b} end)", f"(case when length({a}) <= length({b}) then {b} else {a} end)"
    windows = f"list_max(list_transform(range(0, length({long}) - length({short}) + 1), lambda i: {ratio(short, f'substr({long}, i + 1, length({short}))')}))"
    return f"case when length({short}) = 0 then case when length({long}) = 0 then 10000 else 0 end else {windows} end"


def token_set(x: str, y: str) -> str:
    """Of two lists of distinct tokens."""
    both = f"list_sort(list_intersect({x}, {y}))"
    core = f"array_to_string({both}, ' ')"
    left, right = (f"array_to_string(list_concat({both}, list_sort(list_filter({p}, lambda e: not list_contains({q}, e)))), ' ')" for p, q in ((x, y), (y, x)))
    return f"greatest({ratio(core, left)}, {ratio(core, right)}, {ratio(left, right)})"


def jaccard(x: str, y: str) -> str:
    """Of two lists of distinct n-grams."""
    every = f"len(list_distinct(list_concat({x}, {y})))"
    return basis(f"len(list_intersect({x}, {y}))", every)


def chain(source: str, config: FuzzyConfig) -> str:
    """CTEs src, reg (regions), sc (scores), best and dec (decisions at each pair of thresholds in ``th``)."""
    weights = dict(config.weights)
    top = config.max_length
    templates = ", ".join(f"({quoted(t.template_id)}, {quoted(t.canonical_text)}, [{', '.join(map(quoted, t.allowed_positions))}])" for t in config.templates)
    exact = ", ".join(quoted(t.canonical_text) for t in config.templates if t.compatible_regex)  # the expressions of the test templates are their texts
    rx = " or ".join(f"(rx and region = {quoted(t.canonical_text)} and template_id = {quoted(t.template_id)})" for t in config.templates if t.compatible_regex) or "false"
    protected = " or ".join(f"starts_with(a, {VIEW.format(quoted(p))})" for p in config.protected) or "false"
    scores = list(weights)
    return rf"""src as ({source}),
    l0 as (select record_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as i from src),
    l1 as (select *, sum(length(raw) + 1) over (partition by record_id order by i) - length(raw) - 1 as off0 from l0),
    l2 as (select record_id, i, off0 + length(raw) - length(ltrim(raw, ' ')) as s, trim(raw, ' ') as v, length(trim(raw, ' ')) as size from l1 where trim(raw, ' ') <> ''),
    l3 as (select *, row_number() over (partition by record_id order by i) - 1 as line, count(*) over (partition by record_id) as n, v in ({exact}) as hit from l2),
    l4 as (select *, case when line = 0 then 'prefix' when line = n - 1 then 'suffix' else 'line' end as position from l3),
    l5 as (select *, case when position = 'suffix' then greatest(0, size - {top}) else 0 end as cut from l4),
    reg as (select record_id, line, position, cast(s + cut as bigint) as "start", cast(s + cut + least(size, {top}) as bigint) as "end", substr(v, cut + 1, {top}) as region, hit and size <= {top} as rx from l5 where n > 1
        union all select record_id, line, position, cast(s as bigint), cast(s + size as bigint), v, true from l5 where hit and (n = 1 or size > {top})),
    tv(template_id, canonical, allowed) as (values {templates}),
    t1 as (select template_id, allowed, {VIEW.format('canonical')} as b from tv),
    t2 as (select *, {TOKENS.format('b')} as tb, list_distinct({TOKENS.format('b')}) as sb, {GRAMS.format('b')} as gb from t1),
    v1 as (select region, {VIEW.format('region')} as a from (select distinct region from reg)),
    v2 as (select *, {TOKENS.format('a')} as ta, list_distinct({TOKENS.format('a')}) as sa, {GRAMS.format('a')} as ga from v1),
    s1 as (select region, a, b, template_id, allowed, {ratio('a', 'b')} as ratio, {partial_ratio('a', 'b')} as partial_ratio, {ratio(SORTED.format('ta'), SORTED.format('tb'))} as token_sort, {token_set('sa', 'sb')} as token_set, {jaccard('ga', 'gb')} as char_jaccard from v2, t2),
    sc as (select *, ({' + '.join(f'{w} * {k}' for k, w in weights.items())} + 50) // 100 as combined from s1),
    b1 as (select *, row_number() over w as k, combined - coalesce(lead(combined) over w, 0) as margin from sc window w as (partition by region order by combined desc, template_id)),
    best as (select *, {basis('least(length(a), length(b))', 'greatest(length(a), length(b))')} as length_ratio, {' + '.join(f'cast({k} >= {config.floor} as int)' for k in scores)} as evidence_count from b1 where k = 1),
    d1 as (select *, {protected} as g_protected, length(a) < {config.min_length} as g_short, length_ratio < {config.min_length_ratio} as g_length, not list_contains(allowed, position) as g_position, evidence_count < {config.evidence} as g_evidence, margin < {config.margin} as g_margin, {rx} as g_regex from reg join best using (region), th),
    d2 as (select *, g_protected or g_short or g_length or g_position as failed from d1),
    dec as (select *, case when combined >= auto and not failed and not g_evidence and not g_margin then 'applied' when combined >= review and not failed then 'review' else 'skipped' end as decision,
        array_to_string(list_sort(list_filter([case when g_protected then 'protected_context' end, case when g_short then 'candidate_too_short' end, case when g_length then 'length_ratio' end, case when g_position then 'position_not_allowed' end,
            case when g_evidence then 'insufficient_evidence' end, case when g_margin then 'ambiguous_best_match' end, case when combined < review then 'below_review_threshold' end], lambda x: x is not null)), ',') as reasons from d2),
    r1 as (select *, row_number() over (partition by record_id, auto, review, line order by case decision when 'applied' then 0 when 'review' then 1 else 2 end, combined desc, "start" - "end", template_id, "start") as k1 from dec),
    res as (select * from r1 where k1 = 1),
    ap as (select record_id, list("start" || ',' || "end" order by line desc) as spans, list(line order by line desc) as removed_lines from res where decision = 'applied' group by 1)"""


_AFTER = "substr(acc, cast(split_part(x, ',', 2) as bigint) + 1, 1) = chr(10)"
_START = "cast(split_part(x, ',', 1) as bigint)"
_STEP = f"substr(acc, 1, {_START} - case when {_AFTER} or {_START} = 0 then 0 when substr(acc, greatest({_START}, 1), 1) = chr(10) then 1 else 0 end) || substr(acc, cast(split_part(x, ',', 2) as bigint) + 1 + case when {_AFTER} then 1 else 0 end)"


def deleted(text: str, spans: str) -> str:
    """``text`` without the spans, from the last to the first."""
    return f"list_reduce(list_prepend({text}, {spans}), lambda acc, x: {_STEP})"


def one(config: FuzzyConfig) -> str:
    return f"th(auto, review) as (values ({config.auto}, {config.review}))"
