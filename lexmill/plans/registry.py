"""Named queries over the Parquet test tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cleaning as C
from ..operators import fuzzy as Z
from ..operators import records as R
from ..operators import sampling as S
from . import fuzzy_sql as Q

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: Boilerplate of the test tables, as templates.
LINES = ("The and attion to thanedble the, anea. Eriner thanea.", "Nicht aulich für sch erüver enau sch der.", "En laleenéelle la des et. Enmentai. Réleou eauoué.", "All rights reserved.")
CONFIG = C.CleaningConfig(C.Templates(prefixes=("The ",), suffixes=("thanea.",), lines=LINES[3:], blocks=(("Released under", "License."),)), short_text_threshold=12)
FUZZY = Z.FuzzyConfig((Z.Template("en-head", LINES[0], ("prefix", "line")), Z.Template("de-head", LINES[1], ("prefix", "suffix")), Z.Template("reserved", LINES[3], ("suffix", "line"), r"^All rights reserved\.$")), protected=("In ",), normalise=False)
STRATIFIED = {m: S.SamplePlan(f"plan-{m}", 200, 7, ("dataset_id", "metadata.lang"), m, 2 if m.startswith("min") else 0) for m in S.METHODS[1:]}
SIMPLE = S.SamplePlan("plan-simple", 100, 7)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return R.records_from_documents(_table(spark, d, "documents"))


REC = "(select cast(doc_id as varchar) as record_id, source as dataset_id, 'documents.parquet' as source_file, doc_id as source_offset, 'article' as record_type, null as event_date, text as raw_text, lang, n_chars from documents)"
TAG = r"(?s:<!--.*?-->)|</?[A-Za-z][A-Za-z0-9]*\b[^>]*>|[^<]+|<"
BLOCKS = "'" + "','".join(T.BLOCK_TAGS) + "'"
SCRIPT = r"regexp_replace({0}, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g')"
TAGS = rf"""regexp_replace(regexp_replace(array_to_string(list_transform(regexp_extract_all({{0}}, '{TAG}'),
    lambda t: case when t[1:1] = '<' and length(t) > 1 then case when lower(regexp_extract(t, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) in ({BLOCKS}) then chr(57344) else '' end else t end), ''),
    '(\A|\n)' || chr(57344) || '+', '\1', 'g'), chr(57344) || '+', chr(10), 'g')"""
ENT = r"""array_to_string(list_transform(regexp_extract_all({0}, '&(?:#(?:x[0-9A-Fa-f]+|[0-9]+)|[A-Za-z]+);|[^&]+|&'),
    lambda t: case t when '&amp;' then '&' when '&lt;' then '<' when '&gt;' then '>' when '&quot;' then '"' when '&apos;' then '''' when '&nbsp;' then ' ' when '&copy;' then chr(169) when '&ndash;' then chr(8211) when '&mdash;' then chr(8212) else t end), '')"""
SPACE = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '\r\n?', chr(10), 'g'), '[ \t\r\f\v]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '\A[ \n]+|[ \n]+\z', '', 'g')"""
RANK = "sha256(concat('hash-rank-v1', chr(31), '7', chr(31), record_id))"


# --- records, profile, filters ----------------------------------------------------


@query(f"select record_id, dataset_id, source_offset, record_type, sha256(raw_text) as text_sha from {REC}")
def records_from_documents(spark, d):
    return _docs(spark, d).select("record_id", "dataset_id", "source_offset", "record_type", F.sha2("raw_text", 256).alias("text_sha"))


@query("select conv_id || '-' || turn as record_id, role as dataset_id, case when turn = 0 then 'comment' else 'reply' end as record_type from conversations")
def records_from_conversations(spark, d):
    return R.records_from_conversations(_table(spark, d, "conversations")).select("record_id", "dataset_id", "record_type")


@query(f"select count(*) as total_records, count(*) as missing_title, count(*) filter (where trim(raw_text, ' ' || chr(10)) = '') as empty_body, count(distinct record_id) as unique_ids, count(*) - count(distinct record_id) as duplicate_ids from {REC}")
def profile_totals(spark, d):
    return R.profile_totals(_docs(spark, d))


def _profile(kind: str, sql: str):
    def f(spark, d):
        return R.profile(_docs(spark, d)).where(F.col("kind") == kind).select("value", "n")

    f.__name__ = f"profile_by_{ {'dataset_id': 'dataset', 'record_type': 'type', 'event_date': 'date'}[kind] }"
    query(f"select {sql} as value, count(*) as n from {REC} group by 1")(f)


_profile("dataset_id", "dataset_id")
_profile("record_type", "record_type")
_profile("event_date", "coalesce(event_date, '<null>')")


@query(f"select 'dataset_id' as kind, dataset_id as value, count(*) as n from {REC} group by 2 union all select 'record_type', record_type, count(*) from {REC} group by 2 union all select 'event_date', '<null>', count(*) from {REC} union all select 'schema_version', 'record-v1', count(*) from {REC}")
def profile_grouping_sets(spark, d):
    return R.profile(_docs(spark, d))


@query(f"select count(*) as missing_title, count(*) filter (where trim(raw_text, ' ' || chr(10)) = '') as empty_body from {REC}")
def profile_missing_counts(spark, d):
    return R.profile_totals(_docs(spark, d)).select("missing_title", "empty_body")


@query(f"select count(distinct record_id) as unique_ids, count(*) - count(distinct record_id) as duplicate_ids from {REC}")
def profile_id_uniqueness(spark, d):
    return R.profile_totals(_docs(spark, d)).select("unique_ids", "duplicate_ids")


@query("""select cast(doc_id as varchar) as record_id,
    case when doc_id % 7 = 0 then 'invalid_value' when doc_id % 7 = 1 then 'type_error' when doc_id % 7 = 2 then 'invalid_value' when doc_id % 7 = 3 then 'invalid_value' end as error_type,
    case doc_id % 7 when 0 then 'record_type' when 1 then 'raw_text' when 2 then 'source_offset' when 3 then 'event_date' end as error_field from documents""")  # fmt: skip
def validate_records(spark, d):
    k = F.col("source_offset") % 7
    broken = _docs(spark, d).withColumn("k", k).withColumn("record_type", F.when(F.col("k") == 0, "page").otherwise("article")).withColumn("raw_text", F.when(F.col("k") != 1, F.col("raw_text")))
    return R.validate_records(broken.withColumn("source_offset", F.when(F.col("k") == 2, -1).otherwise(F.col("source_offset"))).withColumn("event_date", F.when(F.col("k") == 3, "2026-1-1\n").otherwise("2026-99-99")))


@query(f"select record_id from {REC} where dataset_id = 'src0' and lang = 'en'")
def filter_eq(spark, d):
    return _docs(spark, d).where(R.matches_filters({"dataset_id": "src0", "metadata.lang": "en"})).select("record_id")


@query(f"select record_id from {REC} where dataset_id in ('src1', 'src2')")
def filter_in(spark, d):
    return _docs(spark, d).where(R.matches_filters({"dataset_id": ["src1", "src2"], "event_date": None})).select("record_id")


@query("select to_json([event_type, coalesce(json_extract_string(props, '$.k'), '__MISSING__'), '__MISSING__']) as stratum, count(*) as population from events group by 1")
def sample_strata_sentinels(spark, d):
    plan = S.SamplePlan("p", 1, 0, ("dataset_id", "metadata.k", "metadata.absent"))
    return S.strata_capacity(R.records_from_events(_table(spark, d, "events")), plan)


# --- sampling ---------------------------------------------------------------------

STRATA = f"(select to_json([dataset_id, lang]) as stratum, count(*) as population from {REC} group by 1)"


@query(f"select stratum, population from {STRATA}")
def sample_strata_capacity(spark, d):
    return S.strata_capacity(_docs(spark, d), STRATIFIED["proportional"])


def _prop_sql(target: str, cap: str, src: str) -> str:
    return f"""select stratum, population, q + case when row_number() over (order by rem desc, stratum) <= {target} - sum(q) over () then 1 else 0 end as more, base from
        (select *, {target} * {cap} // sum({cap}) over () as q, {target} * {cap} % sum({cap}) over () as rem from {src})"""


QUOTA = {
    "proportional": f"select stratum, population, cast(more as bigint) as quota from ({_prop_sql('200', 'population', f'(select *, 0 as base from {STRATA})')})",
    "minimum_then_proportional": f"""with m as (select stratum, population, least(population, 2) as base, population - least(population, 2) as spare from {STRATA}), t as (select 200 - sum(base) as target from m)
        select stratum, population, cast(base + more as bigint) as quota from ({_prop_sql('target', 'spare', '(select m.*, t.target from m, t)')})""",
    "equal": f"""with s as {STRATA}, lv as (select max(l) as l from range(0, 201) r(l) where (select sum(least(population, l)) from s) <= 200)
        select stratum, population, cast(least(population, l) + case when population > l and row_number() over (order by population <= l, stratum) <= 200 - sum(least(population, l)) over () then 1 else 0 end as bigint) as quota from s, lv""",
}
for _name, _method in (("quota_proportional", "proportional"), ("quota_equal", "equal"), ("quota_minimum", "minimum_then_proportional")):

    def _quota(spark, d, _m=_method):
        return S.allocate(S.strata_capacity(_docs(spark, d), STRATIFIED[_m]), STRATIFIED[_m]).select("stratum", "population", "quota")

    _quota.__name__ = _name
    query(QUOTA[_method])(_quota)

SELECTED = {m: f"select record_id, r.stratum from (select record_id, to_json([dataset_id, lang]) as stratum, row_number() over (partition by to_json([dataset_id, lang]) order by {RANK}, record_id) as n from {REC}) r join ({q}) q on r.stratum = q.stratum where n <= quota" for m, q in QUOTA.items()}
for _name, _method in (("sample_stratified_proportional", "proportional"), ("sample_stratified_equal", "equal"), ("sample_stratified_minimum", "minimum_then_proportional")):

    def _stratified(spark, d, _m=_method):
        return S.sample(_docs(spark, d), STRATIFIED[_m]).select("record_id", "stratum")

    _stratified.__name__ = _name
    query(SELECTED[_method])(_stratified)


@query(f"select record_id, {RANK} as rank_hex from {REC}")
def hash_rank(spark, d):
    return _docs(spark, d).select("record_id", T.hash_rank(F.col("record_id"), 7, "hash-rank-v1").alias("rank_hex"))


@query(f"select record_id, {RANK} as rank_hex from {REC} order by 2, 1 limit 100")
def sample_simple(spark, d):
    return S.sample(_docs(spark, d), SIMPLE).select("record_id", "rank_hex")


@query(f"select q.stratum, population, quota, count(record_id) as selected from ({QUOTA['proportional']}) q left join ({SELECTED['proportional']}) s on q.stratum = s.stratum group by all")
def sample_report_strata(spark, d):
    return S.report_strata(_docs(spark, d), STRATIFIED["proportional"])


@query(f"""select record_id, array_to_string(reasons, ',') as risk_reasons from (select record_id, list_sort(list_filter([case when trim(raw_text, ' ' || chr(10)) = '' then 'empty_body' end, 'missing_title', 'missing_date',
    case when length(trim(raw_text, ' ' || chr(10))) between 1 and 11 then 'short_text' end, case when raw_text like '%The %' or raw_text like '%thanea.%' or raw_text like '%All rights reserved.%' or raw_text like '%Released under%' then 'known_template' end], lambda x: x is not null)) as reasons from {REC})
    order by len(reasons) desc, sha256(concat('risk-v1', chr(31), '0', chr(31), record_id)), record_id limit 50""")  # fmt: skip
def risk_sample(spark, d):
    return S.risk_sample(_docs(spark, d), 50, CONFIG.templates.markers()).withColumn("risk_reasons", F.array_join("risk_reasons", ","))


# --- fingerprints -----------------------------------------------------------------


@query("select doc_id, 'sha256:' || sha256(text) as text_hash from documents")
def text_hash(spark, d):
    return _table(spark, d, "documents").select("doc_id", T.sha256_text(F.col("text")).alias("text_hash"))


ROWJSON = "to_json({'dataset_id': source, 'n_chars': n_chars, 'record_id': cast(doc_id as varchar)})"


@query(f"select doc_id, sha256({ROWJSON}) as fingerprint from documents")
def record_fingerprint(spark, d):
    j = F.to_json(F.struct(F.col("source").alias("dataset_id"), "n_chars", F.col("doc_id").cast("string").alias("record_id")))
    return _table(spark, d, "documents").select("doc_id", F.sha2(j, 256).alias("fingerprint"))


@query(f"""with r as (select sha256(cast(doc_id as varchar)) as h, cast(doc_id as varchar) as k, {ROWJSON} as line from documents), b as (select h[1:4] as b, sha256(string_agg(line || chr(10), '' order by k)) as line from r group by 1),
    c as (select b[1:2] as c, sha256(string_agg(line || chr(10), '' order by b)) as line from b group by 1) select 'sha256:' || sha256(string_agg(line || chr(10), '' order by c)) as fingerprint from c""")
def fingerprint_population(spark, d):
    df = _table(spark, d, "documents").select("source", "n_chars", F.col("doc_id").cast("string").alias("record_id"))
    return R.tree_fingerprint(df, F.to_json(F.struct(F.col("source").alias("dataset_id"), "n_chars", "record_id")), "record_id")


@query(f"""select 'sha256:' || sha256(string_agg('"' || record_id || '"' || chr(10), '' order by record_id)) as fingerprint from (select record_id from {REC} order by {RANK}, record_id limit 100)""")
def fingerprint_selected_ids(spark, d):
    return R.fingerprint(S.sample(_docs(spark, d), SIMPLE).select("record_id"), F.concat(F.lit('"'), "record_id", F.lit('"')), ["record_id"])


# --- cleaning ---------------------------------------------------------------------


def _page_query(name: str, spark_fn, sql: str) -> None:
    def f(spark, d):
        new = spark_fn(F.col("html"))
        return _table(spark, d, "pages").select("page_id", new.alias("c")).select("page_id", F.length("c").cast("bigint").alias("n_chars"), F.sha2("c", 256).alias("clean_sha"))

    f.__name__ = name
    query(f"select page_id, length(c) as n_chars, sha256(c) as clean_sha from (select page_id, {sql} as c from pages)")(f)


_page_query("clean_script_style", T.remove_script_style, SCRIPT.format("html"))
_page_query("clean_tags", lambda c: T.remove_tags(T.remove_script_style(c)), TAGS.format(SCRIPT.format("html")))
_page_query("clean_entities", T.decode_entities, ENT.format("html"))
_page_query("clean_html", lambda c: T.normalize_whitespace(T.normalize_html(T.remove_script_style(c))), SPACE.format(ENT.format(TAGS.format(SCRIPT.format("html")))))


def _text_query(name: str, spark_fn, sql: str) -> None:
    def f(spark, d):
        return _table(spark, d, "documents").select("doc_id", spark_fn(F.col("text")).alias("c")).select("doc_id", F.length("c").cast("bigint").alias("n_chars"), F.sha2("c", 256).alias("clean_sha"))

    f.__name__ = name
    query(f"select doc_id, length(c) as n_chars, sha256(c) as clean_sha from (select doc_id, {sql} as c from documents)")(f)


WIDE = "".join(chr(0xFEE0 + ord(c)) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_text_query("clean_zero_width", lambda c: T.remove_zero_width(F.replace(c, F.lit("the"), F.lit("th​e"))), "text")
_text_query("clean_nfkc", lambda c: T.nfkc(F.translate(c, PLAIN, WIDE)), "text")
_text_query("clean_whitespace", lambda c: T.normalize_whitespace(F.replace(c, F.lit(". "), F.lit(". \t \n\n\n"))), SPACE.format("replace(text, '. ', '. ' || chr(9) || ' ' || chr(10) || chr(10) || chr(10))"))


_STRIP = "trim({0}, ' ' || chr(10))"


def _templates(df: DataFrame, t: C.Templates) -> DataFrame:
    out = C.remove_templates(df.select("doc_id", F.col("text").alias("c")), "c", t)
    return out.select("doc_id", F.sha2("c", 256).alias("clean_sha"), F.size("_spans").cast("bigint").alias("n_spans"))


_LIST = "(" + ",".join("'" + x + "'" for x in LINES) + ")"


@query(f"select doc_id, sha256({_STRIP.format(f'array_to_string(list_filter(p, lambda x: x not in {_LIST}), chr(10))')}) as clean_sha, len(list_filter(p, lambda x: x in {_LIST})) as n_spans from (select doc_id, string_split(text, chr(10)) as p from documents)")
def clean_exact_lines(spark, d):
    return _templates(_table(spark, d, "documents"), C.Templates(lines=LINES))


@query(f"""with a as (select doc_id, starts_with(text, 'The ') as p, case when starts_with(text, 'The ') then substr(text, 5) else text end as t from documents), b as (select *, ends_with(t, 'thanea.') as s from a)
    select doc_id, sha256({_STRIP.format("case when s then left(t, length(t) - 7) else t end")}) as clean_sha, cast(p as bigint) + cast(s as bigint) as n_spans from b""")
def clean_prefix_suffix(spark, d):
    return _templates(_table(spark, d, "documents"), C.Templates(prefixes=("The ",), suffixes=("thanea.",)))


@query(f"""with a as (select doc_id, text, instr(text, 'Released under') as i from documents), b as (select *, case when i > 0 then instr(substr(text, i + 14), 'License.') else 0 end as j from a)
    select doc_id, sha256({_STRIP.format("case when j > 0 then left(text, i - 1) || substr(text, i + 14 + j + 7) else text end")}) as clean_sha, cast(j > 0 as bigint) as n_spans from b""")
def clean_block(spark, d):
    return _templates(_table(spark, d, "documents"), C.Templates(blocks=(("Released under", "License."),)))


@query(f"""select doc_id, trim(text, ' ' || chr(10)) = '' as empty, trim(text, ' ' || chr(10)) <> '' and not regexp_matches(text, '[\\p{{L}}\\p{{N}}]') as pure_symbol, trim(text, ' ' || chr(10)) <> '' and length(trim(text, ' ' || chr(10))) < 12 as short from documents""")
def clean_flags(spark, d):
    done = C.clean(_docs(spark, d), C.CleaningConfig(short_text_threshold=12))
    flag = lambda r: F.exists("events", lambda e: e["rule_id"] == r)
    return done.select(F.col("source_offset").alias("doc_id"), flag("flag_empty").alias("empty"), flag("flag_pure_symbol").alias("pure_symbol"), flag("flag_short").alias("short"))


LINES_ONLY = C.CleaningConfig(C.Templates(lines=LINES), short_text_threshold=12)
CLEANED = SPACE.format(ENT.format(TAGS.format(SCRIPT.format("text"))))
CLEANED = _STRIP.format(f"array_to_string(list_filter(string_split({CLEANED}, chr(10)), lambda x: x not in {_LIST}), chr(10))")


@query(f"select doc_id, sha256({CLEANED}) as clean_sha from documents")
def clean_documents(spark, d):
    return C.clean(_docs(spark, d), LINES_ONLY).select(F.col("source_offset").alias("doc_id"), F.sha2("clean_text", 256).alias("clean_sha"))


_BLOCK = "case when i > 0 and j > 0 then left(t, i - 1) || substr(t, i + 14 + j + 7) else t end"
_EVENTS = [("remove_script_style", "t0", "t1"), ("normalize_html", "t1", "t2"), ("normalize_whitespace", "t2", "t3"), ("remove_exact_templates", "t3", "t4")]


@query(f"""with a as (select text as t0, {SCRIPT.format('text')} as t1 from documents), b as (select *, {ENT.format(TAGS.format('t1'))} as t2 from a), c as (select *, {SPACE.format('t2')} as t3 from b),
    p as (select *, case when starts_with(t3, 'The ') then substr(t3, 5) else t3 end as t from c), q as (select * replace (case when ends_with(t, 'thanea.') then left(t, length(t) - 7) else t end as t) from p),
    l as (select * replace (array_to_string(list_filter(string_split(t, chr(10)), lambda x: x <> 'All rights reserved.'), chr(10)) as t) from q), i as (select *, instr(t, 'Released under') as i from l),
    j as (select *, instr(substr(t, i + 14), 'License.') as j from i), k as (select *, {_STRIP.format(_BLOCK)} as t4 from j), e as (
    {' union all '.join(f"select '{r}' as rule_id, 'applied' as decision, greatest(0, length({x}) - length({y})) as removed from k where {x} <> {y}" for r, x, y in _EVENTS)}
    union all select 'flag_empty', 'review', 0 from k where t4 = '' union all select 'flag_pure_symbol', 'review', 0 from k where t4 <> '' and not regexp_matches(t4, '[\\p{{L}}\\p{{N}}]') union all select 'flag_short', 'review', 0 from k where t4 <> '' and length(t4) < 12)
    select rule_id, decision, count(*) as n, cast(sum(removed) as bigint) as removed from e group by 1, 2""")  # fmt: skip
def cleaning_events_by_rule(spark, d):
    return C.cleaning_events(C.clean(_docs(spark, d), CONFIG)).groupBy("rule_id", "decision").agg(F.count("*").alias("n"), F.sum("removed_chars").alias("removed"))


@query(f"select record_id, sha256(c) as after_sha, raw_text <> c as changed from (select record_id, raw_text, {CLEANED.replace('(text,', '(raw_text,')} as c from (select * from {REC} order by {RANK}, record_id limit 100))")
def sampled_pairs(spark, d):
    return C.sampled_pairs(S.sample(_docs(spark, d), SIMPLE), LINES_ONLY).select("record_id", F.sha2("after", 256).alias("after_sha"), "changed")


@query("""select doc_id, cast(len(list_filter(range(1, least(length(a), length(b)) + 1), lambda i: a[i:i] <> b[i:i])) + abs(length(a) - length(b)) as bigint) as changed_characters from (select doc_id, text as a, replace(text, 'th', 'ht') || 'x' as b from documents)""")
def changed_characters(spark, d):
    a = F.col("text")
    return _table(spark, d, "documents").select("doc_id", T.changed_characters(a, F.concat(F.replace(a, F.lit("th"), F.lit("ht")), F.lit("x"))).cast("bigint").alias("changed_characters"))


# --- fuzzy ------------------------------------------------------------------------

_LINES_SQL = f"(select line, {Q.VIEW.format('line')} as a, {Q.quoted(LINES[0].lower())} as b from (select distinct trim(x, ' ') as line from (select unnest(string_split(text, chr(10))) as x from documents)) where line <> '')"
_PARTS_SQL = f"(select *, {Q.TOKENS.format('a')} as ta, {Q.TOKENS.format('b')} as tb, {Q.GRAMS.format('a')} as ga, {Q.GRAMS.format('b')} as gb from {_LINES_SQL})"


def _lines(spark, d) -> DataFrame:
    """All lines of all texts in matching form, beside a template; a text's equal lines once."""
    texts = T.with_lines(_table(spark, d, "documents").select("text"), "text")
    every = texts.select(F.explode_outer(F.array_distinct(F.transform("lines", lambda x: x["value"]))).alias("line")).where("line is not null")
    return every.select("line", T.matching_view(F.col("line"), False).alias("a"), F.lit(LINES[0].lower()).alias("b"))


def _pair_query(name: str, spark_fn, sql: str, cast: str = "bigint") -> None:
    def f(spark, d):
        # equal lines have equal values: what is shuffled is these, not the lines
        return _lines(spark, d).select(F.sha2("line", 256).alias("line_sha"), spark_fn(F.col("a"), F.col("b")).cast(cast).alias("value")).distinct()

    f.__name__ = name
    query(f"select sha256(line) as line_sha, cast({sql} as {'varchar' if cast == 'string' else 'bigint'}) as value from {_PARTS_SQL}")(f)


_pair_query("fuzzy_matching_view", lambda a, b: a, "a", "string")
_pair_query("fuzzy_levenshtein", T.levenshtein, Q.distance("a", "b"))
_pair_query("fuzzy_ratio", T.ratio, Q.ratio("a", "b"))
_pair_query("fuzzy_tokens", lambda a, b: F.array_join(T.tokens(a), "|"), "array_to_string(ta, '|')", "string")
_pair_query("fuzzy_token_sort", T.token_sort_ratio, Q.ratio(Q.SORTED.format("ta"), Q.SORTED.format("tb")))
_pair_query("fuzzy_token_set", T.token_set_ratio, Q.token_set("list_distinct(ta)", "list_distinct(tb)"))
_pair_query("fuzzy_char_jaccard", T.char_jaccard, Q.jaccard("ga", "gb"))
_pair_query("fuzzy_partial_ratio", T.partial_ratio, Q.partial_ratio("a", "b"))


@query(r"""with l as (select doc_id, unnest(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), lambda x, i: {'i': i, 'v': x})) as x from documents),
    n as (select doc_id, max(x.i) as n from l group by 1)
    select case when x.i = 1 then 'prefix' when x.i = n then 'suffix' else 'line' end as position, count(*) as n from l join n using (doc_id) group by 1""")
def line_positions(spark, d):
    rows = T.with_lines(_docs(spark, d).select("raw_text"), "raw_text").select(F.size("lines").alias("n"), F.posexplode_outer("lines").alias("i", "x")).where("i is not null")
    return rows.groupBy(F.when(F.col("i") == 0, "prefix").when(F.col("i") == F.col("n") - 1, "suffix").otherwise("line").alias("position")).agg(F.count("*").alias("n"))


#: Slight variants of two headers, so that all decisions occur.
_VARIANTS = (("Nicht aulich", "Nciht aulihc xq"), ("The and attion", "The and atttion"))
_SRC = f"select cast(doc_id as varchar) as record_id, replace(replace(text, '{_VARIANTS[0][0]}', '{_VARIANTS[0][1]}'), '{_VARIANTS[1][0]}', '{_VARIANTS[1][1]}') as text from documents"
_CHAIN = f"with {Q.one(FUZZY)}, {Q.chain(_SRC, FUZZY)} "


def _noisy(spark, d) -> DataFrame:
    text = F.col("raw_text")
    for old, new in _VARIANTS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return _docs(spark, d).withColumn("raw_text", text)


def _big(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


@query(_CHAIN + 'select record_id, "start", "end", position, sha256(region) as region_sha from reg')
def line_regions(spark, d):
    return _big(Z.regions(_noisy(spark, d), FUZZY).select("record_id", "start", "end", "position", F.sha2("region", 256).alias("region_sha")), "start", "end")


@query(_CHAIN + "select region, template_id, cast(combined as bigint) as combined, cast(margin as bigint) as margin from best")
def fuzzy_best_template(spark, d):
    return _big(Z.best_templates(Z.regions(_noisy(spark, d), FUZZY), FUZZY).select("region", "template_id", "combined", "margin"), "combined", "margin")


@query(_CHAIN + f"select margin >= {FUZZY.margin} as clear, count(*) as n from best group by 1")
def fuzzy_margin(spark, d):
    return Z.best_templates(Z.regions(_noisy(spark, d), FUZZY), FUZZY).groupBy((F.col("margin") >= FUZZY.margin).alias("clear")).agg(F.count("*").alias("n"))


@query(_CHAIN + f"select region, template_id, {', '.join(f'cast({k} as bigint) as {k}' for k in (*T.SCORES, 'combined'))} from sc")
def fuzzy_combined(spark, d):
    return _big(Z.scored(Z.regions(_noisy(spark, d), FUZZY), FUZZY).select("region", "template_id", *T.SCORES, "combined"), *T.SCORES, "combined")


@query(_CHAIN + 'select record_id, "start", "end", position, template_id, cast(combined as bigint) as combined, cast(margin as bigint) as margin, decision, reasons from dec')
def fuzzy_decisions(spark, d):
    rows = Z.decisions(_noisy(spark, d), FUZZY).select("record_id", "start", "end", "position", "template_id", "combined", "margin", "decision", F.array_join("reason_codes", ",").alias("reasons"))
    return _big(rows, "start", "end", "combined", "margin")


@query(_CHAIN + "select decision, count(*) as n from dec group by 1")
def fuzzy_decision_counts(spark, d):
    return Z.decisions(_noisy(spark, d), FUZZY).groupBy("decision").agg(F.count("*").alias("n"))


@query(_CHAIN + """select record_id, "start", "end", template_id, cast(combined as bigint) as combined from res where decision = 'review'""")
def fuzzy_review_queue(spark, d):
    rows = Z.resolved(_noisy(spark, d), FUZZY).select("record_id", F.explode_outer(F.filter("decisions", lambda x: x["decision"] == "review")).alias("d")).where("d is not null")
    return _big(rows.select("record_id", "d.start", "d.end", "d.template_id", "d.combined"), "start", "end", "combined")


@query(_CHAIN + "select record_id, count(*) as n from res group by 1")
def fuzzy_overlaps(spark, d):
    return _big(Z.resolved(_noisy(spark, d), FUZZY).where("decisions is not null").select("record_id", F.size("decisions").alias("n")), "n")


@query(_CHAIN + f"select record_id, sha256(case when spans is null then text else {Q.deleted('text', 'spans')} end) as clean_sha from src left join ap using (record_id)")
def fuzzy_clean(spark, d):
    return Z.fuzzy_clean(_noisy(spark, d), FUZZY).select("record_id", F.sha2("clean_text", 256).alias("clean_sha"))


#: Measures of an event, and its gates in order of their names.
_MEASURES = ["span_start", "span_end", "margin", "length_ratio", "evidence_count", *T.SCORES, "combined", "auto_threshold", "review_threshold", "best_match_margin"]
_GATES = ["boundary", "evidence", "length", "margin", "minimum_length", "position", "protected", "regex"]
_GATES_SQL = {"boundary": "true", "minimum_length": "not g_short", "protected": "g_protected", "regex": "g_regex"} | {k: f"not g_{k}" for k in ("evidence", "length", "margin", "position")}
_MEASURES_SQL = {"span_start": '"start"', "span_end": '"end"', "auto_threshold": "auto", "review_threshold": "review", "best_match_margin": str(FUZZY.margin)}


@query(_CHAIN + f""", ev as (select record_id, text, spans, removed_lines, unnest(range(1, len(spans) + 1)) as k from src join ap using (record_id)),
    done as (select record_id, removed_lines[k] as line, k - 1 as seq, {Q.deleted('text', 'spans[1:k-1]')} as t0, {Q.deleted('text', 'spans[1:k]')} as t1 from ev),
    ends as (select record_id, 'sha256:' || sha256(case when spans is null then text else {Q.deleted('text', 'spans')} end) as last, coalesce(len(spans), 0) as m from src left join ap using (record_id)),
    every as (select record_id, line, seq, 'sha256:' || sha256(t0) as before_hash, 'sha256:' || sha256(t1) as after_hash, greatest(0, length(t0) - length(t1)) as removed_chars from done
        union all select record_id, line, m + row_number() over (partition by record_id order by line) - 1, last, last, 0 from res join ends using (record_id) where decision <> 'applied')
    select record_id, cast(seq as bigint) as seq, 'fuzzy_template_cleaning' as stage, 'fuzzy:' || template_id as rule_id, '1.0.0' as rule_version, 'fuzzy' as match_method, 'remove' as action,
        case decision when 'applied' then 'fuzzy_template_auto' when 'review' then 'fuzzy_template_review' else 'fuzzy_template_skipped' end as reason_code, decision, sha256(region) as span_sha, cast(removed_chars as bigint) as removed_chars, combined / 10000 as score, before_hash, after_hash,
        'fuzzy-template-clean-v1' as algorithm_version, 'cleaning-event-v1' as schema_version, position, reasons, {' || '.join(f"case when {_GATES_SQL[g]} then '1' else '0' end" for g in _GATES)} as gates,
        {', '.join(f'cast({_MEASURES_SQL.get(k, k)} as bigint) as {k}' for k in _MEASURES)} from every join res using (record_id, line)""")  # fmt: skip
def fuzzy_events(spark, d):
    rows = Z.fuzzy_events(_noisy(spark, d), FUZZY)
    plain = ["record_id", "seq", "stage", "rule_id", "rule_version", "match_method", "action", "reason_code", "decision", "removed_chars", "score", "before_hash", "after_hash", "algorithm_version", "schema_version"]
    gates = F.concat(*(F.col(f"metrics.gates.{g}").cast("int").cast("string") for g in _GATES))
    rows = rows.select(*plain, F.sha2("matched_span", 256).alias("span_sha"), "metrics.position", F.array_join("metrics.reason_codes", ",").alias("reasons"), gates.alias("gates"), *(F.col(f"metrics.{k}") for k in _MEASURES))
    return _big(rows, "seq", "removed_chars", *_MEASURES)


def _cases(spark, d) -> DataFrame:
    """Documents that begin with the known header should lose it, and those with its variant be reviewed."""
    t = F.col("raw_text")
    applied = t.startswith(LINES[0] + "\n") | t.contains("\n" + LINES[3])
    rows = _docs(spark, d).withColumn("expected", F.when(applied, "applied").when(t.contains(LINES[1]), "review").otherwise("skipped"))
    for old, new in _VARIANTS:
        rows = rows.withColumn("raw_text", F.replace("raw_text", F.lit(old), F.lit(new)))
    return rows


_EXPECTED = f"""ex as (select cast(doc_id as varchar) as record_id, case when starts_with(text, {Q.quoted(LINES[0])} || chr(10)) or contains(text, chr(10) || {Q.quoted(LINES[3])}) then 'applied' when contains(text, {Q.quoted(LINES[1])}) then 'review' else 'skipped' end as expected from documents)"""
_RANK = "case decision when 'applied' then 2 when 'review' then 1 else 0 end"
_OUTCOME = f"{_CHAIN}, {_EXPECTED}, bd as (select record_id, max_by(decision, {_RANK}) as actual from dec group by 1), oc as (select record_id, expected, coalesce(actual, 'skipped') as actual from ex left join bd using (record_id)) "


def _outcome(spark, d) -> DataFrame:
    return Z.outcomes(_cases(spark, d), FUZZY).select("record_id", "expected", "actual")


@query(_OUTCOME + "select record_id, expected, actual from oc")
def fuzzy_case_outcome(spark, d):
    return _outcome(spark, d)


@query(_OUTCOME + "select expected, count(*) filter (where actual = 'applied') as applied, count(*) filter (where actual = 'review') as review, count(*) filter (where actual = 'skipped') as skipped from oc group by 1")
def fuzzy_confusion(spark, d):
    return Z.confusion(_outcome(spark, d))


def _metric(n: str, of: str) -> str:
    return f"cast({Q.basis(f'count(*) filter (where {n})', f'count(*) filter (where {of})')} as bigint)"


@query(f"""with th(auto, review) as (values (8000, 6000), (8000, 7500), (9500, 6000), (9500, 7500)), {Q.chain(_SRC, FUZZY)}, {_EXPECTED},
    bd as (select record_id, auto, review, max_by(decision, {_RANK}) as actual from res group by all), oc as (select th.auto, th.review, expected, coalesce(actual, 'skipped') as actual from ex cross join th left join bd using (record_id, auto, review))
    select cast(auto as bigint) as auto, cast(review as bigint) as review, {_metric("expected = 'applied' and actual = 'applied'", "actual = 'applied'")} as auto_precision, {_metric("expected = 'applied' and actual = 'applied'", "expected = 'applied'")} as auto_recall,
        {_metric("expected = 'review' and actual = 'review'", "expected = 'review'")} as review_capture, count(*) filter (where actual = 'applied' and expected <> 'applied') as false_removals, count(*) filter (where actual = 'review' and expected = 'skipped') as meaningless_review from oc group by 1, 2""")  # fmt: skip
def fuzzy_threshold_grid(spark, d):
    names = ["auto", "review", "auto_precision", "auto_recall", "review_capture", "false_removals", "meaningless_review"]
    grid = Z.threshold_grid(_cases(spark, d), FUZZY, [8000, 9500], [6000, 7500]).select(*names)
    return _big(grid, "auto", "review", "auto_precision", "auto_recall", "review_capture")


@query("select count(*) filter (where contains(text, 'th')) as changed_records, sum(length(replace(text, 'th', chr(64257))))::bigint as before_characters, sum(length(replace(text, 'th', 'fi')))::bigint as after_characters from documents")
def nfkc_audit(spark, d):
    return Z.nfkc_audit(_docs(spark, d).withColumn("raw_text", F.replace("raw_text", F.lit("th"), F.lit("ﬁ"))))


@query(rf"select c as before, count(*) as n from (select unnest(string_split(translate(text, '{PLAIN}', '{WIDE}'), '')) as c from documents) where c between '{chr(0xFF01)}' and '{chr(0xFF5E)}' group by 1 order by 2 desc, 1 limit 20")
def char_mapping_top(spark, d):
    wide = _docs(spark, d).withColumn("raw_text", F.translate("raw_text", PLAIN, WIDE))
    return Z.character_mappings(wide).select("before", "n")
