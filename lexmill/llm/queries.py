"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe import encode_decode
from .decontaminate import contaminated
from .exact_dedup import exact_duplicates
from .licenses import license_scan
from .lm_score import lm_scores
from .near_dedup import near_duplicates
from .phrases import collocations
from .pii import replace_pii
from .quality import quality_scores
from .search import ranked_search
from .sharding import shards
from .url_filter import url_verdicts
from .warc import archive_pages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), similarity=0.85)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(_table(spark, sf_dir, "documents"), key="public test key")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(_table(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


#: Bytes of a shard in the registered query: small enough that the test tables split.
SHARD_BYTES = 1 << 20


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(_table(spark, sf_dir, "pages"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_decontaminate, op3_lm_score, op4_exact_dedup, op5_pii, op6_url_filter, op7_license_scan, op8_quality, op9_bpe, op10_sharding, op11_phrases, op12_warc, op13_search)}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
        with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
        select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
               doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
        from t""",
    "op11_phrases": r"""
        with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
        words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
        grams as (
            select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
            from words, (values (1), (2), (3)) as t(k) where len(w) >= k),
        f as (select lang, k, phrase, count(*)::hugeint as c from grams group by all),
        totals as (select lang, sum(c) as n from f where k = 1 group by lang),
        candidates as (select lang, k, phrase, c as a, string_split(phrase, ' ') as w from f where k > 1 and c >= 10),
        cuts as (
            select x.lang, x.k, x.phrase, x.a, y.c as l, z.c as r, (1000000 * x.a * x.a) // (y.c * z.c) as score, cut
            from (select *, unnest(range(1, k)) as cut from candidates) as x
            join f as y on y.lang = x.lang and y.phrase = array_to_string(x.w[1:cut], ' ')
            join f as z on z.lang = x.lang and z.phrase = array_to_string(x.w[cut + 1:], ' ')),
        best as (select * from cuts qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
        longer as (
            select lang, part, max(a) as more
            from (select lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) as part from candidates where k = 3) group by all),
        kept as (select b.* from best as b left join longer as m on m.lang = b.lang and m.part = b.phrase where m.more is null or 100 * m.more < 50 * b.a),
        ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
        select lang, rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
        from ranked join totals using (lang) where rank <= 2000""",
    "op12_warc": r"""
        with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
        coded as (
            select *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31)::int + 1, 1)), '') as payload_digest,
                max(page_id) over (partition by html) as target
            from p)
        select page_id, strlen(html)::bigint as payload_bytes, payload_digest, case when page_id = target then 'response' else 'revisit' end as record_type,
               case when page_id <> target then target end as refers_to
        from coded""",
    "op13_search": r"""
        with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms from documents where text is not null),
        sums as (select count(*) as nd, sum(len(terms))::bigint as nt from d where len(terms) > 0),
        tf as (select doc_id, len(terms) as n, term, count(*) as f from (select doc_id, terms, unnest(terms) as term from d) group by all),
        q as (
            select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
            from benchmark),
        w as (select term, floor(1000 * ln((2.0::double * max(nd) + 2) / (2.0::double * count(*) + 1)))::bigint as w from tf, sums where term in (select term from q) group by term),
        scores as (
            select q.item_id, tf.doc_id, sum(w.w * ((1000000000 * f) // (1000 * f + 20 * (100 - 50 + (50 * n * nd) // nt))))::bigint as score
            from q join w using (term) join tf using (term), sums group by all),
        ranked as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scores where score > 0)
        select item_id, rank::int as rank, doc_id, score from ranked where rank <= 50""",
}
