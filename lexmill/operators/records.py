"""The record contract, adapters from Parquet tables, validation, field paths and filters."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.canonical import canonical_json, canonical_text
from ..functions.text import is_blank

RECORD_SCHEMA = (
    "record_id string, dataset_id string, source_file string, source_offset bigint, record_type string, event_date string,"
    " title string, raw_text string, clean_text string, metadata string, parser_version string, schema_version string"
)
RECORD_TYPES = ["article", "comment", "reply"]
NULL, MISSING = "__NULL__", "__MISSING__"


class ProcessingError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"[{code}] {message}")
        self.code, self.message = code, message


def _record(df: DataFrame, **columns: Column) -> DataFrame:
    fixed = {"event_date": F.lit(None), "title": F.lit(None), "clean_text": F.lit(None), "parser_version": F.lit("parquet-v1"), "schema_version": F.lit("record-v1")}
    names = [(p.split()[0], p.split()[1]) for p in RECORD_SCHEMA.replace(", ", ",").split(",")]
    return df.select(*((columns | {k: v for k, v in fixed.items() if k not in columns})[n].cast(t).alias(n) for n, t in names))


def records_from_documents(df: DataFrame) -> DataFrame:
    meta = F.to_json(F.struct("lang", "n_chars", F.lit("parquet").alias("source_format")), {"ignoreNullFields": "false"})
    return _record(df, record_id=F.col("doc_id"), dataset_id=F.col("source"), source_file=F.lit("documents.parquet"), source_offset=F.col("doc_id"), record_type=F.lit("article"), raw_text=F.col("text"), metadata=meta)


def records_from_conversations(df: DataFrame) -> DataFrame:
    return _record(df, record_id=F.concat_ws("-", "conv_id", "turn"), dataset_id=F.col("role"), source_file=F.lit("conversations.parquet"), source_offset=F.col("conv_id"), record_type=F.when(F.col("turn") == 0, "comment").otherwise("reply"), raw_text=F.col("text"), metadata=F.lit('{"source_format":"parquet"}'))


def records_from_pages(df: DataFrame) -> DataFrame:
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    return _record(df, record_id=F.col("page_id"), dataset_id=host, source_file=F.lit("pages.parquet"), source_offset=F.col("page_id"), record_type=F.lit("article"), raw_text=F.col("html"), metadata=F.lit('{"source_format":"parquet"}'))


def records_from_events(df: DataFrame) -> DataFrame:
    return _record(df, record_id=F.col("event_id"), dataset_id=F.col("event_type"), source_file=F.lit("events.parquet"), source_offset=F.col("event_id"), record_type=F.lit("comment"), event_date=F.date_format("ts", "yyyy-MM-dd"), raw_text=F.col("event_type"), metadata=F.col("props"))


def validation_error() -> Column:
    """STRUCT<type, field> of the first broken rule of a typed record, null when valid. Order matters."""

    def error(kind: str, field: str) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(field).alias("field"))

    steps = [F.when(F.col(f).isNull(), error("type_error", f)) for f in ("record_id", "dataset_id", "source_file", "record_type", "raw_text", "parser_version", "schema_version")]
    steps += [F.when(F.col(f) == "", error("invalid_value", f)) for f in ("record_id", "dataset_id", "source_file", "parser_version")]
    steps += [F.when(F.col("source_offset").isNull(), error("type_error", "source_offset")), F.when(F.col("source_offset") < 0, error("invalid_value", "source_offset"))]
    steps += [F.when(~F.col("record_type").isin(RECORD_TYPES), error("invalid_value", "record_type"))]
    steps += [F.when(~F.col("event_date").rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), error("invalid_value", "event_date"))]
    steps += [F.when(F.coalesce(F.schema_of_variant(F.try_parse_json("metadata")), F.lit("")).startswith("OBJECT") == F.lit(False), error("type_error", "metadata"))]
    steps += [F.when(F.col("schema_version") != "record-v1", error("invalid_value", "schema_version"))]
    return F.coalesce(*steps)


def validate_records(records: DataFrame) -> DataFrame:
    """One row per record: error_type and error_field, null when the record keeps the contract."""
    return records.withColumn("_e", validation_error()).select("record_id", F.col("_e.type").alias("error_type"), F.col("_e.field").alias("error_field"))


FIELDS = [p.split()[0] for p in RECORD_SCHEMA.replace(", ", ",").split(",")]


def _inside(path: str, kind: str) -> Column:
    """What metadata has at a path: a variant or a string."""
    keys = path.split(".")[1:]
    if any("'" in k and '"' in k for k in keys):  # Spark's paths can't name such a key
        return F.lit(None).cast(kind)
    steps = "".join(f'["{k}"]' if "'" in k else f"['{k}']" for k in keys)
    return F.try_variant_get(F.try_parse_json("metadata"), "$" + steps, kind)


def field_value(path: str) -> Column:
    """A top-level column or a path into metadata, with sentinels for null and missing."""
    if not path.startswith("metadata."):
        return F.coalesce(F.col(path).cast("string"), F.lit(NULL)) if path in FIELDS else F.lit(MISSING)
    v = _inside(path, "variant")
    return F.when(v.isNull(), MISSING).when(F.is_variant_null(v), NULL).otherwise(_inside(path, "string"))


def _equals(path: str, wanted: Any) -> Column:
    """Whether a field has a value of the same type and content: true is neither 1 nor "true", "__NULL__" no null."""
    if not path.startswith("metadata."):
        if path not in FIELDS:
            return F.lit(False)
        if wanted is None:
            return F.col(path).isNull()
        number = isinstance(wanted, (int, float)) and not isinstance(wanted, bool)
        fits = number if path == "source_offset" else isinstance(wanted, str)
        return F.coalesce(F.col(path) == F.lit(wanted), F.lit(False)) if fits else F.lit(False)
    v = _inside(path, "variant")
    if wanted is None:
        return F.coalesce(F.is_variant_null(v), F.lit(False))
    kind = F.schema_of_variant(v)
    if isinstance(wanted, bool):
        good = (kind == "BOOLEAN") & (_inside(path, "boolean") == F.lit(wanted))
    elif isinstance(wanted, (int, float)):
        good = kind.rlike("^(BIGINT|DOUBLE|DECIMAL)") & (_inside(path, "double") == F.lit(float(wanted)))
        if isinstance(wanted, int):
            good = good & (~kind.startswith("BIGINT") | (_inside(path, "bigint") == F.lit(wanted)))
    elif isinstance(wanted, str):
        good = (kind == "STRING") & (_inside(path, "string") == F.lit(wanted))
    else:
        good = F.to_json(v) == F.to_json(F.parse_json(F.lit(json.dumps(wanted))))
    return F.coalesce(good, F.lit(False))


def matches_filters(filters: dict[str, Any]) -> Column:
    """AND over the keys; a list means any of its values; None means null. Values equal with their types."""
    keep = F.lit(True)
    for path, wanted in filters.items():
        some = F.lit(False)
        for w in wanted if isinstance(wanted, list) else [wanted]:
            some = some | _equals(path, w)
        keep = keep & some
    return keep


def profile(records: DataFrame) -> DataFrame:
    """One pass of grouping sets: kind, value, n for the four count maps."""
    keys = records.select("dataset_id", "record_type", F.coalesce("event_date", F.lit("<null>")).alias("event_date"), "schema_version")
    names = ["dataset_id", "record_type", "event_date", "schema_version"]
    return keys.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in names))).alias("x")).groupBy("x.kind", "x.value").agg(F.count("*").alias("n"))


def profile_totals(records: DataFrame) -> DataFrame:
    return records.agg(
        F.count("*").alias("total_records"),
        F.count_if(F.col("title").isNull() | is_blank(F.col("title"))).alias("missing_title"),
        F.count_if(is_blank(F.col("raw_text"))).alias("empty_body"),
        F.count_distinct("record_id").alias("unique_ids"),
        (F.count("*") - F.count_distinct("record_id")).alias("duplicate_ids"),
    )


def record_json() -> Column:
    """A record as canonical JSON: keys sorted at every depth, nulls kept, numbers of the metadata as Python writes them."""
    own = StructType.fromDDL(RECORD_SCHEMA)
    return canonical_json(F.struct(*(canonical_text(F.col(f)).alias(f) if f == "metadata" else F.col(f) for f in FIELDS)), own, ("metadata",))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = hashlib.sha256()
    for batch in batches:
        sha.update("".join(x + "\n" for x in batch.column("line").to_pylist()).encode())
    yield pa.RecordBatch.from_arrays([pa.array(["sha256:" + sha.hexdigest()])], names=["fingerprint"])


def fingerprint(df: DataFrame, json: Column, order: list[str]) -> DataFrame:
    """SHA-256 over the ordered lines, each with its line end.

    One task sorts (spilling to disk) and hashes line after line, in constant memory. Artifacts
    too large for one executor's disk are written in ordered parts, which are hashed on the way.
    """
    lines = df.select(*(F.col(c).alias(f"k{n}") for n, c in enumerate(order)), json.alias("line"))
    return lines.repartition(1).sortWithinPartitions(*(f"k{n}" for n in range(len(order)))).select("line").mapInArrow(_hashed, "fingerprint string")


def tree_fingerprint(df: DataFrame, json: Column, key: str) -> DataFrame:
    """SHA-256 over hashes, for tables of any size: lines in order of ``key`` within 65,536 buckets of its hash, buckets within 256, these in order."""
    rows = df.select(F.sha2(F.col(key).cast("string"), 256).alias("h"), F.col(key).alias("k"), json.alias("line"))
    level = rows.groupBy(F.substring("h", 1, 4).alias("b")).agg(body_of("k", "line").alias("line"))
    level = level.groupBy(F.substring("b", 1, 2).alias("c")).agg(body_of("b", "line").alias("line"))
    return level.agg(F.concat(F.lit("sha256:"), body_of("c", "line")).alias("fingerprint"))


def body_of(key: str, line: str) -> Column:
    """SHA-256 of a group's lines in order of ``key``, each with its line end."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(line).alias("line")))), lambda x: F.concat(x["line"], F.lit("\n"))), ""), 256)


def mergeable_fingerprint(df: DataFrame, json: Column) -> DataFrame:
    """Order-free fingerprint for tables of any size: count, and XOR and sum of row hashes."""
    h = F.xxhash64(json)
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("sum"))
