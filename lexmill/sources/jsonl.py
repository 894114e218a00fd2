"""Records as JSON Lines: a strict reader, one of fuzzy cases, and line numbers in Spark's own text scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.records import FIELDS, RECORD_SCHEMA, RECORD_TYPES, ProcessingError

#: Fields of a fuzzy case that have to be there: fixed values.
CASE_FIELDS = ["case_id", "record_type", "event_date", "input_text", "case_family", "split"]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line`` (from 1) and ``value`` of a text file. Each split counts its lines, and numbers them behind the splits before it."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    splits = rows.groupBy("file", "at").agg(F.count("*").alias("lines"), F.min("n").alias("first"))
    before = F.coalesce(F.sum("lines").over(Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a split
    splits = splits.select("file", "at", "first", before.alias("before"))
    return rows.join(F.broadcast(splits), ["file", "at"]).select((F.col("n") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def _kind(v: Column, field: str) -> Column:
    """The JSON type of a field: null where it is missing, VOID for null."""
    return F.schema_of_variant(F.try_variant_get(v, f"$.{field}", "variant"))


def _error(v: Column, keys: Column) -> Column:
    """STRUCT<type, field> of the first broken rule of a JSON value, in the contract's order."""

    def error(kind: str, field: str | None = None) -> Column:
        return F.struct(F.lit(kind).alias("type"), F.lit(field).cast("string").alias("field"))

    text = lambda f: F.try_variant_get(v, f"$.{f}", "string")
    steps = [F.when(v.isNull(), error("invalid_json")), F.when(~F.schema_of_variant(v).startswith("OBJECT"), error("type_error"))]
    steps += [F.when(~F.array_contains(keys, f), error("missing_field", f)) for f in FIELDS]
    unknown = F.array_min(F.array_except(keys, F.array(*map(F.lit, FIELDS))))
    steps += [F.when(unknown.isNotNull(), F.struct(F.lit("unexpected_field").alias("type"), unknown.alias("field")))]
    steps += [F.when(_kind(v, f) != "STRING", error("type_error", f)) for f in ("record_id", "dataset_id", "source_file", "raw_text", "parser_version", "schema_version")]
    steps += [F.when(text(f) == "", error("invalid_value", f)) for f in ("record_id", "dataset_id", "source_file", "parser_version")]
    offset = F.try_variant_get(v, "$.source_offset", "decimal(38,0)")
    whole = _kind(v, "source_offset").rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$")
    steps += [F.when(~whole, error("type_error", "source_offset")), F.when(~offset.between(F.lit(0), F.lit(2**63 - 1)), error("invalid_value", "source_offset"))]
    steps += [F.when(~F.coalesce((_kind(v, "record_type") == "STRING") & text("record_type").isin(RECORD_TYPES), F.lit(False)), error("invalid_value", "record_type"))]
    steps += [F.when(~_kind(v, f).isin("STRING", "VOID"), error("type_error", f)) for f in ("event_date", "title", "clean_text")]
    steps += [F.when(~text("event_date").rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), error("invalid_value", "event_date"))]
    steps += [F.when(~_kind(v, "metadata").startswith("OBJECT"), error("type_error", "metadata")), F.when(text("schema_version") != "record-v1", error("invalid_value", "schema_version"))]
    return F.coalesce(*steps)


def _record(v: Column) -> list[Column]:
    types = dict(p.split() for p in RECORD_SCHEMA.replace(", ", ",").split(","))
    value = {f: F.try_variant_get(v, f"$.{f}", types[f]) for f in FIELDS} | {"metadata": F.to_json(F.try_variant_get(v, "$.metadata", "variant"))}
    return [value[f].alias(f) for f in FIELDS]


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    rows = numbered_lines(spark, path)
    return rows.withColumn("v", F.try_parse_json("value")).withColumn("keys", F.coalesce(F.map_keys(F.from_json("value", "map<string,string>")), F.array().cast("array<string>")))


def record_errors(spark: SparkSession, path: str) -> DataFrame:
    """line, error_type, error_field of the lines that break the record contract."""
    rows = _parsed(spark, path).select("line", _error(F.col("v"), F.col("keys")).alias("e"))
    return rows.where("e is not null").select("line", F.col("e.type").alias("error_type"), F.col("e.field").alias("error_field"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of a JSON Lines file; the first broken line is raised, with line, type and field."""
    first = record_errors(spark, path).orderBy("line").first()
    if first is not None:
        field = f" field={first.error_field}" if first.error_field else ""
        raise ProcessingError(first.error_type, f"line {first.line} [{first.error_type}]{field}")
    return spark.read.text(path).select(F.parse_json("value").alias("v")).select(*_record(F.col("v")))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Records of fuzzy input, with ``expected`` and ``split`` (null for plain records).

    A line is a record, or a case with the text to clean; the first line that is neither is raised.
    """
    rows = _parsed(spark, path)
    text = lambda f: F.try_variant_get("v", f"$.{f}", "string")
    plain = F.coalesce(text("schema_version") == "record-v1", F.lit(False))
    lacking = F.size(F.array_except(F.array(*map(F.lit, CASE_FIELDS)), "keys")) > 0
    wrong = F.when(F.col("v").isNull(), "invalid JSON").when(~F.schema_of_variant("v").startswith("OBJECT"), "expected object").when(plain, F.concat(F.lit("record "), _error(F.col("v"), F.col("keys"))["type"])).when(lacking, "missing case fields")
    first = rows.select("line", wrong.alias("wrong")).where("wrong is not null").orderBy("line").first()
    if first is not None:
        raise ProcessingError("invalid_fuzzy_input", f"line {first.line}: {first.wrong}")
    case = {
        "record_id": text("case_id"), "dataset_id": F.lit("fuzzy_golden"), "source_file": F.lit("fuzzy-cleaning-v1.jsonl"), "source_offset": F.col("line") - 1, "record_type": text("record_type"), "event_date": text("event_date"), "title": F.lit(None).cast("string"),
        "raw_text": text("input_text"), "clean_text": text("input_text"), "metadata": F.to_json(F.struct(text("case_family").alias("case_family"), text("split").alias("golden_split"))), "parser_version": F.lit("fuzzy-golden-v1"), "schema_version": F.lit("record-v1"),
    }
    own = dict(zip(FIELDS, _record(F.col("v"))))
    return rows.select(*(F.when(plain, own[f]).otherwise(case[f]).alias(f) for f in FIELDS), text("expected_decision").alias("expected"), text("split").alias("split"))
