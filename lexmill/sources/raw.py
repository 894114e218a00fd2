"""Raw files (JSONL, TSV, HTML, JSON arrays) to records and quarantine.

Files of lines are read in Spark's own splits and arrays in ranges of bytes, so their size
doesn't matter. What Spark doesn't show (hidden files) and what gives one row only (unknown
formats, files that are not UTF-8 or no JSON) is read in pieces, each file by one task. An
Arrow pass parses with Python's strict JSON, because error codes depend on its rules. Good
and bad rows come out of the same pass and are split by a filter.
"""

from __future__ import annotations

import hashlib
import io
import json
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.records import ProcessingError
from .arrays import RANGE_BYTES, elements, ranges, spread, starts_with_bracket, states
from .scan import BOM, FORMATS, SKIPPED, digest, extension, listing, opened, pieces, scan

#: The raw contract's version, fields and header: fixed values.
PARSER_VERSION = "parser-v1"
FIELDS = ["record_id", "dataset_id", "event_date", "record_type", "title", "raw_text", "category_signal", "source_batch", "synthetic"]
HEADER = ["record_id", "dataset_id", "event_date_json", "record_type", "title_json", "raw_text_json", "category_signal_json", "source_batch", "synthetic"]
OUT = (
    "record_id string, dataset_id string, source_file string, source_offset bigint, record_type string, event_date string, title string, raw_text string, clean_text string,"
    " metadata string, parser_version string, schema_version string, detected_format string, error_code string, message string, raw_fragment_hash string"
)


@dataclass(frozen=True)
class ParsingConfig:
    parser_version: str = PARSER_VERSION
    schema_version: str = "parsing-config-v1"
    supported_extensions: tuple[tuple[str, str], ...] = tuple(sorted(FORMATS.items()))


def canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def _hash(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


class _Bad(Exception):
    def __init__(self, code: str, message: str):
        self.code, self.message = code, message


def _record(raw: object, kind: str) -> dict:
    """A raw object as record fields; the first broken rule in the contract's order is raised."""
    if not isinstance(raw, dict):
        raise _Bad("type_error", "record must be an object")
    if unknown := sorted(set(raw) - set(FIELDS)):
        raise _Bad("unknown_schema_drift", f"unknown fields: {', '.join(unknown)}")
    for f in FIELDS:
        if f not in raw:
            raise _Bad("missing_field", f"missing field: {f}")
    if not isinstance(raw["synthetic"], bool):
        raise _Bad("type_error", "synthetic must be a boolean")
    checks = [(f, "type_error", isinstance(raw[f], str)) for f in ("record_id", "dataset_id", "record_type", "raw_text")]
    checks += [(f, "invalid_value", bool(raw[f])) for f in ("record_id", "dataset_id")]
    checks += [("record_type", "invalid_value", raw["record_type"] in ("article", "comment", "reply"))]
    checks += [(f, "type_error", raw[f] is None or isinstance(raw[f], str)) for f in ("event_date", "title")]
    for f, code, good in checks:
        if not good:
            raise _Bad(code, f"invalid record: {f}")
    d = raw["event_date"]
    if d is not None and not (len(d) == 10 and d[4] == d[7] == "-" and all(c in "0123456789" for c in d[:4] + d[5:7] + d[8:])):
        raise _Bad("invalid_value", "invalid record: event_date")
    meta = {"category_signal": raw["category_signal"], "source_batch": raw["source_batch"], "source_format": kind, "synthetic": raw["synthetic"]}
    return {f: raw[f] for f in ("record_id", "dataset_id", "record_type", "event_date", "title", "raw_text")} | {"metadata": canonical(meta)}


class _Article(HTMLParser):
    found: dict | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "article":
            self.found = dict(attrs)


def _cell(text: str, code: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        raise _Bad(code, "invalid JSON value") from None


def _json_line(line: bytes, first: bool) -> object:
    try:
        return json.loads((line.removeprefix(BOM) if first else line).decode())
    except ValueError:
        raise _Bad("invalid_json", "line is not valid JSON") from None


def _tsv_line(line: bytes, first: bool) -> object:
    cells = line.decode().split("\t")
    if len(cells) != len(HEADER):
        raise _Bad("malformed_tsv", "wrong number of columns")
    raw = {h.removesuffix("_json"): _cell(c, "malformed_tsv") if h.endswith("_json") else c for h, c in zip(HEADER, cells)}
    raw["synthetic"] = {"true": True, "false": False}.get(raw["synthetic"], raw["synthetic"])
    return raw


def _html_line(line: bytes, first: bool) -> object:
    p = _Article()
    p.feed(line.decode())
    if p.found is None:
        raise _Bad("invalid_html", "no article")
    raw = {}
    for f, h in zip(FIELDS, ["record-id", "dataset-id", "event-date-json", "record-type", "title-json", "raw-text-json", "category-signal-json", "source-batch", "synthetic"]):
        v = p.found.get(f"data-{h}")
        if v is None:
            raise _Bad("invalid_html", f"missing data-{h}")
        raw[f] = _cell(v, "invalid_html") if h.endswith("-json") else v
    raw["synthetic"] = raw["synthetic"] == "true"
    return raw


LINES = {"jsonl": _json_line, "tsv": _tsv_line, "html": _html_line}


def _row(name: str, kind: str, offset: int, fragment: bytes, raw: object) -> dict:
    """A record, or a quarantined row where ``raw`` is an error or breaks the contract."""
    base = {"source_file": name, "detected_format": kind, "parser_version": PARSER_VERSION, "source_offset": offset}
    try:
        if isinstance(raw, _Bad):
            raise raw
        return base | _record(raw, kind) | {"schema_version": "record-v1"}
    except _Bad as e:
        return base | {"error_code": e.code, "message": e.message, "raw_fragment_hash": _hash(fragment), "schema_version": "quarantine-record-v1"}


def _line(name: str, kind: str, offset: int, good_header: bool, line: bytes) -> dict:
    line = line.rstrip(b"\r\n")
    if not good_header:
        return _row(name, kind, 0, line.removeprefix(BOM), _Bad("unknown_schema_drift", "unexpected header"))
    if kind == "jsonl" and offset == 0:
        line = line.removeprefix(BOM)
    try:
        return _row(name, kind, offset, line, LINES[kind](line, offset == 0))
    except _Bad as e:
        return _row(name, kind, offset, line, e)


def _element(name: str, offset: int, raw: object) -> dict:
    """A row of an array; offset -2 stands for bytes that are no JSON, -1 for nothing between the brackets."""
    return {"source_file": name, "source_offset": offset} if offset < 0 else _row(name, "json", offset, canonical(raw).encode(), raw)


def _failed(name: str, kind: str, sha: str, code: str, message: str) -> dict:
    """The one row of a file that gives no record, with the hash of its bytes."""
    return {"source_file": name, "detected_format": kind, "parser_version": PARSER_VERSION, "source_offset": 0, "error_code": code, "message": message, "raw_fragment_hash": f"sha256:{sha}", "schema_version": "quarantine-record-v1"}


def _stream(name: str, path: str, kind: str) -> Iterator[dict]:
    """The rows of a file of lines that Spark doesn't show, line by line."""
    system, own = opened(path)
    with system.open_input_stream(own, compression=None) as file:
        n = -1 if kind == "tsv" else 0
        for line in io.BufferedReader(file, 1 << 20):
            if n < 0:
                if (line.rstrip(b"\r\n").removeprefix(BOM)) != "\t".join(HEADER).encode():
                    yield _line(name, kind, 0, False, line)
                    return
            elif kind != "html" or b"<article" in line.lower():
                yield _line(name, kind, n, True, line)
            else:
                continue
            n += 1


def _apart(name: str, path: str, kind: str) -> Iterator[dict]:
    """The rows of a file that isn't read in splits or ranges, in constant memory: of an unknown format, hidden, or with bytes that don't fit its format."""
    try:
        system, own = opened(path)
        size, sha, bom, good = digest(pieces(system, own))
        if not size:
            return
        if kind == "unknown":
            yield _failed(name, kind, sha, "unsupported_format", "unsupported extension")
        elif not good:
            yield _failed(name, kind, sha, "invalid_encoding", "file is not UTF-8")
        elif kind in LINES:
            yield from _stream(name, path, kind)
        else:
            if bom:
                sha = digest(pieces(system, own, 3))[1]
            if not starts_with_bracket(path):  # another JSON value than an array, or none: it has to be parsed as a whole
                try:
                    json.loads(b"".join(pieces(system, own)).removeprefix(BOM))
                    yield _failed(name, kind, sha, "type_error", "file is not an array")
                    return
                except ValueError:
                    pass
            yield _failed(name, kind, sha, "invalid_json", "file is not valid JSON")
    except OSError as e:
        yield _failed(name, kind, hashlib.sha256(b"").hexdigest(), "io_error", type(e).__name__)


def _relative(spark: SparkSession, root: str, path: Column) -> Column:
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    start = F.regexp_replace(F.lit(full), r"^file:/+", "file:/")
    return F.regexp_replace(path, r"^file:/+", "file:/").substr(F.length(start) + 1, F.length(path))


def lines(spark: SparkSession, root: str) -> DataFrame:
    """name, kind, offset, good_header, bad_file, value of the lines of JSONL, TSV and HTML files that hold a row, from Spark's own splits.

    Each split counts its rows, and numbers them behind the splits before it. TSV offsets
    are those of data lines; of a TSV file with another header, the header alone comes.
    """
    path = F.col("_metadata.file_path")
    either = lambda e: "".join(f"[{c}{c.upper()}]" for c in e)
    names = "*.{" + ",".join(either(e[1:]) for e, k in FORMATS.items() if k in LINES) + "}"
    text = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names).option("lineSep", "\n").text(root)
    rows = text.select(F.col("value").cast("binary").alias("value"), F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("path"), F.col("_metadata.file_block_start").alias("at"), (~F.is_valid_utf8("value")).alias("bad"))
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv)), ext)
    rows = rows.withColumn("kind", kind).where(F.col("kind").isin(list(LINES))).withColumn("name", _relative(spark, root, F.col("path")))
    rows = rows.where(~F.exists(F.split("name", "/"), lambda x: x.isin(SKIPPED)))
    mine = rows.where((F.col("kind") != "html") | F.contains(F.lower(F.decode("value", "iso-8859-1")), F.lit("<article"))).withColumn("n", F.monotonically_increasing_id())
    splits = mine.groupBy("name", "at").agg(F.count("*").alias("held"), F.min("n").alias("first"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy("name").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("name", "at", "first", before.alias("before"))
    bare = F.regexp_replace(F.regexp_replace(F.decode("value", "iso-8859-1"), "^\u00ef\u00bb\u00bf", ""), r"[\r\n]+$", "")
    heads = mine.where("kind = 'tsv'").withColumn("good", bare == F.lit("\t".join(HEADER))).groupBy("name").agg(F.min_by("good", F.struct("at", "n")).alias("good_header"))
    bad = rows.groupBy("name").agg(F.bool_or("bad").alias("bad_file"))
    out = mine.join(splits, ["name", "at"]).join(heads, "name", "left").join(bad, "name").withColumn("good_header", F.coalesce("good_header", F.lit(True)))
    out = out.withColumn("offset", F.col("n") - F.col("first") + F.col("before") - F.when(F.col("kind") == "tsv", 1).otherwise(0))
    return out.where((F.col("kind") != "tsv") | F.when(F.col("good_header"), F.col("offset") >= 0).otherwise(F.col("offset") == -1)).select("name", "kind", "offset", "good_header", "bad_file", "value")


def scan_manifest(spark: SparkSession, root: str, without: str | None = None) -> DataFrame:
    """One row per file: size, hash, format, encoding and status."""
    return scan(spark, root, without)


def parse_directory(spark: SparkSession, root: str, parser_version: str = PARSER_VERSION) -> tuple[DataFrame, DataFrame]:
    """(records, quarantine), each in order of file and offset. A file that can't be read is quarantined as ``io_error``."""
    if parser_version != PARSER_VERSION:
        raise ProcessingError("invalid_parsing_config", parser_version)
    names = [x.split()[0] for x in OUT.replace(", ", ",").split(",")]
    schema = pa.schema([(n, pa.int64() if n == "source_offset" else pa.string()) for n in names])

    def batched(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        while part := list(islice(rows, 5000)):
            yield pa.RecordBatch.from_pylist(part, schema=schema)

    def parse_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("name", "path", "kind"))):
                yield from batched(_apart(*row))

    def parse_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from batched(_line(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("name", "kind", "offset", "good_header", "value"))))

    scheme = root.split("://")[0] + "://" if "://" in root else "file://" if root.startswith("file:") else ""
    found = [(n, scheme + p, size, FORMATS.get(extension(n), "unknown"), any(x.startswith(("_", ".")) for x in n.split("/"))) for n, p, size in listing(root)]
    held = spark.createDataFrame(found, "name string, path string, byte_size bigint, kind string, hidden boolean").where("byte_size > 0")

    rows = lines(spark, root)
    broken = rows.where("bad_file").select("name").distinct()
    parsed = rows.where("not bad_file").select("name", "kind", "offset", "good_header", "value").mapInArrow(parse_lines, OUT)

    dealt = states(spread(spark, ranges(held.where("kind = 'json'"), RANGE_BYTES)))
    items = elements(spread(spark, dealt), _element, OUT, schema)
    # an array counts if no range found an error, and either elements or the one gap of an empty array
    verdict = items.groupBy(F.col("source_file").alias("name")).agg((F.min("source_offset") >= F.when(F.count("*") > 1, 0).otherwise(-1)).alias("good"))
    arrays = held.where("kind = 'json'").join(verdict, "name", "left").select("name", "path", "kind", F.coalesce("good", F.lit(False)).alias("good"))
    items = items.where("source_offset >= 0").join(arrays.where("good").select(F.col("name").alias("source_file")), "source_file", "left_semi").select(*names)

    apart = held.where((F.col("kind") == "unknown") | (F.col("hidden") & F.col("kind").isin(list(LINES)))).select("name", "path", "kind")
    apart = apart.unionByName(held.join(broken, "name", "left_semi").select("name", "path", "kind")).unionByName(arrays.where("not good").drop("good"))
    every = parsed.unionByName(items).unionByName(spread(spark, apart).mapInArrow(parse_apart, OUT))
    records = every.where("error_code is null").drop("error_code", "message", "raw_fragment_hash", "detected_format").orderBy("source_file", "source_offset")
    bad = every.where("error_code is not null").select("source_file", "source_offset", "detected_format", "error_code", "message", "raw_fragment_hash", "parser_version", "schema_version")
    return records, bad.orderBy("source_file", "source_offset", "error_code")
