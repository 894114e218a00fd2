"""What other programs import: records of JSON Lines files, their profile, and the contracts' row types."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .operators.records import RECORD_SCHEMA, ProcessingError, profile, profile_totals
from .operators.sampling import SamplePlan
from .sources.jsonl import read_records
from .sources.scan import MANIFEST

TYPES = {"string": StringType(), "bigint": LongType(), "int": IntegerType(), "double": DoubleType(), "boolean": BooleanType()}


def _schema(fields: str, **nested: DataType) -> StructType:
    pairs = [f.split() for f in fields.replace(", ", ",").split(",")]
    return StructType([StructField(name, nested.get(name) or TYPES[kind]) for name, kind in pairs])


ValidationError = ProcessingError
SamplePlanV1 = SamplePlan
#: Row types of the contracts, as schemas.
RecordV1 = _schema(RECORD_SCHEMA)
FileManifestEntryV1 = _schema(MANIFEST)
QuarantineRecordV1 = _schema("source_file string, source_offset bigint, detected_format string, error_code string, message string, raw_fragment_hash string, parser_version string, schema_version string")
CleaningEventV1 = _schema(
    "record_id string, stage string, rule_id string, rule_version string, match_method string, action string, reason_code string, decision string, matched_span string, removed_chars int, score double,"
    " before_hash string, after_hash string, metrics struct, algorithm_version string, schema_version string",
    metrics=_schema("priority int"),
)


@dataclass(frozen=True)
class Profile:
    total_records: int
    by_dataset_id: dict[str, int]
    by_record_type: dict[str, int]
    by_event_date: dict[str, int]
    missing_title_count: int
    missing_or_empty_body_count: int
    unique_record_id_count: int
    duplicate_record_id_count: int
    schema_versions: dict[str, int]

    def to_dict(self) -> dict:
        return asdict(self)


def _session(spark: SparkSession | None) -> SparkSession:
    return spark or SparkSession.builder.appName("lexmill").getOrCreate()


def validate_jsonl(path: str, spark: SparkSession | None = None) -> DataFrame:
    """The records of a file; the first line that breaks the contract is raised as ValidationError."""
    return read_records(_session(spark), path)


def profile_records(records: DataFrame) -> Profile:
    """Counts over records. The maps come to the driver: they have one entry for each dataset, type, date and schema version."""
    counts: dict[str, dict[str, int]] = {k: {} for k in ("dataset_id", "record_type", "event_date", "schema_version")}
    for r in profile(records).orderBy("kind", "value").collect():
        counts[r.kind][r.value] = r.n
    t = profile_totals(records).first()
    return Profile(t.total_records, counts["dataset_id"], counts["record_type"], counts["event_date"], t.missing_title, t.empty_body, t.unique_ids, t.duplicate_ids, counts["schema_version"])


def profile_jsonl(path: str, spark: SparkSession | None = None) -> Profile:
    return profile_records(validate_jsonl(path, spark))
