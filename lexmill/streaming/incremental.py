"""Row-local stages under Structured Streaming: each micro-batch is cleaned as it arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.cleaning import CleaningConfig, clean


def clean_stream(records: DataFrame, config: CleaningConfig, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends cleaned records with their events as Parquet; exactly once by the sink's log. Sampling and profiles need bounded input."""
    writer = clean(records, config).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
