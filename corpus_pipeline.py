"""The corpus pipeline: quality, exact dedup, near dedup, decontamination, encoding.

Every decision is taken and applied row by row: rows with a null doc_id, or one that
repeats, are judged like all others, each by its own text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.bpe import encode_decode
from lexmill.llm.decontaminate import contaminated
from lexmill.llm.exact_dedup import exact_duplicates
from lexmill.llm.near_dedup import near_duplicates
from lexmill.llm.quality import quality_scores
from lexmill.llm.scratch import Scratch, numbered

#: Rows to drop up to this number are broadcast (8 bytes each); beyond it they are shuffled.
BROADCAST_ROWS = 1_000_000


def _without(docs: DataFrame, find: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """``docs`` without the rows that ``find(numbered docs, name of the number)`` returns, by their numbers in its column ``row``."""
    scratch, number = Scratch(docs.sparkSession, "rows"), "row number"
    while number in docs.columns:
        number += "_"
    rows = numbered(docs, scratch, number)
    gone = scratch.save(find(rows, number).select(F.col("row").alias(number)).distinct())
    return rows.join(F.broadcast(gone) if gone.facts["n"] <= BROADCAST_ROWS else gone, number, "left_anti").drop(number)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the classifier rejects."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(docs, lambda rows, number: quality_scores(rows, labels, row=number).where("predicted = 0"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, the one with the smallest doc_id."""
    return _without(docs, lambda rows, number: exact_duplicates(rows, number).where("not kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, the one with the smallest doc_id; rows without words all stay."""
    return _without(docs, lambda rows, number: near_duplicates(rows, 0.8, number).where("not stays"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item or a paraphrase of one."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, lambda rows, number: contaminated(rows, benchmark, row=number))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("encoding", encoding)]

#: SQL can express neither the classifier nor the near duplicates nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
