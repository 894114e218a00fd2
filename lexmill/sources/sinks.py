"""Parquet tables and small JSON documents."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json(spark: SparkSession, value: Any, path: str) -> str:
    """One small canonical JSON document, through Hadoop's file systems; returns its hash."""
    body = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")) + "\n"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(body.encode()))
    out.close()
    return "sha256:" + hashlib.sha256(body.encode()).hexdigest()


def read_json(spark: SparkSession, path: str) -> Any | None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return json.loads("".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))


def cache_key(algorithm: str, input_fingerprint: str, config_fingerprint: str) -> str:
    return "sha256:" + hashlib.sha256("\x1f".join((algorithm, input_fingerprint, config_fingerprint)).encode()).hexdigest()
