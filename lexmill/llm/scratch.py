"""Written intermediate tables in the folder that all executors share.

A table written here cuts the lineage: what comes after it is recomputed from
the files, not from the shuffles before it, so a lost executor costs little.
The folder is the session's ``spark.checkpoint.dir``. Only where that is unset and
the session runs in one machine (tests, a laptop) a folder of our own is used; a
cluster without the setting is refused, for its executors share no other folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: File names up to this number are broadcast, to number the files' rows.
BROADCAST_FILES = 100_000
#: Rows and bytes of an Arrow batch that goes to a Python worker (the bytes: where Spark knows the setting).
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20}
LOCAL_DEFAULT = "/tmp/checkpoints/lexmill"


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master.startswith("local") and not master.startswith("local-cluster"):
        return LOCAL_DEFAULT
    raise ValueError("spark.checkpoint.dir is unset: set it to a folder that all executors share")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """The settings of BATCH while a plan is made and run; the session's own ones afterwards."""
    before = {k: spark.conf.get(k, None) for k in BATCH}
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Names, writes, rereads and deletes the intermediate tables of one operator run."""

    def __init__(self, spark: SparkSession, owner: str):
        self.spark, self.root, self.n = spark, f"{shared_folder(spark)}/lexmill-{owner}-{uuid.uuid4().hex}", 0

    def save(self, df: DataFrame, **sums: Column) -> DataFrame:
        """Write ``df`` and return the table read back from its files.

        Its ``facts`` have the rows' number ``n`` and the aggregates ``sums``, taken while the rows were written.
        """
        self.n += 1
        path, seen = f"{self.root}/{self.n}", Observation()
        with small_batches(self.spark):
            df.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in sums.items())).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path, out.facts = path, seen.get
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of tables that nothing reads any more."""
        for t in tables:
            self._delete(t._scratch_path)

    def delete(self, name: str) -> None:
        """Delete a folder of one's own beside the tables."""
        self._delete(f"{self.root}/{name}")

    def close(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def numbered(docs: DataFrame, scratch: Scratch, name: str = "row") -> DataFrame:
    """``docs`` with a further column of unique longs, the same in every reading.

    Rows of Parquet files are numbered by file and place in the file, which needs no
    copy. Where ``docs`` isn't such a table, its rows are numbered and written once.
    """
    try:
        if "_metadata" in docs.columns:
            raise AnalysisException("the name is taken")
        placed = docs.select("*", F.col("_metadata.file_path").alias(f"{name} file"), F.col("_metadata.row_index").alias(f"{name} place"))
        names = docs.select(F.col("_metadata.file_path").alias(f"{name} file")).distinct()
    except AnalysisException:
        return scratch.save(docs.withColumn(name, F.monotonically_increasing_id()))
    files = scratch.save(names.select(f"{name} file", F.row_number().over(Window.orderBy(f"{name} file")).cast("long").alias(f"{name} number")))
    rows = placed.join(F.broadcast(files) if files.facts["n"] <= BROADCAST_FILES else files, f"{name} file")
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns), F.shiftleft(F.col(f"`{name} number`"), 36).bitwiseOR(F.col(f"`{name} place`")).alias(name))
