"""A stream's sample equals the batch sample of the same rows, in any order of micro-batches."""

import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import records as R
from lexmill.operators import sampling as S
from lexmill.streaming.samples import held_sample, sample_stream


def rows(spark):
    docs = spark.createDataFrame([(k, f"t{k}\n\"é\"", random.Random(k).choice(["en", "en", "en", "fr", None]), f"s{k % 2}", 3) for k in range(160)], "doc_id long, text string, lang string, source string, n_chars long")
    return R.records_from_documents(docs)


@pytest.mark.parametrize(("plan", "seed"), [(S.SamplePlan("p", 17, 3, ("dataset_id", "metadata.lang"), "proportional"), 1), (S.SamplePlan("p", 9, 4, ("metadata.lang",), "equal", filters={"dataset_id": "s1"}), 2), (S.SamplePlan("p", 11, 5), 3)])
def test_stream_equals_batch(spark, tmp_path, plan, seed):
    every = rows(spark)
    order = list(range(5))
    random.Random(seed).shuffle(order)
    source = tmp_path / "in"
    stream = lambda: spark.readStream.schema(every.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    for n, part in enumerate(order):
        every.where(F.pmod(F.hash("record_id"), F.lit(5)) == part).coalesce(1).write.mode("append").parquet(str(source))
        if n in (1, 4):  # the stream is stopped and goes on from its state
            sample_stream(stream(), plan, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    key = lambda d: [(r.record_id, r.rank_hex, r.raw_text, r.metadata) for r in d.collect()]
    assert key(held_sample(spark, plan, str(tmp_path / "out"))) == key(S.sample(every, plan))


def test_too_few_rows(spark, tmp_path):
    rows(spark).limit(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows(spark).schema).parquet(str(tmp_path / "in"))
    plan = S.SamplePlan("p", 4)
    sample_stream(stream, plan, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    with pytest.raises(R.ProcessingError):
        held_sample(spark, plan, str(tmp_path / "out"))
