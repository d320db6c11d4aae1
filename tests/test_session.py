"""Settings that the queries bring to a session."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilstream.session import BATCH_BYTES, BATCH_KEY, bound_batches, shipped


@pytest.fixture
def unset(spark):
    spark.conf.unset(BATCH_KEY)
    yield spark
    spark.conf.unset(BATCH_KEY)


def test_batches_of_a_query_are_bounded(unset):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    def query(spark, sf_dir):
        return spark.range(0, 64, 1, 1).select(F.repeat(F.lit("long text "), 1 << 15).alias("text")).mapInArrow(sizes, "n long")

    counts = [r["n"] for r in shipped(query)(unset, "").collect()]
    assert sum(counts) == 64 and max(counts) <= -(-int(BATCH_BYTES) // (10 << 15)) + 1


def test_a_bound_of_the_session_stays(unset):
    unset.conf.set(BATCH_KEY, "1m")
    bound_batches(unset)
    assert unset.conf.get(BATCH_KEY) == "1m"


@pytest.mark.parametrize("name", ["language", "near_copies", "secrets", "source_mix", "packing"])
def test_a_stage_by_itself_bounds_batches(unset, name):
    docs = unset.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(8)
    dict(corpus_pipeline.STAGES)[name](unset, docs, "/root/testdata/sf0.001")
    assert unset.conf.get(BATCH_KEY) == BATCH_BYTES
