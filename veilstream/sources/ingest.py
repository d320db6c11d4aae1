"""The push source: request bodies in, accepted events and one answer per request out.

A pull engine has no request to hold up: requests land as files or rows, and the bound on a trigger takes the place of a full
queue. ``ingest`` decides what a server would have answered; ``land`` keeps what was accepted for the stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstream.operators.validate import classify
from veilstream.plans.model import EVENT, MAX_BATCH
from veilstream.sources.events import decode_batches

# Status codes.
ACCEPTED, BAD_REQUEST, UNAVAILABLE = 202, 400, 503


def ingest(requests: DataFrame, now: Column, per_row: bool = False, most: int = MAX_BATCH) -> tuple[DataFrame, DataFrame]:
    """(batch_id, body) to (events with batch_id, answers (batch_id, status, error, events)).

    A batch that is empty, too large or malformed, or has an invalid event, is refused whole. ``per_row`` refuses the
    invalid events alone, and a batch only if none is left.
    """
    events, refused = decode_batches(requests, most=most)
    checked = classify(events, now)
    answers = checked.groupBy("batch_id").agg(F.count_if(F.col("error").isNull()).alias("good"), F.count("*").alias("all"), F.min("error").alias("error"))
    fine = (F.col("good") > 0) if per_row else (F.col("good") == F.col("all"))
    answers = answers.select("batch_id", F.when(fine, ACCEPTED).otherwise(BAD_REQUEST).alias("status"), F.when(~fine, F.col("error")).alias("error"), F.when(fine, F.col("good")).otherwise(F.lit(0)).cast("long").alias("events"))
    good = checked.filter("error IS NULL").drop("error")
    if not per_row:
        bad = answers.filter(F.col("status") != ACCEPTED).select("batch_id")
        good = good.join(bad, "batch_id", "left_anti")
    rest = refused.select("batch_id", F.lit(BAD_REQUEST).alias("status"), "error", F.lit(0).cast("long").alias("events"))
    return good, answers.unionByName(rest)


def land(events: DataFrame, folder: str) -> None:
    """Append accepted events to the landing folder."""
    events.select(*EVENT.names).write.mode("append").parquet(folder)


def landed(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """The landing folder as a stream, so many files at a time."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
