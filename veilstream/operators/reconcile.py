"""Comparison of aggregates with known truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilstream.operators.rollup import batch_cells, finalize
from veilstream.plans.model import CELL, WINDOW


class Drift(AssertionError):
    """Aggregates differ from truth."""


def truth_cells(events: DataFrame, size: str | None = WINDOW) -> DataFrame:
    """Truth of a stream: the cells of its events before any was repeated."""
    return batch_cells(events, size)


def compare(expected: DataFrame, partial: DataFrame) -> DataFrame:
    """Keys with ``status``: matched, mismatched, missing or unexpected, and both sides' counts. One full outer join."""
    keys = ["window_start", *CELL]
    want = expected.select(*keys, F.col("events").alias("expected_events"), F.col("users").alias("expected_users"))
    got = finalize(partial).select(*keys, F.col("events").alias("actual_events"), F.col("users").alias("actual_users"))
    status = (
        F.when(F.col("actual_events").isNull(), F.lit("missing"))
        .when(F.col("expected_events").isNull(), F.lit("unexpected"))
        .when((F.col("actual_events") != F.col("expected_events")) | (F.col("actual_users") != F.col("expected_users")), F.lit("mismatched"))
        .otherwise(F.lit("matched"))
    )
    return want.join(got, keys, "full_outer").withColumn("status", status)


def unexpected_keys(expected: DataFrame, partial: DataFrame) -> DataFrame:
    """Keys of the aggregates that truth hasn't."""
    keys = ["window_start", *CELL]
    return finalize(partial).select(*keys).join(expected.select(*keys), keys, "left_anti")


def summary(compared: DataFrame) -> DataFrame:
    """One row with the counts of each status and whether all is well."""
    count = lambda s: F.count_if(F.col("status") == s)
    out = compared.agg(*[count(s).alias(s) for s in ("matched", "mismatched", "missing", "unexpected")])
    return out.withColumn("passed", (F.col("mismatched") + F.col("missing") + F.col("unexpected")) == 0)


def reconcile(expected: DataFrame, partial: DataFrame) -> dict:
    """Counts, or Drift if there is any."""
    found = summary(compare(expected, partial)).first().asDict()
    if not found["passed"]:
        raise Drift(str(found))
    return found
