"""Event validation: ordered checks, by row or for whole batches, and quarantine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.functions.scalar import is_blank
from veilstream.plans.model import MAX_SKEW


def validation_error(now: Column, skew: str = MAX_SKEW) -> Column:
    """The first failing check of an event, or null: user, wiki, family, namespace, time; null columns are malformed."""
    c = F.col
    return (
        F.when(c("event_id").isNull() | c("user").isNull() | c("wiki").isNull() | c("family").isNull() | c("namespace").isNull() | c("ts").isNull(), F.lit("Malformed"))
        .when(is_blank(c("user")), F.lit("EmptyUser"))
        .when(is_blank(c("wiki")), F.lit("EmptyWiki"))
        .when(is_blank(c("family")), F.lit("EmptyFamily"))
        .when(c("namespace") < 0, F.lit("NegativeNamespace"))
        .when(c("ts") > now + F.expr(f"INTERVAL {skew}"), F.lit("TimestampInFuture"))
    )


def classify(events: DataFrame, now: Column) -> DataFrame:
    """Events with their ``error``."""
    return events.withColumn("error", validation_error(now))


def accepted(events: DataFrame, now: Column) -> DataFrame:
    """Valid events."""
    return classify(events, now).filter("error IS NULL").drop("error")


def quarantined(events: DataFrame, now: Column) -> DataFrame:
    """Invalid events with the reason."""
    return classify(events, now).filter("error IS NOT NULL")


def accepted_batches(events: DataFrame, now: Column, batch_id: str = "batch_id") -> DataFrame:
    """Events of the batches without an invalid event: one bad event rejects its batch.

    The bad batches are found by an aggregate and removed by an anti join, so no batch is gathered in one task.
    """
    checked = classify(events, now)
    bad = checked.filter("error IS NOT NULL").select(batch_id).distinct()
    return checked.join(bad, batch_id, "left_anti").drop("error")
