"""Events from JSON: single events, request batches, and captured upstream changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstream.functions.scalar import family_for_wiki, is_kind
from veilstream.plans.model import EVENT, EVENT_BATCH, MAX_BATCH, RECENT_CHANGE

REQUIRED = [f.name for f in EVENT.fields]
#: Unix seconds that a timestamp can have. The first and last second of the calendar that upstream clients know.
FIRST_SECOND, LAST_SECOND = -8334601228800, 8210266876799
#: Timestamps in JSON keep microseconds.
JSON_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def decode_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines to event columns and ``decode_error``: unknown fields are ignored, a missing or mistyped one is an error."""
    parsed = lines.withColumn("__event", F.from_json(F.col(value).cast("string"), EVENT))
    missing = [F.col(f"__event.{c}").isNull() for c in REQUIRED]
    broken = missing[0]
    for m in missing[1:]:
        broken = broken | m
    kind = F.col("__event.kind")
    return parsed.select(
        *[F.col(c) for c in lines.columns if c != value and c not in REQUIRED], *[F.col(f"__event.{c}").alias(c) for c in REQUIRED],
        F.when(broken, F.lit("Malformed")).when(~is_kind(kind), F.lit("UnknownKind")).alias("decode_error"),
    )


def decoded_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """The events that can be decoded, with the other columns; the rest is skipped, and counted by the observation ``aggregator``."""
    rows = decode_events(lines, value)
    bad = F.col("decode_error").isNotNull()
    counted = rows.observe("aggregator", F.count_if(bad).alias("decode_errors"), F.count_if(~bad).alias("events_decoded"))
    return counted.filter(~bad).drop("decode_error")


def encode_events(events: DataFrame) -> DataFrame:
    """(key, value): the user, and the event as JSON."""
    return events.select(F.col("user").alias("key"), F.to_json(F.struct(*REQUIRED), JSON_TIME).alias("value"))


def size_error(events: Column, most: int = MAX_BATCH) -> Column:
    """Why a batch of events is refused for its size, or null."""
    return F.when(events.isNull() | (F.size(events) == 0), F.lit("EmptyBatch")).when(F.size(events) > most, F.lit("BatchTooLarge"))


def decode_batches(requests: DataFrame, batch_id: str = "batch_id", body: str = "body", most: int = MAX_BATCH) -> tuple[DataFrame, DataFrame]:
    """Request bodies to (events with their batch id, refused batches with the reason)."""
    parsed = requests.select(F.col(batch_id).alias("batch_id"), F.from_json(body, EVENT_BATCH)["events"].alias("events"))
    parsed = parsed.withColumn("error", size_error(F.col("events"), most))
    return parsed.filter("error IS NULL").select("batch_id", F.inline("events")), parsed.filter("error IS NOT NULL").select("batch_id", "error")


def decode_changes(lines: DataFrame, value: str = "value") -> DataFrame:
    """Upstream change records, and ``parse_error`` where a field is missing."""
    parsed = lines.withColumn("__change", F.from_json(F.col(value).cast("string"), RECENT_CHANGE))
    names = [f.name for f in RECENT_CHANGE.fields]
    broken = F.lit(False)
    for n in names:
        broken = broken | F.col(f"__change.{n}").isNull()
    return parsed.select(*[F.col(f"__change.{n}").alias(n) for n in names], broken.alias("parse_error"))


def mappable(kind: Column, seconds: Column) -> Column:
    """Is the type known, and the time one that a timestamp can have?"""
    return is_kind(kind) & F.coalesce(seconds.between(FIRST_SECOND, LAST_SECOND), F.lit(False))


def changes_to_events(changes: DataFrame) -> DataFrame:
    """Events of change records. The id is a hash of the record, so a replay is recognised; ``map_error`` marks unknown types and times out of range."""
    fine = mappable(F.col("type"), F.col("timestamp"))
    names = [f.name for f in RECENT_CHANGE.fields]
    digest = F.md5(F.concat_ws("\x1f", *[F.col(n).cast("string") for n in names]).cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return changes.select(
        uuid.alias("event_id"), "user", F.when(fine, F.timestamp_seconds("timestamp")).alias("ts"), family_for_wiki(F.col("wiki")).alias("family"),
        "wiki", "namespace", F.col("type").alias("kind"), F.col("bot").alias("is_bot"), (~fine).alias("map_error"),
    )


def mapped_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Captured lines to events; what can't be parsed or mapped is skipped, and counted by the observation ``wiki_source``."""
    mapped = changes_to_events(decode_changes(lines, value).withColumn("type", F.when(~F.col("parse_error"), F.col("type"))))
    reason = F.when(F.col("kind").isNull(), F.lit("parse_error")).when(F.col("map_error"), F.lit("map_error"))
    counted = mapped.observe("wiki_source", F.count_if(reason == "parse_error").alias("skipped_parse_error"), F.count_if(reason == "map_error").alias("skipped_map_error"), F.count_if(reason.isNull()).alias("events_mapped"))
    return counted.filter("NOT map_error").drop("map_error")


def skipped(lines: DataFrame, value: str = "value") -> DataFrame:
    """(reason, n) of captured lines that ``mapped_events`` leaves out."""
    rows = decode_changes(lines, value).withColumn("reason", F.when(F.col("parse_error"), "parse_error").when(~mappable(F.col("type"), F.col("timestamp")), "map_error"))
    return rows.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
