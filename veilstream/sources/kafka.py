"""Kafka source and sink options. The connector is not part of Spark's own distribution; without it both raise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilstream.plans.model import Settings
from veilstream.sources.events import encode_events


def source_options(settings: Settings, per_trigger: int | None = None) -> dict[str, str]:
    """Earliest offsets; a bound per trigger instead of a bounded queue."""
    return {
        "kafka.bootstrap.servers": settings.kafka_servers, "subscribe": settings.kafka_topic, "startingOffsets": "earliest",
        "maxOffsetsPerTrigger": str(per_trigger or settings.queue_capacity), "failOnDataLoss": "true",
    }


def sink_options(settings: Settings) -> dict[str, str]:
    """Idempotent, acknowledged by all replicas, lz4, a short linger."""
    return {
        "kafka.bootstrap.servers": settings.kafka_servers, "topic": settings.kafka_topic, "kafka.enable.idempotence": "true", "kafka.acks": "all",
        "kafka.compression.type": "lz4", "kafka.linger.ms": str(settings.linger_ms), "kafka.batch.size": str(settings.batch_bytes),
    }


def read_events(spark: SparkSession, settings: Settings) -> DataFrame:
    """(kpartition, offset, value) of the topic."""
    rows = spark.readStream.format("kafka").options(**source_options(settings)).load()
    return rows.select(F.col("partition").alias("kpartition"), "offset", F.col("value").cast("string").alias("value"))


def messages(events: DataFrame) -> DataFrame:
    """(key, value) of pseudonymized events, counted by the observation ``ingest_kafka``."""
    return encode_events(events).observe("ingest_kafka", F.count("*").alias("produced"))


def write_events(events: DataFrame, settings: Settings, checkpoint: str) -> StreamingQuery:
    """Pseudonymized events to the topic, keyed by pseudonym."""
    return messages(events).writeStream.format("kafka").options(**sink_options(settings)).option("checkpointLocation", checkpoint).start()
