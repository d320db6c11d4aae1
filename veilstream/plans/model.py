"""Schemas, constants and settings of the analytics engine."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import types as T

# Window size and lateness, idle time, accepted clock skew, partitions, threshold, sketch precision.
WINDOW = "60 seconds"
LATENESS = "30 seconds"
IDLE_SECONDS = 10
MAX_SKEW = "60 seconds"
PARTITIONS = 12
TOPIC = "events"
K = 10
HLL_PRECISION = 12
MAX_BATCH = 5000

# Levels of the hierarchy, and what stands for a rolled-up axis.
GLOBAL, FAMILY, WIKI, NAMESPACE = 0, 1, 2, 3
ANY, ANY_NAMESPACE = "*", -1
KINDS = ("edit", "new", "log", "categorize")

EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("family", T.StringType()),
        T.StructField("wiki", T.StringType()),
        T.StructField("namespace", T.IntegerType()),
        T.StructField("kind", T.StringType()),
        T.StructField("is_bot", T.BooleanType()),
    ]
)
EVENT_BATCH = T.StructType([T.StructField("events", T.ArrayType(EVENT))])
RECENT_CHANGE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("namespace", T.IntegerType()),
        T.StructField("user", T.StringType()),
        T.StructField("bot", T.BooleanType()),
        T.StructField("wiki", T.StringType()),
        T.StructField("timestamp", T.LongType()),
    ]
)
CELL = ["level", "family", "wiki", "namespace"]
AGG_CELLS = T.StructType(
    [
        T.StructField("window_start", T.TimestampType()),
        T.StructField("level", T.ShortType()),
        T.StructField("family", T.StringType()),
        T.StructField("wiki", T.StringType()),
        T.StructField("namespace", T.IntegerType()),
        T.StructField("kpartition", T.IntegerType()),
        T.StructField("events", T.LongType()),
        T.StructField("users", T.LongType()),
        T.StructField("users_hll", T.BinaryType()),
    ]
)
AGG_KEY = ["window_start", "level", "family", "wiki", "namespace", "kpartition"]
PROGRESS = T.StructType(
    [
        T.StructField("kpartition", T.IntegerType()),
        T.StructField("committed_offset", T.LongType()),
        T.StructField("flushed_watermark", T.TimestampType()),
    ]
)
TRUTH = T.StructType([T.StructField("cells", T.ArrayType(T.StructType([*AGG_CELLS.fields[:5], *AGG_CELLS.fields[6:8]])))])


@dataclass(frozen=True)
class Settings:
    """Settings with defaults; ``load`` reads them from the environment."""

    pseudonym_salt: str = ""
    kafka_servers: str = "localhost:9092"
    kafka_topic: str = TOPIC
    kafka_group: str = "aggregator"
    queue_capacity: int = 10_000
    max_batch: int = MAX_BATCH
    linger_ms: int = 5
    batch_bytes: int = 262_144
    flush_interval_ms: int = 1000
    idle_check_interval_ms: int = 1000
    hll_enabled: bool = False
    privacy_k: int = K
    cache_capacity: int = 10_000
    dp_enabled: bool = False
    dp_epsilon: float = 1.0
    stream_url: str = ""
    batch_max_events: int = 500
    batch_max_ms: int = 200

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, required: tuple[str, ...] = ()) -> Settings:
        """Keys are the upper-case field names. An unparsable value falls back to the default; a missing required one is an error."""
        env = os.environ if env is None else env
        for name in required:
            if not env.get(name.upper()):
                raise KeyError(f"{name.upper()} must be set")
        found = {}
        for field in fields(cls):
            raw = env.get(field.name.upper())
            if raw is None:
                continue
            kind = type(field.default)
            try:
                if kind is bool:
                    if raw.lower() not in ("true", "false"):
                        continue
                    found[field.name] = raw.lower() == "true"
                else:
                    found[field.name] = kind(raw)
            except ValueError:
                continue
        return cls(**found)
