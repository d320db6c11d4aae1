import datetime as dt
import http.server
import json
import threading
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from veilstream.operators.rollup import finalize
from veilstream.plans.model import Settings
from veilstream.sources import events, kafka, sse
from veilstream.sources.store import CellStore
from veilstream.sources.truth import read_truth, write_truth
from veilstream.streaming.metrics import Metrics

GOOD = {"event_id": "e1", "user": "Alice", "ts": "2026-09-23T10:15:47.123456789Z", "family": "wikipedia", "wiki": "enwiki", "namespace": 0, "kind": "edit", "is_bot": False}


def lines(spark, *rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "value string")


def test_decode(spark):
    rows = events.decode_events(lines(spark, GOOD | {"more": 1}, GOOD | {"kind": "wat"}, {k: v for k, v in GOOD.items() if k != "wiki"}, "no json")).collect()
    assert [r["decode_error"] for r in rows] == [None, "UnknownKind", "Malformed", "Malformed"]
    assert rows[0]["ts"] == dt.datetime(2026, 9, 23, 10, 15, 47, 123456)


def test_encode_decode_round_trip(spark):
    decoded = events.decode_events(lines(spark, GOOD)).drop("decode_error")
    again = events.decode_events(events.encode_events(decoded)).drop("decode_error", "key")
    assert again.select(*events.REQUIRED).collect() == decoded.select(*events.REQUIRED).collect()


def test_batches(spark):
    bodies = [(1, json.dumps({"events": [GOOD, GOOD]})), (2, json.dumps({"events": []})), (3, json.dumps({"events": [GOOD] * 4})), (4, "x")]
    fine, refused = events.decode_batches(spark.createDataFrame(bodies, "batch_id int, body string"), most=3)
    assert fine.groupBy("batch_id").count().collect() == [(1, 2)]
    assert {(r["batch_id"], r["error"]) for r in refused.collect()} == {(2, "EmptyBatch"), (3, "BatchTooLarge"), (4, "EmptyBatch")}


def test_changes(spark):
    change = {"type": "edit", "namespace": 0, "user": "Alice", "bot": False, "wiki": "enwiki", "timestamp": 1700000000, "title": "x"}
    far = [change | {"timestamp": t} for t in (9 * 10**18, -9 * 10**18, 8210266876800)]
    rows = lines(spark, change, change, change | {"type": "wat"}, "garbage", {"type": "edit"}, *far)
    got = events.mapped_events(rows).collect()
    assert len(got) == 2 and got[0]["event_id"] == got[1]["event_id"] and len(got[0]["event_id"]) == 36
    assert (got[0]["family"], got[0]["kind"], got[0]["is_bot"]) == ("wikipedia", "edit", False)
    assert {r["reason"]: r["n"] for r in events.skipped(rows).collect()} == {"parse_error": 2, "map_error": 4}


def cells(spark, users, batch_events=3, window="2026-09-23 10:15:00"):
    return spark.createDataFrame([(dt.datetime.fromisoformat(window), 0, "*", "*", -1, 5, batch_events, users)], "window_start timestamp, level int, family string, wiki string, namespace int, kpartition int, events long, users long")


def progress(spark, offset, mark):
    return spark.createDataFrame([(5, offset, dt.datetime.fromisoformat(mark))], "kpartition int, committed_offset long, flushed_watermark timestamp")


def test_store(spark, tmp_path):
    store = CellStore(spark, f"file://{tmp_path}/s")
    assert store.min_watermark() is None and store.load_progress(5) is None and store.cells().count() == 0
    store.flush(cells(spark, 3), progress(spark, 42, "2026-09-23 10:16:00"), 1)
    assert store.load_progress(5) == (42, dt.datetime(2026, 9, 23, 10, 16)) and store.load_progress(999) is None
    for _ in range(2):  # a replayed batch, and a later one, replace and never add
        store.flush(cells(spark, 2, 5), progress(spark, 50, "2026-09-23 10:17:00"), 2)
    rows = store.cells().collect()
    assert len(rows) == 1 and (rows[0]["events"], rows[0]["users"]) == (5, 2)
    assert finalize(store.cells(dt.datetime(2026, 9, 23, 10, 15))).count() == 1
    plan = store.cells(dt.datetime(2026, 9, 23, 10, 15))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(window_date" in plan
    assert store.min_watermark() == dt.datetime(2026, 9, 23, 10, 17)


def test_retention(spark, tmp_path):
    store = CellStore(spark, f"file://{tmp_path}/s")
    store.flush(cells(spark, 3, window="2026-09-01 00:00:00").unionByName(cells(spark, 3)), progress(spark, 1, "2026-09-23 10:16:00"), 1)
    assert store.cells().count() == 2 and store.drop_before(dt.date(2026, 9, 10)) == 1 and store.cells().count() == 1


def test_truth_file(spark, tmp_path):
    rows = cells(spark, 3).drop("kpartition")
    write_truth(rows, f"{tmp_path}/truth")
    assert read_truth(spark, f"{tmp_path}/truth").collect() == rows.withColumn("level", F.col("level").cast("short")).collect()


def test_kafka_options():
    settings = Settings(linger_ms=7)
    sink, source = kafka.sink_options(settings), kafka.source_options(settings)
    assert sink["kafka.acks"] == "all" and sink["kafka.enable.idempotence"] == "true" and sink["kafka.compression.type"] == "lz4" and sink["kafka.linger.ms"] == "7"
    assert source["startingOffsets"] == "earliest" and source["maxOffsetsPerTrigger"] == "10000"


def test_messages_through_a_file_topic(spark, tmp_path):
    """What the Kafka sink would be given, and what the aggregator makes of it, with files in place of a topic."""
    topic, metrics = f"{tmp_path}/topic", Metrics()

    def run(rows, to):
        query = rows.writeStream.format("parquet").option("path", to).option("checkpointLocation", f"{to}-c").trigger(availableNow=True).start()
        query.awaitTermination()
        for p in query.recentProgress:
            metrics.onQueryProgress(SimpleNamespace(progress=p))

    for k, users in enumerate((["Alice", "Bob"], ["Alice"])):  # the second run starts from the checkpoint and sends new events only
        sent = events.decode_events(lines(spark, *[GOOD | {"user": u, "event_id": f"{k}{u}"} for u in users])).drop("decode_error")
        sent.write.parquet(f"{tmp_path}/sent/part={k}")
        frame = kafka.messages(spark.readStream.schema(sent.schema).parquet(f"{tmp_path}/sent/part=*"))
        assert [(f.name, f.dataType.simpleString()) for f in frame.schema] == [("key", "string"), ("value", "string")]
        run(frame, topic)
    spark.createDataFrame([("x", "no json"), ("y", json.dumps(GOOD | {"kind": "wat"})), ("z", None)], "key string, value string").write.mode("append").parquet(topic)
    run(events.decoded_events(spark.readStream.schema("key string, value string").parquet(f"{topic}/part-*")), f"{tmp_path}/read")
    got = spark.read.parquet(f"{tmp_path}/read").collect()
    assert sorted((r["key"], r["user"], r["event_id"]) for r in got) == [("Alice", "Alice", "0Alice"), ("Alice", "Alice", "1Alice"), ("Bob", "Bob", "0Bob")]
    assert (metrics.totals["ingest_kafka_produced"], metrics.totals["aggregator_decode_errors"], metrics.totals["aggregator_events_decoded"]) == (3, 3, 3)


def test_sse_parse_and_backoff():
    got = list(sse.parse([": hello\n", "id: 1\n", "data: {\n", "data: }\n", "\n", "event: x\n", "\n", "data: b\n", "id: 2\n", "\n"]))
    assert got == [("1", "{\n}"), ("2", "b")]
    assert [sse.backoff(n) for n in (1, 2, 3, 10)] == [1, 2, 4, 30]


class Feed(http.server.BaseHTTPRequestHandler):
    seen: list = []

    def do_GET(self):
        last = int(self.headers.get("Last-Event-ID") or 0)
        Feed.seen.append(last)
        self.send_response(200)
        self.end_headers()
        for n in range(last + 1, 8):
            self.wfile.write(f"id: {n}\ndata: line {n}\n\n".encode())

    def log_message(self, *a):
        pass


def test_sse_resumes(tmp_path):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Feed)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    reader = sse.SseReader({"url": f"http://127.0.0.1:{server.server_port}/", "maxevents": "5", "maxmillis": "2000"})
    start = reader.initialOffset()
    rows, middle = reader.read(start)
    more, end = reader.read(middle)
    assert [i for i, _ in rows] == ["1", "2", "3", "4", "5"] and [i for i, _ in more] == ["6", "7"]
    assert Feed.seen == [0, 5] and end == {"last": "7", "n": 7}
    assert [i for i, _ in reader.readBetweenOffsets(middle, end)] == ["6", "7"]
    server.shutdown()


def test_sse_gives_up_quietly(monkeypatch):
    waits = []
    monkeypatch.setattr(sse.time, "sleep", waits.append)
    rows, end = sse.SseReader({"url": "http://127.0.0.1:9/", "tries": "3"}).read({"last": "x", "n": 4})
    assert list(rows) == [] and end == {"last": "x", "n": 4} and waits == [1, 2, 4]


@pytest.mark.parametrize("name", ["sse"])
def test_sse_is_registered(spark, name):
    sse.register(spark)
    assert spark.readStream.format(name).option("url", "http://127.0.0.1:9/").load().columns == ["id", "value"]
