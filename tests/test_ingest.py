import json

import pytest
from pyspark.sql import functions as F

from veilstream.operators import loadgen
from veilstream.sources.ingest import ingest, land, landed

GOOD = {"event_id": "e1", "user": "Alice", "ts": "2026-09-23T10:15:47Z", "family": "wikipedia", "wiki": "enwiki", "namespace": 0, "kind": "edit", "is_bot": False}


def now():
    return F.lit("2026-09-23 11:00:00").cast("timestamp")


@pytest.fixture
def requests(spark):
    bad = GOOD | {"event_id": "e2", "namespace": -1}
    bodies = [(1, [GOOD, GOOD | {"event_id": "e3"}]), (2, [GOOD, bad]), (3, []), (4, [GOOD] * 6), (5, [bad])]
    return spark.createDataFrame([(i, json.dumps({"events": e})) for i, e in bodies] + [(6, "{")], "batch_id int, body string")


def test_all_or_nothing(requests):
    events, answers = ingest(requests, now(), most=5)
    assert sorted(r["batch_id"] for r in events.collect()) == [1, 1]
    got = {r["batch_id"]: (r["status"], r["error"], r["events"]) for r in answers.collect()}
    assert got == {1: (202, None, 2), 2: (400, "NegativeNamespace", 0), 3: (400, "EmptyBatch", 0), 4: (400, "BatchTooLarge", 0), 5: (400, "NegativeNamespace", 0), 6: (400, "EmptyBatch", 0)}


def test_row_by_row(requests):
    events, answers = ingest(requests, now(), per_row=True, most=5)
    assert sorted(r["batch_id"] for r in events.collect()) == [1, 1, 2]
    assert {r["batch_id"]: (r["status"], r["events"]) for r in answers.collect()} == {1: (202, 2), 2: (202, 1), 3: (400, 0), 4: (400, 0), 5: (400, 0), 6: (400, 0)}


def test_landing(spark, requests, tmp_path):
    events, _ = ingest(requests, now(), most=5)
    land(events, f"{tmp_path}/in")
    query = landed(spark, f"{tmp_path}/in").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2


def test_feed(spark, tmp_path):
    load = loadgen.Load(rate=100, seconds=4, batch_size=50)
    assert loadgen.feed(spark, load, f"{tmp_path}/in", 3) == 3
    got = spark.read.parquet(f"{tmp_path}/in")
    assert got.count() == loadgen.stream(spark, load).count() and got.select("event_id").distinct().count() == load.total
