import datetime as dt

import pytest
from pyspark.sql import functions as F

from veilstream.operators import loadgen, rollup
from veilstream.operators.validate import accepted, accepted_batches, classify, quarantined
from veilstream.plans.model import EVENT

NOW = dt.datetime(2026, 9, 23, 10)
BASE = ("e", "Alice", NOW, "wikipedia", "enwiki", 0, "edit", False)


def event(**changes):
    return tuple(changes.get(name, value) for name, value in zip(EVENT.names, BASE, strict=True))


CASES = [
    ({}, None), ({"user": ""}, "EmptyUser"), ({"user": " \t"}, "EmptyUser"), ({"wiki": " "}, "EmptyWiki"), ({"family": "\n"}, "EmptyFamily"),
    ({"namespace": -1}, "NegativeNamespace"), ({"ts": NOW + dt.timedelta(hours=1)}, "TimestampInFuture"), ({"ts": NOW + dt.timedelta(seconds=60)}, None),
    ({"ts": NOW + dt.timedelta(seconds=60, microseconds=1)}, "TimestampInFuture"), ({"user": "", "wiki": "", "namespace": -1}, "EmptyUser"),
    ({"family": "", "namespace": -1, "ts": NOW + dt.timedelta(days=1)}, "EmptyFamily"), ({"user": None}, "Malformed"),
]


@pytest.mark.parametrize("changes,want", CASES)
def test_first_failing_check(spark, changes, want):
    assert classify(spark.createDataFrame([event(**changes)], EVENT), F.lit(NOW).cast("timestamp")).first()["error"] == want


def test_rows_and_batches(spark):
    rows = spark.createDataFrame([(1, *event()), (1, *event(user="")), (2, *event()), (2, *event(event_id="f"))], "batch_id int, event_id string, user string, ts timestamp, family string, wiki string, namespace int, kind string, is_bot boolean")
    now = F.lit(NOW).cast("timestamp")
    assert accepted(rows, now).count() == 3 and quarantined(rows, now).count() == 1
    assert {r["batch_id"] for r in accepted_batches(rows, now).collect()} == {2}


def test_fan_out_and_parents(spark):
    cells = rollup.fan_out(spark.createDataFrame([event(wiki="knwiki")], EVENT)).select("*", *rollup.parent_columns()).orderBy("level").collect()
    assert [(c["level"], c["family"], c["wiki"], c["namespace"]) for c in cells] == [(0, "*", "*", -1), (1, "wikipedia", "*", -1), (2, "wikipedia", "knwiki", -1), (3, "wikipedia", "knwiki", 0)]
    for child, parent in zip(cells[1:], cells, strict=False):
        assert (child["parent_level"], child["parent_family"], child["parent_wiki"], child["parent_namespace"]) == (parent["level"], parent["family"], parent["wiki"], parent["namespace"])
    assert cells[0]["parent_level"] is None and rollup.global_cell() == {"level": 0, "family": "*", "wiki": "*", "namespace": -1}


def test_generator_is_reproducible_and_shaped(spark):
    load = loadgen.Load(rate=200, seconds=30)
    one, two = (loadgen.stream(spark, load).orderBy("n", "copy").collect() for _ in range(2))
    assert one == two and load.batches == 60
    copies = sum(r["copy"] for r in one)
    assert 20 < copies < 130
    events = [r for r in one if not r["copy"]]
    assert len({r["event_id"] for r in events}) == load.total
    share = sum(r["namespace"] == 0 for r in events) / load.total
    assert 0.66 < share < 0.74 and sum(r["wiki"] == "enwiki" for r in events) > sum(r["wiki"] == "commonswiki" for r in events)
    back = [(load.start + dt.timedelta(seconds=r["n"] / load.rate) - r["ts"]).total_seconds() for r in events]
    late = [b for b in back if b > 0.5]
    assert late and max(late) < 28 and len(late) < 0.02 * load.total
