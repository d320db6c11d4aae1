"""Streaming: restarts, late and repeated events, metrics, and the stateful form's arithmetic."""

import datetime as dt
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from veilstream.operators import loadgen, reconcile
from veilstream.operators.rollup import finalize
from veilstream.operators.suppress import release
from veilstream.plans.model import EVENT, Settings
from veilstream.plans.queries import click_cells
from veilstream.plans.stats import BadRequest, Incomplete, Stats, is_complete, latest_window, parent_key
from veilstream.sources.store import CellStore
from veilstream.streaming import queries as stream_queries
from veilstream.streaming.metrics import Metrics, consumer_lag, observed
from veilstream.streaming.partitioned import PartitionClock, PartitionWindows, Window, partition_cells, run_available
from veilstream.streaming.pipeline import prepared, start, stream_cells, stream_counts, stream_sketches

LOAD = loadgen.Load(rate=50, seconds=150, users=60)
END = dt.datetime(2026, 1, 1, 1)


def drops(spark, folder, parts=3):
    """The generator's stream in files by time, then an event far ahead that closes all windows."""
    sent = loadgen.stream(spark, LOAD).select("n", *EVENT.names)
    for k in range(parts):
        low, high = LOAD.total * k // parts, LOAD.total * (k + 1) // parts
        sent.filter(F.col("n").between(low, high - 1)).drop("n").coalesce(1).write.parquet(f"{folder}/part={k}")
    end = sent.limit(1).drop("n").withColumn("ts", F.lit(END).cast("timestamp")).withColumn("event_id", F.lit("end"))
    return sent, end


def stream(spark, folder):
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/part=*")


def prepare(events):
    return prepared(events, F.lit(END).cast("timestamp"), Settings(pseudonym_salt="s"))


def test_restarts_lose_and_repeat_nothing(spark, tmp_path):
    _, end = drops(spark, tmp_path / "all")
    store = CellStore(spark, f"file://{tmp_path}/store")
    for k in range(3):  # each run sees one more file and starts from the checkpoint
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "all" / f"part={k}").rename(tmp_path / "in" / f"part={k}")
        start(stream_counts(prepare(stream(spark, tmp_path / "in"))), store, f"{tmp_path}/checkpoint").awaitTermination()
    end.write.parquet(f"{tmp_path}/in/part=9")
    start(stream_counts(prepare(stream(spark, tmp_path / "in"))), store, f"{tmp_path}/checkpoint").awaitTermination()
    got = reconcile.reconcile(loadgen.truth(spark, LOAD), store.cells())
    assert got["passed"] and got["matched"] > 0
    stats = Stats(store, Settings(privacy_k=10))
    last = stats.latest_window()
    assert last is not None
    rows = stats.stats(last, 1).collect()
    assert rows and all(r["users"] >= 10 for r in rows)
    assert stats.stats(last, 1) is stats.stats(last, 1, family="ignored")
    with pytest.raises(Incomplete):
        stats.stats(END, 0)
    for bad in ((4, None, None), (2, None, None), (3, "wikipedia", None)):
        with pytest.raises(BadRequest):
            stats.stats(last, *bad)


class Torn(CellStore):
    """A store whose first flush is lost half way: while cells are written, or between cells and progress."""

    def __init__(self, spark, path, at):
        super().__init__(spark, path)
        self.at = at

    def flush(self, cells, progress, batch):
        fail, at, self.at = F.raise_error(F.lit("lost")).cast("long"), self.at, None
        if at == "cells":
            cells = cells.withColumn("events", F.when(F.col("level") == 2, fail).otherwise(F.col("events")))
        if at == "progress":
            progress = progress.withColumn("committed_offset", fail)
        super().flush(cells, progress, batch)


@pytest.mark.parametrize("at", ["cells", "progress"])
def test_a_batch_lost_half_way_is_written_again(spark, tmp_path, at):
    _, end = drops(spark, tmp_path / "in")
    end.write.parquet(f"{tmp_path}/in/part=9")
    store = Torn(spark, f"file://{tmp_path}/store", at)
    run = lambda: start(stream_counts(prepare(stream(spark, tmp_path / "in"))), store, f"{tmp_path}/checkpoint").awaitTermination()
    with pytest.raises(StreamingQueryException):
        run()
    assert store.min_watermark() is None and store.at is None
    run()
    got = reconcile.reconcile(loadgen.truth(spark, LOAD), store.cells())
    assert got["passed"] and got["matched"] > 0


@pytest.mark.parametrize("form", ["counts", "cells"])
def test_stored_sketches(spark, tmp_path, form):
    _, end = drops(spark, tmp_path / "in")
    end.write.parquet(f"{tmp_path}/in/part=9")
    store = CellStore(spark, f"file://{tmp_path}/store")
    rows = prepare(stream(spark, tmp_path / "in"))
    cells = stream_counts(rows) if form == "counts" else stream_cells(rows, sketches=True)
    start(cells, store, f"{tmp_path}/checkpoint", sketches=True).awaitTermination()
    assert reconcile.reconcile(loadgen.truth(spark, LOAD), store.cells())["passed"]
    stats = Stats(store, Settings(privacy_k=10))
    for level in (0, 1):
        exact, sketched = (stats.stats(dt.datetime(2026, 1, 1, 0, 1), level, estimator=e).collect() for e in ("exact", "hll"))
        assert [(r["kind"], r["family"], r["events"]) for r in exact] == [(r["kind"], r["family"], r["events"]) for r in sketched]
        assert all(abs(a["users"] - b["users"]) <= max(2, 0.07 * a["users"]) for a, b in zip(exact, sketched, strict=True))


def test_drift_is_an_error(spark):
    truth = loadgen.truth(spark, LOAD)
    short = truth.withColumn("kpartition", F.lit(0)).filter("level < 3")
    with pytest.raises(reconcile.Drift):
        reconcile.reconcile(truth, short)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    row = lambda i, s, u: (i, u, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=s), "f", "w", 0, "edit", False)
    for k, rows in enumerate([[row("a", 5, "u1"), row("a", 5, "u1"), row("b", 6, "u2")], [row("c", 200, "u1")], [row("e", 201, "u1")], [row("d", 7, "u3"), row("g", 202, "u1")], [row("z", 4000, "u1")]]):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    metrics = Metrics()
    spark.streams.addListener(metrics)
    store = CellStore(spark, f"file://{tmp_path}/store")
    query = start(stream_cells(prepare(stream(spark, tmp_path / "in"))), store, f"{tmp_path}/checkpoint")
    query.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] if isinstance(op, dict) else op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)
    spark.streams.removeListener(metrics)
    first = finalize(store.cells()).filter("level = 0").orderBy("window_start").first()
    assert (first["events"], first["users"]) == (2, 2) and late == 1


def test_sketches_stream(spark, tmp_path):
    _, end = drops(spark, tmp_path / "in")
    end.write.parquet(f"{tmp_path}/in/part=9")
    out = stream_sketches(prepare(stream(spark, tmp_path / "in")))
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    users = spark.read.parquet(f"{tmp_path}/out").filter("level = 0").groupBy("window_start").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n"))
    want = {r["window_start"]: r["users"] for r in loadgen.truth(spark, LOAD).filter("level = 0").collect()}
    got = {r["window_start"]: r["n"] for r in users.collect()}
    assert all(abs(got[w] - n) <= max(2, 0.07 * n) for w, n in want.items())


def test_stateful_form(spark, tmp_path):
    _, end = drops(spark, tmp_path / "in")
    marks = spark.range(12).crossJoin(end.drop("user", "event_id")).select(F.concat(F.lit("end"), "id").alias("event_id"), F.lit("x").alias("user"), *EVENT.names[2:], F.col("id").cast("int").alias("kpartition"))
    plain = spark.read.schema(EVENT).parquet(f"{tmp_path}/in/part=*").withColumn("kpartition", F.pmod(F.crc32(F.col("user").cast("binary")), F.lit(12)).cast("int"))
    plain.write.parquet(f"{tmp_path}/keyed/part=0")
    marks.select(*plain.columns).write.parquet(f"{tmp_path}/keyed/part=1")
    events = spark.readStream.schema(plain.schema).parquet(f"{tmp_path}/keyed/part=*")
    run_available(partition_cells(events, lateness_seconds=200), f"{tmp_path}/out", f"{tmp_path}/c")
    rows = spark.read.parquet(f"{tmp_path}/out")
    cells = rows.filter(F.col("window_start").isNotNull() & (F.col("window_start") < F.lit(END)))
    assert reconcile.reconcile(loadgen.truth(spark, LOAD), cells)["passed"]
    sent = loadgen.stream(spark, LOAD).filter("copy = 1").count()
    assert rows.agg(F.sum("duplicates"), F.sum("late")).first() == (sent, 0)
    assert rows.filter("window_start IS NULL").select("kpartition").distinct().count() == 12


@pytest.fixture(scope="module")
def scattered(spark, tmp_path_factory):
    """The events in files without any order of time, each of which is a task: more files than a trigger takes."""
    folder = tmp_path_factory.mktemp("scattered")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(12, F.hash("event_id")).write.parquet(f"{folder}/events.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["stream_cells_e1", "stream_released_e1", "stream_partitioned"])
def test_a_stream_of_many_triggers_gives_the_batch_result(spark, scattered, monkeypatch, name):
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 100, raising=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "8k")
    try:
        got = stream_queries.STREAMS[name](spark, scattered)
        want = click_cells(spark, scattered)
        want = release(want, 2) if name == "stream_released_e1" else want
        rows = lambda df: sorted(map(str, df.select(*[F.col(c).cast("string") for c in sorted(want.columns)]).collect()))
        assert rows(got) == rows(want)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


S = 10**6


def at(n):
    return n * S


def clock():
    return PartitionClock(60 * S, 30 * S, at(-60), at(-60))


def test_close_boundary_and_late():
    c = clock()
    assert c.see(at(5)) == 0 and c.close([0]) == []
    assert c.see(at(95)) == 60 * S and c.close([0, 60 * S]) == [0]
    c = clock()
    c.see(at(200))
    c.close([180 * S])
    assert c.see(at(5)) is None and c.latest == at(200)


def test_nothing_is_late_in_the_first_batch():
    c = PartitionClock(60 * S, 30 * S)
    assert c.see(at(864_000)) == 864_000 * S and c.see(at(0)) == 0 and c.see(at(300_000)) == 300_000 * S
    assert c.flushed == at(-86_400) and c.latest == at(864_000)
    assert c.close([0, 300_000 * S, 864_000 * S]) == [0, 300_000 * S] and c.flushed == at(863_970)
    c = PartitionClock(60 * S, 30 * S, c.latest, c.flushed)
    assert c.see(at(5)) is None and c.see(at(864_001)) == 864_000 * S


def test_idle_closes_and_watermark_never_goes_back():
    c = clock()
    c.see(at(5))
    c.idle(at(3600))
    assert c.close([0]) == [0] and c.flushed == at(3570)
    c.latest = at(100)
    c.close([])
    assert c.flushed == at(3570)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 19), st.integers(0, 4), st.integers(0, 2)), min_size=1, max_size=59), st.randoms())
def test_totals_are_those_of_unique_events(rows, rng):
    sent = [(f"e{i}", ts, f"u{u}") for i, (ts, u, copies) in enumerate(rows) for _ in range(copies + 1)]
    random.Random(rng.random()).shuffle(sent)
    c, window = clock(), Window()
    for event_id, ts, user in sent:
        assert c.see(at(ts)) == 0
        window.add(event_id, ("f", "w", 0), user)
        window = Window(window.dump())
    totals = window.totals()
    assert len(totals) == 4 and set(totals.values()) == {(len(rows), len({u for _, u, _ in rows}))}


def test_gate_and_latest_window():
    t = dt.datetime(2026, 9, 23, 10, 15)
    assert not is_complete(t, None) and not is_complete(t, t + dt.timedelta(seconds=59)) and is_complete(t, t + dt.timedelta(seconds=60))
    assert latest_window(None) is None and latest_window(dt.datetime(2026, 9, 23, 10, 16, 30)) == t
    assert parent_key(1, None, None)["family"] == "*" and parent_key(3, "f", "w") == {"level": 2, "family": "f", "wiki": "w", "namespace": -1}


def test_metrics(spark):
    m = Metrics()
    m.count("x", 5, 10.0)
    m.count("x", 10, 12.0)
    assert m.totals["x"] == 15 and m.rate("x") == 5 and m.rate("y") == 0
    assert consumer_lag({"0": 10, "1": 5}, {"0": 4, "1": 9}) == {"0": 6, "1": 0}
    from pyspark.sql import Observation

    seen = Observation("o")
    spark.range(4).withColumn("error", F.when(F.col("id") == 0, "bad")).observe(seen, F.count_if(F.col("error").isNull()).alias("ok")).count()
    assert seen.get["ok"] == 3 and observed(spark.range(1).withColumn("error", F.lit(None))).count() == 1


class FakeValue:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class FakeMap(dict):
    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


class FakeHandle:
    def __init__(self):
        self.timers = set()

    def getValueState(self, *a):
        return FakeValue()

    def getMapState(self, *a):
        return FakeMap()

    def listTimers(self):
        return set(self.timers)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def registerTimer(self, at):
        self.timers.add(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentProcessingTimeInMs(self):
        return self.ms


def test_a_silent_partition_closes_its_windows():
    import pandas as pd

    processor, handle = PartitionWindows(), FakeHandle()
    processor.init(handle)
    start_at = pd.Timestamp("2026-09-23 10:00:00", tz="UTC")
    frame = lambda *seconds: pd.DataFrame([("e%d" % s, "u", start_at + pd.Timedelta(seconds=s), "f", "w", 0) for s in seconds], columns=["event_id", "user", "ts", "family", "wiki", "namespace"])
    now = int(start_at.timestamp() * 1000)
    out = pd.concat(processor.handleInputRows((3,), iter([frame(5, 6, 5)]), Clock(now)))
    assert out["window_start"].isna().all() and out["duplicates"].sum() == 1 and handle.timers == {now + 10_000}
    out = pd.concat(processor.handleInputRows((3,), iter([frame(50)]), Clock(now + 4000)))
    assert handle.timers == {now + 14_000} and len(processor.windows) == 1
    out = pd.concat(processor.handleExpiredTimer((3,), Clock(now + 3_600_000), None))
    closed = out[out["window_start"].notna()]
    assert len(closed) == 4 and set(closed["events"]) == {3} and set(closed["users"]) == {1} and not processor.windows
    assert out["flushed_watermark"].iloc[0] == start_at + pd.Timedelta(seconds=3570)
    out = pd.concat(processor.handleInputRows((3,), iter([frame(7)]), Clock(now + 3_600_000)))
    assert out["late"].sum() == 1
