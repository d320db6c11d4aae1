import io
import json

from veilstream.__main__ import run
from veilstream.plans.model import EVENT, Settings

SETTINGS = Settings(pseudonym_salt="s", privacy_k=10)


def call(spark, *argv):
    out = io.StringIO()
    code = run(spark, [str(a) for a in argv], SETTINGS, out)
    return code, json.loads(out.getvalue())


def test_generate_aggregate_ask_and_reconcile(spark, tmp_path):
    landing, store, truth = f"{tmp_path}/in", f"file://{tmp_path}/store", f"{tmp_path}/truth"
    assert call(spark, "latest", "--store", store) == (0, {"window_start": None})
    code, said = call(spark, "loadgen", "--landing", landing, "--truth", truth, "--rate", 40, "--seconds", 150, "--users", 80)
    assert code == 0 and said["events"] == 6000
    call(spark, "aggregate", "--landing", landing, "--store", store)
    assert call(spark, "reconcile", "--store", store, "--truth", truth)[0] == 1  # the last windows are open
    code, said = call(spark, "stats", "--store", store, "--window", "2026-01-01T00:03:00", "--level", 0)
    assert (code, said["status"]) == (1, 409)
    last = spark.read.schema(EVENT).parquet(landing).limit(1)
    last.selectExpr("'end' AS event_id", "user", "TIMESTAMP '2026-01-01 01:00:00' AS ts", "family", "wiki", "namespace", "kind", "is_bot").write.mode("append").parquet(landing)
    call(spark, "aggregate", "--landing", landing, "--store", store)
    code, said = call(spark, "reconcile", "--store", store, "--truth", truth)
    assert code == 0 and said["passed"] and said["matched"] > 20
    before = call(spark, "stats", "--store", store, "--window", "2026-01-01T00:01:00", "--level", 1)
    assert before[0] == 0 and before[1]["cells"] and all(c["users"] >= 10 for c in before[1]["cells"])
    assert call(spark, "compact", "--store", store)[1]["batch"] is not None
    assert call(spark, "stats", "--store", store, "--window", "2026-01-01T00:01:00", "--level", 1) == before
    assert call(spark, "reconcile", "--store", store, "--truth", truth)[0] == 0
    code, said = call(spark, "stats", "--store", store, "--window", "2026-01-01T00:01:00", "--level", 2)
    assert (code, said["status"]) == (1, 400)
    assert call(spark, "compact", "--store", store, "--keep-days", 0)[1]["dropped"] > 0
