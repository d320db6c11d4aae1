"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from veilstream.plans import queries as q
from veilstream.session import local_session
from veilstream.streaming.queries import STREAMS

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "cells_exact_e1", "cells_exact_e2", "partials_final_equals_distinct", "suppress_e1_l1", "suppress_e1_l2", "suppress_e1_l3", "suppress_e2_l2", "fetch_cell",
    "fetch_children_l2", "stats_l2", "validate_classify", "pseudonymize_hmac", "hierarchy_fanout", "dedup_in_window", "late_drop_replay", "hll_parity_cells", "hll_native",
    "dp_noise", "reconcile_clean", "latency_quantiles", "json_round_trip", "stream_cells_e1",
]


def main() -> None:
    spark = local_session(CPUS, int(CPUS) if CPUS.isdigit() else 8)
    run = lambda df: df.write.format("noop").mode("overwrite").save()
    every = q.QUERIES | STREAMS
    run(q.cells_exact_e1(spark, SF_DIR))  # start-up and code generation aren't what is measured
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(1 if name.startswith("stream") else 2):
            began = time.perf_counter()
            run(every[name](spark, SF_DIR))
            best = min(best, time.perf_counter() - began)
        times[name] = round(best, 3)
    rows = spark.read.parquet(f"{SF_DIR}/events.parquet").count()
    sf = SF_DIR.rstrip("/").rpartition("sf")[2]
    rates = {k: round(rows / times[k]) for k in ("cells_exact_e1", "validate_classify", "json_round_trip", "stream_cells_e1") if k in times}
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "events_per_sec": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
