"""Command line: ``python -m veilstream COMMAND``. Settings come from the environment, see ``plans.model.Settings``.

    loadgen    --landing F --truth F    drop a generated stream as files, and its truth
    aggregate  --landing F --store F    run the streaming pipeline over what has landed, or for ever with --every
    latest     --store F                the last complete window
    stats      --store F --window T --level N [--family A] [--wiki B] [--estimator hll]
    reconcile  --store F --truth F      compare; exit code 1 on drift
    compact    --store F [--keep-days N]
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilstream.operators import loadgen, reconcile
from veilstream.operators.suppress import as_json
from veilstream.plans.model import Settings
from veilstream.plans.stats import BadRequest, Incomplete, Stats
from veilstream.session import ship
from veilstream.sources.ingest import landed
from veilstream.sources.store import CellStore
from veilstream.sources.truth import read_truth, write_truth
from veilstream.streaming.pipeline import prepared, start, stream_counts


def arguments(argv: list[str]) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="veilstream", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = parser.add_subparsers(dest="command", required=True)
    add = lambda name, *needed: (p := commands.add_parser(name), [p.add_argument(f"--{n}", required=True) for n in needed])[0]
    load = add("loadgen", "landing", "truth")
    for name, default in (("rate", 200), ("seconds", 60), ("batch-size", 100), ("users", 5000), ("seed", 42)):
        load.add_argument(f"--{name}", type=int, default=default)
    load.add_argument("--start", type=dt.datetime.fromisoformat, default=dt.datetime(2026, 1, 1))
    load.add_argument("--paced", action="store_true")
    run = add("aggregate", "landing", "store")
    run.add_argument("--every", help="trigger interval, as '1 second'; without it the job ends when all input is read")
    add("latest", "store")
    ask = add("stats", "store", "window", "level")
    for name in ("family", "wiki"):
        ask.add_argument(f"--{name}")
    ask.add_argument("--estimator", default="exact")
    add("reconcile", "store", "truth")
    add("compact", "store").add_argument("--keep-days", type=int)
    return parser.parse_args(argv)


def run(spark: SparkSession, argv: list[str], settings: Settings | None = None, out=sys.stdout) -> int:
    """One command; returns the exit code."""
    args, settings = arguments(argv), settings or Settings.load()
    ship(spark)
    say = lambda **x: print(json.dumps(x, default=str), file=out)
    if args.command == "loadgen":
        load = loadgen.Load(args.rate, args.seconds, args.batch_size, args.users, seed=args.seed, start=args.start)
        files = loadgen.feed(spark, load, args.landing, paced=args.paced)
        write_truth(loadgen.truth(spark, load), args.truth)
        say(events=load.total, files=files)
        return 0
    store = CellStore(spark, args.store)
    if args.command == "aggregate":
        events = prepared(landed(spark, args.landing), F.current_timestamp(), settings if settings.pseudonym_salt else None)
        query = start(stream_counts(events), store, f"{args.store}/checkpoint", every=args.every, sketches=settings.hll_enabled)
        query.awaitTermination()
        say(batches=len(query.recentProgress), watermark=store.min_watermark())
    elif args.command == "latest":
        say(window_start=Stats(store, settings).latest_window())
    elif args.command == "stats":
        window = dt.datetime.fromisoformat(args.window)
        try:
            rows = Stats(store, settings).stats(window, int(args.level), args.family, args.wiki, args.estimator)
        except (BadRequest, Incomplete) as e:
            say(error=str(e), status=e.status)
            return 1
        say(window_start=window, level=int(args.level), cells=[json.loads(r["value"]) for r in as_json(rows).collect()])
    elif args.command == "reconcile":
        found = reconcile.summary(reconcile.compare(read_truth(spark, args.truth), store.cells())).first().asDict()
        say(**found)
        return 0 if found["passed"] else 1
    elif args.command == "compact":
        dropped = store.drop_before(dt.date.today() - dt.timedelta(days=args.keep_days)) if args.keep_days is not None else 0
        say(batch=store.compact(), dropped=dropped)
    return 0


if __name__ == "__main__":
    sys.exit(run(SparkSession.builder.appName("veilstream").config("spark.sql.session.timeZone", "UTC").getOrCreate(), sys.argv[1:]))
