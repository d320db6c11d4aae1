"""The registered queries of the analytics engine, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstream.functions import dp, hll
from veilstream.functions.pseudonym import pseudonymize
from veilstream.functions.scalar import family_for_wiki, is_kind, kpartition, window_end, window_start
from veilstream.operators import loadgen, reconcile, replay, rollup, suppress, validate
from veilstream.plans.model import CELL, K, Settings
from veilstream.plans.stats import Stats, hll_counts
from veilstream.sources.adapters import clicks, purchases, table
from veilstream.sources.events import changes_to_events, decode_events, encode_events
from veilstream.session import work_dir
from veilstream.sources.store import CellStore

KEYS = ["window_start", *CELL]
SALT = "test-salt"


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _click_partition():
    return F.pmod(F.col("user").cast("long"), F.lit(12)).cast("int")


def click_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.batch_cells(clicks(spark, sf_dir), "1 day")


def purchase_cells(spark: SparkSession, sf_dir: str, size: str = "month") -> DataFrame:
    return rollup.batch_cells(purchases(spark, sf_dir), size)


# Common parts of the SQL: the two event sources and their cells.
CLICKS = """clicks AS (
  SELECT event_id::VARCHAR AS event_id, user_id::VARCHAR AS "user", user_id, ts, event_type AS family, event_type || '-' || (k % 5)::VARCHAR AS wiki, ((k // 5) % 3)::INT AS namespace, value
  FROM (SELECT *, regexp_extract(props, '"k"\\s*:\\s*(-?[0-9]+)', 1)::INT AS k FROM events))"""
PURCHASES = """purchases AS (
  SELECT o_orderkey::VARCHAR AS event_id, c_name AS "user", o_orderdate AS ts, r_name AS family, n_name AS wiki,
    list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'], c_mktsegment)::INT - 1 AS namespace, o_totalprice AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _cells_sql(source: str, size: str, extra: str = "", where: str = "") -> str:
    """cells AS (...): all four levels by GROUPING SETS."""
    extra_select = f"{extra}, " if extra else ""
    return f"""cells AS (
  SELECT {extra_select}window_start::TIMESTAMP AS window_start, (3 - CASE WHEN GROUPING(family) = 1 THEN 3 WHEN GROUPING(wiki) = 1 THEN 2 WHEN GROUPING(namespace) = 1 THEN 1 ELSE 0 END)::INT AS level,
    CASE WHEN GROUPING(family) = 1 THEN '*' ELSE family END AS family, CASE WHEN GROUPING(wiki) = 1 THEN '*' ELSE wiki END AS wiki,
    (CASE WHEN GROUPING(namespace) = 1 THEN -1 ELSE namespace END)::INT AS namespace, count(*)::BIGINT AS events, count(DISTINCT "user")::BIGINT AS users
  FROM (SELECT *, date_trunc('{size}', ts) AS window_start FROM {source} {where})
  GROUP BY GROUPING SETS (({extra_select}window_start), ({extra_select}window_start, family), ({extra_select}window_start, family, wiki), ({extra_select}window_start, family, wiki, namespace)))"""


CLICK_CELLS = f"{CLICKS}, {_cells_sql('clicks', 'day')}"
PURCHASE_CELLS = f"{PURCHASES}, {_cells_sql('purchases', 'month')}"


def _suppress_sql(cells: str, level: int, k: int, parent: str = "p.users") -> str:
    axes = {1: [], 2: ["family"], 3: ["family", "wiki"]}[level]
    on = " AND ".join(["c.window_start = p.window_start", *(f"c.{a} = p.{a}" for a in axes)])
    by = ", ".join(["window_start", *(f"parent_{a}" for a in axes)])
    return f"""WITH {cells},
children AS (
  SELECT c.*, {"".join(f"c.{a} AS parent_{a}, " for a in axes)}coalesce({parent}, 0) AS parent_users
  FROM (SELECT * FROM cells WHERE level = {level}) c LEFT JOIN (SELECT * FROM cells WHERE level = {level - 1}) p ON {on}),
shares AS (
  SELECT *, coalesce(sum(users) FILTER (WHERE users < {k}) OVER w, 0) + greatest(0, parent_users - sum(users) OVER w) AS hidden_users,
    greatest(0, parent_users - sum(users) OVER w) AS residual,
    CASE WHEN users >= {k} THEN row_number() OVER (PARTITION BY {by}, users >= {k} ORDER BY users, family, wiki, namespace) END AS place
  FROM children WINDOW w AS (PARTITION BY {by})),
decided AS (SELECT *, users < {k} OR (place = 1 AND hidden_users > 0 AND hidden_users < {k}) AS hidden FROM shares)
SELECT {by}, 'Visible' AS kind, family, wiki, namespace, events, users FROM decided WHERE NOT hidden
UNION ALL
SELECT {by}, 'Other', NULL, NULL, NULL, sum(events)::BIGINT, (sum(users) + max(residual))::BIGINT FROM decided WHERE hidden
GROUP BY {by} HAVING sum(users) + max(residual) >= {k}"""


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Mapping and scalar functions.

WIKI_NAMES = ["enwiki", "knwiki", "enwiktionary", "frwikinews", "dewikibooks", "itwikiquote", "plwikisource", "enwikiversity", "dewikivoyage", "wikidatawiki", "commonswiki", "specieswiki", "mediawikiwiki", "totally-unknown", "wikipedia.org"]


@query(
    f"""
SELECT n_nationkey, wiki, CASE wiki WHEN 'wikidatawiki' THEN 'wikidata' WHEN 'commonswiki' THEN 'commons' WHEN 'specieswiki' THEN 'wikispecies' WHEN 'mediawikiwiki' THEN 'mediawiki'
  ELSE CASE WHEN wiki LIKE '%wiktionary' THEN 'wiktionary' WHEN wiki LIKE '%wikinews' THEN 'wikinews' WHEN wiki LIKE '%wikibooks' THEN 'wikibooks' WHEN wiki LIKE '%wikiquote' THEN 'wikiquote'
    WHEN wiki LIKE '%wikisource' THEN 'wikisource' WHEN wiki LIKE '%wikiversity' THEN 'wikiversity' WHEN wiki LIKE '%wikivoyage' THEN 'wikivoyage' WHEN wiki LIKE '%wiki' THEN 'wikipedia' ELSE 'other' END END AS family
FROM (SELECT n_nationkey, unnest({WIKI_NAMES!r}) AS wiki FROM nation)"""
)
def recentchange_family_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.explode(F.array(*[F.lit(n) for n in WIKI_NAMES]))
    return table(spark, sf_dir, "nation").select("n_nationkey", names.alias("wiki")).withColumn("family", family_for_wiki(F.col("wiki")))


@query(
    f"""
WITH {CLICKS}, changes AS (
  SELECT CASE WHEN family = 'error' THEN 'wat' WHEN family = 'signup' THEN 'new' ELSE 'edit' END AS type, namespace, "user", false AS bot, 'enwiki' AS wiki, floor(epoch(ts))::BIGINT AS timestamp, event_id FROM clicks WHERE event_id::BIGINT % 13 <> 0)
SELECT "user", make_timestamp(timestamp * 1000000) AS ts, 'wikipedia' AS family, wiki, namespace, type AS kind, bot AS is_bot, count(*) AS n, count(DISTINCT md5(concat_ws(chr(31), type, namespace::VARCHAR, "user", 'false', wiki, timestamp::VARCHAR))) AS ids
FROM changes WHERE type <> 'wat' GROUP BY ALL"""
)
def recentchange_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change records made of clicks, mapped to events; unknown types and times out of any calendar are skipped."""
    kind = F.when(F.col("family") == "error", F.lit("wat")).when(F.col("family") == "signup", F.lit("new")).otherwise(F.lit("edit"))
    changes = clicks(spark, sf_dir).select(kind.alias("type"), "namespace", "user", F.lit(False).alias("bot"), F.lit("enwiki").alias("wiki"), F.when(F.col("event_id").cast("long") % 13 == 0, F.lit(9 * 10**18)).otherwise(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("timestamp"))
    events = changes_to_events(changes).filter(~F.col("map_error"))
    keys = ["user", "ts", "family", "wiki", "namespace", "kind", "is_bot"]
    return _ntz(events.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids")), "ts")


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with faults: blank users, wikis and families, negative namespaces and future times, by event number."""
    n = F.col("event_id").cast("long")
    when = lambda k, bad, name: F.when(n % 11 == k, bad).otherwise(F.col(name)).alias(name)
    return clicks(spark, sf_dir).select(
        "event_id", when(1, F.lit(" \t"), "user"), when(2, F.lit(""), "wiki"), F.when((n % 11 == 3) | (n % 22 == 1), F.lit("  ")).otherwise(F.col("family")).alias("family"),
        F.when((n % 11 == 4) | (n % 22 == 2), F.lit(-1)).otherwise(F.col("namespace")).alias("namespace"), F.when(n % 11 == 5, F.col("ts") + F.expr("INTERVAL 100 days")).otherwise(F.col("ts")).alias("ts"),
        F.floor(n / 4).alias("batch_id"),
    )


NOW = "2024-02-01 00:00:00"
FAULTY = f"""{CLICKS}, faulty AS (
  SELECT event_id, CASE WHEN n % 11 = 1 THEN E' \\t' ELSE "user" END AS "user", CASE WHEN n % 11 = 2 THEN '' ELSE wiki END AS wiki, CASE WHEN n % 11 = 3 OR n % 22 = 1 THEN '  ' ELSE family END AS family,
    CASE WHEN n % 11 = 4 OR n % 22 = 2 THEN -1 ELSE namespace END AS namespace, CASE WHEN n % 11 = 5 THEN ts + INTERVAL 100 DAYS ELSE ts END AS ts, (n // 4)::BIGINT AS batch_id
  FROM (SELECT *, event_id::BIGINT AS n FROM clicks)),
classified AS (
  SELECT *, CASE WHEN regexp_full_match("user", '\\s*') THEN 'EmptyUser' WHEN regexp_full_match(wiki, '\\s*') THEN 'EmptyWiki' WHEN regexp_full_match(family, '\\s*') THEN 'EmptyFamily'
    WHEN namespace < 0 THEN 'NegativeNamespace' WHEN ts > TIMESTAMP '{NOW}' + INTERVAL 60 SECONDS THEN 'TimestampInFuture' END AS error FROM faulty)"""


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


@query(f"WITH {FAULTY} SELECT event_id, error FROM classified")
def validate_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.classify(_faulty(spark, sf_dir), _now()).select("event_id", "error")


@query(f"WITH {FAULTY} SELECT event_id, \"user\", wiki, family, namespace, ts FROM classified WHERE error IS NULL")
def validate_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.accepted(_faulty(spark, sf_dir), _now()).select("event_id", "user", "wiki", "family", "namespace", "ts")


@query(f"WITH {FAULTY} SELECT event_id, error FROM classified WHERE error IS NOT NULL")
def validate_quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.quarantined(_faulty(spark, sf_dir), _now()).select("event_id", "error")


@query(f"WITH {FAULTY} SELECT event_id, batch_id FROM classified WHERE batch_id NOT IN (SELECT batch_id FROM classified WHERE error IS NOT NULL)")
def validate_batch_all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.accepted_batches(_faulty(spark, sf_dir), _now()).select("event_id", "batch_id")


@query(f"WITH {CLICKS} SELECT event_id, \"user\", ts, family, wiki, namespace, CASE WHEN event_id::BIGINT % 7 = 0 THEN 'Malformed' WHEN event_id::BIGINT % 7 = 1 THEN 'UnknownKind' END AS decode_error FROM (SELECT * REPLACE (CASE WHEN event_id::BIGINT % 7 = 0 THEN NULL ELSE namespace END AS namespace) FROM clicks)")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to JSON and back; a missing field and an unknown kind are told apart."""
    n = F.col("event_id").cast("long")
    rows = clicks(spark, sf_dir).select(
        "event_id", "user", F.col("ts").cast("timestamp").alias("ts"), "family", "wiki", F.when(n % 7 != 0, F.col("namespace")).alias("namespace"),
        F.when(n % 7 == 1, F.lit("wat")).otherwise(F.lit("edit")).alias("kind"), F.lit(False).alias("is_bot"),
    )
    lines = encode_events(rows).select(F.regexp_replace("value", r"\}$", ',"ignored":1}').alias("value"))  # a field that no event has
    return _ntz(decode_events(lines).select("event_id", "user", "ts", "family", "wiki", "namespace", "decode_error"), "ts")


_IPAD = "".join(f"{b ^ 0x36:02x}" for b in SALT.encode().ljust(64, b"\0"))
_OPAD = "".join(f"{b ^ 0x5C:02x}" for b in SALT.encode().ljust(64, b"\0"))


@query(f"SELECT c_custkey, sha256(unhex('{_OPAD}') || unhex(sha256(unhex('{_IPAD}') || encode(c_name)))) AS pseudonym FROM customer")
def pseudonymize_hmac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", pseudonymize(F.col("c_name"), SALT).alias("pseudonym"))


@query("SELECT event_id, date_trunc('minute', ts)::TIMESTAMP AS window_start, date_trunc('minute', ts)::TIMESTAMP + INTERVAL 60 SECONDS AS window_end FROM events")
def window_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", window_start(F.col("ts")).alias("window_start"))
    return rows.withColumn("window_end", window_end(F.col("window_start")))


@query(f"WITH {CLICKS} SELECT event_id FROM clicks WHERE family IN ('purchase', 'signup')")
def kind_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose type maps to a known kind."""
    kind = F.when(F.col("family") == "purchase", F.lit("edit")).when(F.col("family") == "signup", F.lit("new")).otherwise(F.upper(F.lit("edit")))
    return clicks(spark, sf_dir).filter(is_kind(kind)).select("event_id")


# Hierarchy and cells.


@query(
    f"""
WITH {CLICKS} SELECT event_id, l.level, CASE WHEN l.level >= 1 THEN family ELSE '*' END AS family, CASE WHEN l.level >= 2 THEN wiki ELSE '*' END AS wiki, (CASE WHEN l.level >= 3 THEN namespace ELSE -1 END)::INT AS namespace
FROM clicks, (SELECT unnest([0, 1, 2, 3])::INT AS level) l"""
)
def hierarchy_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.fan_out(clicks(spark, sf_dir).select("event_id", "family", "wiki", "namespace"))


@query(
    f"""
WITH {CLICK_CELLS} SELECT DISTINCT level, family, wiki, namespace, CASE WHEN level > 0 THEN level - 1 END AS parent_level, CASE WHEN level >= 2 THEN family WHEN level = 1 THEN '*' END AS parent_family,
  CASE WHEN level = 3 THEN wiki WHEN level > 0 THEN '*' END AS parent_wiki, CASE WHEN level > 0 THEN -1 END AS parent_namespace FROM cells"""
)
def hierarchy_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = rollup.fan_out(clicks(spark, sf_dir).select("family", "wiki", "namespace")).distinct()
    return cells.select("*", *rollup.parent_columns())


@query(f"WITH {CLICKS} SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, count(*) AS events FROM clicks GROUP BY 1")
def dedup_in_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of a stream in which a third of the events come twice."""
    events = clicks(spark, sf_dir).select("event_id", "ts")
    twice = events.unionByName(events.filter(F.col("event_id").cast("long") % 3 == 0))
    return rollup.dedup_in_window(twice, "1 hour").groupBy("window_start").agg(F.count("*").alias("events"))


@query(f"WITH {CLICK_CELLS} SELECT window_start, level, family, wiki, namespace, events, users FROM cells")
def cells_exact_e1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return click_cells(spark, sf_dir)


@query(f"WITH {PURCHASE_CELLS} SELECT window_start, level, family, wiki, namespace, events, users FROM cells")
def cells_exact_e2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return purchase_cells(spark, sf_dir)


_PARTIALS = f"{CLICKS}, parted AS (SELECT *, (user_id % 12)::INT AS kpartition FROM clicks), {_cells_sql('parted', 'day', 'kpartition')}"


@query(f"WITH {_PARTIALS} SELECT window_start, kpartition, level, family, wiki, namespace, events, users FROM cells")
def partials_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.partials(clicks(spark, sf_dir), _click_partition(), "1 day")


@query(f"WITH {CLICK_CELLS} SELECT window_start, level, family, wiki, namespace, events, users FROM cells")
def partials_final_equals_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.finalize(rollup.partials(clicks(spark, sf_dir), _click_partition(), "1 day"))


DAY = "2024-01-10 00:00:00"
DAY_AT = dt.datetime(2024, 1, 10)


def _partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.partials(clicks(spark, sf_dir), _click_partition(), "1 day")


_STORES: dict[tuple[str, str], CellStore] = {}
FLUSHED = "2024-01-08 00:00:00"


def stored_clicks(spark: SparkSession, sf_dir: str) -> CellStore:
    """A store of daily cells that was flushed twice: what the first flush had of the later days lacks a third of the events, and the second replaces it.

    Partitions are those of the streaming job. Filled once for each application and folder.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        store = CellStore(spark, work_dir(spark, "clicks"))
        events = clicks(spark, sf_dir).drop("value").withColumn("ts", F.col("ts").cast("timestamp"))
        later = F.col("ts") >= F.lit(FLUSHED).cast("timestamp")
        cells = lambda some: rollup.partials(some, kpartition(F.col("user")), "1 day")
        progress = lambda batch, until: spark.range(12).select(F.col("id").cast("int").alias("kpartition"), F.lit(batch).alias("committed_offset"), F.lit(until).cast("timestamp").alias("flushed_watermark"))
        store.flush(cells(events.filter(~later | (F.col("event_id").cast("long") % 3 != 0))), progress(1, FLUSHED), 1)
        store.flush(cells(events.filter(later)), progress(2, NOW), 2)
        _STORES[key] = store
    return _STORES[key]


def _stored_day(spark: SparkSession, sf_dir: str, day: dt.datetime) -> DataFrame:
    return stored_clicks(spark, sf_dir).cells(day)


def _fetch_sql(level: int, where: str = "") -> str:
    return f"WITH {CLICK_CELLS} SELECT family, wiki, namespace, events, users FROM cells WHERE window_start = TIMESTAMP '{DAY}' AND level = {level} {where}"


@query(f"WITH {CLICK_CELLS} SELECT coalesce(sum(events), 0)::BIGINT AS events, coalesce(sum(users), 0)::BIGINT AS users FROM cells WHERE window_start = TIMESTAMP '{DAY}' AND level = 1 AND family = 'click'")
def fetch_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.fetch_cell(_stored_day(spark, sf_dir, DAY_AT), DAY_AT, 1, "click")


@query("SELECT 0::BIGINT AS events, 0::BIGINT AS users")
def fetch_cell_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.fetch_cell(_stored_day(spark, sf_dir, dt.datetime(1999, 1, 1)), dt.datetime(1999, 1, 1), 0)


@query(_fetch_sql(1))
def fetch_children_l1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.fetch_children(_stored_day(spark, sf_dir, DAY_AT), DAY_AT, 1)


@query(_fetch_sql(2, "AND family = 'view'"))
def fetch_children_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.fetch_children(_stored_day(spark, sf_dir, DAY_AT), DAY_AT, 2, "view")


@query(_fetch_sql(3, "AND family = 'view' AND wiki = 'view-3'"))
def fetch_children_l3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.fetch_children(_stored_day(spark, sf_dir, DAY_AT), DAY_AT, 3, "view", "view-3")


# Suppression and release.


def _add_suppression(name: str, cells, sql: str, level: int, k: int = K) -> None:
    QUERIES[name] = lambda spark, sf_dir: suppress.release(cells(spark, sf_dir), level, k)
    ORACLES[name] = _suppress_sql(sql, level, k)


for _level in (1, 2, 3):
    _add_suppression(f"suppress_e1_l{_level}", click_cells, CLICK_CELLS, _level)
    _add_suppression(f"suppress_e2_l{_level}", purchase_cells, PURCHASE_CELLS, _level)
_add_suppression("suppress_k5", click_cells, CLICK_CELLS, 2, 5)
_add_suppression("suppress_k25", purchase_cells, PURCHASE_CELLS, 2, 25)


@query(_suppress_sql(CLICK_CELLS, 2, K, "p.users * 3"))
def suppress_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents with more users than their children account for."""
    children, keys = suppress.with_parents(click_cells(spark, sf_dir), 2)
    return suppress.suppress(children.withColumn("parent_users", F.col("parent_users") * 3), keys, K)


_GLOBAL = f"{CLICKS}, {_cells_sql('clicks', 'hour')}"


@query(f"WITH {_GLOBAL} SELECT window_start, 'Visible' AS kind, family, wiki, namespace, events, users FROM cells WHERE level = 0 AND users >= 10")
def release_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.release_global(rollup.batch_cells(clicks(spark, sf_dir), "1 hour"))


@query(
    f"""WITH {_GLOBAL} SELECT window_start, CASE WHEN users >= 10 THEN 'Visible' ELSE 'Other' END AS kind, CASE WHEN users >= 10 THEN family END AS family,
  CASE WHEN users >= 10 THEN wiki END AS wiki, CASE WHEN users >= 10 THEN namespace END AS namespace, events, users FROM cells WHERE level = 0"""
)
def release_global_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.release_global(rollup.batch_cells(clicks(spark, sf_dir), "1 hour"), strict=False)


@query(f"WITH {CLICK_CELLS} SELECT window_start, level, family, wiki, namespace, events, users FROM cells WHERE users >= 10")
def suppress_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.suppress_single(click_cells(spark, sf_dir))


@query(f"SELECT '{{\"kind\":\"' || kind || '\"' || CASE WHEN kind = 'Visible' THEN ',\"family\":\"' || family || '\",\"wiki\":\"' || wiki || '\",\"namespace\":' || namespace ELSE '' END || ',\"events\":' || events || ',\"users\":' || users || '}}' AS value FROM ({_suppress_sql(CLICK_CELLS, 2, K)})")
def released_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppress.as_json(suppress.release(click_cells(spark, sf_dir), 2))


# Released statistics of one window, asked of the store.


def _add_stats(level: int, family: str | None = None, wiki: str | None = None, k: int = K) -> None:
    where = "".join(f" AND parent_{a} = '{v}'" for a, v in (("family", family), ("wiki", wiki)) if v)
    QUERIES[f"stats_l{level}"] = lambda spark, sf_dir: _ntz(Stats(stored_clicks(spark, sf_dir), Settings(privacy_k=k), "1 day").stats(DAY_AT, level, family, wiki), "window_start")
    ORACLES[f"stats_l{level}"] = f"SELECT window_start, kind, family, wiki, namespace, events, users FROM ({_suppress_sql(CLICK_CELLS, level, k)}) WHERE window_start = TIMESTAMP '{DAY}'{where}"


_add_stats(1)
_add_stats(2, "view")
_add_stats(3, "view", "view-3", 2)  # a day of one wiki has few users


@query(f"WITH {CLICK_CELLS} SELECT window_start, 'Visible' AS kind, family, wiki, namespace, events, users FROM cells WHERE level = 0 AND users >= 10 AND window_start = TIMESTAMP '{DAY}'")
def stats_l0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(Stats(stored_clicks(spark, sf_dir), size="1 day").stats(DAY_AT, 0), "window_start")


@query(f"SELECT TIMESTAMP '{NOW}' - INTERVAL 1 DAY AS window_start")
def stats_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last complete window of the store."""
    latest = Stats(stored_clicks(spark, sf_dir), size="1 day").latest_window()
    return _ntz(spark.createDataFrame([(latest,)], "window_start timestamp"), "window_start")


# Progress, late events, latency.

_PROGRESS = "progress AS (SELECT (user_id % 12)::INT AS kpartition, max(ts) - INTERVAL 30 SECONDS AS flushed_watermark FROM events GROUP BY 1)"


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("kpartition", (F.col("user_id") % 12).cast("int"))
    return rows.groupBy("kpartition").agg((F.max("ts") - F.expr("INTERVAL 30 seconds")).alias("flushed_watermark"))


@query(f"WITH {_PROGRESS} SELECT min(flushed_watermark) AS min_watermark FROM progress")
def min_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _progress(spark, sf_dir).agg(F.min("flushed_watermark").alias("min_watermark"))


@query(f"WITH {_PROGRESS} SELECT date_trunc('minute', min(flushed_watermark))::TIMESTAMP - INTERVAL 60 SECONDS AS window_start FROM progress")
def latest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    least = _progress(spark, sf_dir).agg(F.min("flushed_watermark").alias("w"))
    return least.select((F.date_trunc("minute", "w").cast("timestamp_ntz") - F.expr("INTERVAL 60 seconds")).alias("window_start"))


@query(f"WITH {CLICK_CELLS}, {_PROGRESS} SELECT window_start, events, users FROM cells WHERE level = 0 AND window_start + INTERVAL 1 DAY <= (SELECT min(flushed_watermark) FROM progress)")
def completeness_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global cells of the windows that every partition has flushed."""
    least = _progress(spark, sf_dir).agg(F.min("flushed_watermark").alias("least"))  # one row
    cells = click_cells(spark, sf_dir).filter("level = 0")
    return cells.join(F.broadcast(least), window_end(F.col("window_start"), "1 day") <= F.col("least")).select("window_start", "events", "users")


@query(
    f"""
WITH {CLICKS}, arrived AS (
  SELECT *, ts + ((event_id::BIGINT * 7919) % 7) * INTERVAL 10 MINUTES AS arrival, date_trunc('hour', ts)::TIMESTAMP AS window_start, (user_id % 12)::INT AS kpartition FROM clicks),
marked AS (
  SELECT *, max(ts) OVER (PARTITION BY kpartition ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 30 MINUTES AS watermark FROM arrived)
SELECT event_id, kpartition, window_start, watermark, coalesce(window_start + INTERVAL 1 HOUR <= watermark, false) AS late FROM marked"""
)
def late_drop_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    delay = F.make_dt_interval(mins=((F.col("event_id").cast("long") * 7919) % 7 * 10).cast("int"))
    events = clicks(spark, sf_dir).withColumn("kpartition", _click_partition())
    marked = replay.arrivals(events, F.col("ts") + delay, ["kpartition"], "1 hour", "30 minutes")
    return marked.select("event_id", "kpartition", "window_start", "watermark", "late")


@query(
    f"""
WITH {CLICKS}, numbered AS (SELECT *, (user_id % 12)::INT AS kpartition, event_id::BIGINT AS "offset" FROM clicks)
SELECT kpartition, coalesce(min("offset") FILTER (WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR > TIMESTAMP '2024-01-20 00:00:00'), max("offset") + 1) AS committed_offset FROM numbered GROUP BY 1"""
)
def committed_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = clicks(spark, sf_dir).withColumn("kpartition", _click_partition()).withColumn("offset", F.col("event_id").cast("long"))
    return replay.committed_offsets(rows, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), "1 hour")


@query("SELECT quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max FROM events")
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.latency_quantiles(table(spark, sf_dir, "events"), "value")


# HyperLogLog.

_FNV = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length(u) + 1), lambda i: ascii(u[i])::UHUGEINT)), lambda a, x: (xor(a, x) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"
_HLL = """
hashed AS (SELECT {keys}, u, {fnv} AS h FROM (SELECT DISTINCT {keys}, "user" AS u FROM {source})),
mixed AS (SELECT * REPLACE (((xor(h, h // 8589934592::UHUGEINT)) * 18397679294719823053::UHUGEINT) % 18446744073709551616::UHUGEINT AS h) FROM hashed),
mixed2 AS (SELECT * REPLACE (((xor(h, h // 8589934592::UHUGEINT)) * 14181476777654086739::UHUGEINT) % 18446744073709551616::UHUGEINT AS h) FROM mixed),
final AS (SELECT * REPLACE (xor(h, h // 8589934592::UHUGEINT) AS h) FROM mixed2),
ranked AS (SELECT {keys}, (h // 4503599627370496::UHUGEINT)::INT AS idx, (h * 4096::UHUGEINT) % 18446744073709551616::UHUGEINT AS rest FROM final),
placed AS (SELECT {keys}, idx, max(CASE WHEN rest = 0 THEN 52 ELSE least(65 - length(ltrim(bin(rest::UBIGINT), '0')), 52) END)::INT AS rho FROM ranked GROUP BY {keys}, idx),
summed AS (SELECT {keys}, sum(pow(2.0::DOUBLE, -rho)) AS filled, count(*) AS used FROM placed GROUP BY {keys}),
raw AS (SELECT *, (0.7213::DOUBLE / (1 + 1.079::DOUBLE / 4096) * 4096 * 4096) / (filled + (4096 - used)) AS raw, 4096 - used AS zeros FROM summed),
estimates AS (SELECT {keys}, CASE WHEN raw <= 10240 AND zeros > 0 THEN 4096.0::DOUBLE * ln(4096.0::DOUBLE / zeros) ELSE raw END AS estimate FROM raw)"""


def _hll_sql(keys: str, source: str) -> str:
    return _HLL.format(keys=keys, source=source, fnv=_FNV)


@query(f"WITH {CLICKS}, keyed AS (SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, family, \"user\" FROM clicks), {_hll_sql('window_start, family', 'keyed')} SELECT window_start, family, round(estimate, 6) AS estimate FROM estimates")
def hll_parity_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["window_start", "family"]
    rows = clicks(spark, sf_dir).withColumn("window_start", window_start(F.col("ts"), "1 day"))
    return hll.estimate(hll.registers(rows, keys), keys).withColumn("estimate", F.round("estimate", 6))


@query(f"WITH keyed AS (SELECT 1 AS one, c_name AS \"user\" FROM customer), {_hll_sql('one', 'keyed')} SELECT round(estimate, 6) AS estimate FROM estimates")
def hll_merge_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches per nation, merged to one."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("part"), F.col("c_name").alias("user"), F.lit(1).alias("one"))
    merged = hll.merge(hll.registers(rows, ["part", "one"]), ["one"])
    return hll.estimate(merged, ["one"]).select(F.round("estimate", 6).alias("estimate"))


@query(f"WITH {CLICKS}, keyed AS (SELECT family, \"user\" FROM clicks), {_hll_sql('family', 'keyed')}, sums AS (SELECT family, count(*) AS events FROM clicks GROUP BY 1) SELECT family, events, round(estimate)::BIGINT AS users FROM sums JOIN estimates USING (family)")
def hll_stored_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partial rows with stored sketches, read back and merged by family."""
    rows = clicks(spark, sf_dir).withColumn("kpartition", _click_partition())
    keys = ["family", "kpartition"]
    stored = rows.groupBy(*keys).agg(F.count("*").alias("events")).join(hll.to_bytes(hll.registers(rows, keys), keys), keys)
    return hll_counts(stored, ["family"])


@query()
def hll_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark's own sketches per nation, merged per region."""
    people = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    sketches = people.groupBy("n_regionkey", "c_nationkey").agg(hll.native_sketch(F.col("c_name")).alias("sketch"))
    return sketches.groupBy("n_regionkey").agg(hll.native_estimate(hll.native_merge(F.col("sketch"))).alias("users"))


# Noise, truth, reconciliation.

_NOISY = "('0x' || substr(sha256('noise|' || strftime(window_start, '%Y-%m-%d %H:%M:%S') || '|' || kind || '|' || coalesce(family, '') || '|' || coalesce(wiki, '') || '|' || coalesce(namespace::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE - 0.5::DOUBLE"


@query(
    f"""
WITH released AS ({_suppress_sql(CLICK_CELLS, 1, K)}), drawn AS (SELECT *, {_NOISY} AS u FROM released)
SELECT window_start, kind, family, wiki, namespace, events, round(greatest(0.0::DOUBLE, users::DOUBLE + -2.0::DOUBLE * sign(u) * ln(greatest(1.0::DOUBLE - 2.0::DOUBLE * abs(u), pow(2.0::DOUBLE, -53)))))::BIGINT AS users FROM drawn"""
)
def dp_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    released = suppress.release(click_cells(spark, sf_dir), 1)
    return dp.noisy_users(released, ["window_start", "kind", "family", "wiki", "namespace"], "noise", 0.5)


@query(f"WITH {CLICK_CELLS} SELECT window_start, level, family, wiki, namespace, events, users FROM cells")
def truth_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.truth_cells(clicks(spark, sf_dir), "1 day")


@query(f"WITH {CLICK_CELLS} SELECT count(*) AS matched, 0::BIGINT AS mismatched, 0::BIGINT AS missing, 0::BIGINT AS unexpected, true AS passed FROM cells")
def reconcile_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.summary(reconcile.compare(reconcile.truth_cells(clicks(spark, sf_dir), "1 day"), _partials(spark, sf_dir)))


_DRIFT = f"""{CLICKS}, cells_all AS (SELECT * FROM (WITH {_cells_sql("clicks", "day")} SELECT * FROM cells)), cells_some AS (SELECT * FROM (WITH {_cells_sql("clicks", "day", where="WHERE event_id::BIGINT % 50 <> 0")} SELECT * FROM cells)),
joined AS (
  SELECT window_start, level, family, wiki, namespace, a.events AS expected_events, a.users AS expected_users, b.events AS actual_events, b.users AS actual_users
  FROM (SELECT * FROM cells_all WHERE wiki <> 'click-2') a FULL JOIN cells_some b USING (window_start, level, family, wiki, namespace))"""


@query(
    f"""
WITH {_DRIFT} SELECT *, CASE WHEN actual_events IS NULL THEN 'missing' WHEN expected_events IS NULL THEN 'unexpected' WHEN actual_events <> expected_events OR actual_users <> expected_users THEN 'mismatched' ELSE 'matched' END AS status FROM joined"""
)
def reconcile_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 50th event is lost on the way, and truth lacks the cells of a wiki."""
    events = clicks(spark, sf_dir)
    expected = reconcile.truth_cells(events, "1 day").filter("wiki <> 'click-2'")
    return reconcile.compare(expected, rollup.partials(events.filter(F.col("event_id").cast("long") % 50 != 0), _click_partition(), "1 day"))


@query(f"WITH {_DRIFT} SELECT window_start, level, family, wiki, namespace FROM joined WHERE expected_events IS NULL")
def reconcile_unexpected(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = clicks(spark, sf_dir)
    expected = reconcile.truth_cells(events, "1 day").filter("wiki <> 'click-2'")
    return reconcile.unexpected_keys(expected, rollup.partials(events.filter(F.col("event_id").cast("long") % 50 != 0), _click_partition(), "1 day"))


@query("SELECT 0::BIGINT AS mismatched, 0::BIGINT AS missing, 0::BIGINT AS unexpected, true AS passed")
def loadgen_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generator's stream, deduplicated and rolled up, against its truth: drift by status."""
    load = loadgen.Load()
    sent = rollup.dedup_in_window(loadgen.stream(spark, load)).withColumn("kpartition", F.pmod(F.crc32(F.col("user").cast("binary")), F.lit(12)).cast("int"))
    found = reconcile.summary(reconcile.compare(loadgen.truth(spark, load), rollup.batch_cells(sent, None, ["kpartition"])))
    return found.withColumn("passed", F.col("passed") & (F.col("matched") > 0)).drop("matched")  # how much is sent isn't known to SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Released statistics of all quarters by region: rollup and suppression in one plan."""
    return suppress.release(purchase_cells(spark, sf_dir, "quarter"), 1)
