import datetime as dt
import hashlib
import hmac
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilstream.functions import dp, hll
from veilstream.functions.pseudonym import SALT_VARIABLE, pseudonymize, pseudonymize_secret
from veilstream.functions.scalar import family_for_wiki, is_blank, is_kind, kpartition, saturating_minus, window_end, window_start
from veilstream.plans.model import Settings

FAMILIES = {
    "enwiki": "wikipedia", "knwiki": "wikipedia", "enwiktionary": "wiktionary", "wikidatawiki": "wikidata", "commonswiki": "commons", "specieswiki": "wikispecies",
    "mediawikiwiki": "mediawiki", "frwikinews": "wikinews", "dewikibooks": "wikibooks", "itwikiquote": "wikiquote", "plwikisource": "wikisource",
    "enwikiversity": "wikiversity", "dewikivoyage": "wikivoyage", "totally-unknown": "other", "": "other",
}


def test_families(spark):
    rows = spark.createDataFrame([(w,) for w in [*FAMILIES, None]], "w string").select("w", family_for_wiki(F.col("w")).alias("f")).collect()
    assert {r["w"]: r["f"] for r in rows} == FAMILIES | {None: None}


def test_kinds_and_blanks(spark):
    rows = spark.createDataFrame([("edit",), ("Edit",), ("wat",), (None,)], "k string").select(is_kind(F.col("k"))).collect()
    assert [r[0] for r in rows] == [True, False, False, False]
    rows = spark.createDataFrame([("",), (" \t\n",), ("  ",), (" a ",)], "t string").select(is_blank(F.col("t"))).collect()
    assert [r[0] for r in rows] == [True, True, True, False]


@pytest.mark.parametrize("ts,start", [("2026-09-23 10:15:47", "10:15:00"), ("2026-09-23 10:15:00", "10:15:00"), ("1969-12-31 23:59:59", "23:59:00")])
def test_windows(spark, ts, start):
    row = spark.sql(f"SELECT TIMESTAMP_NTZ '{ts}' AS ts").select(window_start(F.col("ts")).alias("s")).withColumn("e", window_end(F.col("s"))).first()
    assert row["s"].strftime("%H:%M:%S") == start and row["e"] - row["s"] == dt.timedelta(seconds=60)


@pytest.mark.parametrize("salt", ["salt1", "salt2", "s" * 64, "long" * 40])
def test_pseudonyms_are_hmac(spark, salt):
    users = ["Alice", "Bob", "Zoë", "利用者", ""]
    rows = spark.createDataFrame([(u,) for u in users], "u string").select("u", pseudonymize(F.col("u"), salt).alias("p")).collect()
    assert {r["u"]: r["p"] for r in rows} == {u: hmac.new(salt.encode(), u.encode(), hashlib.sha256).hexdigest() for u in users}


def test_secret_salt_is_not_in_the_plan(spark):
    os.environ[SALT_VARIABLE] = "very-secret"
    df = spark.createDataFrame([("Alice",), (None,)], "u string").select(pseudonymize_secret(F.col("u")).alias("p"))
    assert "very-secret" not in df._jdf.queryExecution().toString()


def test_partition_depends_on_user_alone(spark):
    import zlib

    rows = spark.createDataFrame([("Alice",), ("Zoë",), (None,)], "u string").select("u", kpartition(F.col("u")).alias("k")).collect()
    assert {r["u"]: r["k"] for r in rows} == {"Alice": zlib.crc32(b"Alice") % 12, "Zoë": zlib.crc32("Zoë".encode()) % 12, None: zlib.crc32(b"") % 12}


def test_saturating_minus(spark):
    assert spark.range(1).select(saturating_minus(F.lit(3), F.lit(5)), saturating_minus(F.lit(5), F.lit(3))).first() == (0, 2)


@pytest.mark.parametrize("n,want", [(100, 99.2), (1000, 1009.9), (10_000, 9892.4)])
def test_hll_estimates(spark, n, want):
    users = spark.range(n).select(F.concat(F.lit("user-"), F.col("id").cast("string")).alias("user"), F.lit(1).alias("one"))
    assert hll.estimate(hll.registers(users, ["one"]), ["one"]).first()["estimate"] == pytest.approx(want, abs=0.05)


def test_hll_union_and_bytes(spark):
    user = lambda a, b, g: spark.range(a, b).select(F.concat(F.lit("user-"), F.col("id").cast("string")).alias("user"), F.lit(g).alias("g"), F.lit(1).alias("one"))
    both = hll.registers(user(0, 5000, "a").unionByName(user(2000, 7000, "b")), ["g", "one"])
    merged = hll.estimate(hll.merge(both, ["one"]), ["one"]).first()["estimate"]
    assert abs(merged - 7000) < 700
    stored = hll.to_bytes(both, ["g", "one"])
    assert {len(r["users_hll"]) for r in stored.collect()} == {4097} and hll.memory_bytes() == 4096
    again = hll.from_bytes(stored, ["g", "one"])
    assert sorted(again.select("g", "idx", "rho").collect()) == sorted(both.select("g", "idx", "rho").collect())
    broken = spark.createDataFrame([(1, None), (1, bytearray(b"\x0c123"))], "one int, users_hll binary")
    assert hll.from_bytes(broken, ["one"]).count() == 0


def test_hll_precision_bounds(spark):
    with pytest.raises(ValueError):
        hll.register(F.lit(1), 3)


def test_laplace_mean_variance_and_sign(spark):
    draw = lambda v, eps, n, seed: np.array([r[0] for r in spark.range(n).select(dp.noisy_count(F.lit(v), dp.sample_laplace(1 / eps, seed))).collect()])
    assert abs(draw(1000, 1.0, 20_000, 1).mean() - 1000) < 20
    assert draw(1000, 0.1, 5000, 2).var() > draw(1000, 5.0, 5000, 3).var()
    assert draw(2, 0.05, 2000, 4).min() >= 0


def test_noise_is_the_same_when_asked_again(spark):
    cells = spark.createDataFrame([("a", 50), ("b", 60)], "family string, users long")
    one, two = (sorted(map(tuple, dp.noisy_users(cells, ["family"], "s", 0.3).collect())) for _ in range(2))
    assert one == two and one != sorted(map(tuple, dp.noisy_users(cells, ["family"], "t", 0.3).collect()))
    with pytest.raises(ValueError):
        dp.noisy_users(cells, ["family"], "s", 0.0)
    assert dp.noisy_users(cells, ["family"], "s", 1.0, enabled=False) is cells


def test_settings():
    env = {"PRIVACY_K": "7", "DP_ENABLED": "true", "DP_EPSILON": "x", "HLL_ENABLED": "maybe", "PSEUDONYM_SALT": "s"}
    got = Settings.load(env, ("pseudonym_salt",))
    assert (got.privacy_k, got.dp_enabled, got.dp_epsilon, got.hll_enabled) == (7, True, 1.0, False)
    with pytest.raises(KeyError):
        Settings.load({}, ("pseudonym_salt",))
