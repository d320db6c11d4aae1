"""Operators 1, 5, 6, 7 and 9 on hand-made rows: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilstream.llm import op1_sharding, op5_chat, op6_mixing, op7_jpeg, op9_packing
from veilstream.llm.columns import flat, slices

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "wörd 123 <|endoftext|> \\### ok\n" * 20_000
ROWS = [
    (1, "one two three", "en", "a", 13), (1, "one two three", "en", "a", 13), (2, None, None, None, None), (3, "", "en", "b", 0), (None, "lost id", "de", "b", 7),
    (4, LONG, "en", "a", len(LONG)), (5, "   \t\n", "fr", "c", 5), (6, "naïve 😀 text", "fr", "c", 12), (7, "x", None, None, 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def sf(spark, docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("sf"))
    docs.write.parquet(f"{at}/documents.parquet")
    return at


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at


# Sharding.


def test_shards_keep_every_row(spark, sf, empty):
    got = op1_sharding.op1_sharding(spark, sf).collect()
    want = collections.Counter((i, n, len((t or "").encode()), None if t is None else hashlib.sha256(t.encode()).hexdigest()) for i, t, _, _, n in ROWS)
    assert collections.Counter((r["doc_id"], r["n_chars"], r["n_bytes"], r["text_sha256"]) for r in got) == want
    assert op1_sharding.op1_sharding(spark, empty).count() == 0


def test_compaction_versions_and_conflicts(spark, tmp_path):
    df = spark.range(4000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("file"), F.lit(None).cast("string").alias("bytes"))
    table = op1_sharding.ShardTable(spark, f"file://{tmp_path}/t", df.schema)
    assert table.version() == 0 and table.read().count() == 0
    for k in range(3):
        table.append(df.filter(F.col("id") % 3 == k), rows_per_shard=50)
    before = table.manifest().collect()
    target = sum(r["bytes"] for r in before) // 4
    version = table.compact_all(target_bytes=target, base_bytes=1000)
    after = table.manifest().collect()
    assert version > 3 and len(after) < len(before) / 5 and max(r["bytes"] for r in after) < 1.5 * target
    assert sorted(r["id"] for r in table.read().collect()) == list(range(4000))
    assert table.read(1).count() == df.filter("id % 3 = 0").count()  # older versions stay readable
    assert table.compact(target_bytes=target, base_bytes=1000) == version
    with pytest.raises(op1_sharding.CommitConflict):
        table._commit(1, table.manifest())
    assert table.vacuum() > 0 and table.read().count() == 4000


def test_writers_that_come_second(spark, tmp_path, monkeypatch):
    df = spark.range(300).coalesce(1)
    table, other = (op1_sharding.ShardTable(spark, f"file://{tmp_path}/t", df.schema) for _ in range(2))
    options = {"target_bytes": 1 << 20, "base_bytes": 1 << 10}
    whole, first = table._commit, []

    def beaten(by):
        """Let another writer commit between this one's look at the version and its commit, once."""
        first.append(by)
        monkeypatch.setattr(table, "_commit", lambda version, live: (first and first.pop()(), whole(version, live))[1])

    beaten(lambda: other.append(df))
    assert table.append(df, rows_per_shard=50) == 2 and table.read().count() == 600
    beaten(lambda: other.append(df))
    assert table.compact(**options) == 4 and table.read().count() == 900 and table.manifest().count() == 2
    table.append(df, rows_per_shard=50)
    beaten(lambda: other.compact(**options))
    with pytest.raises(op1_sharding.CommitConflict):
        table.compact(**options)
    assert table.read().count() == 1200 and len(list((tmp_path / "t" / "manifests").iterdir())) == table.version()


def test_tiers_hold_similar_sizes(spark, tmp_path):
    table = op1_sharding.ShardTable(spark, f"file://{tmp_path}/t", spark.range(1).schema)
    sizes = [10, 11, 12, 13, 14, 100, 110, 900, 5000]
    live = spark.createDataFrame([(f"f{i}", b, 1) for i, b in enumerate(sizes)], op1_sharding.MANIFEST)
    table.manifest = lambda version=None: live
    plan = {r["file"]: r["run"] for r in table.plan(1, 2000, 4, 4, 10).collect()}
    assert set(plan) == {"f0", "f1", "f2", "f3", "f4"} and len(set(plan.values())) == 1


# Chat formatting.

TEXTS = st.lists(st.sampled_from([*"ab \\<>\n/trun é😀", "</turn>\n", "<turn "]), max_size=12).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(TEXTS, TEXTS), min_size=1, max_size=6))
def test_assembly_is_reversible(turns):
    import pyarrow as pa

    columns = [flat(pa.array([t[k] for t in turns], pa.string())) for k in (0, 1)]
    out, at, a, b = op5_chat.assemble(*columns)
    raw = out.tobytes()
    assert list(op5_chat.turns_of(raw.decode())) == turns
    assert [op5_chat.unescape(raw[i:j].decode()) for i, j in zip(a, b, strict=True)] == [t for _, t in turns]
    assert at[-1] == len(raw)


def test_conversations(spark, empty, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</turn>\n<turn user>\nx\\"), (1, 2, "assistant", None), (2, 5, None, "é😀"), (2, None, "assistant", ""), (None, 1, "assistant", "lost")]
    rows += [(3, 1, "assistant", "same")] * 3
    spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, part int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in op5_chat.op5_chat(spark, str(tmp_path)).collect()}
    rows += [(op5_chat.OWN_ID, 0, "user", op5_chat.OWN_TEXT), (op5_chat.OWN_ID, 1, "assistant", op5_chat.OWN_TEXT)]
    low = lambda v: (v is not None, v if v is not None else 0)
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (low(r[1]), r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        said = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert set(got) == {r[0] for r in rows}
    assert [r["conv_id"] for r in op5_chat.op5_chat(spark, empty).collect()] == [op5_chat.OWN_ID]


def test_a_conversation_in_parts(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = spark.range(100).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("ß\\"), "id").alias("text"))
        parts = op5_chat.format_conversations(rows)
        assert parts.count() > 5
        got = op5_chat.read_back(parts).collect()
        said = "".join(f"ß\\{i}" for i in range(1, 100, 2))
        assert len(got) == 1 and got[0]["n_turns"] == 100 and got[0]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[0]["formatted_chars"] == sum(len(r["formatted"]) for r in parts.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# Mixing.


def test_targets_by_hand(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 5), ("d", 0)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in op6_mixing.source_targets(sizes).collect()}
    weights, caps = {"a": 5, "b": 2, "c": 1, "d": 5, None: 2}, {"a": 300, "b": 3000, "c": 30, "d": 0, None: 15}
    want: dict = {}
    rest, free = 1115.0, set(weights)
    while True:
        level = rest / sum(weights[s] for s in free)
        over = [s for s in free if level * weights[s] > caps[s]]
        if not over:
            break
        for s in over:
            want[s] = caps[s]
            rest -= caps[s]
            free.discard(s)
    want |= {s: level * weights[s] for s in free}
    assert got == pytest.approx(want)


def test_mix(spark, sf, empty, docs):
    rows = op6_mixing.op6_mixing(spark, sf).collect()
    assert len(rows) == len(ROWS) and sorted(map(tuple, rows), key=repr) == sorted(map(tuple, op6_mixing.op6_mixing(spark, sf).collect()), key=repr)
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] or not r["taken"]) and r["target"] <= 3 * r["source_size"]
    assert {r["doc_id"]: r["size"] for r in rows}[5] == 0
    assert op6_mixing.op6_mixing(spark, empty).count() == 0
    clash = docs.withColumn("size", F.lit("s")).withColumn("taken", F.lit("t")).withColumn("key", F.lit(1))
    mixed = op6_mixing.mixed_documents(clash)
    assert mixed.columns == clash.columns and mixed.count() >= 1


def test_taken_is_near_the_target(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit("word"), (F.col("id") % 17 + 1).cast("int")), " ").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    mixed = op6_mixing.mix(rows)
    for r in mixed.groupBy("source").agg(F.sum("__mix_taken").alias("t"), F.first("__mix_target").alias("g")).collect():
        assert abs(r["t"] - r["g"]) <= 17
    better = mixed.filter("__mix_target < __mix_source_size").withColumn("long", F.col("__mix_size") > 8)
    assert better.filter("__mix_taken > 0").count() > 0


@pytest.mark.parametrize("per_group", [20_000, 7])
def test_repeated_rows_at_a_threshold(spark, tmp_path, monkeypatch, per_group):
    import duckdb

    monkeypatch.setattr(op6_mixing, "TIED_ROWS", per_group)
    rows = [(7, "four words in all", "b")] * 100 + [(8, "x " * 30, "a")] * 5 + [(100 + i, "some words " * (i % 9 + 1), "c") for i in range(60)] + [(9, "twice", None)] * 2
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_mixing.op6_mixing(spark, str(tmp_path)).collect()
    taken = collections.Counter((r["doc_id"], r["taken"]) for r in got)
    for source in {r["target"]: r for r in got}.values():
        ids = {i for i, t, s in rows if s == next(s for i, _, s in rows if i == source["doc_id"])}
        assert abs(sum(r["taken"] for r in got if r["doc_id"] in ids) - source["target"]) <= 30
    assert len({n for i, n in taken if i == 7}) == 2  # some of the equal rows are taken once more than others
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = db.execute(op6_mixing.ORACLE).fetchall()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    extra = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n", F.monotonically_increasing_id())
    assert op6_mixing.mix(extra).count() == len(rows) and op6_mixing.mix(extra).columns[:4] == extra.columns


def test_given_qualities(spark):
    rows = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("ten words of text that are the same for all").alias("text"), F.concat(F.lit("s"), F.col("id") % 2).alias("source"), F.when(F.col("id") % 10 < 4, 20.0).when(F.col("id") % 10 == 9, float("nan")).otherwise(0.05).alias("q"))
    mixed = op6_mixing.mix(rows, weights=(8, 1), quality=F.col("q")).filter("source = 's1'")  # a share of a third of its size
    got = {r["q"]: r["t"] for r in mixed.groupBy("q").agg(F.avg((F.col("__mix_taken") > 0).cast("int")).alias("t")).collect()}
    assert got[20.0] > 0.5 > 5 * got[0.05]


# Media.


def test_media(spark, sf, empty):
    for r in op7_jpeg.op7_jpeg(spark, sf).collect():
        texts = [t or "" for i, t, *_ in ROWS if i == r["doc_id"]]
        raw = texts[0].encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
        assert r["height"] == len(padded) // 8 and r["feature"].startswith(f"512x{r['height']}:")
    assert op7_jpeg.op7_jpeg(spark, empty).count() == 0
    same = op7_jpeg.op7_jpeg(spark, sf).filter("doc_id = 1").collect()
    assert len(same) == 2 and same[0] == same[1]
    odd = spark.createDataFrame([(1, bytearray(b"GIF89a")), (2, None), (3, bytearray(b"\xff\xd8\xff\xd9"))], "doc_id long, media binary")
    assert [r["feature"] for r in op7_jpeg.media_features(odd).collect()] == [None] * 3


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=5))
def test_jpeg_round_trip(payloads):
    data = np.frombuffer(b"".join(payloads), np.uint8)
    at = np.cumsum([0, *map(len, payloads)])
    out, ends = op7_jpeg.encode(data, at)
    for raw, images in zip(payloads, op7_jpeg.decode_luma(out, ends), strict=True):
        got = np.concatenate([t for _, t in images]).tobytes()
        assert got[: len(raw)] == raw and not any(got[len(raw) :]) and len(got) == max(64, math.ceil(len(raw) / 64) * 64)


def test_long_payloads_are_several_images():
    data = np.random.default_rng(3).integers(0, 256, 64 * 8191 + 100).astype(np.uint8)
    (images,) = op7_jpeg.decode_luma(*op7_jpeg.encode(data, np.array([0, len(data)])))
    assert [x.height for x, _ in images] == [8 * 8191, 16] and np.concatenate([t for _, t in images]).tobytes()[: len(data)] == data.tobytes()


def build_colour(dc: list[int], chroma: list[int], ac_every: int, restart: int, width: int, height: int) -> bytes:
    """A 4:2:0 image with other tables than the encoder's, AC coefficients and optional restarts, bit by bit."""
    seg, dc_len, ac = op7_jpeg._segment, 4, {0x00: "00", 0x01: "01", 0xF0: "100", 0x32: "101"}
    out = b"\xff\xd8" + seg(0xDB, bytes([0] + [16] * 64)) + seg(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    out += seg(0xC4, bytes([0x00] + [0, 0, 0, 12] + [0] * 12) + bytes(range(12))) + seg(0xC4, bytes([0x10, 0, 2, 2] + [0] * 13) + bytes([0x00, 0x01, 0xF0, 0x32]))
    out += seg(0xDD, restart.to_bytes(2, "big")) + seg(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    mcus, bits, body, pred, n = len(dc) // 4, "", b"", [0, 0, 0], 0

    def flush(bits: str) -> bytes:
        bits += "1" * (-len(bits) % 8)
        return bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")

    for m in range(mcus):
        if restart and m and m % restart == 0:
            body += flush(bits) + bytes([0xFF, 0xD0 + n % 8])
            bits, pred, n = "", [0, 0, 0], n + 1
        for c, value in [*((0, v) for v in dc[4 * m : 4 * m + 4]), (1, chroma[2 * m]), (2, chroma[2 * m + 1])]:
            diff, pred[c] = value - pred[c], value
            s = abs(diff).bit_length()
            bits += format(s, f"0{dc_len}b") + (format(diff if diff > 0 else diff + (1 << s) - 1, f"0{s}b") if s else "")
            if m % ac_every == 0:
                bits += ac[0x01] + "1" + ac[0xF0] + ac[0x32] + "10"
            bits += ac[0x00]
    return out + body + flush(bits) + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 1, 3])
def test_decoder_reads_other_baseline_images(restart):
    rng = np.random.default_rng(restart)
    width, height = 70, 40  # 5 x 3 MCUs
    dc, chroma = rng.integers(-60, 60, 15 * 4).tolist(), rng.integers(-60, 60, 30).tolist()
    raw = build_colour(dc, chroma, 2, restart, width, height)
    own, own_at = op7_jpeg.encode(np.frombuffer(b"mixed with others", np.uint8), np.array([0, 17]))
    both = np.concatenate([own, np.frombuffer(raw, np.uint8), own])
    first, second, third = op7_jpeg.decode_luma(both, np.array([0, len(own), len(own) + len(raw), len(both)]))
    image, thumb = second[0]
    grid = np.array(dc).reshape(3, 5, 2, 2).transpose(0, 2, 1, 3).reshape(6, 10)[:5, :9]
    assert (image.width, image.height) == (width, height) and np.array_equal(thumb, np.clip(np.rint(grid * 2.0 + 128), 0, 255))
    assert first[0][1].tobytes()[:17] == b"mixed with others" == third[0][1].tobytes()[:17]


@pytest.mark.parametrize("cut", [30, 200, -3])
def test_cut_images_do_not_crash(cut):
    out, _ = op7_jpeg.encode(np.arange(200, dtype=np.uint8), np.array([0, 200]))
    broken = out[:cut]
    op7_jpeg.decode_luma(broken, np.array([0, len(broken)]))


def slow_decode(raw):
    """DC-only luminance of one baseline image, a bit at a time; (width, height, rows of samples)."""
    at, tables, quant, restart = 2, {}, {}, 0
    while True:
        marker, n = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body, at = raw[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xDB:
            quant[body[0] & 15] = body[1]
        elif marker == 0xC4:
            code, k, codes = 0, 17, {}
            for length in range(1, 17):
                for _ in range(body[length]):
                    codes[format(code, f"0{length}b")] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            tables[body[0]] = codes
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xC0:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, len(body), 3)]
        elif marker == 0xDA:
            chosen = {body[k]: body[k + 1] for k in range(1, 1 + 2 * body[0], 2)}
            break
    end = raw.index(b"\xff\xd9", at)
    lanes = [x.replace(b"\xff\x00", b"\xff") for x in re.split(rb"\xff[\xd0-\xd7]", raw[at:end])]
    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    cols, rows = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    samples = {}
    for lane, data in enumerate(lanes):
        bits, i, pred = "".join(f"{b:08b}" for b in data), 0, dict.fromkeys(chosen, 0)

        def symbol(codes):
            nonlocal i
            j = i + 1
            while bits[i:j] not in codes:
                j += 1
            out, i = codes[bits[i:j]], j
            return out

        for m in range(lane * restart, min((lane + 1) * restart, rows * cols) if restart else rows * cols):
            for cid, h, v, q in parts:
                for b in range(h * v):
                    size = symbol(tables[chosen[cid] >> 4])
                    value = int(bits[i : i + size], 2) if size else 0
                    pred[cid] += value if not size or bits[i] == "1" else value - (1 << size) + 1
                    i += size
                    k = 1
                    while k < 64:
                        s = symbol(tables[0x10 | chosen[cid] & 15])
                        i += s & 15
                        k = 64 if s == 0 else k + (s >> 4) + 1
                    if cid == parts[0][0]:
                        samples[m // cols * v + b // h, m % cols * h + b % h] = min(255, max(0, round(pred[cid] * quant[q] / 8 + 128)))
    high, wide = -(--(-height * parts[0][2] // most_v) // 8), -(--(-width * parts[0][1] // most_h) // 8)
    return width, height, [[samples[y, x] for x in range(wide)] for y in range(high)]


@pytest.mark.parametrize("restart", [0, 2])
def test_a_slow_decoder_reads_the_same(restart):
    rng = np.random.default_rng(restart + 9)
    colour = build_colour(rng.integers(-60, 60, 60).tolist(), rng.integers(-60, 60, 30).tolist(), 2, restart, 70, 40)
    own, _ = op7_jpeg.encode(rng.integers(0, 256, 1000).astype(np.uint8), np.array([0, 1000]))
    for raw in (colour, own.tobytes()):
        width, height, rows = slow_decode(raw)
        ((image, thumb),) = op7_jpeg.decode_luma(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
        assert (image.width, image.height) == (width, height) and thumb.tolist() == rows


def test_headers_that_lie(spark):
    import time

    raw = bytearray(op7_jpeg.encode(np.arange(200, dtype=np.uint8), np.array([0, 200]))[0].tobytes())
    at = raw.index(b"\xff\xc0")
    cases = [bytes(raw)]
    for place, value in ((at + 11, 0x00), (at + 11, 0x10), (at + 11, 0x01), (at + 11, 0xFF), (at + 9, 0), (at + 9, 3), (at + 12, 3), (at + 3, 1), (at + 4, 12)):
        case = bytearray(raw)
        case[place] = value
        cases.append(bytes(case))
    for side in (4096, 65535):  # more than the scan holds, without restart intervals
        case = bytearray(raw).replace(b"\xff\xdd\x00\x04\x00\x40", b"\xff\xdd\x00\x04\x00\x00")
        case[at + 5 : at + 9] = side.to_bytes(2, "big") * 2
        cases.append(bytes(case))
    taller = bytearray(raw)
    taller[at + 5 : at + 7] = (8 * 5).to_bytes(2, "big")  # a row more than there is
    cases.append(bytes(taller))
    table = raw.index(b"\xff\xc4")
    over = bytearray(raw)
    over[table + 5] = 200
    cases.append(bytes(over))
    began = time.perf_counter()
    got = op7_jpeg.decode_luma(np.frombuffer(b"".join(cases), np.uint8), np.cumsum([0, *map(len, cases)]))
    assert got[0] is not None and got[1:] == [None] * (len(cases) - 1) and time.perf_counter() - began < 5


SEEDS = [op7_jpeg.encode(np.arange(150, dtype=np.uint8), np.array([0, 150]))[0].tobytes(), build_colour([5, -9] * 30, [3, 4] * 15, 2, 3, 70, 40)]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(SEEDS), st.lists(st.tuples(st.integers(0, 700), st.integers(0, 255)), min_size=1, max_size=6), st.integers(0, 700))
def test_damaged_images_do_not_crash(raw, changes, cut):
    data = bytearray(raw)
    for place, value in changes:
        data[place % len(data)] = value
    data = bytes(data[: len(data) - cut % 20])
    both = np.frombuffer(data + SEEDS[0], np.uint8)
    first, second = op7_jpeg.decode_luma(both, np.array([0, len(data), len(both)]))
    assert second is not None and second[0][1].tobytes()[:150] == bytes(range(150))
    if first is not None:
        assert all(t.size <= 4 * len(data) for _, t in first)


def hash_brute(rows):
    high, wide = len(rows), len(rows[0])
    cut = lambda n: [(k * n // 8, max(k * n // 8 + 1, (k + 1) * n // 8)) for k in range(8)]
    cells = [sum(rows[y][x] for y in range(*ys) for x in range(*xs)) / ((ys[1] - ys[0]) * (xs[1] - xs[0])) for ys in cut(high) for xs in cut(wide)]
    mean = np.mean(np.array(cells).reshape(8, 8))
    return f"{int(''.join('1' if c > mean else '0' for c in cells), 2):016x}"


def test_features_equal_brute_force(spark, sf):
    for r in op7_jpeg.op7_jpeg(spark, sf).collect():
        raw = next((t or "") for i, t, *_ in ROWS if i == r["doc_id"]).encode()
        if len(raw) <= 64 * op7_jpeg.MAX_ROWS:
            padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
            assert r["feature"] == f"512x{len(padded) // 8}:{hash_brute([padded[i : i + 64] for i in range(0, len(padded), 64)])}"


# Packing.


def test_packing(spark, sf, empty):
    rows = op9_packing.op9_packing(spark, sf).collect()
    encoder = op9_packing.Encoder.of(op9_packing.TOKENIZER, None)
    want = collections.Counter()
    for i, text, *_ in ROWS:
        ids = [*encoder.slow.encode(text or "", add_special_tokens=False).ids, 0]
        n = -(-len(ids) // 2048)
        cuts = [0, *range(len(ids) - 2048 * (n - 1), len(ids) + 1, 2048)]
        want.update((i, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places(rows, 2048)
    assert op9_packing.op9_packing(spark, empty).count() == 0


def places(rows, capacity):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for got in by.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def best_fit(histogram, capacity):
    """Best fit decreasing, a piece at a time: into the fullest sequence that takes it, the first of several."""
    sequences = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            room, at = min(((capacity - sum(s), i) for i, s in enumerate(sequences) if capacity - sum(s) >= length), default=(0, None))
            if at is None:
                sequences.append([length])
            else:
                sequences[at].append(length)
    return sequences


@settings(max_examples=200, deadline=None)
@given(st.integers(5, 40).flatmap(lambda c: st.tuples(st.just(c), st.dictionaries(st.integers(1, c), st.integers(1, 9), min_size=1, max_size=9))))
def test_plan_is_best_fit_decreasing(case):
    capacity, histogram = case
    slots, sequences = op9_packing.plan(histogram, capacity)
    rows = []
    for length, count in histogram.items():
        table = np.array(slots[length])
        assert (np.diff(table[:, 0]) > 0).all()
        for rank in range(count):
            first, times, sequence, offset = table[np.searchsorted(table[:, 0], rank, "right") - 1]
            rows.append({"sequence_id": sequence + (rank - first) // times, "offset": offset + (rank - first) % times * length, "length": length})
    assert places(rows, capacity) == sequences
    got = collections.defaultdict(list)
    for r in rows:
        got[r["sequence_id"]].append(r["length"])
    assert collections.Counter(tuple(sorted(s)) for s in got.values()) == collections.Counter(tuple(sorted(s)) for s in best_fit(histogram, capacity))


def test_plan_by_hand_and_of_many():
    slots, sequences = op9_packing.plan({1: 1, 3: 1, 8: 1, 10: 1}, 12)
    assert sequences == 2 and slots[1][0][2] == slots[8][0][2] == slots[3][0][2] != slots[10][0][2]
    slots, sequences = op9_packing.plan(dict.fromkeys(range(1, 2049), 10**12))
    assert sum(map(len, slots.values())) < 20_000 and sequences * 2048 >= 10**12 * 2048 * 2049 // 2


def test_salted_ranks(spark, monkeypatch):
    monkeypatch.setattr(op9_packing, "GROUP_ROWS", 100)
    rows = spark.range(5000).select("id", (F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 20 + 1)).cast("long").alias("length"), F.lit("x").alias("offset"))
    got = op9_packing.pack(rows, 64)
    assert got.columns == ["id", "length", "sequence_id", "offset"]
    packed = got.collect()
    assert len(packed) == 5000 and places(packed, 64) <= math.ceil(sum(r["length"] for r in packed) / 64) + 1


def test_fast_ids_equal_the_tokenizer():
    encoder = op9_packing.Encoder.of(op9_packing.TOKENIZER, op9_packing.RANKS)
    texts = [f"{a}{chr(i)}{b}" for i in range(0x250) for a, b in (("", ""), ("a", "b"), (" ", " "), ("1", "\n"), ("'", "s"))]
    texts += [LONG[:5000], "<|endoftext|>", "x <|endoftext|> y", "漢字 かな 😀", "a" * 5000, " " * 3000]
    for text in texts:
        assert encoder.ids(text).tolist() == encoder.slow.encode(text, add_special_tokens=False).ids, repr(text[:20])


BELOW = st.characters(max_codepoint=0x24F)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(BELOW, max_size=80), st.lists(st.sampled_from(["'s", "'LL", " ", "\n", "\t ", "\x85", "\xa0", "\xad", "ñ", "ß", "12", "½", "word", "Über", "...", "<|", "_", "'"]), max_size=30).map("".join)))
def test_fast_ids_equal_the_tokenizer_on_any_string(text):
    encoder = op9_packing.Encoder.of(op9_packing.TOKENIZER, op9_packing.RANKS)
    assert encoder.ids(text).tolist() == encoder.slow.encode(text, add_special_tokens=False).ids


def test_fast_ids_equal_the_tokenizer_on_documents(spark):
    encoder = op9_packing.Encoder.of(op9_packing.TOKENIZER, op9_packing.RANKS)
    for (text,) in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect():
        assert encoder.ids(text or "").tolist() == encoder.slow.encode(text or "", add_special_tokens=False).ids


def test_slices_cover_all_rows():
    at = np.array([0, 5, 5, 105, 106, 107])
    assert list(slices(at, 10)) == [(0, 2), (2, 3), (3, 5)] and list(slices(np.array([0]), 10)) == []
