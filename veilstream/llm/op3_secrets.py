r"""Secret scans with multipart credential linking, in DataFrame operations only.

Base spans are what three patterns find on their own: assignments of secrets, access identifiers and long hex runs.
The method adds weak candidates: identifiers, secrets and endpoints that mean nothing alone. They are reported only
where complementary parts co-occur in one scope, that is between blank lines, with at most ``REACH`` code points from
the end of the one to the start of the other:

* an identifier beside a secret of any kind,
* a secret beside an identifier or an endpoint,
* an endpoint beside both an identifier and a secret.

A weak candidate wholly inside a base span is part of that; one that only overlaps it counts, and is reported, by itself.

The linking is an interval join of a text's parts with themselves; it is written as running windows over the parts'
places, so that no pair is formed and a text with many parts costs as much as it has parts. Places come from the
lengths of matches and of the gaps between them, summed up in order: the text itself is never shuffled.

Defined results: a null text counts as empty; a text without spans has counts 0, an empty ``spans`` and the digest of
the empty string. Repeated rows give repeated rows. Places are code points, ends exclusive; places in bytes go with them, and
``redact`` cuts by those, so that it passes over a text once whatever it holds. Rows are told apart by
their position in the one scan that looks for parts; ``redact`` joins the cuts with the texts by a digest of the text.
``redact`` keeps all columns, of whatever names but those that start with ``__secret_``, which are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilstream.session import materialize

REACH = 300
MARK = "[secret]"
#: Up to this many pieces between spans (about 30 bytes each) are broadcast to the texts; more are joined by shuffle.
BROADCAST_SPANS = 100_000

# Kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # of AKIA[A-Z0-9]+ the matches of 20 or more: a shorter one holds no longer one
HEX = r"[0-9a-f]{24,}"  # likewise
# Values have no upper bound, so that a span covers all of one; possessive quantifiers keep the search linear.
IDENTIFIER = r"""(?i)(?:access_?key_?id|client_?id|user(?:name|_?id)?|login|account)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9@._+-]{3,}+|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"""
SECRET = r"""(?i:pwd|pass|passphrase|credentials?|private_?key|auth)["']?\x20{0,4}[:=]\x20{0,4}["']?[^\s"',;]{6,}+|(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*+[0-9])(?=[a-z0-9+/]*+[A-Z])(?=[A-Z0-9+/]*+[a-z])[A-Za-z0-9+/]{32,}+={0,2}"""
ENDPOINT = r"""(?i:https?|ftp|sftp|jdbc:[a-z]{1,16}|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]{3,}+|(?i:host(?:name)?|endpoint|server)["']?\x20{0,4}[:=]\x20{0,4}["']?[A-Za-z0-9.-]{3,}+(?::[0-9]{1,5})?|(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?::[0-9]{1,5})?(?![0-9]|\.[0-9])"""
BLANK = r"\n[\x20\t\r]{0,64}\n"
PATTERNS = (ASSIGN, ACCESS, HEX, IDENTIFIER, SECRET, ENDPOINT)
BREAK, NOTHING = 6, 7


def _parts(text: Column, kind: int, pattern: str, good: Column | None = None) -> Column:
    """Array of (kind, nth, gap, size, gap_bytes, size_bytes, good) of the matches: the gap before each and its size."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    fine = (lambda m: F.lit(True)) if good is None else good
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.length(g).alias("gap"), F.octet_length(g).alias("gap_bytes")))
    zipped = F.zip_with(
        matches, gaps, lambda m, g: F.struct(g["gap"].alias("gap"), F.length(m).alias("size"), g["gap_bytes"].alias("gap_bytes"), F.octet_length(m).alias("size_bytes"), fine(m).alias("good"), m.isNotNull().alias("is"))
    )
    lengths = lambda z: [z[n].cast("long").alias(n) for n in LENGTHS]
    rows = F.transform(F.filter(zipped, lambda z: z["is"]), lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), *lengths(z), z["good"].alias("good")))
    return F.when(F.regexp_instr(text, F.lit(pattern)) > 0, rows).otherwise(F.array().cast(rows_type()))


LENGTHS = ("gap", "size", "gap_bytes", "size_bytes")


def rows_type() -> str:
    return "array<struct<kind:int,nth:int,gap:bigint,size:bigint,gap_bytes:bigint,size_bytes:bigint,good:boolean>>"


def _reported(docs: DataFrame, doc_id: Column, text: str, reach: int) -> DataFrame:
    """(place, doc_id, kind, start, stop, from_byte, to_byte, reported) of all parts, and one row of kind ``NOTHING`` for each text."""
    rows = docs.select(F.monotonically_increasing_id().alias("place"), doc_id.alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    value = F.col("text")
    found = [_parts(value, k, p, (lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6) if k == 0 else None) for k, p in enumerate(PATTERNS)]
    rows = rows.select("place", "doc_id", "text", F.concat(*found[:3]).alias("base"), F.concat(*found[3:]).alias("weak"))
    breaks = F.when(F.size("weak") > 0, _parts(value, BREAK, BLANK)).otherwise(F.array().cast(rows_type()))
    none = F.array(F.struct(F.lit(NOTHING).alias("kind"), F.lit(0).alias("nth"), *[F.lit(0).cast("long").alias(n) for n in LENGTHS], F.lit(False).alias("good")))
    parts = rows.select("place", "doc_id", F.explode(F.concat("base", "weak", breaks, none)).alias("part")).select("place", "doc_id", "part.*")

    parts = parts.repartition("place")  # all windows and the aggregations keep to this
    in_order = Window.partitionBy("place", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    upto = lambda gap, size: F.sum(F.col(gap) + F.col(size)).over(in_order)
    parts = parts.withColumns({"stop": upto("gap", "size"), "to_byte": upto("gap_bytes", "size_bytes")})
    parts = parts.withColumns({"start": F.col("stop") - F.col("size"), "from_byte": F.col("to_byte") - F.col("size_bytes")})
    before = Window.partitionBy("place").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    kind, is_base = F.col("kind"), (F.col("kind") < 3) & F.col("good")
    parts = parts.select(
        "*", F.sum(F.when(kind == BREAK, 1).otherwise(0)).over(before).alias("scope"),
        F.max(F.when(is_base, F.col("stop"))).over(before).alias("base_before"),
    )
    covered = F.coalesce(F.col("base_before"), F.lit(-1)) >= F.col("stop")  # wholly inside a base span; else it counts beside it
    parts = parts.withColumn("weak", (kind >= 3) & (kind < BREAK) & ~covered)
    earlier = Window.partitionBy("place", "scope").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("place", "scope").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)

    def beside(*kinds: int) -> Column:
        """Is the gap to the nearest part of these kinds, before or after, at most ``reach``? Negative gaps are overlaps."""
        one = (is_base | F.col("weak")) & kind.isin(*kinds)
        behind = F.col("start") - F.max(F.when(one, F.col("stop"))).over(earlier) <= reach
        ahead = F.min(F.when(one, F.col("start"))).over(later) - F.col("stop") <= reach
        return F.coalesce(behind, F.lit(False)) | F.coalesce(ahead, F.lit(False))

    parts = parts.select("*", beside(1, 3).alias("by_id"), beside(0, 2, 4).alias("by_secret"), beside(5).alias("by_endpoint"))
    linked = F.col("weak") & F.when(kind == 3, F.col("by_secret")).when(kind == 4, F.col("by_id") | F.col("by_endpoint")).otherwise(F.col("by_id") & F.col("by_secret"))
    return parts.select("place", "doc_id", "kind", "start", "stop", "from_byte", "to_byte", (is_base | linked).alias("reported"))


def secret_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """(place, doc_id, spans) of every row; spans: array of (start, kind, stop), sorted, base and linked ones."""
    span = F.when(F.col("reported"), F.struct("start", "kind", "stop"))
    return _reported(docs, F.col(doc_id), text, reach).groupBy("place", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def _cuts(spans: DataFrame) -> DataFrame:
    """(key, from_byte, to_byte) of spans to (key, kept): what lies between spans, as an array of (at, bytes), one more than there are spans.

    Spans that overlap are one; ``bytes`` of the last is null, as it goes to the end of the text.
    """
    return spans.sparkSession.sql(
        """
        WITH once AS (SELECT DISTINCT key, from_byte, to_byte FROM {spans}),
        reached AS (SELECT *, max(to_byte) OVER (PARTITION BY key ORDER BY from_byte, to_byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM once),
        dealt AS (SELECT *, count_if(before IS NULL OR from_byte >= before) OVER (PARTITION BY key ORDER BY from_byte, to_byte ROWS UNBOUNDED PRECEDING) AS nth FROM reached),
        joined AS (SELECT key, nth, min(from_byte) AS from_byte, max(to_byte) AS to_byte FROM dealt GROUP BY key, nth),
        gaps AS (SELECT key, struct(coalesce(lag(to_byte) OVER w, 0L) AS at, from_byte - coalesce(lag(to_byte) OVER w, 0L) AS bytes) AS gap, to_byte FROM joined WINDOW w AS (PARTITION BY key ORDER BY nth))
        SELECT key, concat(array_sort(collect_list(gap)), array(struct(max(to_byte) AS at, CAST(NULL AS BIGINT) AS bytes))) AS kept FROM gaps GROUP BY key""",
        spans=spans,
    )


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = MARK) -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; texts without spans and nulls stay as they are."""
    key = F.unhex(F.sha2(F.col(text).cast("binary"), 256))  # spans depend on the text alone; a second scan may number rows differently
    spans = _reported(docs.select(text), F.unhex(F.sha2(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"), 256)), text, REACH).filter("reported")
    kept = materialize(_cuts(spans.withColumnRenamed("doc_id", "key")).select(F.col("key").alias("__secret_key"), F.col("kept").alias("__secret_kept")), "cuts")
    few = (kept.agg(F.sum(F.size("__secret_kept"))).first()[0] or 0) <= BROADCAST_SPANS
    rows = docs.withColumn("__secret_key", key).join(F.broadcast(kept) if few else kept, "__secret_key", "left")
    value = F.col(text)

    def piece(raw: Column, gap: Column) -> Column:
        return F.substring(raw, (gap["at"] + 1).cast("int"), F.coalesce(gap["bytes"], F.octet_length(raw)).cast("int")).cast("string")

    # The text is bound once as the one element of an array; bytes are cut by place, without looking for code points.
    clean = F.element_at(F.transform(F.array(value.cast("binary")), lambda raw: F.array_join(F.transform(F.col("__secret_kept"), lambda gap: piece(raw, gap)), mark)), 1)
    return rows.withColumn(text, F.when(F.col("__secret_kept").isNull(), value).otherwise(clean)).select(*[F.col(f"`{c}`") for c in docs.columns])


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and linked spans of every document."""
    found = secret_spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_named(base).cast("binary"), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"),
    )


QUERIES = {"op3_secrets": op3_secrets}
