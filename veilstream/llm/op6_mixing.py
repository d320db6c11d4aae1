"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame operations only.

A document's size is its number of words. Every source gets a target by water filling: sources share the total
by weight, a target stops at ``cap`` times the source's size, and the excess is shared again by weight. A source
takes ``floor(target / size)`` complete epochs of all its documents; the rest of its target is filled by weighted
sampling without replacement. The sampling key is ``-ln(u) / quality`` with ``u`` from a hash of seed, id and
text, so reruns agree. Keys are sorted within the source and prefix-summed to the rest of the target.

``quality`` is any column of positive weights, such as a model's scores; without one, ``quality_of`` weighs a text
by how far it looks like prose: length of words, share of digits and symbols, and whether there is more than a line of it.

No task sorts a whole source: keys are cut into ``RANGES`` ranges by a monotone function and words are summed for each
(source, range); the one range that holds the boundary is cut again, ``DEPTH`` times in all, and only the distinct keys
that are left are sorted, with the number of rows of each. What comes out is a threshold per source, and how many rows of the
very key of the threshold are taken; the final pass is a map over the documents with the table of sources. Rows that repeat
in id and text share a key: where the threshold falls among them, these rows alone are written, ranked in salted groups, and
as many taken as fit.

Defined results: a null or empty text has size 0 and is never taken. A null source is a source of its own, the last
one. Of rows that repeat in id and text at a threshold, the first in the order of their places are taken. A quality that is
null, not a number, not positive or infinite counts as 1. An empty table gives an empty
result. Further columns pass through ``mix``; names that start with ``__mix_`` are reserved.

The weights go by the rank of a source, so windows run over the table of sources, one row each, in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilstream.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: Characters that prose has few of, and the words of a line.
ODD, LINE_WORDS = "0123456789#$%&*+/<=>@[]^_`{|}~", 12
RANGES, DEPTH = 64, 3
#: Tables of sources up to this many rows are broadcast (about 100 bytes a row); larger ones are joined by shuffle.
BROADCAST_SOURCES = 20_000
#: Rows that a salted group of repeated rows holds on average at most.
TIED_ROWS = 20_000


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def quality_of(text: Column, size: Column) -> Column:
    """Weight in (0, 1]: highest for prose of a line or more with words of five characters; 1 for texts without words."""
    value = F.coalesce(text, F.lit(""))
    chars = F.length(value).cast("double")
    words = F.lit(1.0) / (F.lit(1.0) + F.abs(chars / F.greatest(size, F.lit(1)).cast("double") - F.lit(6.0)))
    plain = F.length(F.translate(value, ODD, "")).cast("double") / F.greatest(chars, F.lit(1.0))
    line = F.least(F.lit(1.0), (size.cast("double") + F.lit(1.0)) / F.lit(float(LINE_WORDS)))
    return F.when(size == 0, F.lit(1.0)).otherwise(F.greatest(words * plain * line, F.lit(0.001)))


def key_of(doc_id: Column, text: Column, quality: Column, seed: str) -> Column:
    """Exponential key: the smaller, the earlier. ``u`` is 52 bits of a hash, never 0 or 1."""
    text_id = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")), text_id))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)
    return -F.log(u) / quality


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target). One row per source: the windows are over that table."""
    w = "CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {} {} END".format(len(weights), " ".join(f"WHEN {i} THEN {x}L" for i, x in enumerate(weights)))
    return sizes.sparkSession.sql(
        f"""
        WITH weighed AS (SELECT source, source_size, {w} AS w FROM {{sizes}}),
        ranked AS (
          SELECT *, {cap} * source_size AS cap,
            row_number() OVER (ORDER BY {cap} * source_size / w, source ASC NULLS LAST) AS place,
            sum(w) OVER () AS all_w, sum(source_size) OVER () AS total FROM weighed),
        before AS (
          SELECT *, coalesce(sum(cap) OVER p, 0) AS cap_before, coalesce(sum(w) OVER p, 0) AS w_before FROM ranked
          WINDOW p AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        capped AS (SELECT *, cap * (all_w - w_before) <= w * (total - cap_before) AS full FROM before),
        left_over AS (
          SELECT *, total - coalesce(sum(CASE WHEN full THEN cap END) OVER (), 0) AS rest,
            all_w - coalesce(sum(CASE WHEN full THEN w END) OVER (), 0) AS rest_w FROM capped)
        SELECT source, source_size,
          CASE WHEN full THEN CAST(cap AS DOUBLE) ELSE CAST(w * rest AS DOUBLE) / CAST(rest_w AS DOUBLE) END AS target
        FROM left_over""",
        sizes=sizes,
    )


def thresholds(keyed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, size, key) and targets to (source, source_size, target, epochs, last_key): what the mix takes."""
    spark = keyed.sparkSession
    levels = []
    for n in range(1, DEPTH + 1):  # at most RANGES sums a source; the range with sum before < rest <= sum up to it is the next to be cut
        finer = RANGES ** (DEPTH - n)
        levels.append(f"""
        sums{n} AS (
          SELECT c.source, e.ahead, e.rest, c.bucket div {finer} AS bucket, sum(c.size) AS words
          FROM cut c JOIN edge{n - 1} e ON c.source <=> e.source AND c.bucket div {finer * RANGES} = e.bucket GROUP BY ALL),
        run{n} AS (
          SELECT *, ahead + coalesce(sum(words) OVER (PARTITION BY source ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sums{n}),
        edge{n} AS (SELECT source, bucket, before AS ahead, rest FROM run{n} WHERE before < rest AND rest <= before + words)""")
    return spark.sql(
        f"""
        WITH goal AS (
          SELECT *, CASE WHEN source_size = 0 THEN 0L ELSE CAST(floor(target / source_size) AS BIGINT) END AS epochs FROM {{targets}}),
        goals AS (SELECT *, target - epochs * source_size AS rest FROM goal),
        cut AS (SELECT source, size, key, CAST(floor({RANGES**DEPTH} * (key / (1 + key))) AS BIGINT) AS bucket FROM {{keyed}} WHERE size > 0),
        edge0 AS (SELECT source, 0L AS bucket, 0L AS ahead, rest FROM goals WHERE rest > 0),
        {", ".join(levels)},
        ties AS (
          SELECT e.source, e.rest, e.ahead, c.key, count(*) AS n, sum(c.size) AS words
          FROM cut c JOIN edge{DEPTH} e ON c.source <=> e.source AND c.bucket = e.bucket GROUP BY ALL),
        fine AS (SELECT *, ahead + sum(words) OVER (PARTITION BY source ORDER BY key ROWS UNBOUNDED PRECEDING) - words AS before, words / n AS size FROM ties),
        whole AS (SELECT *, greatest(0D, least(CAST(n AS DOUBLE), floor((rest - before) / size))) AS full FROM fine),
        counted AS (
          SELECT *, CAST(full AS BIGINT) + CASE WHEN full < n AND before + full * size < rest AND before + (full + 1) * size - rest < rest - (before + full * size) THEN 1 ELSE 0 END AS rows
          FROM whole),
        chosen AS (
          SELECT source, max(CASE WHEN rows > 0 THEN struct(key, rows, n) END) AS last, min(key) AS first_key FROM counted GROUP BY source)
        SELECT g.source, g.source_size, g.target, g.epochs,
          CASE WHEN c.first_key IS NULL THEN NULL ELSE coalesce(c.last.key, c.first_key - 1e-12 * c.first_key) END AS last_key,
          coalesce(c.last.rows, 0L) AS last_rows, coalesce(c.last.rows < c.last.n, false) AS split
        FROM goals g LEFT JOIN chosen c ON g.source <=> c.source""",
        keyed=keyed,
        targets=targets,
    )


def _with_sources(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Join the table of sources to rows; broadcast only where its size is checked. Both sides carry ``__mix_source``."""
    bounded = table.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(table) if bounded else table, rows["__mix_source"].eqNullSafe(table["__mix_key_source"]), "inner").drop("__mix_key_source")


def _ranked(tied: DataFrame) -> DataFrame:
    """Rows of one key a source, with __mix_rank within the source, from 1. Written first, so that places stay what they are."""
    rows = materialize(tied.withColumn("__mix_place", F.monotonically_increasing_id()), "mix-ties")
    salts = F.lit(1 + rows.count() // TIED_ROWS)
    salted = rows.withColumn("__mix_salt", F.pmod(F.xxhash64("__mix_place"), salts))
    before = Window.partitionBy("__mix_source").orderBy("__mix_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = salted.groupBy("__mix_source", "__mix_salt").agg(F.count("*").alias("n")).select(
        F.col("__mix_source").alias("__mix_shift_source"), F.col("__mix_salt").alias("__mix_shift_salt"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__mix_shift")
    )
    inside = F.row_number().over(Window.partitionBy("__mix_source", "__mix_salt").orderBy("__mix_place"))
    same = F.col("__mix_source").eqNullSafe(F.col("__mix_shift_source")) & (F.col("__mix_salt") == F.col("__mix_shift_salt"))
    ranked = salted.withColumn("__mix_rank", inside).join(shift, same).withColumn("__mix_rank", F.col("__mix_rank") + F.col("__mix_shift"))
    return ranked.drop("__mix_place", "__mix_salt", "__mix_shift_source", "__mix_shift_salt", "__mix_shift")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED, quality: Column | None = None) -> DataFrame:
    """Documents with what the mix takes of each: all columns of ``docs`` and __mix_size, __mix_source_size, __mix_target, __mix_taken."""
    size = size_of(F.col(text))
    sized = docs.withColumn("__mix_source", F.col(source)).withColumn("__mix_size", size)
    given = quality_of(F.col(text), F.col("__mix_size")) if quality is None else quality.cast("double")
    weight = given if quality is None else F.when((given > 0) & (given < float("inf")), given).otherwise(F.lit(1.0))
    keyed = sized.withColumn("__mix_key", key_of(F.col(doc_id), F.col(text), weight, seed))
    small = materialize(keyed.select(F.col("__mix_source").alias("source"), F.col("__mix_size").alias("size"), F.col("__mix_key").alias("key")), "mix")
    targets = materialize(source_targets(small.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap), "mix-targets")
    table = materialize(thresholds(small, targets), "mix-table").select(
        F.col("source").alias("__mix_key_source"), F.col("source_size").alias("__mix_source_size"), F.col("target").alias("__mix_target"),
        F.col("epochs").alias("__mix_epochs"), F.col("last_key").alias("__mix_last"), F.col("last_rows").alias("__mix_rows"), F.col("split").alias("__mix_split"),
    )
    rows = _with_sources(keyed, table).withColumn("__mix_rank", F.lit(0).cast("long"))
    tied = F.col("__mix_split") & (F.col("__mix_size") > 0) & F.coalesce(F.col("__mix_key") == F.col("__mix_last"), F.lit(False))
    if not table.filter("__mix_split").isEmpty():  # repeated rows at a threshold: which of them are taken goes by rank
        rows = rows.filter(~tied).unionByName(_ranked(rows.filter(tied).drop("__mix_rank")))
    in_ = (F.col("__mix_key") < F.col("__mix_last")) | ((F.col("__mix_key") == F.col("__mix_last")) & (F.col("__mix_rank") <= F.col("__mix_rows")))
    taken = F.col("__mix_epochs") * F.col("__mix_size") + F.when(in_, F.col("__mix_size")).otherwise(F.lit(0))
    return rows.withColumn("__mix_taken", taken.cast("long")).drop("__mix_source", "__mix_key", "__mix_epochs", "__mix_last", "__mix_rows", "__mix_split", "__mix_rank")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document repeated as often as it is taken, with the columns of ``docs``."""
    names = docs.columns
    repeated = mix(docs, **options).withColumn("__mix_times", (F.col("__mix_taken") / F.greatest(F.col("__mix_size"), F.lit(1))).cast("int"))
    return repeated.filter("__mix_times > 0").select(*[F.col(f"`{c}`") for c in names], F.explode(F.sequence(F.lit(1), F.col("__mix_times"))).alias("__mix_copy")).drop("__mix_copy")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with size, source_size, target and taken."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), F.col("__mix_taken").alias("taken"))


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
keyed AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(text)), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / CASE WHEN size = 0 THEN 1.0::DOUBLE ELSE greatest(1.0::DOUBLE / (1.0::DOUBLE + abs(length(text)::DOUBLE / greatest(size, 1)::DOUBLE - 6.0::DOUBLE))
      * (length(translate(text, '{ODD}', ''))::DOUBLE / greatest(length(text), 1)::DOUBLE) * least(1.0::DOUBLE, (size::DOUBLE + 1.0::DOUBLE) / {LINE_WORDS}.0::DOUBLE), 0.001::DOUBLE) END AS key
  FROM sized),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS w FROM sizes),
ranked AS (
  SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY 3 * source_size::DOUBLE / w, source ASC NULLS LAST) AS place,
    sum(w) OVER () AS all_w, sum(source_size) OVER () AS total FROM weighed),
before AS (
  SELECT *, coalesce(sum(cap) OVER p, 0) AS cap_before, coalesce(sum(w) OVER p, 0) AS w_before FROM ranked
  WINDOW p AS (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, cap * (all_w - w_before) <= w * (total - cap_before) AS is_full FROM before),
left_over AS (
  SELECT *, total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0) AS rest,
    all_w - coalesce(sum(CASE WHEN is_full THEN w END) OVER (), 0) AS rest_w FROM capped),
targets AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE (w * rest)::DOUBLE / rest_w::DOUBLE END AS target FROM left_over),
goals AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS epochs FROM targets),
summed AS (
  SELECT k.*, g.source_size, g.target, g.epochs, g.target - g.epochs * g.source_size AS rest,
    sum(size) OVER (PARTITION BY k.source ORDER BY key ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (epochs * size + CASE WHEN upto <= rest OR (upto - size < rest AND upto - rest < rest - (upto - size)) THEN size ELSE 0 END)::BIGINT AS taken
FROM summed"""

QUERIES = {"op6_mixing": op6_mixing}
ORACLES = {"op6_mixing": ORACLE}
