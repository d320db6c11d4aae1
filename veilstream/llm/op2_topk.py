"""Exact top-k search by inner product with MaxScore over signed integer vectors.

A vector's dimensions are terms, its integer components their weights: component x becomes floor(64 * x). Rows are dealt
into shards of about ``SHARD_ROWS`` by their strongest term and its sign, so that a shard's bounds tell it from others; rows
with components so large that products leave the type of the others have shards of their own.

1. Every shard answers the queries among its own rows. That gives a query its threshold, the k-th best exact score so
   far, and every shard its bounds: the largest and smallest weight of each term.
2. A query goes on to a shard only if the sum of its terms' bounds there reaches its threshold. What can't compete is
   dropped before anything is shuffled.
3. What is left goes to the shards in blocks of ``BLOCK_ROWS`` queries; each (shard, block) is one group, and a merge of
   the answers keeps the k best of all.

In a shard, a term's bound is the largest contribution that any row gets from it. The threshold is what the query brings, or
the k-th best of seeds, the rows with the largest weights of the strongest terms. Terms are taken by falling
bound; the essential ones are the shortest head of that order such that the positive bounds of all others together
stay below the threshold, so a row that gains nothing from essential terms can't reach it. Essential postings are
traversed term-wise for the whole shard; the others are probed in groups for the rows whose partial score
plus the remaining bounds still reaches the threshold. A row equal to the threshold is kept, for ties.

Defined results: vectors that are null or hold null, NaN or infinite components take no part; missing dimensions of
shorter vectors count as 0. Ties go to the smaller id, null ids last. A row is no candidate for itself alone: rows that
repeat are told apart by position. Finite components of any size are exact; scores beyond 64 bits are held at the ends of
that range, and tie there. Fewer than k candidates give fewer rows; an empty table none. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilstream.session import materialize

K, SCALE, QUERY_EVERY = 20, 64.0, 20
LEAST, MOST = -(2**63), 2**63 - 1
SHARD_ROWS, BLOCK_ROWS, PROBE_TERMS, SEED_TERMS, SEED_ROWS = 16384, 16384, 8, 4, 32
#: Bounds of shards are broadcast up to this size; beyond it every query goes to every shard, with the same result.
BOUND_BYTES = 64 << 20


def integers(column: pa.Array) -> np.ndarray:
    """Rows by terms, floor(64 * x); whole numbers as objects where 64 * x has no floating-point number."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0))
    offsets = np.asarray(column.offsets)
    raw = np.asarray(column.values)[offsets[0] : offsets[-1]].astype(np.float64)
    with np.errstate(over="ignore"):
        values = np.floor(SCALE * raw)
    if not np.isfinite(values).all():
        values = np.array([int(v) if np.isfinite(v) else int(SCALE) * int(x) for v, x in zip(values, raw, strict=True)], object)
    lengths = np.diff(offsets)
    out = np.zeros((len(column), int(lengths.max(initial=0))), values.dtype)
    out[np.arange(out.shape[1]) < lengths[:, None]] = values
    return out


def _typed(rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with the same terms, in the narrowest type in which sums of products are exact integers."""
    wide = max(rows.shape[1], queries.shape[1])
    rows, queries = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (rows, queries))
    largest = lambda x: max(1, int(np.abs(x).max(initial=0)))
    most = largest(rows) * largest(queries) * max(1, wide)
    for bits, kind in ((24, np.float32), (53, np.float64), (62, np.int64)):
        if most < 2**bits:
            return rows.astype(kind), queries.astype(kind)
    whole = lambda x: np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)
    return whole(rows), whole(queries)


def _best(scores: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best of 64-bit scores; ties to the smaller rank in ``order``."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= edge)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((order[some], ~scores[some]))][:k]


class Shard:
    """Postings of a shard, term-wise, and for each term the rows with its largest and smallest weights."""

    def __init__(self, rows: np.ndarray, ids: list, positions: np.ndarray):
        self.terms = np.ascontiguousarray(rows.T)
        self.rows, self.positions = rows, positions
        rank = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0, positions[i]))
        self.order = np.empty(len(ids), np.int64)
        self.order[rank] = np.arange(len(ids))
        self.high, self.low = rows.max(0), rows.min(0)
        n = min(SEED_ROWS, len(rows))
        by_weight = np.argsort(self.terms, axis=1, kind="stable") if rows.shape[1] else np.zeros((0, n), np.int64)
        self.tops, self.bottoms = by_weight[:, -n:], by_weight[:, :n]

    def search(self, query: np.ndarray, own: int, k: int, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, scores) of the k best rows, exactly, or of those among them that reach ``least``; ``own`` is the query's position."""
        bound = np.maximum(np.maximum(query * self.high, query * self.low), 0)
        by_bound = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[by_bound][::-1])[::-1], 0).astype(bound.dtype)
        seeds = np.unique(np.concatenate([np.arange(min(k + 1, len(self.rows))), *((self.tops if query[t] > 0 else self.bottoms)[t] for t in by_bound[:SEED_TERMS])]).astype(np.int64))
        seeds = seeds[self.positions[seeds] != own]
        first = self.rows[seeds] @ query
        if len(first) >= k:
            reached = int(np.sort(first)[-k])
            least = reached if least is None else max(least, reached)
        if least is not None:  # scores tie at the ends of 64 bits, so nothing can be left out at the lower end
            least = None if least <= LEAST else min(least, MOST)
        essential = len(by_bound) if least is None or not (rest < least).any() else int(np.argmax(rest < least))
        chosen = by_bound[:essential]
        partial = query[chosen] @ self.terms[chosen] if essential else np.zeros(len(self.rows), self.rows.dtype)
        others = self.positions != own
        live = np.flatnonzero(others) if least is None else np.flatnonzero((partial + rest[essential] >= least) & others)
        partial, at = partial[live], essential
        while at < len(by_bound):
            probed = by_bound[at : at + PROBE_TERMS]
            partial = partial + self.terms[probed][:, live].T @ query[probed]
            at += len(probed)
            if least is not None:
                on = partial + rest[at] >= least
                live, partial = live[on], partial[on]
        if partial.dtype == object:
            partial = np.array([max(LEAST, min(MOST, int(s))) for s in partial], np.int64)
        partial = partial.astype(np.int64)
        best = _best(partial, self.order[live], k)
        return live[best], partial[best]


def reachable(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Queries by shards: the largest score that any row of the shard can have, or a little more."""
    with np.errstate(over="ignore", invalid="ignore"):
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        bound = up @ high.T + down @ low.T
        size = up @ np.abs(high).T - down @ np.abs(low).T
        return np.nan_to_num(bound + 1e-9 * size, nan=np.inf, posinf=np.inf, neginf=np.inf)


def _deal(rows: DataFrame, shard_rows: int) -> tuple[DataFrame, int]:
    """Rows with their shard, and the number of shards. Groups of one strongest term share a shard, or have several."""
    groups = rows.groupBy("tier", "lead").agg(F.count("*").alias("n")).collect()  # at most two a term and tier
    table, shard, room, last = [], -1, 0, None
    for g in sorted(groups, key=lambda g: (g["tier"], g["lead"])):
        parts = -(-g["n"] // shard_rows)
        if parts > 1 or g["n"] > room or g["tier"] != last:
            table.append((g["tier"], g["lead"], shard + 1, parts))
            shard, room = shard + parts, 0 if parts > 1 else shard_rows - g["n"]
        else:
            table.append((g["tier"], g["lead"], shard, 1))
            room -= g["n"]
        last = g["tier"]
    plan = rows.sparkSession.createDataFrame(table, "tier int, lead int, shard_from int, parts int")
    dealt = rows.join(F.broadcast(plan), ["tier", "lead"]).withColumn("shard", F.col("shard_from") + F.pmod(F.xxhash64("place", F.lit("shard")), F.col("parts")).cast("int"))
    return dealt.drop("tier", "lead", "shard_from", "parts"), shard + 1


def _answers(shard: Shard, ids: pa.ChunkedArray, queries: np.ndarray, asked_ids: pa.ChunkedArray, asked_places: np.ndarray, least: list, k: int) -> list:
    """Columns query_id, query_place, vec_id, place, score of all answers of a shard."""
    row, query, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, (place, q) in enumerate(zip(asked_places.tolist(), queries, strict=True)):
        found, scores = shard.search(q, place, k, least[i])
        row.append(found)
        query.append(np.full(len(found), i))
        score.append(scores)
    rows, asked = np.concatenate(row), np.concatenate(query)
    return [asked_ids.take(pa.array(asked)), pa.array(asked_places[asked]), ids.take(pa.array(rows)), pa.array(shard.positions[rows]), pa.array(np.concatenate(score))]


def top_k(vectors: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of every row for which ``is_query`` holds, against all rows but itself."""
    spark = vectors.sparkSession
    kind = vectors.schema[vec_id].dataType.simpleString()
    fine = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.filter(F.col(vector).isNotNull()).filter(fine).select(
        F.col(vec_id).alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("place")
    )
    sizes = F.transform("vector", lambda x: F.abs(x))
    strongest = F.array_max(F.transform("vector", lambda x, i: F.struct(F.abs(x), -i, F.when(x < 0, -i - 1).otherwise(i + 1).alias("lead"))))["lead"]
    product = F.pow(F.lit(SCALE) * F.coalesce(F.array_max(sizes), F.lit(0.0)) + 1.0, F.lit(2.0)) * F.greatest(F.size("vector"), F.lit(1))
    tier = F.when(product < 2.0**24, 0).when(product < 2.0**53, 1).when(product < 2.0**62, 2).otherwise(3)
    rows = materialize(rows.withColumns({"tier": tier, "lead": F.coalesce(strongest, F.lit(0))}), "vectors")  # places stay what they are, whatever is recomputed
    dealt, shards = _deal(rows, shard_rows)
    names = ["query_id", "query_place", "vec_id", "place", "score"]
    answer = f"query_id {kind}, query_place long, vec_id {kind}, place long, score long"

    def at_home(part: pa.Table) -> pa.Table:
        data = integers(part.column("vector"))
        shard, asks = part.column("shard")[0].as_py(), np.flatnonzero(part.column("asks").to_numpy())
        bounds = [np.array([float(min(max(x, -1e308), 1e308)) for x in side]).tobytes() for side in (data.max(0), data.min(0))]
        places, ids = part.column("place").to_numpy(), part.column("vec_id")
        rows_, queries = _typed(data, data[asks])
        columns = _answers(Shard(rows_, ids.to_pylist(), places), ids, queries, ids.take(pa.array(asks)), places[asks], [None] * len(asks), k)
        found = pa.table(columns, names=names).append_column("shard", pa.array([shard] * len(columns[1]), pa.int32()))
        for side in ("high", "low"):
            found = found.append_column(side, pa.nulls(len(columns[1]), pa.binary()))
        own = [pa.nulls(1, f.type) for f in found.schema][:5] + [pa.array([shard], pa.int32()), *(pa.array([b], pa.binary()) for b in bounds)]
        return pa.concat_tables([found, pa.table(own, schema=found.schema)])

    home = materialize(dealt.groupBy("shard").applyInArrow(at_home, f"{answer}, shard int, high binary, low binary"), "home")
    found = home.filter("query_place IS NOT NULL").select(*names)
    least = found.groupBy("query_place").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    asking = dealt.filter("asks").select(F.col("vec_id").alias("asked_id"), F.col("vector").alias("asked_vector"), F.col("place").alias("asked_place"), F.col("shard").alias("home"))
    asking = asking.join(least, F.col("asked_place") == F.col("query_place"), "left").drop("query_place")
    pairs = materialize(_pairs(asking, home.filter("high IS NOT NULL").select("shard", "high", "low"), shards, kind), "pairs")
    blocks = materialize(pairs.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks")), "blocks")
    few = shards <= BOUND_BYTES // 64
    per_shard = F.broadcast(blocks) if few else blocks
    right = pairs.join(per_shard, "shard").withColumn("block", F.pmod(F.xxhash64("asked_place", F.lit("block")), F.col("blocks")).cast("int")).drop("blocks", "home")
    left = dealt.drop("asks").join(per_shard, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def run(some: pa.Table, asked: pa.Table) -> pa.Table:
        if not some.num_rows or not asked.num_rows:
            return pa.table([pa.array([], t) for t in (asked.schema.field("asked_id").type, pa.int64(), some.schema.field("vec_id").type, pa.int64(), pa.int64())], names=names)
        data, queries = _typed(integers(some.column("vector")), integers(asked.column("asked_vector")))
        shard = Shard(data, some.column("vec_id").to_pylist(), some.column("place").to_numpy())
        columns = _answers(shard, some.column("vec_id"), queries, asked.column("asked_id"), asked.column("asked_place").to_numpy(), asked.column("least").to_pylist(), k)
        return pa.table(columns, names=names)

    more = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(run, answer)
    rank = F.row_number().over(Window.partitionBy("query_place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "place"))
    return found.unionByName(more).withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pairs(asking: DataFrame, bounds: DataFrame, shards: int, kind: str) -> DataFrame:
    """Each query with the shards, besides its own, in which a row may reach its threshold."""
    size = bounds.agg(F.sum(F.length("high") + F.length("low"))).first()[0] or 0
    if size > BOUND_BYTES:
        return asking.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).filter("shard <> home")
    sides = sorted(bounds.collect(), key=lambda r: r["shard"])
    wide = max((len(r["high"]) // 8 for r in sides), default=0)
    table = np.zeros((2, len(sides), wide))
    for r in sides:
        for side, name in enumerate(("high", "low")):
            one = np.frombuffer(bytes(r[name]), np.float64)
            table[side, r["shard"], : len(one)] = one
    shared = asking.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            queries = integers(batch.column("asked_vector"))
            queries = np.array([[float(min(max(x, -1e308), 1e308)) for x in q] for q in queries]).reshape(queries.shape) if queries.dtype == object else queries
            both = max(queries.shape[1], high.shape[1])
            queries, up, down = (np.pad(x, ((0, 0), (0, both - x.shape[1]))) for x in (queries, high, low))
            home = batch.column("home").to_numpy()
            needed = np.array([-np.inf if x is None or x <= LEAST else float(x) for x in batch.column("least").to_pylist()])
            go = reachable(queries, up, down) >= needed[:, None]
            go[np.arange(len(home)), home] = False
            query, shard = np.nonzero(go)
            kept = batch.take(pa.array(query))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(shard.astype(np.int32))], names=[*batch.schema.names, "shard"])

    schema = f"asked_id {kind}, asked_vector array<double>, asked_place long, home int, least long, shard int"
    return asking.select("asked_id", "asked_vector", "asked_place", "home", "least").mapInArrow(run, schema)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best rows of every row whose vec_id is divisible by 20."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % QUERY_EVERY == 0)


ORACLE = """
WITH vectors AS (
  SELECT vec_id, row_number() OVER () AS place, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, q.place AS query_place, c.vec_id, c.place, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.place <> c.place WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_place ORDER BY score DESC, vec_id NULLS LAST, place)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""

QUERIES = {"op2_topk": op2_topk}
ORACLES = {"op2_topk": ORACLE}
