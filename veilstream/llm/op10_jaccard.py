"""N-gram Jaccard join: near copies by a chosen-path join, checked exactly.

A text's set is its shingles of ``WORDS`` lowered words; two texts are linked if the Jaccard similarity of their sets
is at least ``THRESHOLD``. Equal texts are one node and need no links.

1. Each text gets a MinHash signature of ``TOKENS`` values; two signatures agree in a value with the probability of
   the similarity, so the values are the tokens that paths are chosen from.
2. Chosen paths: a run starts with one path; at each of its levels a path picks, by its own hash, one or two
   positions of the signature (1 / THRESHOLD in expectation) and splits on the tokens found there. Texts that are
   still together after the last level share a bucket. The number of levels grows with the logarithm of the number of
   nodes, and runs are repeated until a pair at the threshold is found with probability ``RECALL``.
3. Buckets with two or more nodes are compared by their signatures. Inside a bucket nodes are gathered from a seed:
   whatever is near joins its cluster and is compared only with what is still alone, so a bucket of near
   copies costs little more than its size. Buckets beyond ``BLOCK`` nodes are dealt into blocks, and each pair of
   blocks is a group of its own. Only links that span a cluster come out.
4. The components of these links are small sets of texts that hold all near copies of each other. In each of them
   all pairs are compared exactly, by matrix products over the shingles that at least two texts share, block by block;
   what comes out is the number of links of each node and links that span the exact components. A pair lies within
   one component, so no link is counted twice and none inside a component is lost, whatever the buckets showed.
   Where only classes are asked for, a component beyond ``EXACT_BLOCK`` texts is compared inside its blocks, then one text
   of each class found so far with those of the others; only what is still in several classes after that needs the rest of the pairs.
5. The components of the exact links are the classes.

Defined results: a text of fewer than ``WORDS`` words has one shingle, all its words. Texts without words, nulls (as empty
texts) among them, have no links; equal ones are a class. The class id is the smallest id in the class, null if it
has none but nulls. Repeated rows are members like any other. An empty table gives no rows. ``one_of_each`` keeps all columns;
the name ``__near_place`` is reserved.

``RECALL`` is the share of pairs at the threshold that are found, averaged over what their signatures agree in; more similar
pairs are found more often, and a pair inside a component is found whatever the buckets showed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstream.llm.columns import flat, slices, within
from veilstream.llm.components import components
from veilstream.session import materialize

WORDS, THRESHOLD, TOKENS, RECALL = 5, 0.8, 128, 0.999
#: Estimates of similarity this far below the threshold still count as near: four standard deviations.
SLACK = 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / TOKENS)
#: Nodes of a bucket, and of a component, that are compared in one group.
BLOCK, EXACT_BLOCK = 4096, 512
#: Lists of nodes up to this length are broadcast (about 60 bytes each); longer ones are joined by shuffle.
BROADCAST_NODES = 100_000
SLICE = 1 << 20

_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and of its inverse, modulo 2**64."""
    if len(_powers.kept[0]) < n:
        base = 0xD6E8FEB86659FD93
        _powers.kept = tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, np.uint64))]) for b in (base, pow(base, -1, 2**64)))
    return _powers.kept


_powers.kept = (np.zeros(0, np.uint64),) * 2


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, first word of every text) of texts in one buffer."""
    inside = _IN_WORD[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):  # long texts a piece at a time
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE, "right")))
        a, b = int(start[i]), int(end[j - 1])
        up, down = _powers(b - a + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=sums[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _ODD)
        i = j
    return out, np.searchsorted(start, offsets)


def shingles(words: np.ndarray, first: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first hash of every text) of all runs of ``size`` words; a shorter text has one of all its words."""
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(1, n - size + 1))
    place = within(first[:-1], count)
    last = np.repeat(first[1:], count)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    out = np.zeros(len(place), np.uint64)
    for k in range(size):
        out = out * _ODD + np.where(place + k < last, padded[place + k], np.uint64(0))
    return mix(out), np.concatenate([[0], np.cumsum(count)])


_RNG = np.random.default_rng(20240607)
_TIMES = _RNG.integers(0, 2**31, TOKENS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RNG.integers(0, 2**32, TOKENS, dtype=np.uint32)


def signatures(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts with shingles, their MinHash signatures of 16 bits a value)."""
    full = np.flatnonzero(np.diff(first))
    out = np.empty((len(full), TOKENS), np.uint16)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    i = 0
    while i < len(full):
        j = max(i + 1, int(np.searchsorted(first[full + 1], first[full[i]] + 32768, "right")))
        part, at = x[first[full[i]] : first[full[j - 1] + 1]], first[full[i:j]] - first[full[i]]
        for t in range(TOKENS):
            least = np.minimum.reduceat(part * _TIMES[t] + _PLUS[t], at)
            out[i:j, t] = (least * np.uint32(0x9E3779B1)) >> np.uint32(16)
        i = j
    return full, out


def levels_for(nodes: int) -> int:
    """Levels of a run, so that unrelated texts hardly ever share a bucket."""
    return max(3, math.ceil(math.log2(max(2, nodes)) / 6))


def runs_for(levels: int, recall: float = RECALL, threshold: float = THRESHOLD) -> int:
    """Runs until a pair at the threshold is found with probability ``recall``. It is lost in a run if it dies out at some level.

    All runs draw from the same signatures, so the loss is averaged over how many of their values agree.
    """
    agree = np.arange(TOKENS + 1)
    logs = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, TOKENS + 1)))])
    share = np.exp(logs[TOKENS] - logs[agree] - logs[TOKENS - agree] + agree * math.log(threshold) + (TOKENS - agree) * math.log(1 - threshold))
    extra, lost = 1 / THRESHOLD - 1, np.zeros(TOKENS + 1)
    for _ in range(levels):
        child = 1 - agree / TOKENS * (1 - lost)
        lost = child * (1 - extra + extra * child)
    runs = 1
    while (share * lost**runs).sum() > 1 - recall:
        runs += 1
    return runs


def paths(signature: np.ndarray, levels: int, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, path) of all buckets that each signature is in."""
    n = len(signature)
    row = np.tile(np.arange(n), runs)
    path = np.repeat(mix(np.arange(1, runs + 1, dtype=np.uint64) * _ODD), n)
    extra = np.uint64(int((1 / THRESHOLD - 1) * 2**32))
    for _ in range(levels):
        draw = mix(path + _ODD)
        second = np.flatnonzero((draw >> np.uint64(32)) < extra)
        row, path, draw = np.concatenate([row, row[second]]), np.concatenate([path, path[second] ^ np.uint64(1)]), np.concatenate([draw, mix(draw[second])])
        position = (draw % np.uint64(TOKENS)).astype(np.int64)
        token = signature[row, position].astype(np.uint64)
        path = mix(path * _ODD + (position.astype(np.uint64) << np.uint64(16)) + token + np.uint64(1))
    return row, path.view(np.int64)


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted batches as tables of whole groups, with where each group starts and the end."""
    kept: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        new = np.ones(table.num_rows, bool)
        new[1:] = False
        for k in keys:
            column = table.column(k).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        table = pa.Table.from_batches(kept)
        at = starts(table)
        if len(at) > 1:  # the last group may go on
            yield table.slice(0, at[-1]).combine_chunks(), at
            kept = table.slice(at[-1]).to_batches()
    if kept:
        table = pa.Table.from_batches(kept).combine_chunks()
        yield table, np.append(starts(table), table.num_rows)


def _blocked(rows: DataFrame, key: str, count: Column, node: str, most: int) -> DataFrame:
    """Rows with (a, b): one pair of blocks for groups of up to ``most`` rows, else each row in the pairs of its block."""
    blocks = F.ceil(count / F.lit(most)).cast("int")
    own = F.pmod(F.xxhash64(node, F.lit("block")), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    return rows.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", other).select(
        *[F.col(c) for c in rows.columns if c != "n"], F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own"
    ).repartition(key, "a", "b").sortWithinPartitions(key, "a", "b", node)


def near_links(signature: np.ndarray, starts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row) that span the clusters of each group, by estimated similarity."""
    need = math.ceil(least * TOKENS)
    sizes = np.diff(starts)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    pairs = np.flatnonzero(sizes == 2)
    a = starts[pairs]
    near = (signature[a] == signature[a + 1]).sum(1) >= need
    out.append((a[near], a[near] + 1))
    for g in np.flatnonzero(sizes > 2).tolist():
        alone = np.arange(starts[g] + 1, starts[g + 1])
        queue = [int(starts[g])]
        while len(alone):
            if not queue:
                queue, alone = [int(alone[0])], alone[1:]
                continue
            one = queue.pop()
            near = (signature[alone] == signature[one]).sum(1) >= need
            found = alone[near]
            if len(found):
                out.append((np.full(len(found), one), found))
                queue.extend(found.tolist())
                alone = alone[~near]
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def exact_links(sets: list[np.ndarray], left: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of sets with a similarity of at least ``least``, at least one in ``left`` and the other not, or both if all are.

    Returns the links of each set, and links (i, j) that span their components.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    token = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    new = np.append(True, token[1:] != token[:-1])
    number = np.cumsum(new) - 1
    shared = np.bincount(number) > 1
    keep = shared[number]
    number, owner = (np.cumsum(shared) - 1)[number[keep]], owner[keep]
    both = np.zeros((n, n), np.float32)
    width = max(1, min(int(shared.sum()), (16 << 20) // (4 * n)))
    for a in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(number, [a, a + width])
        table = np.zeros((n, width), np.float32)
        table[owner[lo:hi], number[lo:hi] - a] = 1
        both += table @ table.T
    linked = both >= least * (size[:, None] + size[None, :] - both) - 1e-6
    linked[np.arange(n), np.arange(n)] = False
    if not left.all():
        linked &= left[:, None] != left[None, :]
    degree = linked.sum(1)
    spans, alone = [], np.ones(n, bool)
    for root in range(n):
        if alone[root]:
            alone[root] = False
            queue = [root]
            while queue:
                one = queue.pop()
                found = np.flatnonzero(linked[one] & alone)
                alone[found] = False
                spans.extend((root, f) for f in found.tolist())
                queue.extend(found.tolist())
    return degree, np.array([a for a, _ in spans], np.int64), np.array([b for _, b in spans], np.int64)


def _text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))


def _sign(texts: DataFrame) -> DataFrame:
    """(key, place, doc_id, text) to (key, place, doc_id, signature): null for texts without words."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(pc.utf8_lower(batch.column(3)))
            for i, j in slices(offsets, SLICE):
                at = offsets[i : j + 1] - offsets[i]
                full, signed = signatures(*shingles(*word_hashes(data[offsets[i] : offsets[j]], at)))
                column: list = [None] * (j - i)
                for row, one in zip(full.tolist(), signed, strict=True):
                    column[row] = one.tobytes()
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(3)), pa.array(column, pa.binary())], names=["key", "place", "doc_id", "signature"])

    return texts.mapInArrow(run, f"key binary, place long, doc_id {kind}, signature binary")


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    data, _ = flat(column)
    return np.frombuffer(data.tobytes(), np.uint16).reshape(-1, TOKENS)


def _candidates(nodes: DataFrame) -> DataFrame:
    """Links (u, v) that span the clusters of near texts."""
    n = nodes.count()
    levels = levels_for(n)
    runs = runs_for(levels)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                row, path = paths(_matrix(part.column(1)), levels, runs)
                yield pa.RecordBatch.from_arrays([pa.array(path), part.column(0).take(pa.array(row))], names=["path", "key"])

    at = nodes.select("key", "signature").mapInArrow(chosen, "path long, key binary")
    shared = at.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1")
    members = at.join(shared, "path").join(nodes.select("key", "signature"), "key").select("path", "key", "signature", "n")
    blocked = _blocked(members, "path", F.col("n"), "key", BLOCK)
    least = THRESHOLD - SLACK

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in groups(batches, ["path", "a", "b"]):
            a, b = near_links(_matrix(table.column("signature")), starts, least)
            key = table.column("key").combine_chunks()
            key = key.chunk(0) if isinstance(key, pa.ChunkedArray) else key
            yield pa.RecordBatch.from_arrays([key.take(pa.array(a)), key.take(pa.array(b))], names=["u", "v"])

    return blocked.select("path", "a", "b", "key", "signature").mapInArrow(compared, "u binary, v binary")


def _sets(docs: DataFrame, text: str, members: DataFrame) -> DataFrame:
    """(part, key, n, shingles) of the members, with the shingles of their texts as bytes."""
    few = members.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    # By the key of the text itself: a row number of this scan need not be the one of another scan.
    texts = docs.select(_text_key(F.col(text)).alias("key"), F.col(text).cast("string").alias("text"))
    texts = texts.join(F.broadcast(members) if few else members, "key").groupBy("part", "key", "n").agg(F.first("text").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(pc.utf8_lower(batch.column(3)))
            for i, j in slices(offsets, SLICE):
                hashes, first = shingles(*word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                sets = [np.unique(hashes[a:b]).tobytes() for a, b in zip(first, first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(3)), pa.array(sets, pa.binary())], names=["part", "key", "n", "shingles"])

    return texts.mapInArrow(cut, "part long, key binary, n long, shingles binary")


def _compared(blocked: DataFrame) -> DataFrame:
    """(u, v, links) of (part, a, b) groups of sets: links of u within a group, or a link u, v that spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in groups(batches, ["part", "a", "b"]):
            keys = table.column("key").to_pylist()
            a, own = table.column("a").to_numpy(), table.column("own").to_numpy()
            column = table.column("shingles")
            u, v, links = [], [], []
            for i, j in zip(starts, starts[1:], strict=False):
                some = [np.frombuffer(x.as_buffer(), np.uint64) for x in column.slice(i, j - i)]
                degree, x, y = exact_links(some, own[i:j] == a[i:j], THRESHOLD)
                u += [*keys[i:j], *(keys[i + k] for k in x)]
                v += [*[None] * (j - i), *(keys[i + k] for k in y)]
                links += [*degree.tolist(), *[0] * len(x)]
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary()), pa.array(links, pa.int64())], names=["u", "v", "links"])

    return blocked.select("part", "a", "b", "key", "own", "shingles").mapInArrow(run, "u binary, v binary, links long")


def _members(near: DataFrame) -> DataFrame:
    sizes = near.groupBy("root").agg(F.count("*").alias("n"))
    return materialize(near.join(sizes, "root").select(F.col("node").alias("key"), F.xxhash64("root").alias("part"), "n"), "near")


def _exact(docs: DataFrame, text: str, near: DataFrame) -> DataFrame:
    """(u, v, links) of the candidates' components: links of u within a group, or a link u, v that spans."""
    return materialize(_compared(_blocked(_sets(docs, text, _members(near)), "part", F.col("n"), "key", EXACT_BLOCK)), "links")


def _exact_spans(docs: DataFrame, text: str, near: DataFrame) -> DataFrame:
    """(u, v): links that span the exact components, without those that large components don't need."""
    members = _members(near)
    spans = lambda sets: _compared(_blocked(sets, "part", F.col("n"), "key", EXACT_BLOCK)).filter("v IS NOT NULL").select("u", "v")
    small = materialize(spans(_sets(docs, text, members.filter(F.col("n") <= EXACT_BLOCK))), "spans")
    large = members.filter(F.col("n") > EXACT_BLOCK)
    if large.isEmpty():
        return small
    sets = materialize(_sets(docs, text, large), "large-sets")
    block = F.pmod(F.xxhash64("key", F.lit("block")), F.ceil(F.col("n") / F.lit(EXACT_BLOCK))).cast("int")
    inside = sets.withColumn("a", block).select("part", "a", F.col("a").alias("b"), "key", F.col("a").alias("own"), "shingles").repartition("part", "a").sortWithinPartitions("part", "a", "key")
    found = materialize(_compared(inside).filter("v IS NOT NULL").select("u", "v"), "inside")

    def rooted(links: DataFrame) -> DataFrame:
        """(part, key, root) of all members of large components."""
        roots = components(links).select(F.col("node").alias("key"), "root")
        return large.select("part", "key").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))

    first = rooted(found).filter("key = root").select("part", "key")
    ones = sets.drop("n").join(first, ["part", "key"]).join(first.groupBy("part").agg(F.count("*").alias("n")), "part")
    found = materialize(found.unionByName(spans(ones.select("part", "key", "n", "shingles"))), "ones")
    apart = rooted(found).groupBy("part").agg(F.count_distinct("root").alias("classes")).filter("classes > 1").select("part")
    apart = materialize(apart, "apart")
    return small.unionByName(found) if apart.isEmpty() else small.unionByName(found).unionByName(spans(sets.join(apart, "part", "left_semi")))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", place: str | None = None, count_links: bool = True) -> DataFrame:
    """(place, doc_id, text_key, class_key, class_id, n_links) of every row; place is the column of that name, or null.

    ``docs`` is read twice, in any partitions. Without ``count_links``, n_links is null and large components cost less.
    """
    number = F.col(place) if place else F.lit(None).cast("long")
    texts = docs.select(_text_key(F.col(text)).alias("key"), number.alias("place"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    signed = materialize(_sign(texts), "signed")
    nodes = materialize(signed.filter("signature IS NOT NULL").groupBy("key").agg(F.min("signature").alias("signature")), "nodes")
    near = components(_candidates(nodes))
    if count_links:
        exact = _exact(docs, text, near)
        links = exact.filter("v IS NULL").groupBy(F.col("u").alias("key")).agg(F.sum("links").alias("links"))
        roots = components(exact.filter("v IS NOT NULL").select("u", "v")).select(F.col("node").alias("key"), "root")
        found = links.join(roots, "key", "left")
    else:
        found = components(_exact_spans(docs, text, near)).select(F.col("node").alias("key"), "root", F.lit(None).cast("long").alias("links"))
    found = materialize(found, "found")  # a plain side, so that Spark can split a text with many copies
    rows = signed.select("key", "place", "doc_id").join(found, "key", "left")
    number = F.coalesce("links", F.lit(0)) if count_links else F.col("links")
    rows = materialize(rows.select("place", "doc_id", "key", F.coalesce("root", "key").alias("class_key"), number.cast("long").alias("n_links")), "classes")
    # Written first, so that the join has two plain exchanges and Spark can split the partition of a large class.
    classes = materialize(rows.groupBy("class_key").agg(F.min("doc_id").alias("class_id")), "class-ids")
    return rows.join(classes, "class_key").select("place", "doc_id", F.col("key").alias("text_key"), "class_key", "class_id", "n_links")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near copies: the one with the smallest id, then the first."""
    # Numbered once and written with the numbers: another scan of ``docs`` may split and so number it differently.
    places = materialize(docs.withColumn("__near_place", F.monotonically_increasing_id()), "places")
    rows = near_copies(places, doc_id, text, "__near_place", count_links=False)
    first = materialize(rows.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("place"))).alias("first")), "first")
    gone = materialize(rows.join(first, "class_key").filter(F.col("place") != F.col("first.place")).select(F.col("place").alias("__near_place")), "gone")
    few = gone.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES
    return places.join(F.broadcast(gone) if few else gone, "__near_place", "left_anti").drop("__near_place")


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document, and how many different texts it is linked with."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_copies(docs).select("doc_id", "class_id", "n_links")


QUERIES = {"op10_jaccard": op10_jaccard}
