"""Language ID: nearest of several centroids per language by cosine over TF-IDF vectors of character n-grams.

A text is lowered, words with digits in them (numbers, keys, digests) and runs of anything but letters become one
space, and all its 2- and 3-grams are hashed into
``DIMS`` buckets; a vector is log(1 + count) * idf, normalised. Training takes at most ``SAMPLE`` documents a label, those
with the smallest hash of their id, and at most the ``LABELS`` most frequent labels, so the bounds are parameters and not
prefixes; whole texts count. Each label's
vectors are split by spherical k-means into ``CENTROIDS`` clusters. A cluster of fewer than ``HANDFUL`` rows (fewer still
for a label of few rows) is dissolved and its centroid dealt again, by halving the largest cluster; one that is as small
after ``RESEEDS`` tries is left out, and its rows go to the nearest of the others. Larger ones stay, so a script
or register that few texts of a label are in keeps its centroid. Texts become counts of n-grams where they are read, so the
group of a label is bounded in bytes whatever the texts' lengths; the driver gets document frequencies and centroids,
at most ``LABELS`` * ``CENTROIDS`` * ``DIMS`` floats, which are what is broadcast.

A document gets the label of the nearest centroid. It is rejected if it has no letters, or if its cosine is below the
floor of that label: ``MARGIN`` times the ``QUANTILE`` of the cosines that held-out rows of the sample (every
``CALIBRATE``-th) have with the nearest centroid of their label when k-means runs without them. All cosines are taken
relative to the square root of the share of ``FULL_GRAMS`` distinct n-grams that the text has, since a short text in
the right language is still far from any centroid; what is closer than that counts as 1 for the floor. A label of under ``CALIBRATE`` rows takes the least floor of the others,
or rejects nothing by distance.

Defined results: a null text, or one without letters, is ``und`` with score 0 and rejected. Rows without label or id
don't train. Ties go to the first label in code point order. Without training rows every text is ``und`` with score 0, and only
those without letters are rejected. Very
long texts are read whole, a piece at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilstream.session import materialize

DIMS, CENTROIDS, SAMPLE, LABELS, ROUNDS, FULL_GRAMS, HANDFUL, RESEEDS = 8192, 3, 1000, 500, 12, 400, 5, 4
CALIBRATE, QUANTILE, MARGIN = 4, 0.01, 0.4
UNKNOWN = "und"
SLICE_CHARS, SLICE_ROWS = 1 << 19, 128
#: Samples of up to this many rows are broadcast as ids (about 50 bytes each).
BROADCAST_SAMPLE = 50_000

_LETTERS: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTERS[0][points]


def _plain(points: np.ndarray) -> np.ndarray:
    """Letters as they are, all else a space; letters of words with digits too. A zero ends a text and stays."""
    letter = _is_letter(points)
    digit = (points >= 48) & (points <= 57)
    if digit.any():
        inside = letter | digit
        word = np.cumsum(inside & ~np.append(False, inside[:-1]))
        letter &= np.bincount(word, digit & inside, int(word[-1]) + 1)[word] == 0
    return np.where(letter, points, np.uint32(32))


def _bucket(points: np.ndarray) -> np.ndarray:
    """Buckets of 2-grams and 3-grams, at the place of their first character; the end has fewer."""
    a = points * np.uint32(2654435761)
    two = a[:-1] ^ (points[1:] * np.uint32(2246822519) + np.uint32(374761393))
    three = two[:-1] ^ (points[2:] * np.uint32(3266489917) + np.uint32(668265263))
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    return ((two * np.uint32(2654435769)) >> shift).astype(np.int64), ((three * np.uint32(2246822507)) >> shift).astype(np.int64)


def counts(texts: list[str]) -> np.ndarray:
    """Rows of n-gram counts by bucket. Each text stands between two spaces."""
    out = np.zeros(len(texts) * DIMS, np.int64)
    for row, text in enumerate(texts):  # long texts piece by piece, with an overlap of two characters
        if len(text) > SLICE_CHARS:
            carry, i = np.full(1, 32, np.uint32), 0
            while i < len(text):
                j = text.rfind(" ", i, i + SLICE_CHARS) + 1 if i + SLICE_CHARS < len(text) else len(text)
                j = j if j > i else min(len(text), i + SLICE_CHARS)  # between words if there is a space
                points = np.frombuffer((text[i:j].lower() + (" " if j == len(text) else "")).encode("utf-32-le", "replace"), np.uint32)
                i = j
                points = np.concatenate([carry, _plain(points)])
                keep = (points != 32) | np.append(True, points[:-1] != 32)
                keep[: len(carry)] = True
                points = points[keep]
                two, three = _bucket(points)
                # pairs and triples that end within the carry were counted with the piece before
                for grams, lag in ((two, 1), (three, 2)):
                    out[row * DIMS : (row + 1) * DIMS] += np.bincount(grams[max(0, len(carry) - lag) :], minlength=DIMS)
                carry = points[-2:]
    short = [t.lower() if len(t) <= SLICE_CHARS else "" for t in texts]
    whole = np.frombuffer((" " + " \0".join(short) + " ").encode("utf-32-le", "replace"), np.uint32)
    if len(whole) > 2:
        cut = whole == 0
        if int(cut.sum()) != len(texts) - 1:  # texts with zero characters of their own
            whole = np.frombuffer((" " + " \0".join(t.replace("\0", " ") for t in short) + " ").encode("utf-32-le", "replace"), np.uint32)
            cut = whole == 0
        plain = _plain(whole)
        keep = (plain != 32) | np.append(True, plain[:-1] != 32) | cut  # a zero is the space that its text begins with
        doc = np.cumsum(cut)[keep] * DIMS
        plain = plain[keep]
        two, three = _bucket(plain)
        for grams in (two, three):
            lag = len(plain) - len(grams)
            same = doc[lag:] == doc[:-lag]
            out += np.bincount(grams[same] + doc[:-lag][same], minlength=len(out))
    return out.reshape(len(texts), DIMS)


def vectors(texts: list[str], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised TF-IDF rows, and how close a text with so few n-grams can come to a centroid (1 for longer ones)."""
    return weighed(counts(texts), idf)


def weighed(grams: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``vectors`` of counted n-grams."""
    out = np.log1p(grams.astype(np.float32)) * idf
    reach = np.sqrt(np.minimum(1, np.maximum(1, (out > 0).sum(1)) / FULL_GRAMS))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12), reach


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, chars = i, 0
        while j < len(texts) and j - i < SLICE_ROWS and (j == i or chars + len(texts[j]) <= SLICE_CHARS):
            chars += len(texts[j])
            j += 1
        yield i, j
        i = j


def k_means(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: (normalised centroids, cluster of each row). Starts from rows far from each other; no chance."""
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    chosen = [unit(rows.mean(0))]
    while len(chosen) < min(k, len(rows)):
        near = np.max(rows @ np.stack(chosen).T, axis=1)
        mid = np.argsort(near, kind="stable")[len(near) // 10]  # not the very farthest, which is an outlier
        chosen.append(rows[mid])
    centroids, own = np.stack(chosen), np.zeros(len(rows), np.int64)
    center = lambda members: unit(members.astype(rows.dtype) @ rows)  # noqa: E731  (no copy of the rows)
    least = min(HANDFUL, len(rows) // (2 * k))
    for reseeds in range(RESEEDS + 1):
        for _ in range(rounds):
            own = np.argmax(rows @ centroids.T, axis=1)
            after = np.stack([center(own == c) if (own == c).any() else centroids[c] for c in range(len(centroids))])
            if np.allclose(after, centroids, atol=1e-6):
                break
            centroids = after
        own = np.argmax(rows @ centroids.T, axis=1)
        sizes = np.bincount(own, minlength=len(centroids))
        few = np.flatnonzero(sizes < least)
        if not len(few) or reseeds == RESEEDS:
            break
        # A handful of rows stands for what they share besides the language: the largest cluster is halved instead.
        for c in few:
            big = int(np.argmax(sizes))
            members = np.flatnonzero(own == big)
            far = members[np.argsort((rows @ centroids[big])[members], kind="stable")[len(members) // 10]]
            order = members[np.argsort(-(rows @ rows[far])[members], kind="stable")]
            own[order[: len(order) // 2]] = c
            centroids[c], centroids[big] = center(own == c), center(own == big)
            sizes = np.bincount(own, minlength=len(centroids))
    centroids = centroids[sizes >= least]
    return centroids, np.argmax(rows @ centroids.T, axis=1)


@dataclass
class LanguageModel:
    idf: np.ndarray
    langs: list[str]  # of each centroid
    centroids: np.ndarray
    floors: np.ndarray  # of each centroid: the least cosine relative to reach that isn't rejected

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(label, cosine, rejected) of each text."""
        letters = [any(map(str.isalpha, t or "")) for t in texts]
        known = letters if self.langs else [False] * len(texts)
        near, reach, best = np.zeros(len(texts)), np.ones(len(texts)), np.zeros(len(texts), np.int64)
        some = [i for i, k in enumerate(known) if k]
        plain = [texts[i] for i in some]
        for i, j in _slices(plain):
            rows, reach[some[i:j]] = vectors(plain[i:j], self.idf)
            cosine = rows @ self.centroids.T
            best[some[i:j]] = np.argmax(cosine, axis=1)
            near[some[i:j]] = np.clip(cosine.max(1), 0, 1)
        rejected = ~np.array(letters, bool) | (near < self.floors[best] * reach if self.langs else False)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known, strict=True)], near, rejected


def held_out(doc_id: Column) -> Column:
    """Is the row kept from training? False for a null id, which doesn't train either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> LanguageModel:
    """Learn from labelled rows that aren't held out, at most ``sample`` a label and ``LABELS`` labels."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    pairs = rows.select("id", "lang").distinct()
    # Of a frequent label only the ids with a small hash can be among the first: four times as many as are needed.
    share = F.least(F.lit(1.0), F.lit(4.0 * sample) / F.count("*"))
    shares = pairs.groupBy("lang").agg(share.alias("share"), F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LABELS).drop("n")
    shares = materialize(shares, "language-shares")
    small = (F.shiftrightunsigned(F.xxhash64("id"), 11) / float(2**53)) < F.col("share")
    order = F.shiftrightunsigned(F.xxhash64("id"), 11)
    first = F.row_number().over(Window.partitionBy("lang").orderBy(order, "id"))
    ids = materialize(pairs.join(F.broadcast(shares), "lang").filter(small).drop("share").withColumn("n", first).filter(F.col("n") <= sample).drop("n"), "language-ids")
    chosen = F.broadcast(ids) if ids.count() <= BROADCAST_SAMPLE else ids
    again = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", F.xxhash64("text")))  # ids may repeat
    picked = rows.join(chosen, ["id", "lang"]).filter(F.col("text").rlike(r"\p{L}")).withColumn("n", again).filter(F.col("n") <= sample)
    table = materialize(_counted(picked.select("lang", "text")).repartition("lang"), "language-sample")

    def frequencies(part: pa.Table) -> pa.Table:
        df = np.zeros(DIMS, np.int64)
        for grams in part.column("grams").to_pylist():
            df[np.frombuffer(grams, _ENTRY)["bucket"]] += 1
        return pa.table({"n": [part.num_rows], "df": [df.astype(np.int32).tobytes()]}, schema=pa.schema([("n", pa.int64()), ("df", pa.binary())]))

    got = table.groupBy("lang").applyInArrow(frequencies, "n long, df binary").collect()  # one row a label
    n = sum(r["n"] for r in got)
    df = sum((np.frombuffer(bytes(r["df"]), np.int32).astype(np.int64) for r in got), np.zeros(DIMS, np.int64))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)

    def clusters(part: pa.Table) -> pa.Table:
        grams = sorted(part.column("grams").to_pylist())  # in an order that doesn't depend on partitions
        data, reach = np.zeros((len(grams), DIMS), np.float32), np.zeros(len(grams))
        for i in range(0, len(grams), SLICE_ROWS):
            data[i : i + SLICE_ROWS], reach[i : i + SLICE_ROWS] = weighed(_dense(grams[i : i + SLICE_ROWS]), idf)
        centroids, own = k_means(data, CENTROIDS)
        used = np.unique(own).tolist()
        floor = floor_of(data, reach)
        return pa.table(
            [[part.column("lang")[0].as_py()] * len(used), used, [centroids[c].astype(np.float32).tobytes() for c in used], [floor] * len(used)],
            schema=pa.schema([("lang", pa.string()), ("cluster", pa.int32()), ("centroid", pa.binary()), ("floor", pa.float64())]),
        )

    found = sorted(table.groupBy("lang").applyInArrow(clusters, "lang string, cluster int, centroid binary, floor double").collect(), key=lambda r: (r["lang"], r["cluster"]))
    centroids = np.stack([np.frombuffer(bytes(r["centroid"]), np.float32) for r in found]) if found else np.zeros((0, DIMS), np.float32)
    known = [r["floor"] for r in found if r["floor"] is not None]
    return LanguageModel(idf, [r["lang"] for r in found], centroids, np.array([min(known, default=0.0) if r["floor"] is None else r["floor"] for r in found]))


def floor_of(rows: np.ndarray, reach: np.ndarray) -> float | None:
    """The floor of a label from held-out rows of its sample; None if there are too few."""
    held = np.arange(len(rows)) % CALIBRATE == 0
    if len(rows) < CALIBRATE:
        return None
    centroids, _ = k_means(rows[~held], CENTROIDS)
    return float(MARGIN * np.quantile(np.minimum(1, (rows[held] @ centroids.T).max(1) / reach[held]), QUANTILE))


_ENTRY = np.dtype([("bucket", "<u2"), ("count", "<u4")])


def _counted(rows: DataFrame) -> DataFrame:
    """(lang, text) to (lang, grams): the n-grams that the text has, by bucket, at most ``DIMS`` entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, j in _slices(texts):
                out = []
                for row in counts(texts[i:j]):
                    some = np.flatnonzero(row)
                    entries = np.empty(len(some), _ENTRY)
                    entries["bucket"], entries["count"] = some, np.minimum(row[some], 2**32 - 1)
                    out.append(entries.tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(out, pa.binary())], names=["lang", "grams"])

    return rows.mapInArrow(run, "lang string, grams binary")


def _dense(grams: list[bytes]) -> np.ndarray:
    out = np.zeros((len(grams), DIMS), np.int64)
    for row, one in zip(out, grams, strict=True):
        entries = np.frombuffer(one, _ENTRY)
        row[entries["bucket"]] = entries["count"]
    return out


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with <prefix>lang_pred, <prefix>score and <prefix>rejected; columns of these names are replaced."""
    new = [f"{prefix}lang_pred", f"{prefix}score", f"{prefix}rejected"]
    rows = docs.drop(*new)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [*rows.columns, *new]
    schema = rows.select("*", F.lit("").alias(new[0]), F.lit(0.0).alias(new[1]), F.lit(False).alias(new[2])).schema
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, near, rejected = shared.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(near, pa.float64()), pa.array(rejected)], names=names)

    return rows.mapInArrow(run, schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op8_language": op8_language}
