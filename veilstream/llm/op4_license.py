"""License scans: an exact set-similarity join of text blocks with license templates.

Words are runs of digits, letters and non-ASCII characters, with A-Z lowered. A template of n words is compared
with blocks of 2n words that start at every n-th word, so any n words in a row lie within one block. A block meets
a template when it holds at least ``CONTAINMENT`` of the template's distinct words. The join is exact:

* pass 1 counts every template word over all texts; the sums order each template's words from rare to frequent;
* prefix filter: a block that meets the threshold holds one of the ``len - need + 1`` rarest words, so only
  blocks around such words are candidates;
* length filter: a block has at least ``need`` words;
* positional filter: if a block's rarest match is the p-th word of that order, at most ``len - p`` words can match;
* the distinct words of the remaining candidates are counted, in numpy, without forming pairs of blocks.

Sets of words can't tell a version or a clause apart, so a template may have a phrase that must stand in the block that
meets it. The templates are parts of public license texts and notices (``license_texts``); others can be given.

Besides, phrases are found wherever their words stand in a row ("base" labels).

Defined results: a null or empty text has no words, no matches and score 0. Repeated rows give repeated rows. A block
may meet several templates, and a template several blocks: each is a match, in the order of first word, label and kind.
The result has the columns doc_id, n_words and matches whatever other columns ``docs`` has. Texts are
read whole; a slice of a few MB is worked on at once, a longer text alone, in memory proportional to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstream.llm.columns import flat, slices, within
from veilstream.llm.license_texts import TEMPLATES

CONTAINMENT = 0.8

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
_WORD = re.compile("[0-9a-z\x80-\U0010ffff]+")


def words_of(text: str) -> list[str]:
    """The words of a template or phrase."""
    return _WORD.findall("".join(c.lower() if c.isascii() else c for c in text))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


@dataclass
class Words:
    """Words of several texts: bytes, where each word starts and ends, its text, and the first word of each text."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray) -> Words:
        data = _LOWER[data]
        inside = _IN_WORD[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        first = np.searchsorted(start, offsets)
        return cls(data, start, end, np.repeat(np.arange(len(offsets) - 1), np.diff(first)), first, offsets)


class Vocabulary:
    """Numbers for a few words; words are told apart by length, first and last byte, then byte for byte."""

    def __init__(self, words: list[str]):
        self.words = sorted(words)
        self.id = {w: i for i, w in enumerate(self.words)}
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(self.words):
            raw = w.encode()
            groups.setdefault(len(raw) << 16 | raw[0] << 8 | raw[-1], []).append(i)
        self.codes = np.array(sorted(groups), np.int64)
        self.groups = [groups[c] for c in self.codes.tolist()]

    def numbers(self, words: Words, at: np.ndarray | None = None) -> np.ndarray:
        """The number of each word (of those at given places), -1 for others."""
        start, end = (words.start, words.end) if at is None else (words.start[at], words.end[at])
        out = np.full(len(start), -1, np.int32)
        if not len(start) or not self.words:
            return out
        code = np.minimum(end - start, 1 << 20) << 16 | words.data[start].astype(np.int64) << 8 | words.data[end - 1]
        slot = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        hit = np.flatnonzero(self.codes[slot] == code)
        by = hit[np.argsort(slot[hit], kind="stable")]
        cuts = np.searchsorted(slot[by], np.arange(len(self.codes) + 1))
        for g, members in enumerate(self.groups):
            some = by[cuts[g] : cuts[g + 1]]
            if len(some):
                for m in members:
                    raw = np.frombuffer(self.words[m].encode(), np.uint8)
                    same = (words.data[start[some][:, None] + np.arange(len(raw))] == raw).all(1)
                    out[some[same]] = m
        return out


@dataclass
class Template:
    label: str
    size: int
    order: list[int]  # distinct words' numbers, rare to frequent
    need: int
    phrase: list[int]  # of words that must stand in a row; empty if none must

    @property
    def prefix(self) -> list[int]:
        return self.order[: len(self.order) - self.need + 1]


def word_counts(texts: DataFrame, vocabulary: Vocabulary) -> dict[int, int]:
    """How often each word of the vocabulary stands in the texts; as many numbers as the vocabulary has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary.words) + 1, np.int64)
        for batch in batches:
            data, offsets = flat(batch.column(0))
            for i, j in slices(offsets):
                part = Words.of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                total += np.bincount(vocabulary.numbers(part) + 1, minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total) - 1), pa.int32()), pa.array(total[1:])], names=["word", "n"])

    rows = texts.mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


def templates_by_rarity(templates: list[tuple[str, str, str]], vocabulary: Vocabulary, counts: dict[int, int], threshold: float) -> list[Template]:
    out = []
    for label, phrase, text in sorted(templates):
        words = words_of(text)
        order = sorted({vocabulary.id[w] for w in words}, key=lambda i: (counts.get(i, 0), vocabulary.words[i]))
        out.append(Template(label, len(words), order, int(np.ceil(threshold * len(order) - 1e-9)), [vocabulary.id[w] for w in words_of(phrase)]))
    return out


def in_a_row(ids: list[int], numbers: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Indices of the vocabulary words where a phrase begins. numbers, at, doc: words in order, by place in the slice and text."""
    good = numbers == ids[0]
    for k, word in enumerate(ids[1:], 1):
        good[len(good) - k :] = False
        ahead = slice(k, None)
        good[: len(good) - k] &= (numbers[ahead] == word) & (at[ahead] == at[: len(at) - k] + k) & (doc[ahead] == doc[: len(doc) - k])
    return np.flatnonzero(good)


def blocks_of(template: Template, numbers: np.ndarray, place: np.ndarray, doc: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, block, distinct words) of the blocks that meet the threshold. numbers, place, doc: vocabulary words by text and place."""
    none = (np.zeros(0, np.int64),) * 3
    rank = np.full(max([*template.order, int(numbers.max(initial=0))]) + 2, -1, np.int64)
    rank[template.order] = np.arange(len(template.order))
    mine = np.flatnonzero(rank[numbers] >= 0)
    if not len(mine):
        return none
    position, block, text = rank[numbers[mine]], place[mine] // template.size, doc[mine]
    # A word is in the block that starts at or before it, and in the one before that.
    position, text = np.concatenate([position, position[block > 0]]), np.concatenate([text, text[block > 0]])
    block = np.concatenate([block, block[block > 0] - 1])
    widest = int(block.max()) + 1
    key = text * widest + block
    order = np.lexsort((position, key))
    key, position = key[order], position[order]
    first = np.append(True, key[1:] != key[:-1])
    start = np.flatnonzero(first)
    rarest = position[start]
    block_words = np.minimum(2 * template.size, n_words[key[start] // widest] - key[start] % widest * template.size)
    candidate = (rarest < len(template.prefix)) & (len(template.order) - rarest >= template.need) & (block_words >= template.need)
    distinct = np.add.reduceat((first | np.append(True, position[1:] != position[:-1])).astype(np.int64), start)
    met = candidate & (distinct >= template.need)
    return key[start][met] // widest, key[start][met] % widest, distinct[met]


MATCH = "array<struct<label:string,kind:string,first_word:long,end_word:long,start_byte:long,end_byte:long,containment:double>>"


def license_matches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = CONTAINMENT, templates: list[tuple[str, str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_words, matches): every phrase and every block that meets a template's threshold, as spans of words and bytes."""
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    templates = [x for x in templates if words_of(x[2])]
    vocabulary = Vocabulary([*{w for x in [*(t for _, *both in templates for t in both), *phrases] for w in words_of(x)}])
    texts = docs.select(F.col(text).cast("string").alias("text"))
    ordered = templates_by_rarity(templates, vocabulary, word_counts(texts, vocabulary), threshold)
    runs = [(label, [vocabulary.id[w] for w in words_of(phrase)]) for phrase, label in sorted(phrases.items())]
    seeds = Vocabulary([vocabulary.words[i] for i in {*(i for t in ordered for i in t.prefix), *(ids[0] for _, ids in runs)}])
    kind = docs.schema[doc_id].dataType.simpleString()

    def found(part: Words) -> dict[int, list]:
        n_words = np.diff(part.first)
        out: dict[int, list] = {}
        seeded = np.unique(part.doc[np.flatnonzero(seeds.numbers(part) >= 0)])
        if not len(seeded):
            return out
        at = within(part.first[seeded], n_words[seeded])
        numbers = vocabulary.numbers(part, at)
        hit = np.flatnonzero(numbers >= 0)
        at, numbers = at[hit], numbers[hit]
        doc = part.doc[at]
        place = at - part.first[doc]

        def add(d: int, label: str, kind: str, a: int, b: int, c: float) -> None:
            w = part.first[d]
            lead = offsets_now[d]
            out.setdefault(d, []).append({"label": label, "kind": kind, "first_word": a, "end_word": b, "start_byte": int(part.start[w + a] - lead), "end_byte": int(part.end[w + b - 1] - lead), "containment": c})

        offsets_now = part.offsets
        for label, ids in runs:
            for i in in_a_row(ids, numbers, at, doc).tolist():
                add(int(doc[i]), label, "phrase", int(place[i]), int(place[i]) + len(ids), 1.0)
        for template in ordered:
            met = blocks_of(template, numbers, place, doc, n_words)
            if not len(met[0]):
                continue
            first = met[1] * template.size
            last = np.minimum(first + 2 * template.size, n_words[met[0]])
            fine = np.ones(len(first), bool)
            if template.phrase:  # the first place of the phrase at or after the block's start has to leave room for it
                begins = at[in_a_row(template.phrase, numbers, at, doc)]
                lead = part.first[met[0]]
                near = np.append(begins, np.iinfo(np.int64).max - len(template.phrase))[np.searchsorted(begins, lead + first)]
                fine = near + len(template.phrase) <= lead + last
            for d, a, b, distinct in zip(*(x[fine].tolist() for x in (met[0], first, last, met[2])), strict=True):
                add(d, template.label, "template", a, b, distinct / len(template.order))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match_type = pa.list_(pa.struct([("label", pa.string()), ("kind", pa.string()), *((x, pa.int64()) for x in ("first_word", "end_word", "start_byte", "end_byte")), ("containment", pa.float64())]))
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in slices(offsets):
                at = offsets[i : j + 1] - offsets[i]
                part = Words.of(data[offsets[i] : offsets[j]], at)
                matches = found(part)
                rows = [sorted(matches.get(d, []), key=lambda m: (m["first_word"], m["label"], m["kind"])) for d in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(part.first), pa.int64()), pa.array(rows, match_type)], names=["doc_id", "n_words", "matches"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, matches {MATCH}")


def op4_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its license phrases and the templates that a block of it meets."""
    found = license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("matches", lambda m: m["kind"] == "phrase")
    joined = lambda m: F.array_join(F.array_sort(F.array_distinct(F.transform(m, lambda x: x["label"]))), ",")
    starts = F.transform(base, lambda m: m["first_word"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("score"), "matches",
    )


QUERIES = {"op4_license": op4_license}
