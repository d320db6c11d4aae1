"""Best-fit packing of tokenised documents, planned on a histogram of lengths.

1. Documents become token ids and a closing id 0, and longer ones are cut into pieces of ``CAPACITY`` tokens of which only
   the first may be shorter. The rows of pieces (no text, no ids) are written once.
2. The histogram of piece lengths, at most ``CAPACITY`` rows, goes to the driver. Best fit decreasing works on counts of
   (room left, sequences): the longest length goes to the fullest open sequences that take it, whole ranges of them at a time,
   and to new ones where none does. A length splits few ranges, so the plan's size depends on ``CAPACITY`` alone.
3. Each piece has a rank among the pieces of its length, and takes the slot of that rank in the plan. Ranks are
   counted in salted groups and shifted by the sums of the groups before, so that a frequent length is no hot key.

Tokens are those of the given tokenizer file. Texts whose characters are all below U+0250 are encoded by a faster
implementation of the same vocabulary, which gives the same ids there (tests compare every such character, random strings
of them, and whole documents); other texts, and texts with special tokens, go through the tokenizer itself. ``ranks=None``
sends every text there.

Defined results: a null or empty text is the closing id alone. Repeated rows are packed once each. An empty table
gives no rows. Texts are encoded whole, one at a time. Columns of pieces named ``sequence_id`` and ``offset`` are replaced;
names that start with ``__pack_`` are reserved.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilstream.session import materialize

CAPACITY, CLOSING = 2048, 0
TOKENIZER, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Pieces of one length that a salted group holds on average at most.
GROUP_ROWS = 500
_FAST = re.compile("[\x00-ɏ]*")


class Encoder:
    """Ids of texts; made once per worker."""

    _made: dict[tuple, Encoder] = {}

    def __init__(self, tokenizer: str, ranks: str | None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(public_tokenizers.path(tokenizer))
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            with open(public_tokenizers.path(ranks), "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @classmethod
    def of(cls, tokenizer: str, ranks: str | None) -> Encoder:
        if (tokenizer, ranks) not in cls._made:
            cls._made[tokenizer, ranks] = cls(tokenizer, ranks)
        return cls._made[tokenizer, ranks]

    def ids(self, text: str) -> np.ndarray:
        if self.fast and _FAST.fullmatch(text) and not any(s in text for s in self.special):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, tokenizer: str = TOKENIZER, ranks: str | None = RANKS, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every piece."""
    schema = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer, ranks)
        for batch in batches:
            row, out, kept = [], ([], [], [], []), []
            for i, value in enumerate(batch.column(1)):
                ids = np.append(encoder.ids(value.as_py() or ""), CLOSING).astype("<u4")
                count = -(-len(ids) // capacity)
                cuts = [0, *range(len(ids) - capacity * (count - 1), len(ids) + 1, capacity)]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row.append(i)
                    for column, x in zip(out, (p, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        column.append(x)
                    if with_ids:
                        kept.append(ids[a:b].astype(np.int32))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Best fit decreasing over counts: for each length its slots as (first rank, pieces a sequence, first sequence, offset), and the number of sequences.

    Open sequences are kept as ranges by the room that they have left. The longest length goes first, each time to the range
    with the least room that takes it. A sequence that has room for several pieces of the length is then the fullest one
    for the next of them too, so it takes them all before the next sequence of its range takes any.
    """
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    open_: dict[int, list[tuple[int, int]]] = {}  # room to ranges of (first sequence, sequences)
    rooms: list[int] = []  # the same rooms, sorted
    sequences = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            insort(open_[room], (first, n))  # ties go to the first sequence

    for length in sorted((k for k, n in histogram.items() if n > 0), reverse=True):
        left, mine = histogram[length], []

        def fill(room: int, first: int, n: int) -> int:
            """Fill up to ``n`` sequences from ``first`` on; how many of them are touched."""
            nonlocal left
            rank, times = histogram[length] - left, room // length
            whole = min(n, left // times)
            if whole:
                mine.append((rank, times, first, capacity - room))
                put(room - times * length, first, whole)
                left -= whole * times
            if whole == n or not left:
                return whole
            mine.append((histogram[length] - left, left, first + whole, capacity - room))  # the last pieces, fewer than fit
            put(room - left * length, first + whole, 1)
            left = 0
            return whole + 1

        while left and (at := bisect_left(rooms, length)) < len(rooms):
            room = rooms.pop(at)
            for first, n in open_.pop(room):
                used = fill(room, first, n) if left else 0
                put(room, first + used, n - used)
        if left:
            sequences += fill(capacity, sequences, -(-left // (capacity // length)))
        slots[length] = mine
    return slots, sequences


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with the sequence and the offset that they take; ``length`` is at most ``capacity``. Further columns stay."""
    rows = materialize(pieces.withColumn("__pack_place", F.monotonically_increasing_id()), "pieces")
    counts = rows.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    slots, _ = plan({int(r["length"]): r["n"] for r in counts}, capacity)
    groups = rows.sparkSession.createDataFrame([(int(r["length"]), -(-r["n"] // GROUP_ROWS)) for r in counts], "length long, __pack_groups long")
    salt = F.pmod(F.xxhash64("__pack_place"), F.col("__pack_groups"))
    salted = rows.join(F.broadcast(groups), "length").withColumn("__pack_salt", salt).drop("__pack_groups")
    before = Window.partitionBy("length").orderBy("__pack_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = salted.groupBy("length", "__pack_salt").agg(F.count("*").alias("n")).withColumn("__pack_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("length", "__pack_salt").orderBy("__pack_place")) - 1
    ranked = salted.withColumn("__pack_rank", rank).join(shift, ["length", "__pack_salt"]).withColumn("__pack_rank", F.col("__pack_rank") + F.col("__pack_before"))
    ranked = ranked.select(*[F.col(f"`{c}`") for c in pieces.columns], F.col("__pack_rank").cast("long").alias("__pack_rank"))
    tables = {k: np.array(v, np.int64).reshape(-1, 4) for k, v in slots.items()}
    schema = ranked.drop("__pack_rank", "sequence_id", "offset").select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("__pack_rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(length[order]) != 0))
            for some in np.split(order, cuts[1:]) if len(order) else []:
                table = tables[int(length[some[0]])]
                slot = table[np.searchsorted(table[:, 0], rank[some], "right") - 1]
                nth = rank[some] - slot[:, 0]
                sequence[some] = slot[:, 2] + nth // slot[:, 1]
                offset[some] = slot[:, 3] + nth % slot[:, 1] * length[some]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(run, schema)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenised and packed into sequences of 2,048 tokens."""
    return pack(pieces_of(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


QUERIES = {"op9_packing": op9_packing}
