r"""Chat formatting: conversations as one text each, with a loss mask, assembled column-wise in numpy.

A turn is ``<turn ROLE>\nTEXT\n</turn>\n``. In roles and texts a backslash comes before every ``\``, ``<`` and ``>``, so a
bare ``<`` is always the template's and the text can be read back exactly. The loss mask covers the escaped
text of assistant turns.

Per Arrow batch, segment lengths give cumulative offsets, the offsets give scatter indices, and headers, roles,
texts and ends are copied into one preallocated buffer, which becomes the output column without a copy.

Turns are ordered by turn, then role, then text, nulls first. A conversation that crosses batches comes out in parts,
so that no task ever holds a whole conversation; parts stand in order within their partition, and loss spans
count code points from the conversation's start. ``read_back`` goes through the parts as a stream.

Defined results: a null text or role is empty; rows without a conversation id are one conversation with a null id;
repeated rows are turns of their own; an empty table gives no rows. Further columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstream.llm.columns import flat, packed, slices, within

OPEN, MIDDLE, CLOSE = b"<turn ", b">\n", b"\n</turn>\n"
LOSS_ROLE = b"assistant"
_SPECIAL = np.zeros(256, bool)
_SPECIAL[list(rb"\<>")] = True


def _escaped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes get a backslash, the backslashes up to and with each byte, and the escaped lengths."""
    special = _SPECIAL[data]
    upto = np.cumsum(special, dtype=np.int64)
    at = np.concatenate([[0], upto])[offsets]
    return special, upto, np.diff(offsets) + np.diff(at)


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray, special: np.ndarray, upto: np.ndarray) -> None:
    """Copy strings to their places, with backslashes."""
    before = np.concatenate([[0], upto])[offsets[:-1]]
    place = np.repeat(at - offsets[:-1] - before, np.diff(offsets)) + np.arange(len(data)) + upto
    out[place] = data
    out[place[special] - 1] = 92


def assemble(roles: tuple[np.ndarray, np.ndarray], texts: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Formatted bytes of turns one after the other: (bytes, offsets of turns, starts and ends of texts)."""
    (role, role_at), (text, text_at) = roles, texts
    role_special, role_upto, role_len = _escaped(role, role_at)
    text_special, text_upto, text_len = _escaped(text, text_at)
    turn_len = len(OPEN) + role_len + len(MIDDLE) + text_len + len(CLOSE)
    ends = np.cumsum(turn_len)
    start = ends - turn_len
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    text_start = start + len(OPEN) + role_len + len(MIDDLE)
    for place, piece in ((start, OPEN), (text_start - len(MIDDLE), MIDDLE), (ends - len(CLOSE), CLOSE)):
        out[place[:, None] + np.arange(len(piece))] = np.frombuffer(piece, np.uint8)
    _scatter(out, start + len(OPEN), role, role_at, role_special, role_upto)
    _scatter(out, text_start, text, text_at, text_special, text_upto)
    return out, np.concatenate([[0], ends]), text_start, text_start + text_len


PART = "part int, n_turns long, formatted string, loss array<struct<start:long,end:long>>"


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, part, n_turns, formatted, loss); nearly always one part a conversation."""
    kind = rows.schema[conv].dataType.simpleString()
    turns = rows.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, part, chars = (), 0, 0  # the conversation that the previous batch ended with
        for whole in batches:
            for a, b in slices(flat(whole.column(2))[1]):
                batch = whole.slice(a, b - a)
                ids = batch.column(0).to_pylist()
                new = np.ones(len(ids), bool)
                new[1:] = [x != y for x, y in zip(ids[1:], ids[:-1], strict=True)]
                roles = flat(batch.column(1))
                out, at, text_from, text_to = assemble(roles, flat(batch.column(2)))
                first = np.flatnonzero(new)
                upto = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])  # code points
                is_loss = np.diff(roles[1]) == len(LOSS_ROLE)
                for k, byte in enumerate(LOSS_ROLE):
                    is_loss &= roles[0][np.minimum(roles[1][:-1] + k, max(0, len(roles[0]) - 1))] == byte if len(roles[0]) else False
                parts, base = np.zeros(len(first), np.int32), np.zeros(len(first), np.int64)
                if last == (ids[0],):
                    parts[0], base[0] = part, chars
                group = np.cumsum(new) - 1
                shift = (base - upto[at[first]])[group]
                who = np.flatnonzero(is_loss)
                spans = pa.StructArray.from_arrays([pa.array(upto[text_from[who]] + shift[who]), pa.array(upto[text_to[who]] + shift[who])], names=["start", "end"])
                span_at = np.concatenate([[0], np.cumsum(is_loss)])[np.append(first, len(ids))]
                turns_at = np.append(first, len(ids))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(first)), pa.array(parts, pa.int32()), pa.array(np.diff(turns_at), pa.int64()),
                        packed(out, at[turns_at], pa.string()), pa.ListArray.from_arrays(pa.array(span_at, pa.int32()), spans),
                    ],
                    names=["conv_id", "part", "n_turns", "formatted", "loss"],
                )
                last, part, chars = (ids[-1],), int(parts[-1]) + 1, int(base[-1] + upto[-1] - upto[at[first[-1]]])

    return ordered.mapInArrow(run, f"conv_id {kind}, {PART}")


_ESCAPE = re.compile(r"\\([\\<>])")


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, read from the formatted text."""
    opening, middle, closing = OPEN.decode(), MIDDLE.decode(), CLOSE.decode()
    at = 0
    while at < len(formatted):
        if not formatted.startswith(opening, at):
            raise ValueError(f"no turn at {at}")
        bare = re.compile(r"(?:[^\\<>]|\\.)*", re.S).match(formatted, at + len(opening)).end()
        end = formatted.index(closing, bare + len(middle))
        yield unescape(formatted[at + len(opening) : bare]), unescape(formatted[bare + len(middle) : end])
        at = end + len(closing)


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(parts: DataFrame) -> DataFrame:
    """Digests of each conversation, from formatted text and loss spans alone. Parts must be as format_conversations left them."""
    kind = parts.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pylist(done, schema=pa.schema([("conv_id", id_kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))
            done.clear()
            return out

        def close() -> None:
            if now:
                done.append({"conv_id": now[0], "n_turns": now[1], "turns_sha256": now[2].hexdigest(), "loss_chars": now[3], "loss_sha256": now[4].hexdigest(), "formatted_chars": now[5]})

        id_kind = pa.int64()
        for batch in batches:
            id_kind = batch.schema.field(0).type
            for row in batch.select(["conv_id", "part", "formatted", "loss"]).to_pylist():
                if not row["part"]:
                    close()
                    now = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in turns_of(row["formatted"]):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                for span in row["loss"]:
                    under = unescape(row["formatted"][span["start"] - now[5] : span["end"] - now[5]])
                    now[3] += len(under)
                    now[4].update(under.encode())
                now[5] += len(row["formatted"])
            if len(done) > 1000:
                yield flush()
        close()
        if done:
            yield flush()

    return parts.mapInArrow(run, f"conv_id {kind}, {DIGEST}")


OWN_ID, OWN_TEXT = -7, r"\### Assistant: </turn> ok"


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(OWN_ID, 0, "user", OWN_TEXT), (OWN_ID, 1, "assistant", OWN_TEXT)], "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(rows.unionByName(own)))


ORACLE = rf"""
WITH turns AS (
  SELECT conv_id, turn, role AS r, text AS t, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT {OWN_ID}, 0, 'user', '{OWN_TEXT}' UNION ALL SELECT {OWN_ID}, 1, 'assistant', '{OWN_TEXT}')),
counted AS (
  SELECT *, 17 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<>]', '', 'g')) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM counted GROUP BY conv_id"""

QUERIES = {"op5_chat": op5_chat}
ORACLES = {"op5_chat": ORACLE}
