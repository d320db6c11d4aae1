"""Media columns: baseline JPEG written and read in numpy.

``encode_media`` stores bytes losslessly as gray baseline JPEG. The format's unit is the quantised coefficient: every
byte is the DC coefficient of one 8x8 block (quantiser 8, so the block's mean sample is the byte itself), AC is empty.
An image is 64 blocks wide; each row of 64 blocks is a restart interval. Huffman codes are laid out so that code and
extra bits of a DC difference always have 9 bits together and the end of block has one: a row takes 80 bytes. Images
hold up to 8,191 rows; a longer payload is several images, one after the other. A comment segment has the length.

``decode_luma`` parses markers of any baseline JPEG (SOF0, 8 bits, any sampling, tables and restart intervals) and
Huffman-decodes the luminance scan; all restart intervals of all images of a batch advance together, one block of each
at a time, as numpy vectors. It reconstructs the DC-only thumbnail (an eighth of the size) and skips AC.

Defined results: a null or empty text is one row of zeros. Equal texts have equal media. What isn't baseline JPEG
decodes to None and has null features; so do headers that contradict themselves, images that declare more blocks than their
scan has bits for, and scans that end or break off before their blocks do. A block takes two bits at least, so work and
memory are bounded by the bytes there are, whatever a header declares. A batch is cut into slices of a few MB; a longer text is handled alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilstream.llm.columns import flat, packed, slices, within

UNIT, ROW_BYTES, MAX_ROWS = 64, 80, 8191


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header() -> bytes:
    dc = bytes([0, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]) + bytes(range(8, -1, -1))
    ac = bytes([0x10, 1] + [0] * 15) + bytes([0])
    return b"".join([
        b"\xff\xd8", _segment(0xFE, b"bytes" + bytes(8)), _segment(0xDB, bytes([0] + [8] * 64)),
        _segment(0xC0, struct.pack(">BHHB3B", 8, 0, UNIT * 8, 1, 1, 0x11, 0)),
        _segment(0xC4, dc), _segment(0xC4, ac), _segment(0xDD, struct.pack(">H", UNIT)), _segment(0xDA, bytes([1, 1, 0, 0, 63, 0])),
    ])


HEADER = np.frombuffer(_header(), np.uint8)
_LENGTH_AT, _HEIGHT_AT = 2 + 4 + 5, HEADER.tobytes().index(b"\xff\xc0") + 5


def _words() -> np.ndarray:
    """Ten bits of a difference from -255 to 255: (8 - size) ones, a zero, the extra bits, and the end of block."""
    out = np.zeros(511, np.uint16)
    for v in range(-255, 256):
        s = abs(v).bit_length()
        prefix = ((1 << (8 - s)) - 1) << 1
        out[v + 255] = ((prefix << s) | (v if v >= 0 else v + (1 << s) - 1)) << 1
    return out


WORDS = _words()


def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """JPEG bytes of each payload, as (bytes, offsets)."""
    n_bytes = np.diff(offsets)
    rows = np.maximum(1, -(-n_bytes // UNIT))
    row_at = np.cumsum(rows) - rows
    payload = np.zeros(int(rows.sum()) * UNIT, np.uint8)
    payload[within(row_at * UNIT, n_bytes)] = data
    blocks = payload.reshape(-1, UNIT).astype(np.int16)
    diff = np.empty_like(blocks)
    diff[:, 0] = blocks[:, 0] - 128
    np.subtract(blocks[:, 1:], blocks[:, :-1], out=diff[:, 1:])
    words = WORDS[diff + 255].reshape(len(blocks), 16, 4).astype(np.uint64)
    five = (words[..., 0] << 30) | (words[..., 1] << 20) | (words[..., 2] << 10) | words[..., 3]
    body = np.empty((len(blocks), 16, 5), np.uint8)
    for k in range(5):
        body[..., k] = (five >> (32 - 8 * k)) & 255
    body = body.reshape(len(blocks), ROW_BYTES)

    images = -(-rows // MAX_ROWS)
    image_doc = np.repeat(np.arange(len(rows)), images)
    image_no = within(np.zeros(len(rows), np.int64), images)
    image_rows = np.minimum(MAX_ROWS, rows[image_doc] - image_no * MAX_ROWS)
    first_row = row_at[image_doc] + image_no * MAX_ROWS
    row_no = within(np.zeros(len(image_rows), np.int64), image_rows)
    row_image = np.repeat(np.arange(len(image_rows)), image_rows)
    last = row_no == image_rows[row_image] - 1

    full = body == 255
    stuffed = full.sum(1)
    row_len = ROW_BYTES + stuffed + 2
    lead = np.zeros(len(blocks), np.int64)
    lead[first_row] = len(HEADER)
    row_end = np.cumsum(row_len + lead)
    start = row_end - row_len
    out = np.zeros(int(row_end[-1]) if len(row_end) else 0, np.uint8)
    shift = np.cumsum(full, axis=1, dtype=np.int32)
    shift -= full
    out[(start[:, None] + np.arange(ROW_BYTES)) + shift] = body
    out[row_end - 2] = 255
    out[row_end - 1] = np.where(last, 0xD9, 0xD0 + row_no % 8)
    head = np.tile(HEADER, (len(image_rows), 1))
    head[:, _HEIGHT_AT] = (image_rows * 8) >> 8
    head[:, _HEIGHT_AT + 1] = (image_rows * 8) & 255
    for k in range(8):
        head[:, _LENGTH_AT + k] = (n_bytes[image_doc] >> (56 - 8 * k)) & 255
    out[(start[first_row] - len(HEADER))[:, None] + np.arange(len(HEADER))] = head
    ends = row_end[row_at + rows - 1] if len(rows) else row_end
    return out, np.concatenate([[0], ends])


@dataclass
class Image:
    """What the markers say; ``scan`` is where the entropy-coded luminance data lies."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantiser
    quantisers: dict[int, int] = field(default_factory=dict)
    tables: dict[tuple[int, int], bytes] = field(default_factory=dict)
    restart: int = 0
    order: list[tuple[int, int, int]] = field(default_factory=list)  # of an MCU's blocks: is luminance, DC, AC table
    alone: bool = False
    scan: tuple[int, int] = (0, 0)
    comment: bytes = b""


def parse(data: bytes, at: int, end: int, scan_end) -> tuple[Image | None, int]:
    """One image from ``at``: its markers, and where it ends. scan_end(i) is the first real marker from i on."""
    if data[at : at + 2] != b"\xff\xd8":
        return None, end
    image, i = Image(), at + 2
    while i + 4 <= end and data[i] == 0xFF:
        marker = data[i + 1]
        if marker == 0xFF:
            i += 1
            continue
        if marker == 0xD9:
            return (image if image.scan[1] else None), i + 2
        n = int.from_bytes(data[i + 2 : i + 4], "big")
        body = data[i + 4 : i + 2 + n]
        i += 2 + n
        if n < 2 or i > end:
            return None, end
        if marker == 0xFE:
            image.comment = image.comment or body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quantisers[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC0:
            if image.components:
                return None, end
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            image.components = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            if body[0] != 8 or not image.width or not image.height or not all(1 <= x <= 4 for _, h, v, _ in image.components for x in (h, v)):
                return None, end
        elif marker == 0xC4:
            while body:
                count = sum(body[1:17])
                if len(body) < 17 + count or sum(n << (16 - length) for length, n in enumerate(body[1:17], 1)) > 1 << 16:
                    return None, end  # symbols are missing, or more codes than there are
                image.tables[body[0] >> 4, body[0] & 15] = body[1 : 17 + count]
                body = body[17 + count :]
        elif marker == 0xDD:
            image.restart = int.from_bytes(body[:2], "big")
        elif 0xC0 < marker < 0xD0:
            return None, end  # not baseline
        elif marker == 0xDA:
            stop = min(scan_end(i), end)
            chosen = {body[k]: body[k + 1] for k in range(1, 1 + 2 * body[0], 2)}
            if image.components and image.components[0][0] in chosen and not image.scan[1]:
                image.alone = len(chosen) == 1
                for c, (cid, h, v, _) in enumerate(image.components):
                    if cid in chosen:
                        image.order += [(c == 0, chosen[cid] >> 4, chosen[cid] & 15)] * (1 if image.alone else h * v)
                image.scan = (i, stop)
            i = stop
    return (image if image.scan[1] else None), end


_LOOKUPS: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """By 16 bits: code length << 8 | symbol; 0 where no code fits."""
    if table not in _LOOKUPS:
        out, code, k = np.zeros(65536, np.int32), 0, 16
        for length in range(1, 17):
            for _ in range(table[length - 1]):
                out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | table[k]
                code, k = code + 1, k + 1
            code <<= 1
        if len(_LOOKUPS) > 256:
            _LOOKUPS.clear()
        _LOOKUPS[table] = out
    return _LOOKUPS[table]


def _geometry(image: Image) -> tuple[int, int, int, int, int, int]:
    """MCU rows and columns, luminance blocks of an MCU (rows, columns), and of the thumbnail (rows, columns)."""
    _, h, v, _ = image.components[0]
    most_h, most_v = max(c[1] for c in image.components), max(c[2] for c in image.components)
    wide, high = -(-image.width * h // most_h), -(-image.height * v // most_v)
    if image.alone:
        return -(-high // 8), -(-wide // 8), 1, 1, -(-high // 8), -(-wide // 8)
    return -(-image.height // (8 * most_v)), -(-image.width // (8 * most_h)), v, h, -(-high // 8), -(-wide // 8)


def _holds(image: Image) -> bool:
    """Are all tables there, and two bits for each declared block?"""
    if any((0, dc) not in image.tables or (1, ac) not in image.tables for _, dc, ac in image.order) or image.components[0][3] not in image.quantisers:
        return False
    rows, cols, *_ = _geometry(image)
    return rows * cols * len(image.order) <= 4 * (image.scan[1] - image.scan[0])


def decode_luma(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[Image, np.ndarray]] | None]:
    """For each row its images with their DC-only luminance thumbnails (uint8), or None."""
    raw = data.tobytes()
    ff = np.flatnonzero(data[:-1] == 255) if len(data) else np.zeros(0, np.int64)
    follow = data[ff + 1]
    is_restart = (follow >= 0xD0) & (follow <= 0xD7)
    real = ff[(follow != 0) & (follow != 255) & ~is_restart]
    scan_end = lambda i: int(real[k]) if (k := np.searchsorted(real, i)) < len(real) else len(raw)
    images: list[tuple[int, Image]] = []
    bad: set[int] = set()
    for d in range(len(offsets) - 1):
        at, end = int(offsets[d]), int(offsets[d + 1])
        if at == end:
            bad.add(d)
        while at < end:
            try:
                image, at = parse(raw, at, end, scan_end)
                if image is None or not _holds(image):
                    raise ValueError
                images.append((d, image))
            except (ValueError, IndexError, struct.error):
                bad.add(d)
                break
    out: list[list | None] = [None if d in bad else [] for d in range(len(offsets) - 1)]
    images = [x for x in images if x[0] not in bad]
    if not images:
        return out
    thumbs = _decode_scans(data, ff, follow, is_restart, [x for _, x in images])
    for (d, image), thumb in zip(images, thumbs, strict=True):
        if thumb is None:
            out[d] = None
        elif out[d] is not None:
            out[d].append((image, thumb))
    return out


def _decode_scans(data, ff, follow, is_restart, images: list[Image]) -> list[np.ndarray | None]:
    starts, ends = np.array([x.scan[0] for x in images]), np.array([x.scan[1] for x in images])
    # The scans alone, without stuffing and restart markers, as one stream; lanes begin at scans and after markers.
    keep = np.zeros(len(data) + 1, np.int8)
    np.add.at(keep, starts, 1)
    np.add.at(keep, ends, -1)
    keep = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
    marks = ff[is_restart]
    marks = marks[keep[marks]]
    lane_from = np.concatenate([starts, marks + 2])
    lane_image = np.concatenate([np.arange(len(images)), np.searchsorted(starts, marks, "right") - 1])
    order = np.argsort(lane_from, kind="stable")
    lane_from, lane_image = lane_from[order], lane_image[order]
    keep[marks] = keep[marks + 1] = False
    keep[ff[follow == 0] + 1] = False
    new_at = np.cumsum(keep) - keep
    lane_at = np.append(new_at, keep.sum())[lane_from]
    lane_end = np.append(lane_at[1:], keep.sum()) * 8  # kept bytes are one stream, so a lane ends where the next begins
    stream = np.concatenate([data[keep], np.zeros(16, np.uint8)])
    window = np.zeros(len(stream) - 8, np.uint64)
    for k in range(8):
        window |= stream[k : len(stream) - 8 + k].astype(np.uint64) << np.uint64(56 - 8 * k)

    shapes = [_geometry(x) for x in images]
    mcus = np.array([s[0] * s[1] for s in shapes])
    per_mcu = np.array([len(x.order) for x in images])
    every = np.array([x.restart for x in images])
    first_lane = np.searchsorted(lane_image, np.arange(len(images)))
    lane_no = np.arange(len(lane_image)) - first_lane[lane_image]
    step = np.where(every[lane_image] > 0, every[lane_image], mcus[lane_image])
    lane_mcus = np.clip(mcus[lane_image] - lane_no * step, 0, step)
    lane_blocks = lane_mcus * per_mcu[lane_image]
    found = np.bincount(lane_image, lane_mcus, len(images)).astype(np.int64)

    tables: dict[bytes, int] = {}
    patterns: dict[tuple, int] = {}
    shape_of = np.empty(len(images), np.int64)
    for i, x in enumerate(images):
        key = tuple((luma, tables.setdefault(x.tables[0, dc], len(tables)), tables.setdefault(x.tables[1, ac], len(tables))) for luma, dc, ac in x.order)
        shape_of[i] = patterns.setdefault(key, len(patterns))
    lookup = np.stack([_lookup(t) for t in tables]).ravel()
    widest = max(len(p) for p in patterns)
    layout = np.zeros((len(patterns), widest, 3), np.int64)
    for p, k in patterns.items():
        layout[k, : len(p)] = p

    by_length = np.argsort(-lane_blocks, kind="stable")
    counts, pos, stop = lane_blocks[by_length], lane_at[by_length] * 8, lane_end[by_length]
    image_of = lane_image[by_length]
    shape, width = shape_of[image_of], per_mcu[image_of]
    same, solid = len(patterns) == 1, len(patterns) == 1 and widest == 1
    pred = np.zeros(len(counts), np.int64)
    base = np.cumsum(counts) - counts
    values = np.zeros(int(counts.sum()), np.int16)
    broken, dead = np.zeros(len(images), bool), np.zeros(len(counts), bool)
    limit = len(window) * 8 - 1
    for b in range(int(counts[0]) if len(counts) else 0):
        live = int(np.searchsorted(-counts, -b, "left"))
        p = pos[:live]
        if same:
            luma, dc, ac = (layout[0, b % widest]).tolist()
        else:
            luma, dc, ac = layout[shape[:live], b % width[:live]].T
        peek = window[np.minimum(p, limit) >> 3] << (p & 7).astype(np.uint64)
        code = lookup[(peek >> np.uint64(48)).astype(np.int64) + dc * 65536]
        size, extra = code >> 8, code & 255
        if not size.all() or (extra > 11).any():
            lost = (size == 0) | (extra > 11)
            broken[image_of[:live][lost]] = True
            extra = np.where(lost, 0, extra)
        bits = ((peek << size.astype(np.uint64)) >> np.uint64(1) >> (63 - extra).astype(np.uint64)).astype(np.int64)
        diff = np.where(bits < (1 << extra >> 1), bits - (1 << extra) + 1, bits)
        p = p + size + extra
        if solid:
            pred[:live] += diff
            values[base[:live] + b] = pred[:live]
        else:  # prediction of luminance alone; other components are passed over
            mine = np.broadcast_to(luma, live).astype(bool)
            pred[:live] += np.where(mine, diff, 0)
            values[base[:live] + b] = pred[:live]
        who, k = None, 1
        while True:  # AC: one symbol of each block that hasn't ended
            at = p if who is None else p[who]
            peek = window[np.minimum(at, limit) >> 3] << (at & 7).astype(np.uint64)
            table = ac if same or who is None else ac[who]
            code = lookup[(peek >> np.uint64(48)).astype(np.int64) + table * 65536]
            size, symbol = code >> 8, code & 255
            moved = at + size + (symbol & 15)
            if who is None:
                p = moved
            else:
                p[who] = moved
            k = k + np.where(symbol == 0, 64, (symbol >> 4) + 1)
            if not size.all():
                broken[image_of[:live][size == 0] if who is None else image_of[:live][who[size == 0]]] = True
                k = np.where(size == 0, 64, k)
            more = np.flatnonzero(k < 64)
            if not len(more):
                break
            who, k = (more if who is None else who[more]), k[more]
        pos[:live] = p
        over = p > stop[:live]
        if over.any():  # past the end of the scan or the restart interval
            dead[:live] |= over
            broken[image_of[:live][over]] = True
            if dead[:live].all():
                break

    # Back from lanes by length to images in order, then to the thumbnail's geometry.
    lane_base = np.empty(len(counts), np.int64)
    lane_base[by_length] = base
    ordered = values[within(lane_base, lane_blocks)]
    image_blocks = found * per_mcu
    at = np.cumsum(image_blocks) - image_blocks
    out: list[np.ndarray | None] = []
    for i, (image, (rows, cols, v, h, high, wide)) in enumerate(zip(images, shapes, strict=True)):
        if broken[i] or found[i] != mcus[i]:
            out.append(None)
            continue
        blocks = ordered[at[i] : at[i] + image_blocks[i]]
        if len(image.order) > 1:
            blocks = blocks.reshape(-1, len(image.order))[:, : v * h]
        grid = blocks.reshape(rows, cols, v, h).transpose(0, 2, 1, 3).reshape(rows * v, cols * h)[:high, :wide]
        quantiser = image.quantisers[image.components[0][3]]
        samples = grid + 128 if quantiser == 8 else np.rint(grid.astype(np.float64) * quantiser / 8 + 128)
        out.append(np.clip(samples, 0, 255).astype(np.uint8))
    return out


def average_hash(thumb: np.ndarray) -> str:
    """64 bits, row by row: is the mean of a cell of an 8x8 grid above the mean of all cells?"""
    sums = np.zeros((thumb.shape[0] + 1, thumb.shape[1] + 1), np.int64)
    np.cumsum(np.cumsum(thumb, axis=0, dtype=np.int64), axis=1, out=sums[1:, 1:])
    cut = lambda n: (np.arange(8) * n // 8, np.maximum(np.arange(8) * n // 8 + 1, np.arange(1, 9) * n // 8))
    (r0, r1), (c0, c1) = cut(thumb.shape[0]), cut(thumb.shape[1])
    cells = (sums[np.ix_(r1, c1)] - sums[np.ix_(r0, c1)] - sums[np.ix_(r1, c0)] + sums[np.ix_(r0, c0)]) / np.outer(r1 - r0, c1 - c0)
    return np.packbits(cells > cells.mean()).tobytes().hex()


def encode_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with a column of JPEG bytes that hold the text's UTF-8; a column of that name is replaced."""
    docs = docs.withColumn(media, F.col(text))
    schema = T.StructType([T.StructField(f.name, T.BinaryType() if f.name == media else f.dataType) for f in docs.schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(media)
            data, offsets = flat(batch.column(k))
            for i, j in slices(offsets):
                out, at = encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                part = batch.slice(i, j - i)
                columns = [packed(out, at, pa.binary()) if c == k else part.column(c) for c in range(batch.num_columns)]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_features(rows: DataFrame, doc_id: str = "doc_id", media: str = "media") -> DataFrame:
    """(doc_id, ...): what the stored bytes hold, read back: the payload's digest, the thumbnail's size and hash."""
    schema = f"doc_id {rows.schema[doc_id].dataType.simpleString()}, {FEATURES}, width long, height long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            for i, j in slices(offsets):
                part = data[offsets[i] : offsets[j]]
                at = offsets[i : j + 1] - offsets[i]
                out = []
                for d, images in enumerate(decode_luma(part, at)):
                    stored = part[at[d] : at[d + 1]]
                    said = (len(stored), hashlib.sha256(stored).hexdigest())
                    if images is None:
                        out.append((None, None, None, None, *said, None, None, None))
                        continue
                    comment = images[0][0].comment
                    width, height = images[0][0].width, sum(x.height for x, _ in images)
                    own = comment.startswith(b"bytes") and len(comment) == 13
                    thumb = images[0][1] if len(images) == 1 else np.concatenate([t for _, t in images]) if len({t.shape[1] for _, t in images}) == 1 else images[0][1]
                    payload = thumb.tobytes()
                    n = int.from_bytes(comment[5:], "big") if own else len(payload)
                    out.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), *said, f"{width}x{height}:{average_hash(thumb)}", width, height))
                columns = list(zip(*out, strict=True)) if out else [[]] * 9
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])

    return rows.select(F.col(doc_id).alias("doc_id"), F.col(media).alias("media")).mapInArrow(run, schema)


def op7_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as JPEG, read back, with the features of what was read."""
    return media_features(encode_media(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


QUERIES = {"op7_jpeg": op7_jpeg}
