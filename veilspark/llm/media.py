"""Media columns: baseline JPEG in numpy.

Storing: a payload is the DC thumbnail of a grey image 24 thumbnail pixels wide.
Each byte is the flat value of one 8x8 block, which baseline JPEG holds without loss (DC
quantiser 8, no AC coefficient), and each row of blocks is a restart interval.

Reading: markers are parsed, Huffman codes are decoded for all restart intervals
of a slice of files at once (one lane each), and the luminance DC values give
the thumbnail. Any baseline file is read so: several components, sampling
factors, AC coefficients, with or without restart markers.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import runtime as R

#: Payloads are padded to a multiple of UNIT bytes, that is of square thumbnails of WIDTH pixels.
WIDTH, UNIT, FILL = 24, 576, 255
#: Thumbnail rows in one image; JPEG heights are below 65,536. Longer payloads are several images in a row.
MAX_ROWS = 8160
#: Huffman code lengths of the DC size categories 2..7, then 0, 1 and 8 (the code of ones only stays free).
_CATEGORIES = ((2, 3), (3, 3), (4, 3), (5, 3), (6, 3), (7, 3), (0, 4), (1, 4), (8, 4))


def _dc_codes() -> tuple[np.ndarray, np.ndarray]:
    """(code, length) by size category, canonical."""
    code, length, nxt, last = np.zeros(9, np.int64), np.zeros(9, np.int64), 0, 3
    for cat, n in _CATEGORIES:
        nxt <<= n - last
        code[cat], length[cat], last = nxt, n, n
        nxt += 1
    return code, length


_CODE, _LENGTH = _dc_codes()
_DIFF = np.arange(-255, 256)
_SIZE = np.array([int(abs(d)).bit_length() for d in _DIFF])
#: Bits and their number for each DC difference: category code, its extra bits, and the one-bit end of block.
_BITS = ((_CODE[_SIZE] << _SIZE) | np.where(_DIFF < 0, _DIFF + (1 << _SIZE) - 1, _DIFF)) << 1
_COUNT = _LENGTH[_SIZE] + _SIZE + 1


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@lru_cache(maxsize=1024)
def _header(rows: int) -> bytes:
    lengths = [sum(n == k for _, n in _CATEGORIES) for k in range(1, 17)]
    return b"".join([
        b"\xff\xd8",
        _segment(0xE0, b"JFIF\0" + struct.pack(">HBHHBB", 0x0101, 0, 1, 1, 0, 0)),
        _segment(0xDB, bytes([0, 8] + [1] * 63)),
        _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, WIDTH * 8, 1) + bytes([1, 0x11, 0])),
        _segment(0xC4, bytes([0x00, *lengths, *[c for c, _ in _CATEGORIES]])),
        _segment(0xC4, bytes([0x10, 1, *[0] * 15, 0])),
        _segment(0xDD, struct.pack(">H", WIDTH)),
        _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
    ])


def padded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Payloads (bytes, offsets): each text and as many bytes FILL as a positive multiple of UNIT needs."""
    n = np.diff(off)
    size = np.maximum(1, -(-n // UNIT)) * UNIT
    to = np.r_[0, np.cumsum(size)]
    out = np.full(to[-1], FILL, np.uint8)
    out[np.arange(len(data)) + np.repeat(to[:-1] - off[:-1], n)] = data
    return out, to


def encode(payload: np.ndarray, off: np.ndarray) -> list[bytes]:
    """The stored form of each payload (a positive multiple of UNIT bytes): baseline JPEG images, one after the other."""
    lanes = payload.reshape(-1, WIDTH).astype(np.int64)
    diff = np.diff(lanes, axis=1, prepend=128)
    bits, count = _BITS[diff + 255], _COUNT[diff + 255]
    within = np.cumsum(count, 1)
    total = within[:, -1]
    size = (total + 7) >> 3
    at = np.r_[0, np.cumsum(size)]
    place = (within - count + 8 * at[:-1, None]).ravel()
    shifted = bits.ravel() << (24 - count.ravel() - (place & 7))
    body = np.zeros(at[-1] + 3)
    for k in range(3):
        body += np.bincount((place >> 3) + k, (shifted >> (16 - 8 * k)) & 255, len(body))
    body = body[: at[-1]].astype(np.uint8)
    body[at[1:] - 1] |= ((1 << (8 * size - total)) - 1).astype(np.uint8)
    # a zero after each byte 255, and a marker after each lane
    row0 = off // WIDTH
    lane_in_text = np.arange(len(lanes)) - np.repeat(row0[:-1], np.diff(row0))
    rows_left = np.repeat(row0[1:], np.diff(row0)) - np.arange(len(lanes))
    full = body == 255
    stuffed = np.r_[0, np.cumsum(full)]
    lane_of = np.repeat(np.arange(len(lanes)), size)
    to = np.arange(len(body)) + stuffed[:-1] + 2 * lane_of
    out = np.zeros(len(body) + stuffed[-1] + 2 * len(lanes), np.uint8)
    out[to] = body
    end = at[1:] + stuffed[at[1:]] + 2 * np.arange(len(lanes))
    out[end] = 255
    in_image = lane_in_text % MAX_ROWS
    last = (in_image == MAX_ROWS - 1) | (rows_left == 1)
    out[end + 1] = np.where(last, 0xD9, 0xD0 + in_image % 8)
    end += 2
    raw, done = out.tobytes(), []
    for a, b in zip(row0.tolist(), row0[1:].tolist()):
        images = []
        for i in range(a, b, MAX_ROWS):
            j = min(b, i + MAX_ROWS)
            images += [_header(j - i), raw[0 if i == 0 else end[i - 1] : end[j - 1]]]
        done.append(b"".join(images))
    return done


@dataclass
class Image:
    """What the markers of one image say, and its entropy-coded bytes."""

    width: int = 0
    height: int = 0
    quant: dict[int, int] = field(default_factory=dict)  # DC quantiser by table
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, table
    tables: dict[int, bytes] = field(default_factory=dict)  # by class and id
    interval: int = 0
    scan: list[tuple[int, int]] = field(default_factory=list)  # component index, DC and AC table
    body: bytes = b""


def parse(data: bytes) -> list[Image]:
    """The images of a stored form. Files that aren't baseline or break off raise ValueError."""
    images, p = [], 0
    while p < len(data):
        if data[p : p + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        image, p = Image(), p + 2
        while not image.body:
            if p + 4 > len(data) or data[p] != 0xFF:
                raise ValueError("broken marker")
            marker, size = data[p + 1], int.from_bytes(data[p + 2 : p + 4], "big")
            if marker == 0xFF:
                p += 1
                continue
            seg, p = data[p + 4 : p + 2 + size], p + 2 + size
            if marker == 0xDB:
                while seg:
                    wide, t = seg[0] >> 4, seg[0] & 15
                    image.quant[t] = int.from_bytes(seg[1 : 2 + wide], "big")
                    seg = seg[1 + 64 * (1 + wide) :]
            elif marker == 0xC0:
                _, image.height, image.width, n = struct.unpack(">BHHB", seg[:6])
                image.components = [(seg[6 + 3 * k], seg[7 + 3 * k] >> 4, seg[7 + 3 * k] & 15, seg[8 + 3 * k]) for k in range(n)]
            elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                raise ValueError("not baseline")
            elif marker == 0xC4:
                while seg:
                    n = 17 + sum(seg[1:17])
                    image.tables[seg[0]], seg = seg[1:n], seg[n:]
            elif marker == 0xDD:
                image.interval = int.from_bytes(seg[:2], "big")
            elif marker == 0xDA:
                ids = [c[0] for c in image.components]
                image.scan = [(ids.index(seg[1 + 2 * k]), seg[2 + 2 * k]) for k in range(seg[0])]
                if len(image.scan) != len(ids):
                    raise ValueError("one scan with all components is needed")
                end = p
                while True:
                    end = data.find(b"\xff", end)
                    if end < 0 or end + 1 >= len(data):
                        raise ValueError("no end of image")
                    if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                        end += 2
                    elif data[end + 1] == 0xFF:
                        end += 1
                    else:
                        break
                image.body, p = data[p:end] + b"\xff\xd9", end
        if data[p : p + 2] != b"\xff\xd9":
            raise ValueError("no end of image")
        images.append(image)
        p += 2
    return images


@lru_cache(maxsize=64)
def _lookup(table: bytes) -> np.ndarray:
    """For the next 16 bits: code length * 256 + symbol; 0 where no code fits."""
    out, code, k = np.zeros(1 << 16, np.int32), 0, 16
    for n in range(1, 17):
        for _ in range(table[n - 1]):
            out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | table[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _lanes(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(32-bit windows at each byte of the bodies without markers and stuffing, first byte of each lane, first lane of each body)."""
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    nxt = np.r_[raw[1:], np.uint8(0)]
    full = raw == 255
    mark = full & (nxt >= 0xD0) & (nxt <= 0xD9)
    keep = ~mark
    keep[1:] &= ~(mark[:-1] | (full[:-1] & (raw[1:] == 0)))
    place = np.cumsum(keep) - keep
    ends = place[mark]
    clean = np.r_[raw[keep], np.zeros(8, np.uint8)].astype(np.uint32)
    word = clean[:-3] << 24 | clean[1:-2] << 16 | clean[2:-1] << 8 | clean[3:]
    marks_before = np.r_[0, np.cumsum(mark)]
    first = marks_before[np.cumsum([0, *map(len, bodies)])[:-1]]
    return word.astype(np.int64), np.r_[0, ends[:-1]] if len(ends) else ends, first


def _peek(word: np.ndarray, bit: np.ndarray) -> np.ndarray:
    return (word[np.minimum(bit >> 3, len(word) - 1)] >> (16 - (bit & 7))) & 0xFFFF


def _take(lut: np.ndarray, word: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    got = lut[_peek(word, bit)]
    if not got.all():
        raise ValueError("no such Huffman code")
    return got & 255, bit + (got >> 8)


def thumbnails(images: list[Image]) -> list[np.ndarray]:
    """The DC-only luminance of each image: one value (0..255) for each 8x8 block of the first component."""
    groups: dict[tuple, list[int]] = {}
    for k, m in enumerate(images):
        groups.setdefault((tuple(m.components), tuple(m.scan), tuple(sorted(m.tables.items())), tuple(sorted(m.quant.items()))), []).append(k)
    out: list[np.ndarray] = [np.zeros((0, 0), np.uint8)] * len(images)
    for (components, scan, tables, quant), members in groups.items():
        tables, single = dict(tables), len(components) == 1
        hs, vs = max(c[1] for c in components), max(c[2] for c in components)
        pattern = [(c, t) for c, t in scan for _ in range(1 if single else components[c][1] * components[c][2])]
        y_h, y_v = (1, 1) if single else components[0][1:3]
        word, start, first = _lanes([images[k].body for k in members])
        across, mcus, todo = [], [], []
        for k in members:
            m = images[k]
            across.append(-(-m.width // (8 * (1 if single else hs))))
            mcus.append(across[-1] * -(-m.height // (8 * (1 if single else vs))))
            every = m.interval or mcus[-1]
            todo += [min(every, mcus[-1] - i) for i in range(0, mcus[-1], every)]
        if len(todo) != len(start):
            raise ValueError("restart markers don't match the image's size")
        todo, bit = np.array(todo), start * 8
        order = np.argsort(-todo, kind="stable")
        bit, left = bit[order], todo[order]
        pred = np.zeros((len(components), len(left)), np.int64)
        per = sum(c == 0 for c, _ in pattern)
        luma = np.zeros((len(left), int(left.max(initial=0)) * per), np.int64)
        for step in range(int(left.max(initial=0))):
            n = int(np.searchsorted(-left, -step, side="left"))  # lanes with more than `step` units
            b, y = bit[:n], 0
            for c, t in pattern:
                s, b = _take(_lookup(tables[t >> 4]), word, b)
                extra = _peek(word, b) >> (16 - s)
                b = b + s
                pred[c, :n] += np.where(extra < (1 << s >> 1), extra - (1 << s) + 1, extra)
                if c == 0:
                    luma[:n, step * per + y] = pred[0, :n]
                    y += 1
                b = _skip_ac(_lookup(tables[0x10 | t & 15]), word, b)
            bit[:n] = b
        if (bit > 8 * np.r_[start[1:], len(word) - 5][order]).any():
            raise ValueError("the data break off")
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        luma = luma[back]
        q = dict(quant)[components[0][3]]
        value = np.clip((luma * q + 4 >> 3) + 128, 0, 255).astype(np.uint8)
        bounds = np.r_[first, len(start)]
        for i, k in enumerate(members):
            rows, units = value[bounds[i] : bounds[i + 1]], todo[bounds[i] : bounds[i + 1]]
            flat = rows.reshape(-1, per) if (units * per == rows.shape[1]).all() else np.concatenate([r[: u * per] for r, u in zip(rows, units)]).reshape(-1, per)
            grid = flat.reshape(mcus[i] // across[i], across[i], y_v, y_h).transpose(0, 2, 1, 3).reshape(-1, across[i] * y_h)
            out[k] = grid[: -(-images[k].height * y_v // (8 * (1 if single else vs))), : -(-images[k].width * y_h // (8 * (1 if single else hs)))]
    return out


def _skip_ac(lut: np.ndarray, word: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Bit positions after the block's AC coefficients."""
    s, out = _take(lut, word, bit)
    at = np.flatnonzero(s)
    k = np.ones(len(at), np.int64)
    s = s[at]
    while len(at):
        out[at] += s & 15
        k += (s >> 4) + 1
        more = k < 64
        at, k = at[more], k[more]
        s, out[at] = _take(lut, word, out[at])
        more = s > 0
        at, k, s = at[more], k[more], s[more]
    return out


def average_hash(thumb: np.ndarray) -> str:
    """64 bits in hex: which cells of an 8x8 grid over the thumbnail are lighter than their mean."""
    h, w = thumb.shape
    if not h or not w:
        return "0" * 16
    rows, cols = np.arange(8) * h // 8, np.arange(8) * w // 8
    if h >= 8 and w >= 8:
        sums = np.add.reduceat(np.add.reduceat(thumb.astype(np.int64), rows, 0), cols, 1)
        cells = sums * 1000 // np.outer(np.diff(np.r_[rows, h]), np.diff(np.r_[cols, w]))
    else:
        cells = thumb[rows][:, cols].astype(np.int64) * 1000
    return np.packbits((cells * 64 > cells.sum()).ravel()).tobytes().hex()


def feature(images: list[Image], thumb: np.ndarray) -> str:
    """Dimensions, number of images and the hash of the joined thumbnails."""
    return f"{images[0].width}x{sum(m.height for m in images)};images={len(images)};ahash={average_hash(thumb)}"


MEDIA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, off in R.row_slices(batches, "media"):
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(np.diff(off)), pa.array(encode(*padded(data, off)), pa.binary())], MEDIA.names)


def store(docs: DataFrame) -> DataFrame:
    """A media column: per row of docs (doc_id, text) the whole text's UTF-8 bytes, padded, as baseline JPEG.

    Null text is empty: one unit of padding. Repeated rows each give a row, equal
    texts equal media; texts of any length are stored whole.
    """
    return R.picked(docs, "doc_id", "text").mapInArrow(_stored, MEDIA)


FEATURES = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        col = batch.column("media").cast(pa.large_binary())
        at = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
        for i, j in R.slices(at):
            media = col.slice(i, j - i).to_pylist()
            images = [parse(m) for m in media]
            thumbs = iter(thumbnails([x for m in images for x in m]))
            joined = [np.concatenate([next(thumbs) for _ in m]) for m in images]
            payload = [t.tobytes() for t in joined]
            rows = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), rows.column("n_bytes"), pa.array([len(p) for p in payload], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payload], pa.string()), pa.array([zlib.crc32(p[-32:]) for p in payload], pa.int64()),
                pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()), pa.array([feature(m, t) for m, t in zip(images, joined)], pa.string()),
            ], FEATURES.names)


def read_features(media: DataFrame) -> DataFrame:
    """From a media column (doc_id, n_bytes, media): the payload read back from the thumbnails, its digests, and the feature string.

    Broken media raise ValueError, null media (which store() never makes) a TypeError; repeated rows each give a row, a null doc_id stays null.
    """
    return R.picked(media, "doc_id", "n_bytes", "media").mapInArrow(_read, FEATURES)
