"""Media columns: baseline JPEG bytes in a binary column, their features from the DC coefficients.

encode() stores a document's bytes losslessly as quantised coefficients, the format's unit: 64 bytes are one
8x8 block of a grey-scale image, byte v as coefficient v + 256. All such coefficients have nine bits, so the
Huffman tables hold one symbol of one bit, and each block is a restart interval of its own: an ordinary
baseline scan whose segments can be decoded side by side. decode() is a general baseline decoder: it parses
the markers and decodes the restart segments of many images in step, one symbol of every segment at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pitlake.llm.common import slices

BLOCK = 64
_SHIFT, _BITS = 256, 9


def zigzag() -> np.ndarray:
    """Row-major index of each coefficient in the order of the scan: along the anti-diagonals, turning at the edges."""
    cells = sorted(((r + c, (r if (r + c) % 2 else c), r, c) for r in range(8) for c in range(8)))
    return np.array([r * 8 + c for *_, r, c in cells])


# --- writing -------------------------------------------------------------------------------------------


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _shape(blocks: int) -> tuple[int, int]:
    """Columns and rows of a nearly square grid with room for so many blocks."""
    columns = max(1, int(np.ceil(np.sqrt(blocks))))
    return columns, -(-blocks // columns)


def _header(blocks: int) -> bytes:
    columns, rows = _shape(blocks)
    if rows * 8 > 0xFFFF:
        raise ValueError("the text is too long for one image")
    table = lambda kind, symbol: bytes([kind, 1, *[0] * 15, symbol])
    return (
        b"\xff\xd8" + _segment(0xFE, blocks.to_bytes(8, "big")) + _segment(0xDB, bytes([0]) + bytes([1] * 64))
        + _segment(0xC0, bytes([8]) + (rows * 8).to_bytes(2, "big") + (columns * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
        + _segment(0xC4, table(0x00, _BITS) + table(0x10, _BITS)) + _segment(0xDD, (1).to_bytes(2, "big"))
        + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    )


def payload(text: str | None) -> tuple[int, bytes]:
    """Length of a text in UTF-8, and its bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % BLOCK if raw else BLOCK)


def encode(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG of each payload; four coefficients of ten bits (one of Huffman code, nine of value) are five bytes."""
    counts = [len(p) // BLOCK for p in payloads]
    grids = [int(np.prod(_shape(n))) for n in counts]
    every = np.frombuffer(b"".join(p + bytes((g - n) * BLOCK) for p, g, n in zip(payloads, grids, counts)), np.uint8)
    quads = every.reshape(-1, 4).astype(np.uint64) + np.uint64(_SHIFT)
    packed = (quads[:, 0] << np.uint64(30)) | (quads[:, 1] << np.uint64(20)) | (quads[:, 2] << np.uint64(10)) | quads[:, 3]
    body = packed.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 3:].reshape(-1, 80)
    out, at = [], 0
    for n, g in zip(counts, grids):
        rows = np.empty((g, 82), np.uint8)
        rows[:, :80] = body[at : at + g]
        rows[:, 80], rows[:, 81] = 0xFF, 0xD0 + np.arange(g) % 8
        rows[-1, 81] = 0xD9
        flat = rows.reshape(-1)
        stuff = rows == 0xFF
        stuff[:, 80] = False
        if stuff.any():
            flat = np.insert(flat, np.flatnonzero(stuff.reshape(-1)) + 1, 0)
        out.append(_header(n) + flat.tobytes())
        at += g
    return out


# --- reading -------------------------------------------------------------------------------------------


@dataclass
class Image:
    """What the markers say, and the entropy-coded bytes without stuffing."""

    width: int = 0
    height: int = 0
    comment: bytes = b""
    restart: int = 0
    quant: dict = field(default_factory=dict)
    huffman: dict = field(default_factory=dict)
    parts: list = field(default_factory=list)  # (id, h, v, quant table, dc table, ac table)
    data: np.ndarray = None
    starts: np.ndarray = None  # of the restart segments in data


def parse(raw: bytes) -> Image:
    """Read the markers of a baseline JPEG with one interleaved scan; other kinds raise ValueError."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    img, at = Image(), 2
    while True:
        if at + 4 > len(raw) or raw[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xFE:
            img.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                img.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC0:
            img.height, img.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            img.parts = [[body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k], 0, 0] for k in range(body[5])]
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a baseline image")
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                img.huffman[body[0]] = bytes(body[1 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            img.restart = int.from_bytes(body, "big")
        elif marker == 0xDA:
            for k in range(body[0]):
                part = next(p for p in img.parts if p[0] == body[1 + 2 * k])
                part[4], part[5] = body[2 + 2 * k] >> 4, 16 + (body[2 + 2 * k] & 15)
            break
    data = np.frombuffer(raw, np.uint8)[at:]
    ff = np.flatnonzero(data[:-1] == 0xFF)
    after = data[ff + 1]
    end = ff[after == 0xD9]
    if not len(end):
        raise ValueError("no end of image")
    ff, after = ff[ff < end[0]], after[: np.searchsorted(ff, end[0])]
    rst = ff[(after >= 0xD0) & (after <= 0xD7)]
    drop = np.zeros(int(end[0]), bool)
    drop[ff[after == 0] + 1] = True
    drop[rst] = True
    drop[rst + 1] = True
    gone = np.cumsum(drop)
    img.data = data[: int(end[0])][~drop]
    img.starts = np.concatenate([[0], rst + 2 - gone[rst + 1]]).astype(np.int64)
    return img


_TABLES: dict[bytes, np.ndarray] = {}


def lookup(spec: bytes) -> np.ndarray:
    """For each 16 bits: code length, run and size of the Huffman symbol they begin with (length 0: none)."""
    if spec not in _TABLES:
        out, code, at = np.zeros(1 << 16, np.int32), 0, 16
        for length in range(1, 17):
            for symbol in spec[at : at + spec[length - 1]]:
                out[code << (16 - length) : (code + 1) << (16 - length)] = length << 8 | symbol
                code += 1
            at += spec[length - 1]
            code <<= 1
        _TABLES[spec] = out
    return _TABLES[spec]


def coefficients(images: list[Image]) -> list[np.ndarray]:
    """Quantised coefficients of each image's blocks in the order of its scan, zigzag within a block: (blocks, 64).

    Images with the same tables, sampling and restart interval are decoded together."""
    out: list = [None] * len(images)
    groups: dict = {}
    for i, img in enumerate(images):
        key = tuple((p[1], p[2], img.huffman.get(p[4]), img.huffman.get(p[5])) for p in img.parts), img.restart
        groups.setdefault(key, []).append(i)
    for (parts, restart), members in groups.items():
        if any(None in p for p in parts):
            raise ValueError("a Huffman table is missing")
        units = [k for k, p in enumerate(parts) for _ in range(p[0] * p[1] if len(parts) > 1 else 1)]
        mcus, starts, base = [], [], 0
        for i in members:
            img = images[i]
            h, v = (max(p[1] for p in img.parts), max(p[2] for p in img.parts)) if len(parts) > 1 else (1, 1)
            total = -(-img.width // (8 * h)) * -(-img.height // (8 * v))
            if 2 * total * len(units) > 8 * len(img.data):  # a block takes two bits at least
                raise ValueError("the scan ends early")
            each = restart or total
            if len(img.starts) != -(-total // each):
                raise ValueError("the restart markers don't fit the size")
            mcus.append(np.minimum(each, total - each * np.arange(len(img.starts))))
            starts.append(img.starts + base)
            base += len(img.data) + 8
        data = np.concatenate([x for i in members for x in (images[i].data, np.full(8, 0xFF, np.uint8))])
        window = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
        count, bit = np.concatenate(mcus), np.concatenate(starts) * 8
        first = np.concatenate([[0], np.cumsum(count)])[:-1] * len(units)
        blocks = np.zeros((int(count.sum()) * len(units), 64), np.int16)
        flat, last = blocks.reshape(-1), np.zeros((len(parts), len(count)), np.int32)
        limit = (len(data) - 8) * 8

        def symbols(table: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Run and value of the symbol at each bit position, and the bits it takes."""
            if len(at) and at.max() > limit:
                raise ValueError("the scan ends early")
            w = window[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)
            got = table[(w >> np.uint64(48)).astype(np.int64)]
            length, size = got >> 8, got & 15
            if not length.all():
                raise ValueError("no such Huffman code")
            v = ((w << length.astype(np.uint64)) >> np.uint64(1)) >> (63 - size).astype(np.uint64)
            v = v.astype(np.int32)
            value = np.where(v >> np.maximum(size - 1, 0) != 0, v, v - (1 << size) + 1)
            return (got >> 4) & 15, np.where(size > 0, value, 0), length + size

        for mcu in range(int(count.max(initial=0))):
            live = np.flatnonzero(count > mcu)
            for u, k in enumerate(units):
                dc, ac = lookup(parts[k][2]), lookup(parts[k][3])
                at = (first[live] + mcu * len(units) + u) * 64
                _, diff, used = symbols(dc, bit[live])
                last[k, live] += diff
                flat[at] = last[k, live]
                bit[live] += used
                who, place, n = live, at, np.zeros(len(live), np.int64)
                while len(who):
                    run, value, used = symbols(ac, bit[who])
                    bit[who] += used
                    stop = (used > 0) & (value == 0) & (run < 15)
                    n = n + run + 1
                    put = ~stop & (n < 64)
                    flat[place[put] + n[put]] = value[put]
                    more = ~stop & (n < 63)
                    if not more.all():
                        who, place, n = who[more], place[more], n[more]
        bounds = np.cumsum([0, *[int(m.sum()) * len(units) for m in mcus]])
        for i, a, b in zip(members, bounds, bounds[1:]):
            out[i] = blocks[a:b]
    return out


def thumbnail(img: Image, blocks: np.ndarray) -> np.ndarray:
    """Luminance of each 8x8 block of the first component from its DC coefficient alone: (rows, columns), 0 to 255."""
    h, v = (img.parts[0][1], img.parts[0][2]) if len(img.parts) > 1 else (1, 1)
    H, V = (max(p[1] for p in img.parts), max(p[2] for p in img.parts)) if len(img.parts) > 1 else (1, 1)
    units = sum(p[1] * p[2] for p in img.parts) if len(img.parts) > 1 else 1
    across, down = -(-img.width // (8 * H)), -(-img.height // (8 * V))
    dc = blocks[:, 0].reshape(down, across, units)[:, :, : h * v].reshape(down, across, v, h)
    dc = dc.transpose(0, 2, 1, 3).reshape(down * v, across * h).astype(np.int32) * int(img.quant[img.parts[0][3]][0])
    rows, columns = -(-img.height * v // (8 * V)), -(-img.width * h // (8 * H))
    return np.clip(np.rint(dc / 8 + 128), 0, 255).astype(np.uint8)[:rows, :columns]


def feature(img: Image, thumb: np.ndarray) -> str:
    """Width, height, the thumbnail's SHA-256 (first 16 digits) and its average hash on an 8x8 grid (nearest cells)."""
    r = np.arange(8) * thumb.shape[0] // 8
    c = np.arange(8) * thumb.shape[1] // 8
    small = thumb[np.ix_(r, c)]
    bits = np.packbits((small > small.mean()).reshape(-1)).tobytes().hex()
    return f"{img.width}x{img.height}:{hashlib.sha256(thumb.tobytes()).hexdigest()[:16]}:{bits}"


# --- columns -------------------------------------------------------------------------------------------


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a JPEG of the whole text) of every row; a null text counts as empty.

    Repeated rows stay, other columns are left out. One image holds texts up to about 4 GB."""

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            both = [payload(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array([n for n, _ in both], pa.int64()), pa.array(encode([p for _, p in both]), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(stored, T.StructType([docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


def read_back(img: Image, blocks: np.ndarray) -> bytes:
    """The payload that encode() stored."""
    return (blocks[: int.from_bytes(img.comment, "big")] - _SHIFT).astype(np.uint8).tobytes()


NAMES = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "width", "height", "feature", "error")
_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())


def _decoded(raw: list[bytes | None]) -> list[tuple[Image, np.ndarray] | str | None]:
    """Image and coefficients of each JPEG; for bytes that are none, what is wrong with them; None for null.

    Images are decoded together; where one of them has a broken scan, each is decoded by itself."""
    out: list = [None] * len(raw)
    for i, x in enumerate(raw):
        if x is not None:
            try:
                out[i] = parse(x)
            except (ValueError, IndexError, StopIteration) as e:
                out[i] = str(e) or "a segment is cut short"
    good = [i for i, x in enumerate(out) if isinstance(x, Image)]

    def read(some: list[int]) -> None:
        try:
            for i, blocks in zip(some, coefficients([out[i] for i in some])):
                out[i] = out[i], blocks
        except (ValueError, IndexError, TypeError, ZeroDivisionError) as e:
            if len(some) == 1:
                out[some[0]] = str(e) or "the scan cannot be decoded"
            else:
                for i in some:
                    read([i])

    if good:
        read(good)
    return out


def _digest(raw: bytes | None, found: tuple[Image, np.ndarray] | str | None) -> tuple:
    """The values of NAMES for one media value."""
    if raw is None:
        return (None,) * len(NAMES)
    stored = len(raw), hashlib.sha256(raw).hexdigest()
    if isinstance(found, str):
        return (None, None, None, *stored, None, None, None, found)
    img, blocks = found
    try:
        p, words = read_back(img, blocks), feature(img, thumbnail(img, blocks))
    except (ValueError, IndexError, KeyError) as e:
        return (None, None, None, *stored, img.width, img.height, None, f"no thumbnail: {e}")
    return (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), *stored, img.width, img.height, words, None)


def describe(stored: DataFrame) -> DataFrame:
    """Decode the media column and digest it: payload as read back, stored form, dimensions and thumbnail hashes.

    The other columns pass through, but for media and those named like a result, which are replaced. A null media
    has null results; of bytes that are no baseline JPEG only the stored form is told, and error says what is
    wrong (null for all others)."""
    rest = [f for f in stored.schema.fields if f.name != "media" and f.name.lower() not in NAMES]
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType(), T.IntegerType(), T.IntegerType(), T.StringType(), T.StringType()]

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media", 2 << 20):
            raw = b.column("media").to_pylist()
            rows = [_digest(x, found) for x, found in zip(raw, _decoded(raw))]
            columns = [pa.array(list(c), k) for c, k in zip(zip(*rows), _KINDS)]
            yield pa.record_batch([*[b.column(f.name) for f in rest], *columns], [*[f.name for f in rest], *NAMES])

    return stored.select(*[f.name for f in rest], "media").mapInArrow(described, T.StructType([*rest, *[T.StructField(n, k) for n, k in zip(NAMES, kinds)]]))
