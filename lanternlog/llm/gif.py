"""GIF media columns: a lossless writer, and a reader for LZW streams, palettes, disposal and transparency."""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import doc_batches, documents, read_table

WIDTH = 192
#: Rows of samples in one frame; a payload of more rows goes on in further frames.
FRAME_ROWS = 256
#: Hundredths of a second that each frame stands.
DELAY = 4
BINS = 16
BLOCK_BYTES = 4 << 20
MAX_CODES = 4096
STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
FEATURES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()),
        ("media_sha256", pa.string()),
        ("feature", pa.string()),
        ("n_frames", pa.int32()),
        ("duration_cs", pa.int64()),
    ]
)
STORED_DDL = "doc_id long, n_bytes long, media binary"
FEATURES_DDL = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, n_frames int, duration_cs long"
)


def _widths(min_bits: int) -> np.ndarray:
    """Bits of the code at each place after a clear code: a place adds one table entry, up to 12 bits."""
    first = (1 << min_bits) + 1
    return np.array([min_bits + 1] + [min(12, max(min_bits + 1, (first + i).bit_length())) for i in range(1, MAX_CODES)])


_SCHEDULES = {bits: _widths(bits) for bits in range(2, 9)}


#: Samples at a stream's start that stand as single codes; the pairs among them are the table that the rest uses.
SINGLE = 1024


def lzw_codes(samples: bytes) -> np.ndarray:
    """Codes of 8-bit samples, to follow one clear code.

    The first SINGLE samples stand as themselves, which enters each of their pairs in the reader's table; what
    follows is taken two samples at a time, as the code of the pair where there is one. That is no greedy parse,
    but a valid stream that numpy makes without a loop over samples.
    """
    s = np.frombuffer(samples, np.uint8).astype(np.int32)
    head, rest = s[:SINGLE], s[SINGLE:]
    if not len(rest):
        return head
    table = np.full(1 << 16, -1, np.int32)
    table[head[:-1] << 8 | head[1:]] = np.arange(258, 258 + len(head) - 1)
    left, right = rest[0::2], rest[1::2]
    code = table[left[: len(right)] << 8 | right]
    alone = code < 0
    ends = np.cumsum(1 + alone)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    out[ends - 1] = np.where(alone, right, code)
    out[ends[alone] - 2] = left[: len(right)][alone]
    return np.concatenate([head, out, left[len(right) :]])


def lzw_pack(codes: np.ndarray, min_bits: int = 8) -> bytes:
    """The code stream as bytes, least bit first: a clear code, the codes, an end code."""
    schedule = _SCHEDULES[min_bits]
    clear = 1 << min_bits
    bits = [((clear >> np.arange(min_bits + 1)) & 1).astype(np.uint8)]
    steps = np.flatnonzero(np.diff(schedule)) + 1
    codes = np.append(codes, clear + 1)
    parts = np.split(codes.astype("<u2"), steps[steps < len(codes)])
    for part, at in zip(parts, np.append(0, steps), strict=False):
        each = np.unpackbits(part.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
        bits.append(each[:, : schedule[at]].ravel())
    return np.packbits(np.concatenate(bits), bitorder="little").tobytes()


def lzw_expand(codes: np.ndarray, min_bits: int) -> bytes:
    """What the codes after a clear code stand for.

    The table entry made at place j is the string of code j and the first sample of code j + 1, so a code's string
    is found by following entries to a single sample: hops by pointer doubling, samples from each string's end.
    """
    single = codes < 1 << min_bits
    place = np.arange(len(codes))
    parent = np.where(single, place, codes - ((1 << min_bits) + 2))
    if (parent < 0).any() or (parent[~single] >= place[~single]).any():
        raise ValueError("code beyond the table")
    root, hops = parent, (~single).astype(np.int64)
    while True:
        further = root[root]
        hops = hops + hops[root]
        if (further == root).all():
            break
        root = further
    first = codes[root]
    last = np.where(single, codes, first[np.minimum(parent + 1, len(codes) - 1)]).astype(np.uint8)
    ends = np.cumsum(hops + 1)
    out = np.empty(int(ends[-1]), np.uint8)
    at, to = place, ends - 1
    while len(at):
        out[to] = last[at]
        more = ~single[at]
        at, to = parent[at[more]], to[more] - 1
    return out.tobytes()


def lzw_decode(data: bytes, min_bits: int) -> bytes:
    """The samples of a code stream; clear codes may stand anywhere, also late ones (a full table stays)."""
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")
    schedule = _SCHEDULES[min_bits]
    steps = [0, *(np.flatnonzero(np.diff(schedule)) + 1).tolist()]
    clear, end, at = 1 << min_bits, (1 << min_bits) + 1, 0
    out: list[bytes] = []
    while True:
        run, pos, stop = [], at, None
        for k, start in enumerate(steps):
            width = int(schedule[start])
            most = (len(bits) - pos) // width
            n = most if k + 1 == len(steps) else min(most, steps[k + 1] - start)
            packed = np.zeros((n, 16), np.uint8)
            packed[:, :width] = bits[pos : pos + n * width].reshape(n, width)
            codes = np.packbits(packed, axis=1, bitorder="little").view("<u2").ravel().astype(np.int64)
            marks = np.flatnonzero((codes == clear) | (codes == end))
            if len(marks):
                stop = int(codes[marks[0]])
                n = int(marks[0])
                codes = codes[:n]
                pos += width
            run.append(codes)
            pos += n * width
            if stop is not None or n == most:
                break
        if any(map(len, run)):
            out.append(lzw_expand(np.concatenate(run), min_bits))
        at = pos
        if stop != clear:
            return b"".join(out)


def _sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


GREYS = bytes(v for i in range(256) for v in (i, i, i))


def write_gif(samples: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay: int = DELAY) -> bytes:
    """Samples (a positive multiple of width) as frames of a grey 256-colour GIF, each frame at the top left."""
    if not samples or len(samples) % width:
        raise ValueError("samples must fill whole rows")
    rows = len(samples) // width
    out = [
        b"GIF89a" + struct.pack("<HHBBB", width, min(rows, frame_rows), 0xF7, 0, 0) + GREYS,
        b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00",
    ]
    for top in range(0, rows, frame_rows):
        n = min(frame_rows, rows - top)
        part = samples[top * width : (top + n) * width]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, n, 0) + b"\x08" + _sub_blocks(lzw_pack(lzw_codes(part))))
    out.append(b"\x3b")
    return b"".join(out)


@dataclass
class Frame:
    """canvas: what is shown, rows x columns x RGBA; box: left, top, width, height of the drawn part; delay in 1/100 s."""

    canvas: np.ndarray
    box: tuple[int, int, int, int]
    delay: int


def read_gif(data: bytes) -> list[Frame]:
    """The shown frames: local or global palettes, interlacing, disposal 0 to 3 and transparency are applied.

    A frame that does not fit the canvas is cut to it. Raises ValueError for data that is no whole GIF.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    wide, high, flags, back, _ = struct.unpack("<HHBBB", data[6:13])
    at, common = 13, None
    if flags & 0x80:
        size = 2 << (flags & 7)
        common = np.frombuffer(data[at : at + 3 * size], np.uint8).reshape(-1, 3)
        at += 3 * size

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while n := data[at]:
            parts.append(data[at + 1 : at + 1 + n])
            at += n + 1
        return b"".join(parts), at + 1

    canvas = np.zeros((high, wide, 4), np.uint8)
    frames: list[Frame] = []
    disposal, delay, clear = 0, 0, None
    try:
        while data[at] != 0x3B:
            kind = data[at]
            if kind == 0x21:
                body, after = blocks(at + 2)
                if data[at + 1] == 0xF9:
                    packed, delay, index = struct.unpack("<BHB", body[:4])
                    disposal, clear = packed >> 2 & 7, index if packed & 1 else None
                at = after
                continue
            if kind != 0x2C:
                raise ValueError("unknown block")
            left, top, w, h, packed = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            palette = common
            if packed & 0x80:
                size = 2 << (packed & 7)
                palette = np.frombuffer(data[at : at + 3 * size], np.uint8).reshape(-1, 3)
                at += 3 * size
            if palette is None:
                raise ValueError("no palette")
            min_bits = data[at]
            if not 2 <= min_bits <= 8:
                raise ValueError("code size")
            stream, at = blocks(at + 1)
            samples = np.frombuffer(lzw_decode(stream, min_bits), np.uint8)
            if len(samples) < w * h:
                raise ValueError("too few samples")
            image = samples[: w * h].reshape(h, w)
            if packed & 0x40:
                order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
                straight = np.empty_like(image)
                straight[order] = image
                image = straight
            if int(image.max(initial=0)) >= len(palette):
                raise ValueError("sample beyond the palette")
            area = (slice(top, min(top + h, high)), slice(left, min(left + w, wide)))
            image = image[: max(0, high - top), : max(0, wide - left)]
            saved = canvas[area].copy() if disposal == 3 else None
            if clear is None:
                canvas[area][..., :3] = palette[image]
                canvas[area][..., 3] = 255
            else:
                drawn = image != clear
                canvas[area][drawn] = np.concatenate(
                    [palette[image[drawn]], np.full((int(drawn.sum()), 1), 255, np.uint8)], axis=1
                )
            frames.append(Frame(canvas.copy(), (left, top, w, h), delay))
            if disposal == 2:
                canvas[area] = 0
            elif disposal == 3:
                canvas[area] = saved
            disposal, delay, clear = 0, 0, None
    except (IndexError, struct.error):
        raise ValueError("broken off") from None
    return frames


def histogram(frames: list[Frame], bins: int = BINS) -> np.ndarray:
    """Shown pixels of each frame's drawn part by red, green and blue level, in bins."""
    total = np.zeros((3, bins), np.int64)
    to_bin = np.arange(256) * bins >> 8
    for f in frames:
        left, top, w, h = f.box
        part = f.canvas[top : top + h, left : left + w].reshape(-1, 4)
        part = part[part[:, 3] > 0]
        for c in range(3):
            total[c] += np.bincount(to_bin, np.bincount(part[:, c], minlength=256), bins).astype(np.int64)
    return total


def grey_samples(frames: list[Frame]) -> bytes:
    """The red channel of each frame's drawn part, in order: what write_gif was given."""
    return b"".join(
        f.canvas[f.box[1] : f.box[1] + f.box[3], f.box[0] : f.box[0] + f.box[2], 0].tobytes() for f in frames
    )


def padded(text: str, multiple: int = WIDTH) -> tuple[bytes, int]:
    raw = text.encode()
    return raw + b" " * (multiple - len(raw) % multiple if len(raw) % multiple or not raw else 0), len(raw)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text's UTF-8, padded with blanks to rows of 192 samples, as a GIF.

    Null text: empty, stored as one blank row. Repeated rows: a row each. Empty table: no rows. Long texts go on in
    further frames of 192 by 256 samples. Nothing is shuffled.
    """

    def run(batches):
        for ids, texts in doc_batches(batches, BLOCK_BYTES):
            sizes, media = [], []
            for text in texts:
                payload, n = padded(text)
                sizes.append(n)
                media.append(write_gif(payload))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], schema=STORED
            )

    return documents(docs).mapInArrow(run, STORED_DDL)


def timed_frames(media: DataFrame) -> DataFrame:
    """doc_id, frame, start_cs, delay_cs, width, height, histogram array<long>, rgba: a row for each shown frame.

    Null media: no frames. Data that is no whole GIF raises ValueError.
    """
    out = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("frame", pa.int32()),
            ("start_cs", pa.int64()),
            ("delay_cs", pa.int64()),
            ("width", pa.int32()),
            ("height", pa.int32()),
            ("histogram", pa.list_(pa.int64())),
            ("rgba", pa.binary()),
        ]
    )

    def run(batches):
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, clock = [], 0
                for k, f in enumerate(read_gif(data.as_py()) if data.is_valid else []):
                    high, wide = f.canvas.shape[:2]
                    rows.append((doc_id, k, clock, f.delay, wide, high, histogram([f]).ravel().tolist(), f.canvas.tobytes()))
                    clock += f.delay
                if rows:
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, schema=out)

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(
        run,
        "doc_id long, frame int, start_cs long, delay_cs long, width int, height int, histogram array<long>, rgba binary",
    )


def read_back(stored: DataFrame) -> DataFrame:
    """From `store`'s rows: the payload as decoded from the media, its digests, and the colour-histogram feature."""

    def run(batches):
        for batch in batches:
            rows = []
            ids, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, n, data in zip(ids, sizes, batch.column(2), strict=True):
                data = data.as_py()
                frames = read_gif(data)
                payload = grey_samples(frames)
                levels = histogram(frames)
                rows.append(
                    (
                        doc_id,
                        n,
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-16:]),
                        len(data),
                        hashlib.sha256(data).hexdigest(),
                        ";".join(f"{c}:" + ",".join(map(str, x)) for c, x in zip("rgb", levels.tolist(), strict=True)),
                        len(frames),
                        sum(f.delay for f in frames),
                    )
                )
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), FEATURES.types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, schema=FEATURES)

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES_DDL)


def op4_gif_media(spark, sf_dir):
    return read_back(store(read_table(spark, sf_dir, "documents")))
