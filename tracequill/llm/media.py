"""GIF media columns: write, decode and describe timed frames.

:func:`decode` parses GIF87a/89a: LZW code streams of any minimum code size with
deferred clears, global and local palettes, interlacing, transparency and the
disposal methods 0 to 3. :func:`encode` writes 8-bit samples losslessly as frames
of a grey palette. :func:`frames` turns a binary column into one row per timed
frame with a colour histogram; :func:`store_payloads` stores any text as a GIF.

Defined results: null text or media is empty; an empty text is stored as 64 zero
samples; bytes that are no GIF, end early, or declare a canvas or frame of more than
``MAX_PIXELS``, give the frames read so far and an ``error``; a long text takes more frames;
equal texts have equal GIFs; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH = 64
#: Rows of a frame: 256 KiB of samples; a longer payload takes more frames.
FRAME_ROWS = 4096
DELAY_CS = 10
TABLE = 4096
#: Canvases and frames above this are refused with an error, whatever a header of a few bytes declares.
MAX_PIXELS = 1 << 26
#: Text bytes whose GIFs share an Arrow batch.
BATCH_BYTES = 32 << 20


@cache
def _schedule(min_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit offset and width of every code of a segment, until its table is full."""
    first = (1 << min_size) + 2
    n = TABLE - first + 1
    free = first + np.arange(-1, n - 1)
    widths = np.maximum(min_size + 1, np.floor(np.log2(np.maximum(free, 1))).astype(np.int64) + 1)
    widths = np.minimum(widths, 12)
    return np.concatenate([[0], np.cumsum(widths)]), widths


def lzw_encode(samples: bytes) -> bytes:
    """LZW codes of 8-bit samples, least significant bit first; a full table is cleared."""
    segments: list[list[int]] = []
    codes = [256]
    segments.append(codes)
    codes = []
    table: dict[int, int] = {}
    get, emit, free = table.get, codes.append, 258
    it = iter(samples)
    current = next(it, None)
    for b in it:
        key = current << 8 | b
        known = get(key)
        if known is not None:
            current = known
            continue
        emit(current)
        current = b
        if free < TABLE:
            table[key] = free
            free += 1
        else:
            emit(256)
            segments.append(codes)
            codes = []
            emit = codes.append
            table.clear()
            free = 258
    if current is not None:
        emit(current)
    emit(257)
    segments.append(codes)
    values = np.fromiter((c for s in segments for c in s), np.uint32, sum(map(len, segments)))
    _, widths = _schedule(8)
    wide = np.concatenate([np.pad(widths, (0, 1), constant_values=12)[: len(s)] if len(s) <= len(widths) + 1 else np.concatenate([widths, np.full(len(s) - len(widths), 12)]) for s in segments])
    return _pack(values, wide)


def _pack(values: np.ndarray, widths: np.ndarray) -> bytes:
    ends = np.cumsum(widths)
    at = ends - widths
    shifted = values.astype(np.uint32) << (at & 7).astype(np.uint32)
    low = at >> 3
    out = np.zeros(int(ends[-1] + 7 >> 3) + 3, np.int64)
    size = len(out)
    for k in range(3):  # codes share no bits, so sums are unions
        out += np.bincount(low + k, weights=shifted >> np.uint32(8 * k) & np.uint32(255), minlength=size)[:size].astype(np.int64)
    return out[: int(ends[-1] + 7 >> 3)].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, min_size: int, limit: int) -> tuple[bytes, bool]:
    """Samples of a code stream, at most ``limit`` (the frame's area); whether it ended as it should."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    buf = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    bits, pos = len(data) * 8, 0
    offsets, widths = _schedule(min_size)
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    size = 0
    table, previous, full = roots.copy(), None, False
    while pos < bits:
        if full:
            starts = pos + 12 * np.arange(4096)
            wide = np.full(4096, 12)
        else:
            starts, wide = pos + offsets[:-1], widths
        fits = int(np.searchsorted(starts + wide, bits, side="right"))
        if not fits:
            break
        starts, wide = starts[:fits], wide[:fits]
        low = starts >> 3
        raw = (buf[low] | buf[low + 1] << np.uint32(8) | buf[low + 2] << np.uint32(16)) >> (starts & 7).astype(np.uint32)
        codes = raw & ((1 << wide) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stops[0]) if len(stops) else fits
        add, grow = out.append, table.append
        for code in codes[:n].tolist():
            if previous is None:
                if code >= clear:
                    return b"".join(out)[:limit], False
                text = roots[code]
            else:
                free = len(table)
                if code < free:
                    text = table[code]
                elif code == free and free < TABLE:
                    text = previous + previous[:1]
                else:
                    return b"".join(out)[:limit], False
                if free < TABLE:
                    grow(previous + text[:1])
            add(text)
            size += len(text)
            previous = text
        if size > limit + TABLE * TABLE:
            break
        if len(stops):
            pos = int(starts[n] + wide[n])
            if codes[n] == end:
                joined = b"".join(out)
                return joined[:limit], len(joined) >= limit
            table, previous, full = roots.copy(), None, False
        else:
            pos = int(starts[-1] + wide[-1])
            full = True
    joined = b"".join(out)
    return joined[:limit], False


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p)]) + p for i in range(0, len(data), 255) if (p := data[i : i + 255])) + b"\0"


def encode(samples: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS, delay_cs: int = DELAY_CS) -> bytes:
    """A looping grey GIF whose frames hold ``samples`` row by row; their number is a multiple of ``width``."""
    if not samples or len(samples) % width:
        raise ValueError("samples must be a positive multiple of the width")
    rows = len(samples) // width
    height = min(rows, frame_rows)
    grey = bytes(v for i in range(256) for v in (i, i, i))
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), grey, b"\x21\xff\x0bNETSCAPE2.0\x03\x01\0\0\0"]
    for top in range(0, rows, frame_rows):
        part = samples[top * width : (top + frame_rows) * width]
        parts.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, 2 << 2, delay_cs, 0, 0))
        parts.append(struct.pack("<BHHHHB", 0x2C, 0, 0, width, len(part) // width, 0) + b"\x08")
        parts.append(_blocks(lzw_encode(part)))
    return b"".join(parts) + b";"


@dataclass
class Frame:
    index: int
    start_ms: int
    delay_ms: int
    left: int
    top: int
    samples: np.ndarray  # palette indices of the sub-image, rows by columns
    canvas: np.ndarray  # RGBA after this frame is drawn


@dataclass
class Gif:
    width: int = 0
    height: int = 0
    frames: list[Frame] = field(default_factory=list)
    error: str = ""


def _deinterlace(rows: np.ndarray) -> np.ndarray:
    h = len(rows)
    order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
    out = np.empty_like(rows)
    out[order] = rows
    return out


def decode(data: bytes) -> Gif:
    gif = Gif()
    try:
        for frame in iter_frames(data, gif):
            gif.frames.append(frame)
    except (struct.error, IndexError, ValueError) as wrong:
        gif.error = f"malformed: {wrong}"
    return gif


def iter_frames(data: bytes, gif: Gif) -> Iterator[Frame]:
    """Frames one at a time, so that a long animation needs one canvas of memory (two for disposal 3)."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF header")
    gif.width, gif.height, flags, _background, _aspect = struct.unpack_from("<HHBBB", data, 6)
    at = 13

    def palette(n: int) -> np.ndarray:
        nonlocal at
        if at + 3 * n > len(data):
            raise ValueError("palette cut off")
        found = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        return found

    def sub_blocks() -> bytes:
        nonlocal at
        parts = []
        while n := data[at]:
            if at + 1 + n > len(data):
                raise ValueError("block cut off")
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts)

    shared = palette(2 << (flags & 7)) if flags & 0x80 else None
    if gif.width * gif.height > MAX_PIXELS:
        raise ValueError(f"a canvas of {gif.width} x {gif.height} is over {MAX_PIXELS} pixels")
    canvas = np.zeros((gif.height, gif.width, 4), np.uint8)
    delay, disposal, clear_index, clock, index = 0, 0, -1, 0, 0
    while True:
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at]
            at += 1
            body = sub_blocks()
            if label == 0xF9 and len(body) >= 4:
                packed, centi, see_through = struct.unpack_from("<BHB", body)
                delay, disposal = centi * 10, packed >> 2 & 7
                clear_index = see_through if packed & 1 else -1
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind}")
        left, top, width, height, packed = struct.unpack_from("<HHHHB", data, at)
        at += 9
        colours = palette(2 << (packed & 7)) if packed & 0x80 else shared
        if colours is None:
            raise ValueError("no palette")
        min_size = data[at]
        at += 1
        if not 2 <= min_size <= 8:
            raise ValueError("bad code size")
        stream = sub_blocks()
        area = width * height
        if area > MAX_PIXELS:
            raise ValueError(f"a frame of {width} x {height} is over {MAX_PIXELS} pixels")
        raw, whole = lzw_decode(stream, min_size, area)
        if not whole:
            gif.error = gif.error or f"frame {index}: code stream ends early"
            raw = raw.ljust(area, b"\0")
        samples = np.frombuffer(raw, np.uint8).reshape(height, width)
        if packed & 0x40:
            samples = _deinterlace(samples)
        before = canvas.copy() if disposal == 3 else None
        shown_h, shown_w = max(0, min(height, gif.height - top)), max(0, min(width, gif.width - left))
        seen = samples[:shown_h, :shown_w]
        area_of = canvas[top : top + shown_h, left : left + shown_w]
        full = np.concatenate([colours, np.zeros((max(0, 256 - len(colours)), 3), np.uint8)])
        if clear_index >= 0:
            drawn = seen != clear_index
            area_of[..., :3][drawn] = full[seen[drawn]]
            area_of[..., 3][drawn] = 255
        else:
            area_of[..., :3] = full[seen]
            area_of[..., 3] = 255
        yield Frame(index, clock, delay, left, top, samples, canvas)
        if disposal == 2:
            area_of[...] = 0
        elif disposal == 3:
            canvas[...] = before
        clock += delay
        index += 1
        delay, disposal, clear_index = 0, 0, -1


def colour_histogram(canvas: np.ndarray) -> np.ndarray:
    """Opaque pixels by 4 x 4 x 4 levels of red, green and blue."""
    rgb = canvas[..., :3].astype(np.uint8) >> 6
    bins = (rgb[..., 0].astype(np.int64) << 4) | (rgb[..., 1].astype(np.int64) << 2) | rgb[..., 2]
    return np.bincount(bins[canvas[..., 3] > 0], minlength=64)


_FRAMES = (
    "media_id long, frame int, start_ms long, delay_ms long, width int, height int, "
    "n_pixels long, histogram array<long>, frame_sha256 string, error string"
)


def frames(df: DataFrame, media_id: str, media: str) -> DataFrame:
    """One row per timed frame of the GIFs in column ``media``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("media_id", pa.int64()), ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("n_pixels", pa.int64()), ("histogram", pa.list_(pa.int64())), ("frame_sha256", pa.string()), ("error", pa.string())])
        for batch in batches:
            rows = []
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                gif, mine = Gif(), []
                try:
                    for f in iter_frames(blob.as_py() or b"", gif):
                        hist = colour_histogram(f.canvas)
                        mine.append({"media_id": key, "frame": f.index, "start_ms": f.start_ms, "delay_ms": f.delay_ms, "width": gif.width, "height": gif.height, "n_pixels": int(hist.sum()), "histogram": hist.tolist(), "frame_sha256": hashlib.sha256(f.canvas.tobytes()).hexdigest()})
                except (struct.error, IndexError, ValueError) as wrong:
                    gif.error = f"malformed: {wrong}"
                    mine = mine or [{"media_id": key}]
                rows += [r | {"error": gif.error or None} for r in mine]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return df.select(F.col(media_id).cast("long").alias("media_id"), F.col(media).cast("binary").alias("media")).mapInArrow(run, _FRAMES)


def payload_of(text: bytes, unit: int = 64) -> bytes:
    return text + bytes(-len(text) % unit if text else unit)


def store_payloads(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the text's bytes as a GIF (``media``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.concatenate([[0], np.cumsum([len(x.as_py() or b"") for x in batch.column(1)])])
            lo = 0
            while lo < batch.num_rows:
                n = max(1, int(np.searchsorted(ends, ends[lo] + BATCH_BYTES, side="right")) - 1 - lo)
                part = batch.slice(lo, n)
                lo += n
                texts = [x.as_py() or b"" for x in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(payload_of(t)) for t in texts], pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, media binary"
    )


_DIGEST = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, n_frames int, duration_ms long, histogram array<long>"
)


def describe(media: DataFrame) -> DataFrame:
    """Decode the stored GIFs again; digests of the samples read back and features of the frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data, gif = blob.as_py(), Gif()
                sha, size, tail, count, clock = hashlib.sha256(), 0, b"", 0, 0
                hist = np.zeros(64, np.int64)
                for f in iter_frames(data, gif):
                    raw = f.samples.tobytes()
                    sha.update(raw)
                    size, tail, count, clock = size + len(raw), (tail + raw)[-64:], count + 1, f.start_ms + f.delay_ms
                    hist += colour_histogram(f.canvas)
                if gif.error:
                    raise ValueError(f"document {key}: {gif.error}")
                feature = f"{gif.width}x{gif.height};frames={count};ms={clock};grey={'/'.join(str(hist[i * 21]) for i in range(4))}"
                rows.append((key, n, size, sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), feature, count, clock, hist.tolist()))
            cols = list(zip(*rows, strict=True)) or [[]] * 11
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            names = [c.split()[0] for c in _DIGEST.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _DIGEST)


def op1_gif(spark, sf_dir: str) -> DataFrame:
    return describe(store_payloads(spark.read.parquet(f"{sf_dir}/documents.parquet")))
