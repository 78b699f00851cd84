import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tracequill.llm import media


def plain_lzw(samples, min_size):
    """Codes of a straightforward encoder, packed bit by bit; never clears when the table is full."""
    clear, end = 1 << min_size, (1 << min_size) + 1
    table = {bytes([i]): i for i in range(clear)}
    size, out, bits, n = min_size + 1, bytearray(), 0, 0

    def put(code, size):
        nonlocal bits, n
        bits |= code << n
        n += size
        while n >= 8:
            out.append(bits & 255)
            bits >>= 8
            n -= 8

    put(clear, size)
    current, nxt = b"", end + 1
    for s in samples:
        longer = current + bytes([s])
        if longer in table:
            current = longer
            continue
        put(table[current], size)
        if nxt < 4096:
            table[longer] = nxt
            if nxt == 1 << size and size < 12:
                size += 1
            nxt += 1
        current = bytes([s])
    put(table[current], size)
    if nxt == 1 << size and size < 12:
        size += 1
    put(end, size)
    if n:
        out.append(bits & 255)
    return bytes(out)


@pytest.mark.parametrize("min_size", [2, 3, 5, 8])
def test_decoder_reads_other_encoders(min_size):
    rng = random.Random(min_size)
    for n in (1, 7, 500, 30_000):
        samples = bytes(rng.choices(range(min(1 << min_size, rng.choice([2, 200]))), k=n))
        assert media.lzw_decode(plain_lzw(samples, min_size), min_size, n) == (samples, True)


def test_round_trip_over_full_tables():
    rng = random.Random(1)
    for n in (64, 4096, 70_000):
        for alphabet in (b"a", b"ab", bytes(range(256))):
            samples = bytes(rng.choices(alphabet, k=n))
            assert media.lzw_decode(media.lzw_encode(samples), 8, n) == (samples, True)
    payload = bytes(rng.choices(range(256), k=64 * 300))
    gif = media.decode(media.encode(payload, frame_rows=100))
    assert not gif.error and [f.start_ms for f in gif.frames] == [0, 100, 200]
    assert b"".join(f.samples.tobytes() for f in gif.frames) == payload


def frame(samples, left, top, w, h, disposal=0, see_through=None, delay=3, interlace=False, palette=None):
    control = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | (see_through is not None), delay, see_through or 0, 0)
    flags = (0x40 if interlace else 0) | (0x81 if palette else 0)
    return control + struct.pack("<BHHHHB", 0x2C, left, top, w, h, flags) + (palette or b"") + b"\x02" + media._blocks(plain_lzw(samples, 2))


def test_disposal_transparency_palettes_and_interlace():
    shared = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + shared
    own = bytes([9, 9, 9, 8, 8, 8, 7, 7, 7, 6, 6, 6])
    body = (
        frame(b"\1\1\1\1", 0, 0, 2, 2)  # red, stays
        + frame(b"\2\0", 0, 0, 2, 1, disposal=3, see_through=0)  # one green pixel, then as before
        + frame(b"\3", 1, 1, 1, 1, disposal=2)  # one blue pixel, then cleared
        + frame(b"\0", 0, 0, 1, 1, palette=own)
    )
    frames = [(f.start_ms, f.canvas.copy()) for f in media.iter_frames(head + body + b";", media.Gif())]
    red, green, blue, clear, grey = [255, 0, 0, 255], [0, 255, 0, 255], [0, 0, 255, 255], [0, 0, 0, 0], [9, 9, 9, 255]
    assert [s for s, _ in frames] == [0, 30, 60, 90]
    assert frames[0][1].tolist() == [[red, red], [red, red]]
    assert frames[1][1].tolist() == [[green, red], [red, red]]
    assert frames[2][1].tolist() == [[red, red], [red, blue]]
    assert frames[3][1].tolist() == [[grey, red], [red, clear]]
    assert media.colour_histogram(frames[3][1]).sum() == 3
    rows = bytes(i % 4 for i in (0, 1, 2, 3, 4, 5, 6, 7))
    stored = bytes(rows[i] for i in (0, 4, 2, 6, 1, 3, 5, 7))
    tall = b"GIF87a" + struct.pack("<HHBBB", 1, 8, 0x81, 0, 0) + shared + frame(stored, 0, 0, 1, 8, interlace=True) + b";"
    assert media.decode(tall).frames[0].samples.tobytes() == rows


def test_malformed_media(spark):
    good = media.encode(bytes(128))
    df = spark.createDataFrame([(1, good), (2, good[:-30]), (3, b"no gif"), (4, None), (5, good)], "id long, media binary")
    got = {r.media_id: r for r in media.frames(df, "id", "media").collect()}
    assert got[1].error is None and got[1].n_pixels == 128
    assert got[2].error and got[3].error and got[4].error
    assert media.frames(df.limit(0), "id", "media").count() == 0


def test_query_stores_every_byte(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in media.op1_gif(spark, sf_dir).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        payload = t + bytes(-len(t) % 64 or (0 if t else 64))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(t), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and sum(r.histogram) == len(payload)
        assert sum(r.histogram[i * 21] for i in range(4)) == len(payload)


def test_null_empty_repeated_and_long_texts(spark):
    long = "".join(np.random.default_rng(0).choice(list("abcdef é"), 400_000))
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "x", 0), (3, "x", 0), (None, long, 0)], "doc_id long, text string, media int")
    got = sorted(((r.doc_id or 0), r.payload_bytes, r.media_sha256, r.n_frames) for r in media.describe(media.store_payloads(df)).collect())
    assert [g[1] for g in got[1:]] == [64, 64, 64, 64] and got[1][2] == got[2][2] and got[3] == got[4]
    assert got[0][1] >= 400_000 and got[0][3] == -(-got[0][1] // (64 * media.FRAME_ROWS))


def test_huge_declared_sizes_are_an_error(spark):
    head = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0x80, 0, 0) + bytes(6)
    frame = b"GIF89a" + struct.pack("<HHBBB", 4, 4, 0x80, 0, 0) + bytes(6) + b"," + struct.pack("<HHHHB", 0, 0, 65535, 65535, 0) + b"\x02\x00;"
    rows = [(1, head + b"\x00" * 9), (2, frame), (3, media.encode(media.payload_of(b"abc")))]
    found = {r.media_id: r for r in media.frames(spark.createDataFrame(rows, "id long, gif binary"), "id", "gif").collect()}
    assert "pixels" in found[1].error and "pixels" in found[2].error and found[3].error is None


def test_batches_end_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(media, "BATCH_BYTES", 100)
    rows = [(i, "x" * n) for i, n in enumerate([0, 300, 20, 0, 90, 90, 1, 500])]
    got = {r.doc_id: r.n_bytes for r in media.store_payloads(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: len(t) for i, t in rows}
