import base64
import gzip
import hashlib
import os
import random
import zlib

import pytest

from tracequill.llm import warc
from tracequill.session import scratch_path


def plain(pages):
    first = {}
    for page_id, _, html in sorted(pages, key=lambda p: p[0]):
        first.setdefault((html or "").encode(), page_id)
    out = []
    for page_id, _, html in pages:
        data = (html or "").encode()
        original = first[data]
        out.append((page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if page_id == original else "revisit", None if page_id == original else original))
    return sorted(out)


def archived(spark, pages, tmp_path, min_bytes=0):
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload_digest string")
    path, _ = warc.deduplicated(spark, df, min_bytes)
    return path


PAGES = [(1, "http://a/", "<p>é</p>"), (2, None, None), (3, "http://b/\r\nX: y", ""), (4, "http://c/", "<p>é</p>"), (5, "u", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1"), (6, "u", "x" * 300_000), (9, "u", "<p>é</p>"), (7, "u", "x" * 300_000)]


def test_archives_read_back(spark, tmp_path):
    path = archived(spark, PAGES, tmp_path)
    rows = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    want = {p[0]: p for p in plain(PAGES)}
    texts = {p[0]: (p[2] or "").encode() for p in PAGES}
    assert set(rows) == set(want)
    for i, r in rows.items():
        assert (r.payload_digest, r.record_type, r.refers_to) == want[i][2:]
        assert bytes(r.payload) == (texts[i] if r.record_type == "response" else b"")


def test_threshold_keeps_small_payloads(spark, tmp_path):
    rows = {r.page_id: r.record_type for r in warc.read_archives(spark, archived(spark, PAGES, tmp_path, 100)).collect()}
    assert {i for i, k in rows.items() if k == "revisit"} == {7}


def test_query_equals_brute_force(spark, sf_dir, tmp_path):
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op7_warc(spark, sf_dir).collect())
    assert got == plain(pages)
    copies = str(tmp_path / "pages.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(copies)
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op7_warc(spark, str(tmp_path)).collect()) == plain(PAGES)


def test_repeated_rows_and_empty_tables(spark, tmp_path):
    twice = PAGES + PAGES[:2]
    rows = warc.read_archives(spark, archived(spark, twice, tmp_path)).collect()
    assert len(rows) == len(twice) and {(r.page_id, r.record_type) for r in rows} == {(p[0], p[3]) for p in plain(PAGES)}
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    path = scratch_path(spark, "none")
    warc.write_archives(empty, warc.resolve(warc.headers(empty)), path)
    assert warc.read_archives(spark, path).count() == 0


def test_broken_archives_are_refused():
    for parts in ([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"], [b"junk"], [b"WARC/1.1\r\nContent-Length: 1\r\n\r\nabc\r\n\r\n"]):
        with pytest.raises(ValueError):
            list(warc.parse(parts))
    with pytest.raises((ValueError, zlib.error)):
        list(warc.members(warc._member(b"x" * 99)[:-9]))


def test_any_reader_can_seek(spark, tmp_path):
    """A member a record, a warcinfo record first, and no byte besides; files end by bytes."""
    rng = random.Random(1)
    pages = [(i, f"http://h/{i}", "".join(rng.choices("abcdefghij", k=3000))) for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = str(tmp_path / "out")
    warc.write_archives(df, warc.resolve(warc.headers(df)), path, block_bytes=20_000, date="2030-05-06T07:08:09Z")
    files = [f for f in sorted(os.listdir(path)) if f.startswith("part-")]
    seen = 0
    for name in files:
        data = open(os.path.join(path, name), "rb").read()
        assert len(data) < 4 * (20_000 + 3000) and (not data or data[:2] == b"\x1f\x8b")
        kinds = [[f["warc-type"] for f, _ in warc.parse([m])] for m in warc.members(data)]
        assert all(len(k) == 1 for k in kinds) and (not kinds or kinds[0] == ["warcinfo"])
        whole = gzip.decompress(data)
        assert whole.count(b"WARC/1.1\r\n") == len(kinds) and (not data or b"WARC-Date: 2030-05-06T07:08:09Z" in whole)
        seen += sum(k == ["response"] for k in kinds)
    assert seen == 300 and len(files) > 4


def test_long_payloads_and_revisit_headers(spark, tmp_path):
    pages = [(2, "http://first/", "é" * 9_000_000), (7, "http://again/", "é" * 9_000_000), (8, "u", "z")]
    path = archived(spark, pages, tmp_path)
    rows = {r.page_id: (r.record_type, len(r.payload)) for r in warc.read_archives(spark, path).collect()}
    assert rows == {2: ("response", 18_000_000), 7: ("revisit", 0), 8: ("response", 1)}
    for blob in spark.read.format("binaryFile").load(path).collect():
        for f, block in warc.parse(warc.members(blob.content)):
            if f["warc-type"] == "revisit":
                assert f["warc-refers-to-target-uri"] == "http://first/" and f["warc-refers-to-date"] == f["warc-date"] and f["warc-profile"] == warc.PROFILE
                assert block.startswith(b"HTTP/1.1 200 OK\r\n") and block.endswith(b"\r\n\r\n")


def test_page_ids_of_any_size_and_null(spark, tmp_path):
    pages = [(-5, "u", "a"), (1 << 60, "u", "a"), (None, "u", "a"), (None, "u", "alone")]
    rows = warc.read_archives(spark, archived(spark, pages, tmp_path)).collect()
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in rows)
    assert got == [(-5, "response", 0), (0, "response", 0), (0, "revisit", -5), (1 << 60, "revisit", -5)]
