"""WARC archives with revisit resolution.

:func:`resolve` shuffles headers only (page id, address, digest, length; never a payload):
the smallest page id of each digest is its original response, every other record
with that digest a revisit of it. :func:`write_archives` writes the records with
fresh headers, revisits without their payload: one gzip member a record, so that readers
can seek, and a ``warcinfo`` record before each run of ``BLOCK_BYTES``. Files end by
bytes, not by records. :func:`read_archives` decompresses member by member and
checks lengths and payload digests.

The parts are written by Spark's own text writer, which works on any file system
the cluster has, and so are named ``.txt``. It ends a row with one zero byte; that byte is
the last one of a row's last member, the top byte of its uncompressed length. A record of
16 MiB or more is followed by an empty member for this, which readers skip.

Defined results: a null payload is empty; a null url is an empty target; every row
of ``pages`` gives a record, so rows that repeat a page id and its payload give
equal records; a null page_id revisits a known page of its payload, and is a
response where there is none; a long payload is one record in a file of its own size; an
empty table gives empty archives; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequill.session import scratch_path, written

MIN_BYTES = 0
#: Compressed bytes of a row of the text writer, and rows of a file.
BLOCK_BYTES = 16 << 20
BLOCKS_PER_FILE = 4
SALTS = 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Record id of a page without one.
NO_ID = "<urn:uuid:00000000-0000-4fff-0000-000000000000>"
_BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32_WARC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: every 5 hex digits are 4 base32 digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), _BASE32_DIGITS, _BASE32_WARC)


def headers(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        F.length(payload).cast("long").alias("payload_bytes"),
        base32_sha1(payload).alias("payload_digest"),
    )


def resolve(heads: DataFrame, min_bytes: int = MIN_BYTES, salts: int = SALTS) -> DataFrame:
    """Headers with record_type and refers_to.

    Originals are found with partial aggregation. Only digests that occur twice are
    joined back, and the join is dealt over ``salts`` keys a digest, so that one
    payload with a third of all records fills no task.
    """
    keys = ["payload_digest", "payload_bytes"]
    spread = heads.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    originals = (
        heads.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy(*keys)
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("_first"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1)
        .drop("_n")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    joined = spread.join(originals, [*keys, "_salt"], "left").drop("_salt")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first.page_id"))
    return joined.select(
        "page_id",
        "url",
        *keys,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("_first.page_id")).alias("refers_to"),
        F.when(revisit, F.col("_first.url")).alias("refers_url"),
    )


def _urn(page_id: int | None) -> str:
    if page_id is None:
        return NO_ID
    digits = f"{page_id & (1 << 64) - 1:016x}"
    return f"<urn:uuid:00000000-0000-4000-{digits[:4]}-{digits[4:]}>"


def _page_id(urn: str) -> int | None:
    found = int("".join(urn.strip("<>").split("-")[-2:]), 16)
    return None if urn == NO_ID else found - (1 << 64) if found >> 63 else found


def record(fields: Iterable[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in (*fields, ("Content-Length", str(len(block)))))
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def page_record(date: str, page_id: int | None, url: str, kind: str, digest: str, refers_to: int | None, refers_url: str | None, payload: bytes) -> bytes:
    target = lambda x: x.replace("\r\n", "\n").replace("\r", "\n").replace("\n", "%0A")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date), ("WARC-Target-URI", target(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", _urn(refers_to)), ("WARC-Refers-To-Target-URI", target(refers_url or "")), ("WARC-Refers-To-Date", date)]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    return record(fields, head + (payload if kind == "response" else b""))


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _blocks(records: Iterable[bytes], date: str, size: int) -> Iterator[bytes]:
    """Runs of gzip members of about ``size`` bytes, each with a ``warcinfo`` record first; all end with a zero byte."""
    held: list[bytes] = []
    n = 0

    def closed() -> bytes:
        name = uuid.UUID(bytes=hashlib.sha1(b"".join(m[-8:] for m in held)).digest()[:16], version=5)
        info = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")]
        members = [_member(record(info, b"software: tracequill\r\nformat: WARC File Format 1.1\r\n")), *held]
        return b"".join(members if not members[-1][-1] else [*members, _member(b"")])

    for one in records:
        held.append(_member(one))
        n += len(held[-1])
        if n >= size:
            yield closed()
            held, n = [], 0
    if held:
        yield closed()


def write_archives(pages: DataFrame, resolved: DataFrame, path: str, block_bytes: int = BLOCK_BYTES, date: str | None = None) -> None:
    """Join the verdicts of :func:`resolve` to the payloads and write the archives; ``date`` is the time of writing by default."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    payloads = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        base32_sha1(html).alias("payload_digest"),
        html.alias("_payload"),
    )
    verdicts = resolved.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "record_type", "refers_to", "refers_url").distinct()
    rows = payloads.join(verdicts, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield page_record(date, *(c[i].as_py() for c in batch.columns))

        for block in _blocks(records(), date, block_bytes):
            yield pa.RecordBatch.from_arrays([pa.array([block[:-1]], pa.binary())], ["value"])

    parts = rows.select("page_id", "url", "record_type", "payload_digest", "refers_to", "refers_url", "_payload").mapInArrow(run, "value binary")
    parts.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", BLOCKS_PER_FILE).text(path)


def members(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """What the gzip members of an archive hold, one after another."""
    view, at = memoryview(data), 0
    while at < len(view):
        reader, parts = zlib.decompressobj(31), []
        while not reader.eof:
            piece = view[at : at + step]
            if not len(piece):
                raise ValueError("the last member is cut off")
            parts.append(reader.decompress(piece))
            at += len(piece) - len(reader.unused_data)
        yield b"".join(parts)


def parse(parts: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record of an archive's uncompressed parts."""
    held = b""
    for part in parts:
        data, at = held + part if held else part, 0
        while at < len(data):
            stop = data.find(b"\r\n\r\n", at)
            if not data.startswith(b"WARC/"[: len(data) - at], at):
                raise ValueError("no WARC record where one should begin")
            if stop < 0:
                break
            lines = data[at:stop].decode("utf-8").split("\r\n")[1:]
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            end = stop + 4 + int(fields["content-length"])
            if end + 4 > len(data):
                break
            if data[end : end + 4] != b"\r\n\r\n":
                raise ValueError("a record is longer than it says")
            yield fields, data[stop + 4 : end]
            at = end + 4
        held = data[at:]
    if held:
        raise ValueError("the last record is cut off")


def read_archives(spark, path: str) -> DataFrame:
    """page_id, record_type, url, payload_digest, refers_to and the stored payload of every page's record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = ["page_id", "record_type", "url", "payload_digest", "refers_to", "payload"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for blob in batch.column(0):
                rows, n = [], 0
                for f, block in parse(members(blob.as_py())):
                    if f["warc-type"] == "warcinfo":
                        continue
                    payload, digest = block[block.index(b"\r\n\r\n") + 4 :], f["warc-payload-digest"].removeprefix("sha1:")
                    if f["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"the payload of {f['warc-record-id']} has another digest")
                    refers = _page_id(f["warc-refers-to"]) if "warc-refers-to" in f else None
                    rows.append((_page_id(f["warc-record-id"]), f["warc-type"], f["warc-target-uri"], digest, refers, payload))
                    n += len(payload)
                    if n >= BLOCK_BYTES or len(rows) >= 1000:
                        yield batch_of(rows)
                        rows, n = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "page_id long, record_type string, url string, payload_digest string, refers_to long, payload binary")


def deduplicated(spark, pages: DataFrame, min_bytes: int = MIN_BYTES) -> tuple[str, DataFrame]:
    """Write the archives of ``pages`` to the shared folder; their path and the resolved headers."""
    resolved = written(spark, resolve(headers(pages), min_bytes), "warc-headers")
    path = scratch_path(spark, "warc")
    write_archives(pages, resolved, path)
    return path, resolved


def op7_warc(spark, sf_dir: str) -> DataFrame:
    """What the archives say, read back; a revisit's payload length is its response's."""
    path, _ = deduplicated(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    records = read_archives(spark, path).withColumn("n", F.length("payload").cast("long"))
    slim = written(spark, records.select("page_id", "record_type", "payload_digest", "refers_to", "n"), "warc-read")
    revisits = slim.filter(F.col("record_type") == "revisit")
    referred = revisits.groupBy(F.col("refers_to").alias("_id"), F.col("payload_digest").alias("_digest")).agg(F.count(F.lit(1)).alias("_times"))
    originals = slim.filter(F.col("record_type") == "response").groupBy(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest")).agg(F.max("n").alias("_n"))
    salted = originals.join(referred, ["_id", "_digest"]).withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = (
        revisits.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
        .join(salted, (F.col("refers_to") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")) & (F.col("_salt") == F.col("_deal")), "left")
        .select("page_id", F.col("_n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    )
    own = slim.filter(F.col("record_type") == "response").select("page_id", F.col("n").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return own.unionByName(found)


_GROUP_SQL = " || ".join(
    f"substr('{_BASE32_WARC}', 1 + ((v[{k + 1}] >> {shift}) & 31), 1)" for k in range(8) for shift in (15, 10, 5, 0)
)
OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
             list_transform(range(8), lambda k: ('0x' || substr(sha1(html), (1 + 5 * k)::INT, 5))::BIGINT) AS v FROM p),
d AS (SELECT page_id, payload_bytes, {_GROUP_SQL} AS payload_digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
