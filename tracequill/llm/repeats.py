"""Removal of byte strings that repeat anywhere in the corpus.

Every byte covered by a string of ``WIDTH`` bytes that also starts elsewhere is removed,
first occurrences included. Sharding is exact:

1. :func:`anchors`: each window of WIDTH bytes names as anchor its least hashed gram
   of ``GRAM`` bytes (the leftmost), so equal windows have equal anchors at equal offsets. A
   run of windows with one anchor is one row: hash of the gram, digest of the run's text.
2. Equal runs (64 bits of gram and 64 of digest) are counted before anything is shuffled by
   text, so that a passage of a third of all documents is one row; runs that occur twice
   are covered whole. Of all equal runs one goes on, and only where its gram has other runs too.
3. Grams with more than ``GROUP`` such runs are dealt again by the longer text that parts of
   their windows share, then by single windows, counted in the same way; no gram fills a task.
4. The others are sharded by gram; each shard's runs are suffix-sorted by external
   induced sorting (:mod:`suffixsort`), whose common-prefix values tell the repeats. Queues
   hold ``MEMORY`` bytes; a shard may be larger, and spills.
5. Covered ranges are gathered by document and joined to the texts once.

Defined results: null text is empty; texts under WIDTH bytes lose nothing; repeated
rows are copies, which remove each other from WIDTH bytes on; an empty table gives an empty
result; extra columns are ignored. Rows with a null doc_id are told apart by text. A long
text is read in chunks of ``_CHUNK`` windows that overlap by a window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.accumulators import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequill.session import written

from . import skew
from .suffixsort import MEMORY, equal_windows

WIDTH = 200
GRAM = 32
SPAN = WIDTH - GRAM + 1  # windows that hold a gram
PART = 21
GROUP = 1_000
SHARD_BYTES = 4 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: Windows handled at once; positions take 24 bits of the sort key.
_CHUNK = 1 << 22

_ANCHORS = "doc_id long, text_hash long, start int, size int, gram_at int, gram long, run long"


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    h, n, power = raw.astype(np.uint64) + np.uint64(1), 1, _BASE
    while n < gram:
        h = h[:-n] * np.uint64(power) + h[n:]
        power, n = power * power & _MASK, 2 * n
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchor_runs(raw: np.ndarray, gram: int = GRAM, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, anchor position and gram hash of every run; ``gram`` is a power of two."""
    n = len(raw) - width + 1
    out: list[tuple] = []
    span = width - gram + 1
    for lo in range(0, max(0, n), _CHUNK):
        hi = min(n, lo + _CHUNK)
        h = _gram_hashes(raw[lo : hi + width - 1], gram)
        least = h >> np.uint64(24) << np.uint64(24) | np.arange(len(h), dtype=np.uint64)
        have = 1
        while 2 * have <= span:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if span > have:
            least = np.minimum(least[: have - span], least[span - have :])
        at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        count = np.diff(np.concatenate([first, [len(at)]]))
        out.append((first + lo, count, at[first] + lo, h[at[first]]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id (-1 for null) and text_hash, the text's bytes, and the doc_id as it is; equal keys mean equal documents."""
    text, own = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("long")
    return docs.select(F.coalesce(own, F.lit(-1)).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"), own.alias("own_id"))


def anchors(keyed: DataFrame) -> DataFrame:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in _ANCHORS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in names]
            for doc_id, text_hash, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = text.as_py()
                start, count, at, gram = anchor_runs(np.frombuffer(data, np.uint8))
                size, inside = count + (WIDTH - 1), at - start
                digests = (xxhash.xxh3_64_intdigest(data[s : s + z], o) for s, z, o in zip(start.tolist(), size.tolist(), inside.tolist(), strict=True))
                run_hash = np.fromiter(digests, np.uint64, len(start))
                for own, x in zip(parts, (np.full(len(start), doc_id), np.full(len(start), text_hash), start, size, inside, gram.view(np.int64), run_hash.view(np.int64)), strict=True):
                    own.append(x)
            if parts[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p).astype(k.to_pandas_dtype())) for p, k in zip(parts, kinds, strict=True)], names)

    return keyed.drop("own_id").filter(F.length("text") >= WIDTH).mapInArrow(run, _ANCHORS)


def _dealt_again(rows: DataFrame, group: int) -> tuple[DataFrame, DataFrame]:
    """Runs of overfull grams: (runs by longer grams, windows that repeat).

    ``rows``: gram, doc_id, text_hash, start, gram_at, copies, text (of the run). Part i of a gram's
    windows shares the bytes from its last window's start to its first window's end.
    """
    spark = rows.sparkSession
    first = F.lit(SPAN - 1) - F.col("gram_at")  # number of the run's first window, counted from SPAN - 1 before the gram
    last = first + F.length("text") - WIDTH
    parts = rows.withColumn("part", F.explode(F.sequence(F.floor(first / PART), F.floor(last / PART)))).withColumn("lo", F.greatest(first, F.col("part") * PART)).withColumn(
        "hi", F.least(last, F.col("part") * PART + PART - 1)
    )

    def cut(begin, end):
        return F.substring("text", (begin - first + 1).cast("int"), (end - begin).cast("int"))

    shared = cut(F.col("part") * PART + PART - 1, F.col("part") * PART + WIDTH)
    finer = parts.select(
        F.xxhash64("gram", "part", shared).alias("gram"), "doc_id", "text_hash", (F.col("start") + F.col("lo") - first).cast("int").alias("start"),
        (F.lit(SPAN - 1) - F.col("lo")).cast("int").alias("gram_at"), "copies", cut(F.col("lo"), F.col("hi") + WIDTH).alias("text"),
    )
    finer = written(spark, finer, "repeat-parts")
    sizes = finer.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("m"))
    fit = finer.join(sizes.filter((F.col("n") <= group) & (F.col("m") > 1)).select("gram"), "gram", "left_semi")
    over = finer.join(sizes.filter(F.col("n") > group).select("gram"), "gram", "left_semi")
    single = over.withColumn("k", F.explode(F.sequence(F.lit(0), F.length("text") - WIDTH))).select(
        "doc_id", "text_hash", (F.col("start") + F.col("k")).alias("start"), "copies", F.substring("text", F.col("k") + 1, F.lit(WIDTH)).alias("window")
    )
    single = single.select("doc_id", "text_hash", "start", "copies", F.xxhash64("window").alias("w1"), F.xxhash64(F.lit("again"), "window").alias("w2"))
    again = single.groupBy("w1", "w2").agg(F.sum("copies").alias("m")).filter("m > 1").select("w1", "w2")
    covered = single.join(again, ["w1", "w2"], "left_semi").select("doc_id", "text_hash", "start", (F.col("start") + WIDTH).alias("stop"))
    return fit, covered


def _in_part(size: int, gram_at: int) -> Iterator[tuple[int, int, int, int]]:
    """(part, shared bytes' offset, first window's offset, windows) of a run's parts."""
    first = SPAN - 1 - gram_at
    last = first + size - WIDTH
    for part in range(first // PART, last // PART + 1):
        lo, hi = max(first, part * PART), min(last, part * PART + PART - 1)
        yield part, part * PART + PART - 1 - first, lo - first, hi - lo + 1


def shard_repeats(rows: list[tuple], memory: int = MEMORY, spilled: Callable[[int], None] | None = None) -> list[tuple[int, int, int, int]]:
    """Covered (doc_id, text_hash, start, stop) of a shard's runs.

    Rows: gram, doc_id, text_hash, start, gram_at, copies, text. Parts of a run whose shared bytes
    no other run of the gram has cannot repeat; the rest is suffix-sorted, equal texts once.
    """
    seen: dict[tuple, int] = {}
    parts = []
    for i, (gram, _, _, _, gram_at, copies, text) in enumerate(rows):
        for part, shared_at, offset, n in _in_part(len(text), gram_at):
            key = (gram, part, xxhash.xxh3_64_intdigest(text[shared_at : _shared_end(part, gram_at)]))
            seen[key] = seen.get(key, 0) + copies
            parts.append((key, i, offset, n))
    distinct: dict[tuple[bytes, tuple], list] = {}
    for key, i, offset, n in parts:
        if seen[key] > 1:
            distinct.setdefault((rows[i][6][offset : offset + n + WIDTH - 1], key), []).append((i, offset))
    segments = [text for text, _ in distinct]
    homes = list(distinct.values())
    out = []
    whole = [len(h) > 1 or rows[h[0][0]][5] > 1 for h in homes]
    for home, twice, segment in zip(homes, whole, segments, strict=True):
        if twice:
            out += [(rows[i][1], rows[i][2], rows[i][3] + o, rows[i][3] + o + len(segment)) for i, o in home if rows[i][5] == 1]
    if segments:
        which, at = equal_windows(segments, WIDTH, memory, spilled)
        if len(which):
            cut = np.flatnonzero((which[1:] != which[:-1]) | (at[1:] != at[:-1] + 1)) + 1
            begins, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(which)]]) - 1
            for k, lo, hi in zip(which[begins].tolist(), at[begins].tolist(), at[ends].tolist(), strict=True):
                if not whole[k]:
                    i, o = homes[k][0]
                    out.append((rows[i][1], rows[i][2], rows[i][3] + o + lo, rows[i][3] + o + hi + WIDTH))
    return out


def _shared_end(part: int, gram_at: int) -> int:
    """Offset in its run of the end of part ``part``'s first window."""
    return part * PART + WIDTH - (SPAN - 1 - gram_at)


def _shards(runs: DataFrame, memory: int, spilled: Accumulator | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])

        def emit(rows: list[tuple]) -> pa.RecordBatch:
            found = shard_repeats(rows, memory, None if spilled is None else spilled.add)
            cols = list(zip(*found, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last and size >= SHARD_BYTES:
                    yield emit(rows)
                    rows, size = [], 0
                last = row[0]
                size += len(row[6])
                rows.append(row)
        if rows:
            yield emit(rows)

    n = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = ["gram", "doc_id", "text_hash", "start", "gram_at", "copies", "text"]
    return runs.select(*cols).repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(run, "doc_id long, text_hash long, start int, stop int")


def covered_ranges(docs: DataFrame, group: int = GROUP, memory: int = MEMORY, spilled: Accumulator | None = None) -> DataFrame:
    """(doc_id, text_hash, start, stop), overlapping: together the bytes that repeat.

    ``memory``: share of each sorter's queues, whatever the size of its shard; ``spilled`` adds up the bytes beyond it.
    """
    spark, keyed = docs.sparkSession, _keyed(docs)
    found = written(spark, anchors(keyed), "repeat-anchors")
    runs = written(
        spark,
        found.groupBy("gram", "run").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "text_hash", "start", "size", "gram_at")).alias("first")),
        "repeat-runs",
    )
    twice = skew.joined(found, runs.filter("copies > 1").select("gram", "run", "copies"), ["gram", "run"], "copies")
    whole = twice.select("doc_id", "text_hash", "start", (F.col("start") + F.col("size")).alias("stop"))
    grams = written(spark, runs.groupBy("gram").count().filter("count > 1"), "repeat-grams")
    heads = skew.joined(runs, grams.withColumn("n", F.col("count")), ["gram"], "n").select("gram", "count", "copies", "first.*")
    texts = keyed.filter(F.length("text") >= WIDTH)
    known = F.substring("text", F.col("start") + 1, F.col("size")).alias("text")
    # A document that is there twice gives its runs twice; their copies say so already.
    rows = heads.join(texts, ["doc_id", "text_hash"]).select("gram", "count", "doc_id", "text_hash", "start", "gram_at", "copies", known)
    out = whole
    if grams.filter(F.col("count") > group).limit(1).count():
        rows = written(spark, rows, "repeat-rows")
        fit, single = _dealt_again(rows.filter(F.col("count") > group).drop("count", "size"), group)
        out = out.unionByName(single)
        rows = rows.filter(F.col("count") <= group).drop("count").unionByName(fit)
    return out.unionByName(written(spark, _shards(rows, memory, spilled), "repeat-ranges"))


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def kept_texts(docs: DataFrame, group: int = GROUP, memory: int = MEMORY, spilled: Accumulator | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` (bytes) of every row of ``docs``."""
    return _removed(docs, covered_ranges(docs, group, memory, spilled), whole=True)


def _removed(docs: DataFrame, ranges: DataFrame, whole: bool) -> DataFrame:
    gathered = ranges.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    rows = _keyed(docs).join(gathered, ["doc_id", "text_hash"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, ...] = ([], [], [], [], [])
            for key, text, ranges_ in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = text.as_py()
                spans = merged([(r["start"], r["stop"]) for r in ranges_.as_py() or ()])
                kept, at = [], 0
                for start, stop in spans:
                    kept.append(data[at:start])
                    at = stop
                kept.append(data[at:])
                left = b"".join(kept)
                for c, x in zip(cols, (key, len(data), len(data) - len(left), len(spans), left if whole else hashlib.sha256(left).hexdigest()), strict=True):
                    c.append(x)
            last = pa.binary() if whole else pa.string()
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], last)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept" if whole else "kept_sha256"])

    return rows.select("own_id", "text", "ranges").mapInArrow(run, f"doc_id long, n_bytes long, n_removed long, n_spans long, {'kept binary' if whole else 'kept_sha256 string'}")


def op9_repeats(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return _removed(docs, covered_ranges(docs), whole=False)
