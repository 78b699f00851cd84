"""Benchmark decontamination: words of documents that lie inside a benchmark window are hit.

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case. A
window is ``WIDTH`` consecutive words of an item, or a shorter item's words as a whole.

1. The benchmark is cut into pieces of bounded length that share ``WIDTH - 1`` words, and dealt
   into blocks whose bytes are checked (``BLOCK_BYTES``); a block's windows are broadcast.
   For each block there is one pass over the documents, so a benchmark may have any size.
2. A task indexes its documents in shards of ``SHARD_WORDS`` words (:mod:`fmindex`). Words that
   no item of the block has cannot match; each run of them is one end symbol. All other words are indexed.
3. All windows of the block are searched backward together; their rows are located by sampled
   suffix positions and merged into spans of each document.

With one block nothing is shuffled. With more, spans meet again by the place of the row.

Defined results: null and empty texts have no words and no hits; an item without words is
none; rows that share an item_id are one item, a null item_id is named by the empty string; repeated
documents are judged alike; an empty table on either side gives no hits; other columns are passed on
by :func:`marked`. A document longer than a shard is indexed in parts that share ``WIDTH - 1`` words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequill.session import identified, written

from .fmindex import FMIndex
from .words import pieces, words

WIDTH = 10
SHARD_WORDS = 1 << 20
#: Words of an item that are one row of a block.
PIECE_WORDS = 4096
BLOCK_BYTES = 8 << 20
_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOUND = "_hits struct<n_words:bigint,spans:array<struct<start:bigint,stop:bigint>>,items:array<string>>"


class Windows:
    """The distinct windows of a block as symbols, and the items that have each."""

    def __init__(self, rows: list[tuple[str, bytes]], width: int = WIDTH) -> None:
        self.width = width
        names = sorted({item for item, _ in rows})
        number = {item: i for i, item in enumerate(names)}
        self.names = names
        self.vocabulary: dict[bytes, int] = {}
        found, owners = [np.zeros((0, width), np.int32)], [np.zeros(0, np.int64)]
        for item, text in rows:
            own = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int32)
            if len(own):
                own = np.concatenate([np.zeros(max(0, width - len(own)), np.int32), own])
                found.append(np.lib.stride_tricks.sliding_window_view(own, width))
                owners.append(np.full(len(own) - width + 1, number[item]))
        self.windows, which = np.unique(np.concatenate(found), axis=0, return_inverse=True)
        self.lengths = (self.windows > 0).sum(axis=1)
        pairs = np.unique(which.reshape(-1) * max(1, len(names)) + np.concatenate(owners))
        self.owners = pairs % max(1, len(names))
        self.owner_at = np.searchsorted(pairs // max(1, len(names)), np.arange(len(self.windows) + 1))

    def symbols(self, text: bytes) -> np.ndarray:
        """The words of ``text`` by number, 0 for a word that no item has."""
        own = [np.fromiter(map(self.vocabulary.get, some, repeat(0)), np.int32, len(some)) for some in pieces(text)]
        return own[0] if len(own) == 1 else np.concatenate(own) if own else np.zeros(0, np.int32)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges lo to hi, and which range each is of."""
    n = hi - lo
    which = np.repeat(np.arange(len(lo)), n)
    return np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), which


def search_shard(parts: list[tuple[int, int, np.ndarray]], own: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Spans (row, start, stop) and pairs (row, item) of a shard.

    ``parts``: a document's row, the number of the part's first word, and its words as symbols.
    """
    sizes = np.array([len(x) + 1 for _, _, x in parts], np.int64)
    begins = np.cumsum(sizes) - sizes
    text = np.zeros(int(sizes.sum()), np.int32)
    for begin, (_, _, x) in zip(begins, parts, strict=True):
        text[begin : begin + len(x)] = x
    kept = np.flatnonzero((text > 0) | (np.concatenate([[0], text[:-1]]) > 0))
    none = np.zeros((0, 3), np.int64), np.zeros((0, 2), np.int64)
    if not len(kept) or not len(own.windows):
        return none
    index = FMIndex(text[kept], len(own.vocabulary) + 1)
    rows, which = _ranges(*index.search(own.windows))
    if not len(rows):
        return none
    at = kept[index.locate(rows)]
    edges = np.zeros(len(text) + 1, np.int32)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + own.lengths[which], -1)
    hit = np.concatenate([[False], np.cumsum(edges) > 0])
    start, stop = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:])
    row, first = np.array([r for r, _, _ in parts], np.int64), np.array([f for _, f, _ in parts], np.int64)
    part = np.searchsorted(begins, start, "right") - 1
    spans = np.stack([row[part], first[part] + start - begins[part], first[part] + stop - begins[part]], axis=1)
    pairs = np.unique(row[np.searchsorted(begins, at, "right") - 1] * len(own.windows) + which)
    owner, of = _ranges(own.owner_at[pairs % len(own.windows)], own.owner_at[pairs % len(own.windows) + 1])
    pairs = np.unique((pairs // len(own.windows))[of] * len(own.names) + own.owners[owner])
    return spans, np.stack([pairs // len(own.names), pairs % len(own.names)], axis=1)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


def search_texts(texts: list[bytes], own: Windows, shard_words: int = SHARD_WORDS) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """(n_words, merged spans, items in order) of every text."""
    lengths, spans, items = [0] * len(texts), [[] for _ in texts], [set() for _ in texts]
    shard: list[tuple[int, int, np.ndarray]] = []
    size = 0

    def close() -> None:
        found, pairs = search_shard(shard, own)
        for row, start, stop in found.tolist():
            spans[row].append((start, stop))
        for row, item in pairs.tolist():
            items[row].add(own.names[item])
        shard.clear()

    step = max(1, shard_words - own.width + 1)
    for row, text in enumerate(texts):
        symbols = own.symbols(text)
        lengths[row] = len(symbols)
        for first in range(0, max(1, len(symbols) - own.width + 1), step):
            shard.append((row, first, symbols[first : first + step + own.width - 1]))
            size += len(shard[-1][2])
            if size >= shard_words:
                close()
                size = 0
    if shard:
        close()
    return [(n, merged(s), sorted(i)) for n, s, i in zip(lengths, spans, items, strict=True)]


def _blocks(benchmark: DataFrame, width: int, limit: int) -> tuple[DataFrame, int]:
    """Pieces of all items (item, text, block), as a table, and the number of blocks, each of ``limit`` bytes at most (or one piece)."""
    lowered = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER)
    own = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.regexp_extract_all(lowered, F.lit(_WORD), F.lit(0)).alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)), F.lit(PIECE_WORDS))
    cut = own.filter(F.size("w") > 0).select("item", "w", F.explode(starts).alias("at"))
    cut = cut.select("item", F.array_join(F.slice("w", F.col("at") + 1, F.lit(PIECE_WORDS + width - 1)), " ").alias("text"))
    rows = written(benchmark.sparkSession, cut, "windows")
    total = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    n = max(1, 2 * (total[0] or 0) // limit)
    while True:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
        most = dealt.groupBy("block").agg(F.sum(F.octet_length("text")).alias("b"), F.countDistinct("item", "text").alias("k")).filter(F.col("k") > 1).agg(F.max("b")).first()[0] or 0
        if most <= limit or n >= 64 * total[1]:
            return dealt, n
        n *= 2


def _pass(docs: DataFrame, own: Windows, shard_words: int) -> DataFrame:
    """``docs`` with the column ``_hits``."""
    known = docs.sparkSession.sparkContext.broadcast(own)
    at = docs.columns.index("text")
    sent = docs.withColumn("text", F.col("text").cast("string"))
    kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            found = [{"n_words": n, "spans": [{"start": a, "stop": b} for a, b in s], "items": i} for n, s, i in search_texts(texts, known.value, shard_words)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, "_hits"])

    return sent.mapInArrow(run, ", ".join([*(f"`{c}` {t}" for c, t in sent.dtypes), _FOUND]))


def marked(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` and ``_hits``: n_words, spans (words ``start`` to ``stop``, exclusive, maximal) and items (sorted) of every row."""
    dealt, n = _blocks(benchmark, width, block_bytes)

    def block(k: int) -> Windows:
        rows = dealt.filter(F.col("block") == k).select("item", "text").distinct().collect()  # bounded by block_bytes
        return Windows(sorted((r.item, r.text.encode()) for r in rows), width)

    if n == 1:
        return _pass(docs, block(0), shard_words)
    spark = docs.sparkSession
    keyed = identified(docs, "_place")
    texts = keyed.select("_place", "text")
    found = None
    for k in range(n):
        own = _pass(texts, block(k), shard_words).select("_place", "_hits")
        some = written(spark, own if k == 0 else own.filter(F.size("_hits.spans") > 0), "block-hits")
        found = some if found is None else found.unionByName(some)
    joined = found.groupBy("_place").agg(
        F.max("_hits.n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("_hits.spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_hits.items")))).alias("items")
    )
    spans = F.expr(
        "aggregate(s, cast(array() AS array<struct<start:bigint,stop:bigint>>), (a, x) -> CASE WHEN size(a) > 0 AND x.start <= element_at(a, -1).stop "
        "THEN array_append(slice(a, 1, size(a) - 1), named_struct('start', element_at(a, -1).start, 'stop', greatest(element_at(a, -1).stop, x.stop))) ELSE array_append(a, x) END)"
    )
    hits = joined.select("_place", F.struct("n_words", spans.alias("spans"), "items").alias("_hits"))
    return keyed.join(hits, "_place").drop("_place")


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without its words ``start`` to ``stop`` of every span, and without what stands between them."""
    places = [m.span() for m in _BYTES.finditer(text)] if spans else []
    kept, at = [], 0
    for start, stop in spans:
        kept.append(text[at : places[start][0]])
        at = places[stop - 1][1]
    return b"".join([*kept, text[at:]])


def removed(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """``docs``, each text without its spans, from the first to the last character of each; a null text stays null."""
    found = marked(docs, benchmark, width)
    at, columns = docs.columns.index("text"), [c for c in found.columns if c != "_hits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            spans = batch.column(len(columns)).field("spans").to_pylist()
            left = [None if t is None else cut(t, [(x["start"], x["stop"]) for x in s]) for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()).cast(pa.string()) if i == at else batch.column(i) for i in range(len(columns))], columns)

    return found.mapInArrow(run, found.drop("_hits").schema)


def op11_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    found = marked(docs.select("doc_id", "text"), benchmark)
    n_hit = F.aggregate("_hits.spans", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    out = found.select("doc_id", F.col("_hits.n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_hits.items").cast("long").alias("n_items"), F.sha2(F.array_join("_hits.items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


_OWN_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}')"
OP11_SQL = f"""
WITH b AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, {_OWN_WORDS} AS w FROM benchmark),
k AS (SELECT DISTINCT item, least(len(w), {WIDTH}) AS size, unnest(list_transform(range(1, greatest(len(w) - {WIDTH}, 0) + 2), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))) AS win
      FROM b WHERE len(w) > 0),
z AS (SELECT DISTINCT size FROM k),
d AS (SELECT row_number() OVER () AS r, doc_id, {_OWN_WORDS} AS w FROM documents),
p AS (SELECT r, size, unnest(range(1, len(w) - size + 2)) AS o, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i:i + size - 1], ' '))) AS win FROM d, z WHERE len(w) >= size),
h AS (SELECT r, o, p.size, item FROM p JOIN k ON p.size = k.size AND p.win = k.win),
c AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(o, o + size)) AS x FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)
"""
