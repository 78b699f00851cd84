"""Ranked lexical search over a two-level quantised index.

A document's score for an item sums ``w * part(tf, m)`` over the item's terms, repeats
included; ``w`` falls with the term's document frequency, ``m`` grows with the document's
length. All is integer arithmetic but the logarithm in ``w``.

1. :func:`statistics` counts documents with terms and their terms, in one pass without a shuffle.
2. :func:`index` writes shards of ``SHARD_WORDS`` words: every term of every document, with a byte
   impact (the part of its score, in units of ``UNIT`` rounded up: first level) and its frequency (second level).
3. :func:`search` takes the items in blocks of checked size. Document frequencies of a block's terms
   are summed over the shards. A task then adds byte impacts: they bound each score from
   above, and less a unit a term from below. Documents whose upper bound reaches the k-th
   lower bound of what the task has seen are scored exactly; its k best go on.

Shards are read one by one; a task holds k documents an item. Nothing is shuffled but the
results of tasks, and counts by term.

Defined results: null and empty texts, and texts without terms, are no documents of the index;
repeated rows are documents of their own, with a rank each; equal scores go by ascending
doc_id, null last; items without known terms, and null ones, give no rows; rows that share
an item_id are ranked each on its own; scores of 0 give no rows; an empty table on either
side gives none; a very long text is one document, read in pieces; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracequill.session import identified, written

from .words import pieces, words

TOP = 10
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 4 << 20
SCALE = 1_000_000_000
#: A byte holds a part of the score in this unit; parts are under SCALE / 1000.
UNIT = -(-SCALE // 1000 // 255)
_INDEX = "terms binary, starts binary, docs binary, impacts binary, counts binary, doc_ids binary, unnamed binary, norms binary"


def norm(n, n_docs: int, n_terms: int):
    """The divisor's length part of documents with ``n`` terms."""
    return 25 + (75 * n * n_docs) // n_terms


def part(tf, m):
    return (SCALE * tf) // (1000 * tf + 8 * m)


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))


def statistics(docs: DataFrame) -> tuple[int, int]:
    """Documents with a term, and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sum(map(len, pieces(x.as_py()))) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(map(bool, own))], pa.int64()), pa.array([sum(own)], pa.int64())], ["n", "terms"])

    row = _texts(docs).select("text").mapInArrow(run, "n long, terms long").agg(F.sum("n"), F.sum("terms")).first()
    return row[0] or 0, row[1] or 0


class _Shard:
    """Documents on their way into a row of the index."""

    def __init__(self) -> None:
        self.terms: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.own: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        found = [np.fromiter(map(self.terms.__getitem__, some), np.int64, len(some)) for some in pieces(text)]
        n = sum(map(len, found))
        if n:
            own, counts = np.unique(np.concatenate(found), return_counts=True)
            self.ids.append(doc_id)
            self.lengths.append(n)
            self.own.append(own)
            self.counts.append(counts)
            self.size += n

    def row(self, n_docs: int, n_terms: int) -> list[bytes]:
        docs = np.repeat(np.arange(len(self.own), dtype=np.int32), [len(x) for x in self.own])
        term, tf = np.concatenate(self.own), np.concatenate(self.counts)
        order = np.argsort(term, kind="stable")
        norms = np.array([norm(n, n_docs, n_terms) for n in self.lengths], np.int64)
        docs, tf = docs[order], tf[order]
        impacts = -(-part(tf, norms[docs]) // UNIT)
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.terms)))])
        ids = np.array([x or 0 for x in self.ids], np.int64)
        unnamed = np.array([x is None for x in self.ids], np.uint8)
        return [b" ".join(self.terms), starts.astype(np.int32).tobytes(), docs.tobytes(), impacts.astype(np.uint8).tobytes(), tf.astype(np.int32).tobytes(), ids.tobytes(), unnamed.tobytes(), norms.tobytes()]


def index(docs: DataFrame, n_docs: int, n_terms: int, shard_words: int = SHARD_WORDS) -> DataFrame:
    """A row for each shard, as a table in the shared folder."""
    names = [c.split()[0] for c in _INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard.add(doc_id, text.as_py())
                if shard.size >= shard_words:
                    yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in shard.row(n_docs, n_terms)], names)
                    shard = _Shard()
        if shard.size:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in shard.row(n_docs, n_terms)], names)

    return written(docs.sparkSession, _texts(docs).mapInArrow(run, _INDEX), "lexical-index")


def _postings(terms: bytes, wanted: dict[bytes, int]) -> list[tuple[int, int]]:
    """(wanted number, place among the shard's terms) of the terms that both have."""
    return [(wanted[t], i) for i, t in enumerate(terms.split(b" ")) if t in wanted]


def frequencies(found: DataFrame, wanted: list[bytes]) -> np.ndarray:
    """Of each of ``wanted`` terms (a block's) the documents that hold it."""
    own = found.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(wanted)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(own.value), np.int64)
        for batch in batches:
            for terms, starts in zip(batch.column(0), batch.column(1), strict=True):
                sizes = np.diff(np.frombuffer(starts.as_py(), np.int32))
                for k, i in _postings(terms.as_py(), own.value):
                    total[k] += sizes[i]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "df"])

    df = np.zeros(len(wanted), np.int64)
    for r in found.select("terms", "starts").mapInArrow(run, "k long, df long").groupBy("k").agg(F.sum("df").alias("df")).collect():  # a block's terms at most
        df[r.k] = r.df
    return df


class Ranking:
    """The best documents of each query over the shards of a task."""

    def __init__(self, queries: list[list[tuple[int, int]]], k: int) -> None:
        self.queries, self.k = queries, k
        self.floors = [np.zeros(0, np.int64) for _ in queries]
        self.best: list[list[tuple[int, bool, int]]] = [[] for _ in queries]
        self.bounded = self.scored = 0

    def add(self, places: dict[int, int], starts: np.ndarray, docs: np.ndarray, impacts: np.ndarray, counts: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, norms: np.ndarray) -> None:
        """``queries``: for each its terms' numbers and weights (repeats multiplied in); ``places``: of those the shard has."""
        wide = impacts.astype(np.int64)
        for q, query in enumerate(self.queries):
            own = [(starts[places[t]], starts[places[t] + 1], w) for t, w in query if w and t in places]
            if not own:
                continue
            above, terms = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            for a, b, w in own:
                above[docs[a:b]] += w * wide[a:b]
                terms[docs[a:b]] += w
            some = np.flatnonzero(above)
            lower = (above[some] - terms[some]) * UNIT
            top = np.concatenate([self.floors[q], lower[lower > 0]])
            if len(top) > self.k:
                top = np.partition(top, len(top) - self.k)[-self.k :]
            self.floors[q] = top
            floor = top.min() if len(top) == self.k else 1
            few = some[above[some] * UNIT >= floor]
            self.bounded += len(some)
            self.scored += len(few)
            if len(few):
                self._rescore(q, own, few, docs, counts, ids, unnamed, norms)

    def _rescore(self, q: int, own: list, few: np.ndarray, docs: np.ndarray, counts: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, norms: np.ndarray) -> None:
        score = np.zeros(len(few), np.int64)
        for a, b, w in own:
            at = np.searchsorted(docs[a:b], few)
            at[at == b - a] = 0
            here = docs[a:b][at] == few
            score[here] += w * part(counts[a:b][at[here]].astype(np.int64), norms[few[here]])
        keep = np.lexsort([ids[few], unnamed[few], -score])[: self.k]
        rows = [(-int(score[i]), bool(unnamed[few[i]]), int(ids[few[i]])) for i in keep if score[i] > 0]
        self.best[q] = sorted(self.best[q] + rows)[: self.k]


def _query_blocks(items: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """All items (place, item_id, text, block) as a table, and the number of blocks, each of ``limit`` bytes at most (or one item)."""
    own = identified(items, "_place").select("_place", "item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = written(items.sparkSession, own, "queries")
    total = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    n = max(1, 2 * (total[0] or 0) // limit)
    while True:
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("_place"), F.lit(n)))
        most = dealt.groupBy("block").agg(F.sum(F.octet_length("text")).alias("b"), F.count(F.lit(1)).alias("k")).filter("k > 1").agg(F.max("b")).first()[0] or 0
        if most <= limit or n >= 64 * total[1]:
            return dealt, n
        n *= 2


def search(found: DataFrame, items: DataFrame, n_docs: int, k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the ``k`` best documents of every row of ``items``.

    ``found``: what :func:`index` gave; ``n_docs``: what :func:`statistics` counted.
    """
    spark = found.sparkSession
    dealt, n_blocks = _query_blocks(items, block_bytes)
    out = None
    for block in range(n_blocks):
        rows = sorted(dealt.filter(F.col("block") == block).collect(), key=lambda r: tuple(r._place))  # bounded by block_bytes
        own = [Counter(words(r.text.encode())) for r in rows]
        wanted = sorted({t for x in own for t in x})
        number = {t: i for i, t in enumerate(wanted)}
        df = frequencies(found, wanted)
        weights = [weight(int(x), n_docs) if x else 0 for x in df]
        queries = [[(number[t], weights[number[t]] * n) for t, n in x.items()] for x in own]
        some = _searched(found, number, queries, k)
        names = spark.createDataFrame([(i, tuple(r._place), r.item_id) for i, r in enumerate(rows)], f"q int, _place {dealt.schema['_place'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}")
        some = some.join(F.broadcast(names), "q").drop("q")
        out = some if out is None else out.unionByName(some)
    order = Window.partitionBy("_place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _searched(found: DataFrame, number: dict[bytes, int], queries: list[list[tuple[int, int]]], k: int) -> DataFrame:
    sent = found.sparkSession.sparkContext.broadcast((number, queries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, own = sent.value
        ranking = Ranking(own, k)
        for batch in batches:
            for i in range(batch.num_rows):
                terms, *blobs = (c[i].as_py() for c in batch.columns)
                kinds = (np.int32, np.int32, np.uint8, np.int32, np.int64, np.uint8, np.int64)
                ranking.add(dict(_postings(terms, wanted)), *(np.frombuffer(x, t) for x, t in zip(blobs, kinds, strict=True)))
        rows = [(q, None if unnamed else doc_id, -score) for q, best in enumerate(ranking.best) for score, unnamed, doc_id in best]
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["q", "doc_id", "score"])

    return found.mapInArrow(run, "q int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    n_docs, n_terms = statistics(docs)
    return search(index(docs, n_docs, max(1, n_terms), shard_words), items, n_docs, k, block_bytes)


def op12_lexical(spark, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"
OP12_SQL = f"""
WITH t AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, {_TERMS} AS term FROM (SELECT row_number() OVER () AS r, * FROM documents)) GROUP BY ALL),
d AS (SELECT r, sum(tf)::BIGINT AS n FROM t GROUP BY r),
g AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM d),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
q AS (SELECT item_id, i, term, count(*) AS c FROM (SELECT item_id, i, {_TERMS} AS term FROM (SELECT row_number() OVER () AS i, * FROM benchmark)) GROUP BY ALL),
s AS (SELECT i, item_id, r, doc_id, sum(c * floor(1000 * ln((2 * nd + 2) / (2 * df + 1)))::BIGINT * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // l))))::BIGINT AS score
      FROM q JOIN t USING (term) JOIN f USING (term) JOIN d USING (r), g GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0) WHERE rank <= {TOP}
"""
