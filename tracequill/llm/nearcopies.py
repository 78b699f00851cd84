"""Near copies: SimHash links of five-word shingles, held against exact Jaccard similarity, and completed.

A SimHash radius that the index can search (3 bits) misses most pairs with a Jaccard
similarity just above 4/5, so the fingerprints find what they can and an exact prefix
filter finds the rest; no pair of 4/5 or more is lost, and none below is linked.

1. :func:`sets`: 64-bit shingle hashes of every text, and their SimHash fingerprint; texts with
   equal sets are copies and one node from then on.
2. :func:`fingerprint_pairs`: nodes that the Gray-order index of :mod:`simhash` links.
3. Prefix filter: with every set in one common order, two sets with a similarity of 4/5
   or more share one of their first n - ceil(4n/5) + 1 hashes. The order puts hashes last
   that many texts share (:func:`common_hashes`): all texts are counted, in a table of fixed size, so
   a hash's counter is at least its texts and a passage that stands in many makes few candidates.
4. :func:`matches`: candidates are held against each other's whole sets. First those of
   the fingerprints and one for each row of a hash (:func:`_central`), then every pair that is not yet in
   one class (:func:`_meeting`); both only where the hash's places in the common order leave room for
   enough common hashes, so a large group of near copies does not grow with its square. Whole sets are
   made and shuffled only for pairs whose prefixes leave that room too (:func:`_possible`).
5. Classes are those of the links, by :func:`simhash.classes`.

Words are those of ``simhash.fingerprint``. Defined results: fewer words than a shingle
give one shingle; null, empty and white texts are without a word and copies of each
other; a long text is one set, however long; rows are told apart by their place in the
table (:func:`tracequill.session.identified`), so repeated rows and rows that share a doc_id or
have none are rows like any other; an empty table gives an empty result; other columns
are kept by :func:`representatives`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequill.session import identified, scope, scratch_path, written

from . import simhash, skew

SHINGLE = 5
#: Counters of the table that says how common a hash is (8 bytes each), and the blocks in which tasks hand them on.
COUNTERS, BLOCKS = 1 << 18, 1 << 10
#: Up to so many blocks of 4,096 places (a kilobyte each at most, besides the file's name) chosen rows are broadcast as bits; beyond, the rows are shuffled.
MAX_BROADCAST_BLOCKS = 10_000
#: Rows of one hash that a part of its smaller sides has, about.
PART = 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The hashes of all shingles of ``text`` in order, repeats included."""
    words = text.lower().split()
    at = np.fromiter((xxhash.xxh64_intdigest(w, simhash.SEED) for w in words), np.uint64, len(words))
    n = len(at) - width + 1
    if n < 1:
        n, width = min(1, len(at)), len(at)
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = mixed * _ODD + at[k : k + n]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return mixed ^ (mixed >> np.uint64(31))


def hashes(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """The distinct shingle hashes of ``text``, ascending as signed longs."""
    return np.unique(shingles(text, width).view(np.int64))


def node(found: np.ndarray) -> int:
    return simhash._signed(xxhash.xxh64_intdigest(found.tobytes(), simhash.SEED))


def _counter(found: np.ndarray) -> np.ndarray:
    """The counter of each hash of ``found``: its leading bits."""
    return (found.view(np.uint64) >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def prefix(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The hashes of which two sets with a similarity of 4/5 or more share one, those of low counters in ``common`` first."""
    return found[np.lexsort((found, common[_counter(found)]))][: len(found) - (4 * len(found) + 4) // 5 + 1]


def _arrays(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [hashes(x.as_py() or b"") for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([node(x) for x in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["node", "hashes"])

    return texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(run, "node long, hashes array<long>")


def common_hashes(docs: DataFrame) -> np.ndarray:
    """In how many texts of ``docs`` the hashes of each counter stand, summed over them; all texts count.

    A task hands on its counters in blocks, whatever its texts, and blocks are added up as they come.
    """
    step = COUNTERS // BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for x in batch.column(0):
                np.add.at(seen, _counter(hashes(x.as_py() or b"")), 1)
        yield from blocks({k: seen[k * step : (k + 1) * step] for k in range(BLOCKS)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[k] = total.get(k, 0) + np.frombuffer(part.as_py(), np.int64)
        yield from blocks(total)

    def blocks(of: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        some = {k: x for k, x in of.items() if x.any()}
        yield pa.RecordBatch.from_arrays([pa.array(list(some), pa.int32()), pa.array([x.tobytes() for x in some.values()], pa.binary())], ["block", "counts"])

    shape = "block int, counts binary"
    rows = docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, shape).repartition("block").mapInArrow(add, shape)
    table = np.zeros(COUNTERS, np.int64)
    for r in rows.collect():
        table[r.block * step : (r.block + 1) * step] = np.frombuffer(r.counts, np.int64)
    return table


def sets(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """doc_id, _row, node, fingerprint, number of hashes, prefix and the counter of its last hash of every row of doc_id, _row, text."""
    # 8 bytes a counter: a proven bound.
    known = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [shingles(x.as_py() or b"") for x in batch.column(2)]
            found = [np.unique(x.view(np.int64)) for x in every]
            longs = ([node(x) for x in found], [simhash._signed(simhash.majority(x)) for x in every], [len(x) for x in found])
            first = [prefix(x, known.value) for x in found]
            ends = [int(known.value[_counter(x[-1:])][0]) if len(x) else 0 for x in first]
            columns = [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in longs), pa.array(first, pa.list_(pa.int64())), pa.array(ends, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "_row", "node", "fp", "n", "prefix", "rank"])

    texts = rows.select("doc_id", "_row", F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, _row struct<f:string,i:long>, node long, fp long, n long, prefix array<long>, rank long")


def _checked(pairs: DataFrame, arrays: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have a similarity of 4/5 or more."""
    left, right = (arrays.select(F.col("node").alias(x), F.col("hashes").alias(f"of_{x}")) for x in "ab")
    both = F.size(F.array_intersect("of_a", "of_b"))
    return pairs.join(left, "a").join(right, "b").filter(9 * both >= 4 * (F.size("of_a") + F.size("of_b"))).select("a", "b")


def _possible(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose prefixes leave room for a similarity of 4/5. ``prefixes``: node, n, prefix, rank.

    What two sets share up to the end of the prefix that ends first in the common order is in both prefixes;
    behind it the set of that prefix has n less the prefix's length.
    """
    left, right = (prefixes.select(*(F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in ("node", "n", "prefix", "rank"))) for x in "ab")
    end = lambda x: F.struct(f"rank_{x}", F.try_element_at(f"prefix_{x}", F.lit(-1)))
    behind = F.when(end("a") <= end("b"), F.col("n_a") - F.size("prefix_a")).otherwise(F.col("n_b") - F.size("prefix_b"))
    most = F.size(F.array_intersect("prefix_a", "prefix_b")) + behind
    return pairs.join(left, "a").join(right, "b").filter(9 * most >= 4 * (F.col("n_a") + F.col("n_b"))).select("a", "b")


def _placed(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Those of ``rows`` whose ``_row`` is one of ``chosen`` (_row); the rows are not shuffled.

    A chosen place is a bit, bits are broadcast by file and block of 4,096 places.
    """
    spark = rows.sparkSession
    words = chosen.groupBy(F.col("_row.f").alias("f"), F.expr("_row.i div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(_row.i % 64 AS int)))").alias("bits"))
    blocks = words.groupBy("f", F.expr("word div 64").alias("block")).agg(F.map_from_entries(F.collect_list(F.struct(F.expr("cast(word % 64 AS int)").alias("k"), "bits"))).alias("words"))
    known = written(spark, blocks, "near-places")
    if known.limit(MAX_BROADCAST_BLOCKS + 1).count() > MAX_BROADCAST_BLOCKS:
        return rows.join(chosen, "_row", "left_semi")
    file, i = rows["_row"]["f"], rows["_row"]["i"]
    word = F.coalesce(F.try_element_at(known["words"], F.shiftright(i, 6).bitwiseAND(63).cast("int")), F.lit(0).cast("long"))
    same = (file == known["f"]) & (F.shiftright(i, 12) == known["block"])
    return rows.join(F.broadcast(known), same & (F.getbit(word, i.bitwiseAND(63).cast("int")) == 1), "left_semi")


def _ends(rows: DataFrame, firsts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of each node of ``pairs`` the one of ``rows`` that ``firsts`` names."""
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    return _placed(rows, firsts.join(nodes, "node", "left_semi").select("first._row"))


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b) of ``nodes`` (node, n, fp) that the Gray-order index links within ``simhash.MAX_BITS``, or whose fingerprints are equal."""
    spark = nodes.sparkSession
    heads = written(spark, nodes.groupBy("fp").agg(F.min("node").alias("head"), F.min_by("n", "node").alias("head_n"), F.count(F.lit(1)).alias("c")), "near-prints")
    same = skew.joined(nodes, heads, ["fp"], "c").select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("head").alias("b"), F.col("head_n").alias("n_b"))
    ends = [heads.select(F.col("fp").alias(x), F.col("head").alias(f"head_{x}"), F.col("head_n").alias(f"n_{x}")) for x in "ab"]
    linked = simhash.links(heads.select("fp")).join(ends[0], "a").join(ends[1], "b")
    apart = linked.select(F.col("head_a").alias("a"), "n_a", F.col("head_b").alias("b"), "n_b")
    fit = same.unionByName(apart).filter("a <> b AND 4 * greatest(n_a, n_b) <= 5 * least(n_a, n_b)")
    return fit.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


#: Whether two sets with a common hash can be a link: that hash leaves both room for enough common ones, and sizes agree.
_FIT = "n_b <= top_a AND n_a <= top_b AND 4 * greatest(n_a, n_b) <= 5 * least(n_a, n_b)"


def _band(size: Column) -> Column:
    """5/4 of ``size`` lies in the same band or the next."""
    return F.floor(F.log(F.greatest(size, F.lit(1))) / F.log(F.lit(1.2501)))


def _shared(one: DataFrame) -> DataFrame:
    """h, node, n, at, top, band, members: a row for each hash of a prefix that has several.

    Of the first common hash of two sets all further ones lie behind in both. At place ``at`` (from 0)
    of n there are at most n - at, and a link has 4/9 of both sizes: so no partner is larger than ``top``.
    """
    spread = one.select("node", "n", F.posexplode("prefix").alias("at", "h")).withColumn("members", F.count(F.lit(1)).over(Window.partitionBy("h")))
    return spread.filter("members > 1").select("h", "node", "n", "at", F.expr("(9 * (n - at)) div 4 - n").alias("top"), _band(F.col("n")).alias("band"), "members")


def _central(shared: DataFrame) -> DataFrame:
    """(a, b), a < b, that can be links: each row of a hash with the one of its band in which the hash comes first.

    The latter has the fewest rarer hashes and so lies amid the texts that grew from one.
    """
    in_band = Window.partitionBy("h", "band")
    beside = shared.withColumn("middle", F.min(F.struct("at", "n", "node", "top")).over(in_band))
    met = beside.select(*(F.col(f"{side}{c}").alias(f"{c}_{to}") for side, to in (("", "a"), ("middle.", "b")) for c in ("node", "n", "top"))).filter(f"node_a <> node_b AND {_FIT}")
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))


def _meeting(rooted: DataFrame) -> DataFrame:
    """(a, b), a < b, of different roots under one hash that can be links.

    A row whose ``top`` is below its own n meets smaller sets only. The smaller side goes to the bands
    that a partner can have, and that of a hash with many rows to parts of about ``PART`` rows.
    """
    rows = rooted.withColumn("parts", F.expr(f"members div {PART} + 1"))
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "top", "root")]
    reach = _band(F.least("top", F.expr("5 * n div 4")))
    small = rows.filter("top >= n").withColumn("band", F.explode(F.array_distinct(F.array("band", reach))))
    small = small.select("h", "band", F.expr("pmod(xxhash64(node), parts)").alias("part"), *side("a"))
    large = rows.select("h", "band", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), *side("b"))
    apart = "root_a <> root_b AND (n_a < n_b OR n_a = n_b AND node_a < node_b)"
    met = small.join(large, ["h", "band", "part"]).filter(f"{apart} AND {_FIT}")
    return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def _linked(rows: DataFrame, found: DataFrame, firsts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of the table ``pairs`` that are links; the prefixes and sets that decide go again at once."""
    spark = rows.sparkSession
    path = scratch_path(spark, "near-links")
    with scope(spark):
        prefixes = written(spark, _ends(found, firsts, pairs).select("node", "n", "prefix", "rank"), "near-ends")
        likely = written(spark, _possible(pairs, prefixes), "near-likely")
        links = _checked(likely, written(spark, _arrays(_ends(rows, firsts, likely)), "near-sets"))
        links.write.parquet(path)
    return spark.read.schema(links.schema).parquet(path)


def matches(rows: DataFrame, found: DataFrame, firsts: DataFrame) -> DataFrame:
    """(a, b): enough links of nodes with a similarity of 4/5 or more that classes are the same as of all."""
    spark = rows.sparkSession
    shared = written(spark, _shared(_placed(found, firsts.select("first._row"))), "near-shared")
    prints = found.select("node", "n", "fp").distinct()
    tried = written(spark, _central(shared).unionByName(fingerprint_pairs(prints)).distinct(), "near-pairs")
    links = _linked(rows, found, firsts, tried)

    member = simhash.classes(links)
    rooted = shared.join(member, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = written(spark, _meeting(rooted).join(tried, ["a", "b"], "left_anti"), "near-pairs")
    more = _linked(rows, found, firsts, rest)
    return member.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ``docs`` with their node, nodes with their root); ``docs`` has a column ``_row``."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "_row", "text")
    found = written(spark, sets(rows, common_hashes(docs)), "near-prefixes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "_row")).alias("first")
    firsts = written(spark, found.groupBy("node").agg(first, F.count(F.lit(1)).alias("n")), "near-nodes")
    member = simhash.classes(matches(rows, found, firsts))
    return found, written(spark, firsts.join(member, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first", "n"), "near-rooted")


def components(docs: DataFrame) -> DataFrame:
    """doc_id, root and component_id (the smallest doc_id of the class ``root``) of every row of ``docs``."""
    spark = docs.sparkSession
    found, rooted = _classes(identified(docs))
    least = written(spark, rooted.groupBy("root").agg(F.min("first.doc_id").alias("component_id"), F.count(F.lit(1)).alias("n_nodes")), "near-roots")
    of_node = written(spark, skew.joined(rooted.select("node", "root", "n"), least, ["root"], "n_nodes"), "near-classes")
    return skew.joined(found.select("doc_id", "node"), of_node, ["node"], "n").select("doc_id", "root", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """Of each class the row with the smallest doc_id, with all columns of ``docs``.

    Rows without a doc_id come after all others; of equal doc_ids in a class the first row in the table stays.
    """
    keyed = identified(docs)
    kept = _classes(keyed)[1].groupBy("root").agg(F.min("first").alias("first")).select("first._row")
    kept = written(docs.sparkSession, kept, "near-kept")
    return _placed(keyed, kept).select(*docs.columns)
