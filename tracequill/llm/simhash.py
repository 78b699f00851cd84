"""SimHash near-duplicate classes through a Gray-order hierarchical index.

1. :func:`fingerprints`: 64-bit SimHash of every whole text (no shuffle).
2. :func:`nodes`: distinct fingerprints with their smallest doc_id, so copies weigh nothing later.
3. :func:`buckets`: fingerprints within 3 bits agree on one of four 16-bit blocks, so
   each goes to four buckets. A bucket over ``BUCKET`` members is dealt again by
   four parts of its open bits, and so on; after ``LEVELS`` levels at most 15 bits are
   open, so no bucket can exceed 32,768 members whatever the corpus. No link is lost.
4. :class:`GrayForest`, the only way that links arise: a bucket is the upper node of its
   members, below it they lie in Gray-rank order, bits that a run of members shares
   are factored into its node, and whole nodes are pruned by the differences added up
   from the root. Each bucket gives links to its classes' first members.
5. :func:`classes`: star contraction over those links, cut by tables in the shared folder.

Joins on a fingerprint, a class or a hub take hot keys apart (:mod:`skew`), since a
third of all documents may be one text.

Defined results: null or empty text, or one of white space only, has fingerprint
zero, which links like any other; fewer words than a shingle give one shingle;
repeated rows are copies; rows with null doc_id get a class (the smallest known
doc_id, or null); an empty table gives an empty result; extra columns are ignored.
A long text's bits are counted in blocks of 65,536 shingles. A bit set in exactly half the
shingles is 0; links at exactly 3 bits count; equal doc_ids give a row each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracequill.session import written

from . import skew

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BUCKET = 4096
LEVELS = 5
#: Up to so many hot buckets (32 bytes each) their list is broadcast; beyond, it is joined by shuffle.
MAX_BROADCAST_BUCKETS = 100_000
LEAF, FANOUT = 4, 4
_CHUNK = 65_536
#: Members that the queries of one step could meet at most, which bounds a step's memory.
_FRONTIER = 2_000_000


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    return majority(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(n)), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the ``hashes``."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _CHUNK):
        counts += np.unpackbits(hashes[lo : lo + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint(x.as_py() or b"", width)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long")


def nodes(prints: DataFrame) -> DataFrame:
    return prints.groupBy("fp").agg(F.min("doc_id").alias("min_doc"), F.count(F.lit(1)).alias("n_docs"))


def part_masks(mask: int, parts: int = MAX_BITS + 1) -> list[int]:
    """Split the bits that ``mask`` leaves open into ``parts`` masks; those of ``mask`` are added to each."""
    open_bits = [b for b in range(64) if not mask >> b & 1]
    cuts = [round(i * len(open_bits) / parts) for i in range(parts + 1)]
    return [mask | sum(1 << b for b in open_bits[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _deal(rows: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    choice: Column = F.lit(None).cast("array<long>")
    for mask, finer in masks.items():
        choice = F.when(F.col("mask") == F.lit(_signed(mask)), F.array(*(F.lit(_signed(m)) for m in finer))).otherwise(choice)
    return rows.withColumn("mask", F.explode(choice)).withColumn("bits", F.col("fp").bitwiseAND(F.col("mask"))).select("mask", "bits", "fp")


def buckets(points: DataFrame, size: int = BUCKET, levels: int = LEVELS, max_broadcast: int = MAX_BROADCAST_BUCKETS) -> DataFrame:
    """(mask, bits, fp): buckets of two members or more, of at most ``size`` or with few bits open."""
    known = [0]
    rows = points.select(F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("bits"), "fp")
    done: DataFrame | None = None
    for level in range(levels):
        finer = {m: part_masks(m) for m in known}
        known = sorted({x for found in finer.values() for x in found})
        rows = _deal(rows, finer)
        if level == levels - 1:
            ready, rows = rows, None
        else:
            hot = written(rows.sparkSession, rows.groupBy("mask", "bits").count().filter(F.col("count") > size).select("mask", "bits"), "hot")
            n_hot = hot.limit(max_broadcast + 1).count()
            if not n_hot:
                ready, rows = rows, None
            else:
                side = F.broadcast(hot) if n_hot <= max_broadcast else hot
                ready = rows.join(side, ["mask", "bits"], "left_anti")
                rows = rows.join(side, ["mask", "bits"], "left_semi")
        done = ready if done is None else done.unionByName(ready)
        if rows is None:
            break
    return done


def gray_rank(fps: np.ndarray) -> np.ndarray:
    out = fps.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class GrayForest:
    """Members of many buckets in Gray order, below trees of masked bit patterns, built and searched level by level.

    A bucket is a tree. A node stands for ``span`` neighbours in Gray order: its mask holds the bits
    in which they agree, and its value these bits. What an upper node holds is not
    looked at again below: differences add up from the root, and a node whose sum is
    over the radius goes with all its members. Leaves have ``leaf`` members; these
    are compared in the bits that no node above has settled.
    """

    def __init__(self, fps: np.ndarray, begins: np.ndarray, ends: np.ndarray, leaf: int = LEAF, fanout: int = FANOUT):
        sizes = ends - begins
        self.group = np.repeat(np.arange(len(sizes)), sizes)
        self.order = np.lexsort((gray_rank(fps), self.group))
        self.fps, self.begins, self.ends, self.fanout = fps[self.order], begins, ends, fanout
        self.levels: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # span, first node by group, mask, value, groups rooted here
        self.tested = self.pruned = self.compared = 0
        span, largest = leaf, int(sizes.max(initial=0))
        while True:
            here = (sizes > span // fanout) if self.levels else sizes > 0
            counts = np.where(here, -(-sizes // span), 0)
            own = self.fps[np.repeat(here, sizes)]
            first = np.concatenate([[0], np.cumsum(counts)])
            base = np.cumsum(np.where(here, sizes, 0)) - np.where(here, sizes, 0)
            starts = np.repeat(base, counts) + span * (np.arange(first[-1]) - np.repeat(first[:-1], counts))
            all_, any_ = np.bitwise_and.reduceat(own, starts), np.bitwise_or.reduceat(own, starts)
            mask = ~(all_ ^ any_)
            self.levels.append((span, first[:-1], mask, all_ & mask, here & (sizes <= span)))
            if span >= largest:
                break
            span *= fanout
        self.levels.reverse()

    def near(self, lo: int, hi: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), lo <= i < hi, i < j, of members of one bucket within ``bits``; positions in Gray order."""
        q, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        gone, above = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        mine = np.arange(lo, hi)
        for span, first, masks, values, rooted in self.levels:
            new = mine[rooted[self.group[lo:hi]]]
            if len(new):
                q, at = np.concatenate([q, new]), np.concatenate([at, self.begins[self.group[new]]])
                gone, above = np.concatenate([gone, np.zeros(len(new), np.int64)]), np.concatenate([above, np.zeros(len(new), np.uint64)])
            own = self.group[q]
            node = first[own] + (at - self.begins[own]) // span
            mask = masks[node]
            gone = gone + np.bitwise_count((self.fps[q] ^ values[node]) & mask & ~above)
            stay = (gone <= bits) & (np.minimum(at + span, self.ends[own]) > q + 1)
            self.tested += len(q)
            self.pruned += int((gone > bits).sum())
            q, at, gone, above = q[stay], at[stay], gone[stay], mask[stay]
            last = span == self.levels[-1][0]
            wide, step = (span, 1) if last else (self.fanout, span // self.fanout)
            at = (at[:, None] + step * np.arange(wide)).ravel()
            q, gone, above = np.repeat(q, wide), np.repeat(gone, wide), np.repeat(above, wide)
            inside = at < self.ends[self.group[q]]
            if last:
                inside &= at > q
            q, at, gone, above = q[inside], at[inside], gone[inside], above[inside]
        self.compared += len(q)
        gone = gone + np.bitwise_count((self.fps[q] ^ self.fps[at]) & ~above)
        near = gone <= bits
        return q[near], at[near]


def link_classes(forest: GrayForest, bits: int = MAX_BITS) -> np.ndarray:
    """For each member the first one of its class of links in its bucket; positions in Gray order."""
    n = len(forest.fps)
    label = np.arange(n)
    reach = np.cumsum((forest.ends - forest.begins)[forest.group]) if n else label
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(reach, (reach[lo - 1] if lo else 0) + _FRONTIER, side="right")))
        i, j = forest.near(lo, hi, bits)
        while True:
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
        lo = hi
    return label


def _links(fps: np.ndarray, begins: np.ndarray, ends: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of many buckets that lie one after another: each member with the first of its class."""
    forest = GrayForest(fps, begins, ends)
    head = link_classes(forest, bits)
    moved = np.flatnonzero(head != np.arange(len(head)))
    return forest.fps[moved], forest.fps[head[moved]]


def links(points: DataFrame, bits: int = MAX_BITS, size: int = BUCKET) -> DataFrame:
    """Distinct (a, b), a < b: enough links within ``bits`` that classes are the same as of all links."""
    if bits > MAX_BITS:
        raise ValueError(f"the buckets find links of up to {MAX_BITS} bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def emit(rows: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1)) + 1
            begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(rows)]])
            a, b = _links(np.ascontiguousarray(rows[:, 2]).view(np.uint64), begins, ends, bits)
            a, b = a.view(np.int64), b.view(np.int64)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            changes = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(axis=1))
            if held and (held[-1][-1, :2] != rows[0, :2]).any():
                yield emit(np.concatenate(held))
                held = []
            if len(changes):
                cut = int(changes[-1]) + 1
                yield emit(np.concatenate([*held, rows[:cut]]))
                held = [rows[cut:]]
            else:
                held.append(rows)
        if held:
            yield emit(np.concatenate(held))

    dealt = buckets(points, size)
    spread = dealt.repartition(_partitions(dealt), "mask", "bits").sortWithinPartitions("mask", "bits", "fp")
    return spread.mapInArrow(run, "a long, b long").distinct()


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def classes(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable.

    Alternating large-star and small-star steps; each round is a table in the shared
    folder. Rounds grow with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    current = written(spark, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    for _ in range(max_rounds):
        n, settled = _state(current)
        if settled:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("u", "m"))
        large = _to_hubs(both, least, 2 * n).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = large.distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _to_hubs(large, floor, 2 * n).select("u", "v", "m")
        current_next = small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()
        current = written(spark, current_next, "links")
    else:
        raise RuntimeError("star contraction did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _to_hubs(edges: DataFrame, hubs: DataFrame, most: int) -> DataFrame:
    if most <= skew.MIN_HOT:
        return edges.join(hubs.drop("n"), "u")
    return skew.joined(edges, written(edges.sparkSession, hubs, "hubs"), ["u"], "n")


def _state(edges: DataFrame) -> tuple[int, bool]:
    """How many edges there are, and whether they are stars: no node has two centres or is one itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("out")), F.struct(F.col("v").alias("x"), F.lit(0).alias("out")))).alias("e"))
    by_node = ends.groupBy("e.x").agg(F.sum("e.out").alias("up"), F.count(F.lit(1)).alias("all"))
    row = by_node.agg(F.sum("up"), F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("all") > F.col("up")))).first()
    return row[0] or 0, not row[1]


def components(docs: DataFrame, width: int = SHINGLE, bits: int = MAX_BITS, size: int = BUCKET) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs``."""
    spark = docs.sparkSession
    prints = written(spark, fingerprints(docs, width), "simhash")
    points = written(spark, nodes(prints), "simhash-nodes")
    member = classes(links(points.select("fp"), bits, size))
    rooted = written(spark, points.join(member, points["fp"] == member["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "min_doc", "n_docs"), "simhash-rooted")
    least = written(spark, rooted.groupBy("root").agg(F.min("min_doc").alias("component_id"), F.count(F.lit(1)).alias("n")), "simhash-roots")
    of_print = written(spark, skew.joined(rooted, least, ["root"], "n").select("fp", "component_id", "n_docs"), "simhash-classes")
    return skew.joined(prints, of_print, ["fp"], "n_docs").select("doc_id", "fp", "component_id")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
