"""Prefix tries of conversations: what a cache of shared first turns would hold and save.

1. :func:`rebuilt` gives each conversation as a row of turn digests (128 bits of SHA-256 over role and
   text) and text lengths; texts are read once and never shuffled.
2. Equal conversations become one row with a count, so a group of copies weighs as one.
3. Rows are dealt by a digest of their first turn. A group with more turns than ``most`` is split again by
   the turn after its longest common prefix, round by round, so that no group fills a
   task; the nodes of that prefix come from sums over the group.
4. Each bucket of groups becomes pointer dictionaries inside ``applyInPandas``; totals rise in an
   iterative postorder, then through the prefixes of split groups, last round first.
5. Ids of conversations that end in a node are hashed as a stream, in chunks of at most
   ``CHUNK`` ids, whatever their number.

Defined results: rows without a conv_id belong to no conversation; a null role or text is
empty; turns are ordered by turn, null first, equal ones by their digest; repeated rows are turns of their own; ids
below zero take ``conv_id % 100`` with their sign; an empty table has no nodes; other
columns are ignored. Texts may have any length; one conversation's digests are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequill.functions.folds import sums_before
from tracequill.session import written

from . import skew

BLOCK = 100
HEADS = 6
CHUNK_BITS = 8
CHUNK = 1 << CHUNK_BITS
#: Bounds of the turns that a group may have before it is split; between them it is an eighth of a partition's share.
LEAST, MOST = 1 << 10, 1 << 18
#: Split groups that are broadcast at most (32-letter names); more are joined by a shuffle.
FEW = 100_000
_TRIE = "gid string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, end_seq string"
_NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "end_seq"]


def _digest(*parts) -> F.Column:
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 32)


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, path (digests of its turns in order) and sizes (their texts' code points)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = _digest(F.length(role).cast("string"), F.lit(":"), role, text)
    own = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("digest"), F.length(text).cast("long").alias("size")).alias("t"))
    rows = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return rows.select("conv_id", F.col("t.digest").alias("path"), F.col("t.size").alias("sizes"))


def rebuilt(own: DataFrame) -> DataFrame:
    """Each conversation with its first ``crc32(conv_id) % HEADS`` turns taken from the first of its block of ids."""
    at = F.col("conv_id") - F.col("conv_id") % BLOCK
    heads = own.filter(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base"), *(F.slice(c, 1, HEADS - 1).alias(f"head_{c}") for c in ("path", "sizes")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    joined = own.withColumn("base", at).join(heads, "base", "left").withColumn("h", h)
    none = {"path": "array<string>", "sizes": "array<bigint>"}
    cut = [F.concat(F.slice(F.coalesce(f"head_{c}", F.array().cast(kind)), F.lit(1), F.col("h")), F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0)))).alias(c) for c, kind in none.items()]
    return joined.select("conv_id", *cut)


def build(rows: pd.DataFrame) -> pd.DataFrame:
    """Nodes of the tries of some groups.

    Rows: gid, depth (of the group's top node), parent_conv, seq, conv, n, path and sizes; the turns from ``depth`` on differ.
    """
    children: list[dict] = []
    nodes: list[list] = []  # gid of a top node, conv, depth, parent, n, children, leaves, saved, end
    tops: dict[str, int] = {}

    def made(gid: str | None, depth: int, parent: int, size: int) -> int:
        children.append({})
        nodes.append([gid, None, depth, parent, 0, 0, 0, size, None])
        return len(nodes) - 1

    above: dict[int, int | None] = {}
    for gid, depth, parent_conv, seq, conv, n, path, sizes in zip(*(rows[c] for c in ("gid", "depth", "parent_conv", "seq", "conv", "n", "path", "sizes")), strict=True):
        at = tops.get(gid)
        if at is None:
            at = tops[gid] = made(gid, depth, -1, int(sizes[depth - 1]))
            above[at] = None if pd.isna(parent_conv) else int(parent_conv)
        for k in range(depth - 1, len(path)):
            if k >= depth:
                below = children[at].get(path[k])
                if below is None:
                    below = children[at][path[k]] = made(None, k + 1, at, int(sizes[k]))
                at = below
            node = nodes[at]
            node[1] = conv if node[1] is None else min(node[1], conv)
            node[4] += n
        nodes[at][8] = seq
    for top in tops.values():
        stack = [(top, False)]
        while stack:
            at, after = stack.pop()
            if not after:
                stack.append((at, True))
                stack += [(x, False) for x in children[at].values()]
                continue
            node = nodes[at]
            own = [nodes[x] for x in children[at].values()]
            node[5] = len(own)
            node[6] = sum(x[6] for x in own) or 1
            node[7] = (node[4] - 1) * node[7] + sum(x[7] for x in own)
    out = [(gid, conv, depth, above[i] if parent < 0 else nodes[parent][1], n, c, leaves, saved, end) for i, (gid, conv, depth, parent, n, c, leaves, saved, end) in enumerate(nodes)]
    frame = pd.DataFrame(out, columns=[c.split()[0] for c in _TRIE.split(", ")])
    return frame.astype({c: "Int64" for c in frame.columns if c not in ("gid", "end_seq")})


def _prefixes(groups: DataFrame) -> DataFrame:
    """One row a group: its longest common prefix (``last`` turns), sums, and the conversation that ends there, if any."""
    own = groups.groupBy("gid").agg(
        F.min("depth").alias("depth"), F.min("parent_gid").alias("parent_gid"), F.min("parent_conv").alias("parent_conv"), F.min("path").alias("lo"), F.max("path").alias("hi"),
        F.min_by(F.struct("sizes", "seq"), "path").alias("own"), F.sum("n").alias("n"), F.min("conv").alias("conv"), F.count(F.lit(1)).alias("rows"),
    )
    differ = F.array_position(F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b)), F.lit(False))
    last = F.when(differ > 0, differ - 1).otherwise(F.size("lo").cast("long")).cast("int")
    return own.withColumn("last", last).select(
        "gid", "depth", "parent_gid", "parent_conv", "n", "conv", "rows", "last", F.when(F.size("lo") == F.col("last"), F.col("own.seq")).alias("end_seq"),
        F.concat(F.when(F.col("depth") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.array().cast("array<bigint>")), F.slice("own.sizes", F.greatest("depth", F.lit(1)), F.col("last") - F.greatest("depth", F.lit(1)) + 1)).alias("sizes"),
    )


def _next(groups: DataFrame, tops: DataFrame) -> DataFrame:
    """Rows of split groups, grouped by the turn after their common prefix."""
    few = tops.select("gid", "rows", "last", F.col("conv").alias("top_conv"))
    rows = skew.joined(groups.drop("depth", "parent_gid", "parent_conv"), few, ["gid"], "rows").filter(F.size("path") > F.col("last"))
    return rows.select(
        _digest("gid", F.element_at("path", F.col("last") + 1)).alias("gid"), (F.col("last") + 1).alias("depth"), F.col("gid").alias("parent_gid"), F.col("top_conv").alias("parent_conv"), "seq", "conv", "n", "path", "sizes"
    )


def _chains(tops: DataFrame, below: DataFrame) -> DataFrame:
    """``tops`` with n_children, n_leaves and saved (by place in the prefix); ``below``: gid, n_children, n_leaves, saved_tokens of the groups under each."""
    rows = tops.join(below, "gid", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).withColumn("n_leaves", F.coalesce("n_leaves", F.lit(1).cast("long")))
    total = F.coalesce("saved_tokens", F.lit(0).cast("long")) + (F.col("n") - 1) * F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = rows.withColumn("before", F.expr(sums_before("sizes"))).withColumn("total", total)
    return rows.withColumn("saved", F.transform("before", lambda x: F.col("total") - (F.col("n") - 1) * x)).drop("before", "total", "saved_tokens")


def _chain_nodes(rows: DataFrame) -> DataFrame:
    each = rows.select("*", F.posexplode("saved").alias("k", "saved_tokens"))
    at_end = F.col("depth") + F.col("k") == F.col("last")
    return each.select(
        F.col("conv").alias("conv_id"), (F.col("depth") + F.col("k")).cast("long").alias("depth"), F.when(F.col("k") == 0, F.col("parent_conv")).otherwise(F.col("conv")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(at_end, F.col("n_children")).otherwise(F.lit(1).cast("long")).alias("n_children"), "n_leaves", "saved_tokens", F.when(at_end, F.col("end_seq")).alias("end_seq"),
    )


def ends(own: DataFrame) -> DataFrame:
    """seq and the SHA-256 of its conv_ids, ascending and comma-joined. ``own``: conv_id, seq."""
    chunks = own.groupBy("seq", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for seq, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if seq != last:
                    if state is not None:
                        done.append((last, state.hexdigest()))
                    last, state = seq, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["end_seq", "ends_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([state.hexdigest()])], ["end_seq", "ends_sha256"])

    n = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return chunks.repartition(n, "seq").sortWithinPartitions("seq", "chunk").select("seq", "ids").mapInArrow(run, "end_seq string, ends_sha256 string")


def nodes(conversations: DataFrame, most: int | None = None) -> DataFrame:
    """Every node of the trie of ``conversations``: conv_id, path, sizes. ``most``: turns that a group may have before it is split."""
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = written(spark, conversations.select("conv_id", _digest(F.array_join("path", "")).alias("seq"), "path", "sizes"), "conversations")
    distinct = own.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv"), F.first("path").alias("path"), F.first("sizes").alias("sizes"))
    start = distinct.select(F.lit("").alias("gid"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_gid"), F.lit(None).cast("long").alias("parent_conv"), "seq", "conv", "n", "path", "sizes")
    groups = written(spark, start, "trie-rows")
    turns = groups.agg(F.sum(F.size("path"))).first()[0] or 0
    most = most or min(MOST, max(LEAST, turns // (8 * parts)))
    rounds, ready = [], None
    while not groups.isEmpty():
        rounds.append(written(spark, _prefixes(groups), "trie-prefixes"))
        after = written(spark, _next(groups, rounds[-1]), "trie-rows")
        sizes = written(spark, after.groupBy("gid").agg(F.sum(F.size("path") - F.col("depth") + 1).alias("turns")).filter(F.col("turns") > most).select("gid"), "trie-large")
        large = F.broadcast(sizes) if sizes.count() <= FEW else sizes
        small = after.join(large, "gid", "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        groups = written(spark, after.join(large, "gid", "left_semi").select(*after.columns), "trie-rows")
    if ready is None:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    buckets = max(4 * parts, turns // MOST)
    tries = ready.withColumn("bucket", F.pmod(F.xxhash64("gid"), F.lit(buckets))).groupBy("bucket").applyInPandas(lambda rows: build(rows), _TRIE)
    tries = written(spark, tries, "tries")
    named = ready.select("gid", "parent_gid").distinct()
    inner = tries.filter("gid IS NOT NULL").join(named, "gid").select("parent_gid", "n_leaves", "saved_tokens")
    every, deeper = tries.select(*_NODE), None
    for tops in reversed(rounds):
        below = inner if deeper is None else inner.unionByName(deeper)
        sums = below.groupBy(F.col("parent_gid").alias("gid")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        chains = written(spark, _chains(tops, sums), "trie-chains")
        every = every.unionByName(_chain_nodes(chains))
        deeper = chains.select("parent_gid", "n_leaves", F.element_at("saved", 1).alias("saved_tokens"))
    of = ends(own.select("conv_id", "seq"))
    bare = every.filter("end_seq IS NULL").withColumn("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
    return every.filter("end_seq IS NOT NULL").join(of, "end_seq").unionByName(bare).drop("end_seq")


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return nodes(rebuilt(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


_CRC = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: "
    "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
)
OP13_SQL = f"""
WITH t AS (SELECT conv_id, turn, left(sha256(length(role) || ':' || role || text), 32) AS g, length(text) AS size
           FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS i FROM t),
c AS (SELECT conv_id, {_CRC} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, i, g, size FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % {BLOCK} AND i <= h UNION ALL SELECT conv_id, i, g, size FROM c JOIN o USING (conv_id) WHERE i > h),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i) AS d, string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS p FROM r),
p AS (SELECT conv_id, d, p, size FROM k UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS (SELECT d, p, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size FROM p GROUP BY d, p),
b AS (SELECT left(p, 32 * (d - 1)) AS p, count(*) AS children FROM n WHERE d > 0 GROUP BY 1),
w AS (SELECT n.*, coalesce(children, 0) AS children FROM n LEFT JOIN b ON n.p = b.p),
u AS (SELECT left(p, 32 * a) AS p, sum(CASE WHEN children = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * size) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM w) GROUP BY 1),
e AS (SELECT p, string_agg(conv_id, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, arg_max(p, d) AS p FROM p GROUP BY conv_id) GROUP BY p)
SELECT w.conv_id, w.d::BIGINT AS depth, v.conv_id AS parent_conv_id, w.n::BIGINT AS n_convs, w.children::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens,
       sha256(coalesce(ids, '')) AS ends_sha256
FROM w JOIN u ON w.p = u.p LEFT JOIN e ON w.p = e.p LEFT JOIN n v ON v.d = w.d - 1 AND v.p = left(w.p, 32 * (w.d - 1))
"""
