"""Temperature mixing of sources, realised as budgeted block permutations.

Weights are source token shares to the power of an exponent, normalised. The
exponent is bisected on a grid of 2**20 steps of [0, 1]: the largest one whose
weights reach the target entropy (as a share of the greatest possible), but no less
than the smallest one that keeps within the repetition limit. Each round evaluates
15 exponents in one aggregation over sources, so 5 jobs settle it, and nothing
that grows with sources or documents is collected.

A source with weight w has the token budget floor(w * budget): whole epochs, then
as much of one more as fits. In an epoch its blocks (by hash of doc_id, about
``BLOCK_DOCS`` documents each) and the documents in a block are ordered by hashes
of epoch and seed. Running sums are taken over blocks first, then inside blocks,
so a source with a third of all rows is never ordered in one task.

Budgets: ``total`` is the tokens there are; ``cover`` is the least budget that takes
every document once at least, and repetition then is relative to the least
repeated source. Defined results: null text has no tokens; a null source is a source
of its own; a source without tokens is taken once; ties of the order (repeated rows)
go by tokens; an empty table gives an empty result; extra columns are ignored here
and kept by :func:`mixed`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequill.session import identified, written

STEPS = 1 << 20
WAYS = 16
BLOCK_DOCS = 4096
SEED = 7
TARGET_ENTROPY = 0.97
MAX_REPETITION = 4.0
SALTS = 32
#: Up to so many sources (under 200 bytes each) their table is broadcast; beyond, a salted join.
MAX_BROADCAST_SOURCES = 50_000
_WORDS = r"[^\x20\x09-\x0D]+"


def token_rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(_WORDS)), F.lit(0)).cast("long").alias("n_tokens"),
    )


def _sections(shares: DataFrame, grid: list[int], cover: bool) -> list[tuple[float, float]]:
    """Entropy share and largest repetition (for a budget of all tokens) for each exponent of ``grid``."""
    columns: list[Column] = [F.count(F.lit(1)).alias("k")]
    for g in grid:
        power = F.pow("p", F.lit(g / STEPS))
        columns += [F.sum(power).alias(f"s{g}"), F.sum(power * F.log(power)).alias(f"e{g}"), F.max(power / F.col("p")).alias(f"x{g}"), F.min(power / F.col("p")).alias(f"n{g}")]
    row = shares.agg(*columns).first()
    most = _ln(row["k"])
    out = []
    for g in grid:
        total = row[f"s{g}"]
        entropy = (_ln(total) - row[f"e{g}"] / total) / most if most > 0 else 1.0
        out.append((entropy, row[f"x{g}"] / row[f"n{g}"] if cover else row[f"x{g}"] / total))
    return out


def _ln(x: float) -> float:
    return math.log(x) if x and x > 0 else 0.0


def exponent(shares: DataFrame, target_entropy: float, max_repetition: float, cover: bool = False) -> int:
    """In steps of 1 / STEPS. ``shares``: p > 0 of every source with tokens."""
    if not shares.limit(1).count():
        return STEPS

    def last_true(test) -> int:
        """The largest step for which the falling predicate holds; it holds at 0."""
        lo, hi = 0, STEPS + 1
        while hi - lo > 1:
            grid = sorted({lo + (hi - lo) * i // WAYS for i in range(1, WAYS)} - {lo, hi}) or [lo + 1]
            held = test(grid)
            lo, hi = max([lo, *(g for g, ok in zip(grid, held, strict=True) if ok)]), min([hi, *(g for g, ok in zip(grid, held, strict=True) if not ok)])
        return lo

    by_entropy = last_true(lambda grid: [e >= target_entropy for e, _ in _sections(shares, grid, cover)])
    if _sections(shares, [by_entropy], cover)[0][1] <= max_repetition:
        return by_entropy
    too_many = last_true(lambda grid: [r > max_repetition for _, r in _sections(shares, grid, cover)])
    return min(STEPS, max(by_entropy, too_many + 1))


def source_plan(tokens: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repetition: float = MAX_REPETITION, budget: str = "total") -> DataFrame:
    """source, n_docs, tokens, weight, epochs (whole), rest (tokens of the last epoch) and blocks."""
    spark, cover = tokens.sparkSession, budget == "cover"
    totals = written(spark, tokens.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("tokens")), "mix-sources")
    everything = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = totals.filter("tokens > 0").withColumn("p", F.col("tokens") / F.lit(float(max(everything, 1))))
    step = exponent(shares, target_entropy, max_repetition, cover)
    power = F.pow("p", F.lit(step / STEPS))
    row = shares.agg(F.sum(power).alias("s"), F.max(F.col("tokens") / power).alias("most")).first()
    scale = float(row["s"] or 1.0)
    size = (row["most"] or 0.0) * scale if cover else float(everything)
    p = F.col("tokens") / F.lit(float(max(everything, 1)))
    weight = F.when(F.col("tokens") > 0, F.round(F.pow(p, F.lit(step / STEPS)) / F.lit(scale), 12)).otherwise(F.lit(0.0))
    own = F.floor(F.col("weight") * F.lit(size) + F.lit(1e-6)).cast("long")
    if cover:
        own = F.greatest(own, F.col("tokens"))
    return totals.withColumn("weight", weight).withColumn("budget", own).select(
        "source", "n_docs", "tokens", "weight", "budget",
        F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("long").alias("epochs"),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).cast("long").alias("rest"),
        F.ceil(F.col("n_docs") / F.lit(BLOCK_DOCS)).cast("long").alias("blocks"),
    )


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"))


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def realised(tokens: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per taken document and epoch, with its block and the token at which it starts in its source's sequence.

    A column ``_row`` of ``tokens`` is kept, and is the last to decide the order.
    """
    spark = tokens.sparkSession
    row = [c for c in tokens.columns if c == "_row"]
    small = plan.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES

    def with_plan(rows: DataFrame, side: DataFrame) -> DataFrame:
        side = side.withColumnRenamed("source", "_source")
        same = F.col("source").eqNullSafe(F.col("_source"))
        if small:
            return rows.join(F.broadcast(side), same).drop("_source")
        many = side.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        return spread.join(many, same & (F.col("_salt") == F.col("_deal"))).drop("_source", "_salt", "_deal")

    seeded = F.lit(seed)
    dealt = with_plan(tokens, plan.select("source", "tokens", "epochs", "rest", "blocks")).withColumn(
        "block", F.pmod(_number(_hash(seeded, F.col("doc_id"))), F.col("blocks"))
    )
    blocks = written(spark, dealt.groupBy("source", "block").agg(F.sum("n_tokens").alias("block_tokens"), F.max("tokens").alias("tokens"), F.max("epochs").alias("epochs"), F.max("rest").alias("rest")), "mix-blocks")
    epochs = F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs")))
    order = Window.partitionBy("source", "epoch").orderBy("_key", "block")
    starts = (
        blocks.withColumn("epoch", epochs)
        .withColumn("_key", _hash(seeded, F.col("epoch"), F.lit("block"), F.col("block")))
        .withColumn("block_start", F.sum("block_tokens").over(order) - F.col("block_tokens"))
        .filter((F.col("epoch") < F.col("epochs")) | (F.col("block_start") < F.col("rest")))
        .select(F.col("source").alias("_source"), F.col("epoch").alias("_epoch"), F.col("block").alias("_block"), "block_start")
    )
    copies = dealt.withColumn("epoch", epochs).select("doc_id", "source", "n_tokens", *row, "tokens", "epochs", "rest", "block", "epoch")
    on = F.col("source").eqNullSafe(F.col("_source")) & (F.col("epoch") == F.col("_epoch")) & (F.col("block") == F.col("_block"))
    inside = Window.partitionBy("source", "epoch", "block").orderBy("_key", "doc_id", "n_tokens", *row).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        copies.join(starts, on)
        .withColumn("_key", _hash(seeded, F.col("epoch"), F.col("doc_id")))
        .withColumn("_upto", F.col("block_start") + F.sum("n_tokens").over(inside))
        .filter((F.col("epoch") < F.col("epochs")) | (F.col("_upto") <= F.col("rest")))
    )
    return placed.select(
        "doc_id", "source", "epoch", "block", "n_tokens", (F.col("epoch") * F.col("tokens") + F.col("_upto") - F.col("n_tokens")).alias("token_start"), *row
    )


def mix_plan(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repetition: float = MAX_REPETITION, budget: str = "total", seed: int = SEED) -> DataFrame:
    tokens = written(docs.sparkSession, token_rows(docs), "mix-tokens")
    plan = written(docs.sparkSession, source_plan(tokens, target_entropy, max_repetition, budget), "mix-plan")
    return realised(tokens, plan, seed)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = rf"""
WITH RECURSIVE t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}'))::BIGINT AS n_tokens FROM documents),
s AS (SELECT source, count(*) AS n_docs, sum(n_tokens)::BIGINT AS tokens FROM t GROUP BY source),
a AS (SELECT sum(tokens)::BIGINT AS everything FROM s),
p AS (SELECT tokens / everything AS p FROM s, a WHERE tokens > 0),
g AS (SELECT list(p) AS ps, ln(count(*)) AS most FROM p),
e(lo, hi) AS (SELECT 0, {STEPS} + 1 UNION ALL
  SELECT CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT lo, hi, mid, CASE WHEN most > 0 THEN (ln(z) - list_sum(list_transform(ws, lambda w: w * ln(w))) / z) / most >= {TARGET_ENTROPY} ELSE true END AS ok
    FROM (SELECT *, list_sum(ws) AS z FROM (SELECT lo, hi, (lo + hi) // 2 AS mid, most, list_transform(ps, lambda x: pow(x, ((lo + hi) // 2) / {STEPS})) AS ws FROM e, g WHERE hi - lo > 1)))),
be AS (SELECT max(lo) AS step FROM e),
r(lo, hi) AS (SELECT 0, {STEPS} + 1 UNION ALL
  SELECT CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT lo, hi, mid, list_max(list_transform(ps, lambda x: pow(x, mid / {STEPS} - 1))) / list_sum(list_transform(ps, lambda x: pow(x, mid / {STEPS}))) > {MAX_REPETITION} AS ok
    FROM (SELECT lo, hi, (lo + hi) // 2 AS mid, ps FROM r, g WHERE hi - lo > 1))),
br AS (SELECT max(lo) AS step FROM r),
x AS (SELECT CASE WHEN list_max(list_transform(ps, lambda x: pow(x, be.step / {STEPS} - 1))) / list_sum(list_transform(ps, lambda x: pow(x, be.step / {STEPS}))) <= {MAX_REPETITION}
                  THEN be.step ELSE least({STEPS}, greatest(be.step, br.step + 1)) END / {STEPS} AS alpha FROM be, br, g),
z AS (SELECT sum(pow(p, alpha)) AS scale FROM p, x),
w AS (SELECT source, n_docs, tokens, CASE WHEN tokens > 0 THEN round(pow(tokens / everything, alpha) / scale, 12) ELSE 0 END AS weight, everything FROM s, a, x, z),
b AS (SELECT source, n_docs, tokens, floor(weight * everything + 1e-6)::BIGINT AS budget FROM w),
pl AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS epochs, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest,
              ceil(n_docs / {BLOCK_DOCS})::BIGINT AS blocks FROM b),
d AS (SELECT t.doc_id, t.source, t.n_tokens, tokens, epochs, rest, ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % blocks AS block
      FROM t JOIN pl ON t.source IS NOT DISTINCT FROM pl.source),
k AS (SELECT source, block, sum(n_tokens)::BIGINT AS block_tokens, max(epochs) AS epochs FROM d GROUP BY source, block),
ke AS (SELECT *, unnest(range(0, epochs + 1)) AS epoch FROM k),
ks AS (SELECT *, sum(block_tokens) OVER (PARTITION BY source, epoch ORDER BY md5('{SEED}:' || epoch || ':block:' || block), block
                                       ROWS UNBOUNDED PRECEDING)::BIGINT - block_tokens AS block_start FROM ke),
c AS (SELECT *, unnest(range(0, epochs + 1)) AS epoch FROM d),
f AS (SELECT c.*, block_start + sum(n_tokens) OVER (PARTITION BY c.source, c.epoch, c.block ORDER BY md5('{SEED}:' || c.epoch || ':' || coalesce(doc_id::VARCHAR, '')), doc_id, n_tokens
                                       ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
      FROM c JOIN ks ON c.source IS NOT DISTINCT FROM ks.source AND c.epoch = ks.epoch AND c.block = ks.block)
SELECT doc_id, source, epoch, block, n_tokens, epoch * tokens + upto - n_tokens AS token_start FROM f WHERE epoch < epochs OR upto <= rest
"""


def mixed(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repetition: float = MAX_REPETITION, budget: str = "cover", seed: int = SEED) -> DataFrame:
    """Rows of ``docs`` as often as the plan takes them, with all their columns.

    Rows are told apart by their place in the table, whatever they hold. Order and blocks go by a
    hash of doc_id, source and text.
    """
    spark = docs.sparkSession
    keyed = identified(docs)
    n = F.coalesce(F.regexp_count("text", F.lit(_WORDS)), F.lit(0)).cast("long")
    own = keyed.select(F.xxhash64("doc_id", "source", "text").alias("doc_id"), F.col("source").cast("string").alias("source"), n.alias("n_tokens"), "_row")
    tokens = written(spark, own, "mix-tokens")
    plan = written(spark, source_plan(tokens, target_entropy, max_repetition, budget), "mix-plan")
    copies = realised(tokens, plan, seed).groupBy("_row").agg(F.count(F.lit(1)).alias("_copies"))
    taken = keyed.join(copies, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return taken.select(*docs.columns)
