"""Lineage of claims over rounds of migration: contracts of one round, and the closure over all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequill.session import written

from .evidence import lineage_errors


def migration_errors(entries: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """case_id, error and subject: every old and new claim must be named by one entry, once.

    ``entries``: case_id, entry_id, kind, old_refs, new_refs; ``old``, ``new``: case_id, ref, source_ids. Errors: unknown_old, unknown_new, repeated_old,
    repeated_new, missing_old, missing_new (subject: the claim), cardinality, and no_overlap (entry:claim; an old claim that was merged shares no source with the new one; without sources it may).
    """
    found = []
    for side, known in (("old", old), ("new", new)):
        named = entries.select("case_id", "entry_id", F.explode(f"{side}_refs").alias("ref"))
        counted = named.groupBy("case_id", "ref").agg(F.count(F.lit(1)).alias("n"))
        rows = counted.join(known.select("case_id", "ref", F.lit(True).alias("known")), ["case_id", "ref"], "full")
        tests = [("unknown", F.col("known").isNull()), ("repeated", F.col("n") > 1), ("missing", F.col("n").isNull())]
        errors = F.array_compact(F.array(*(F.when(t, F.lit(f"{name}_{side}")) for name, t in tests)))
        found.append(rows.select("case_id", F.explode(errors).alias("error"), F.col("ref").alias("subject")))
    wrong = lineage_errors(entries.withColumn("entry_id", F.struct("case_id", "entry_id"))).select("entry_id.case_id", F.lit("cardinality").alias("error"), F.col("entry_id.entry_id").alias("subject"))
    found.append(wrong)
    merged = entries.filter((F.col("kind") == "merged") & (F.size("old_refs") >= 2) & (F.size("new_refs") == 1))
    pairs = merged.select("case_id", "entry_id", F.explode("old_refs").alias("ref"), F.element_at("new_refs", 1).alias("into"))
    held = pairs.join(old.select("case_id", "ref", F.col("source_ids").alias("a")), ["case_id", "ref"]).join(new.select("case_id", F.col("ref").alias("into"), F.col("source_ids").alias("b")), ["case_id", "into"], "left")
    apart = (F.size("a") > 0) & ~F.coalesce(F.arrays_overlap("a", "b"), F.lit(False))
    found.append(held.filter(apart).select("case_id", F.lit("no_overlap").alias("error"), F.concat("entry_id", F.lit(":"), "ref").alias("subject")))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def origins(edges: DataFrame, claims: DataFrame) -> DataFrame:
    """case_id, round, ref, origin_round and origin_ref: what each of ``claims`` (case_id, round, ref) goes back to.

    ``edges``: case_id, round, ref, old_ref (of the round before). A claim that no edge leads back from is its own origin. Paths of
    all claims double in length each time, so ``r`` rounds take log2(r) joins, each of them by claim.
    """
    spark = edges.sparkSession
    key = ["case_id", "round", "ref"]
    steps = edges.select(*key, (F.col("round") - 1).alias("to_round"), F.col("old_ref").alias("to_ref")).distinct()
    onward = edges.select("case_id", F.col("round").alias("to_round"), F.col("ref").alias("to_ref")).distinct().withColumn("open", F.lit(True))
    paths = written(spark, steps.join(onward, ["case_id", "to_round", "to_ref"], "left").withColumn("open", F.coalesce("open", F.lit(False))), "lineage")
    while not paths.filter("open").isEmpty():
        far = paths.select("case_id", F.col("round").alias("to_round"), F.col("ref").alias("to_ref"), F.col("to_round").alias("far_round"), F.col("to_ref").alias("far_ref"), F.col("open").alias("far_open"))
        longer = paths.filter("open").join(far, ["case_id", "to_round", "to_ref"]).select(*key, F.col("far_round").alias("to_round"), F.col("far_ref").alias("to_ref"), F.col("far_open").alias("open"))
        paths = written(spark, paths.filter("NOT open").select(*longer.columns).unionByName(longer).distinct(), "lineage")
    ends = paths.select(*key, F.col("to_round").alias("origin_round"), F.col("to_ref").alias("origin_ref"))
    return claims.select(*key).join(ends, key, "left").select(*key, F.coalesce("origin_round", "round").alias("origin_round"), F.coalesce("origin_ref", "ref").alias("origin_ref"))
