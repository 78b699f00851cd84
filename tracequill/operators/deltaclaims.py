"""Reviews of changed claims alone, and the downgrade of single findings to warnings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .claimreview import blank, yes
from .gates import listed

# What a finding must be to become a warning, what it must never be, and what must be assured.
DOWNGRADABLE = ("asr_ambiguity", "minor_support_boundary", "unsupported_semantic_extension")
NEVER = r"(?i)fabricat|hallucin|invent|misattribut|wrong[_-]?speaker|contradict|invalid[_-]?citation|citation[_-]?invalid|wrong[_-]?provenance|material[_-]?(?:semantic|meaning|causal|numeric)|changed[_-]?(?:meaning|causality)|false[_-]?quote"
SAFEGUARDS = ("noFabrication", "noMisattribution", "noContradiction", "noInvalidCitation", "noMaterialSemanticChange", "coreUnderstandingUnaffected")
DECISION, BASIS, CONSTRAINT = "warning", "non_core_asr_ambiguity", "exclude_from_new_reader"


def weighed(entries: DataFrame, hard: DataFrame) -> DataFrame:
    """``entries`` (case_id, ref, change_type, verdict, issue_kinds) with ``weight``: blocking, advisory or none.

    ``hard`` (case_id, ref, code) names findings that block whatever the verdict; their codes, distinct and sorted, join ``issue_kinds``.
    """
    codes = hard.filter("ref IS NOT NULL").groupBy("case_id", "ref").agg(F.collect_set("code").alias("_codes"), F.lit(True).alias("_hard"))
    rows = entries.join(codes, ["case_id", "ref"], "left")
    nothing = F.array().cast("array<string>")
    kinds = F.array_sort(F.array_distinct(F.filter(F.concat(F.coalesce("issue_kinds", nothing), F.coalesce("_codes", nothing)), lambda k: k != "")))
    blocking = yes(F.col("verdict") == "hard_error") | F.col("_hard").isNotNull()
    weight = F.when(blocking, "blocking").when(F.col("verdict") == "revise", "advisory").otherwise("none")
    return rows.withColumn("issue_kinds", kinds).withColumn("weight", weight).drop("_codes", "_hard")


def scope_errors(changes: DataFrame, entries: DataFrame) -> DataFrame:
    """(case_id, ref, error): changed claims (case_id, ref, change_type) without a review or under another type, reviews twice or of what did not change."""
    due = changes.select("case_id", "ref", F.col("change_type").alias("_type")).distinct()
    seen = entries.groupBy("case_id", "ref").agg(F.count(F.lit(1)).alias("n"), F.collect_set("change_type").alias("types"))
    rows = due.join(seen, ["case_id", "ref"], "full")
    rules = [
        ("not_reviewed", F.col("n").isNull()),
        ("change_type", F.col("_type").isNotNull() & (F.col("types") != F.array("_type"))),
        ("outside_scope", F.col("_type").isNull()),
        ("entry_repeated", F.col("n") > 1),
    ]
    return rows.select("case_id", "ref", F.explode(listed(rules)).alias("error"))


def downgrade_errors(downgrades: DataFrame, entries: DataFrame, claims: DataFrame) -> DataFrame:
    """(case_id, ref, error) of downgrades against the :func:`weighed` entries they speak of.

    ``downgrades``: case_id, ref, finding_hash, decision, basis, constraint, safeguards (map of text to boolean),
    rationale. ``entries`` carry ``finding_hash`` too; ``claims`` (case_id, id) are those of now. A downgrade of
    what does not block has that error alone.
    """
    blocking = entries.filter("weight = 'blocking'").select("case_id", "ref", F.col("finding_hash").alias("_hash"), "issue_kinds")
    now = claims.select("case_id", F.col("id").alias("ref"), F.lit(True).alias("_now")).distinct()
    rows = downgrades.join(blocking, ["case_id", "ref"], "left").join(now, ["case_id", "ref"], "left")
    kinds = F.col("issue_kinds")
    assured = lambda name: yes(F.element_at("safeguards", name))
    rules = [
        ("stale_finding", ~F.col("finding_hash").eqNullSafe(F.col("_hash"))),
        ("decision", ~yes(F.col("decision") == DECISION)),
        ("basis", ~yes(F.col("basis") == BASIS)),
        ("constraint", ~yes(F.col("constraint") == CONSTRAINT)),
        ("claim_gone", F.col("_now").isNull()),
        ("kind_not_downgradable", (F.size(kinds) == 0) | F.exists(kinds, lambda k: ~k.isin(*DOWNGRADABLE))),
        ("kind_never_downgradable", F.exists(kinds, lambda k: k.rlike(NEVER))),
        *((f"safeguard_{name}", ~assured(name)) for name in SAFEGUARDS),
        ("rationale", blank(F.col("rationale"))),
    ]
    errors = F.when(F.col("issue_kinds").isNull(), F.array(F.lit("not_blocking"))).otherwise(listed(rules))
    twice = downgrades.groupBy("case_id", "ref").count().filter("count > 1").select("case_id", "ref", F.lit("entry_repeated").alias("error"))
    return rows.select("case_id", "ref", F.explode(errors).alias("error")).unionByName(twice).distinct()


def outcomes(entries: DataFrame, downgrades: DataFrame, errors: DataFrame) -> DataFrame:
    """(case_id, ref, level): what blocks stays ``hard`` unless a downgrade makes it a ``warning``; advice is ``advisory``.

    Downgrades of a case with any error (case_id, ...) count for nothing.
    """
    sound = downgrades.select("case_id", "ref").distinct().join(errors.select("case_id").distinct(), "case_id", "left_anti").withColumn("_down", F.lit(True))
    rows = entries.filter("weight <> 'none'").join(sound, ["case_id", "ref"], "left")
    return rows.select("case_id", "ref", F.when(F.col("weight") == "advisory", "advisory").when(F.col("_down").isNull(), "hard").otherwise("warning").alias("level"))
