"""Incremental review: what a change of claims or of reader text reaches, which roles look again, which reports still hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import full_diff

#: Artefacts whose change makes every claim doubtful, each with its reason; and what stands for unknown.
STRUCTURAL = {"source": "source_changed", "normalizedSource": "normalized_source_changed", "segments": "segments_changed", "speakerMap": "speaker_map_changed"}
UNAVAILABLE = "__unavailable_in_base_packet__"
AUDITED = ("source_fact", "speaker_view", "synthesis", "external")
PLACE = ("section_id", "module_id", "block_id", "type")
ROLES = ("fidelity", "reader_advocate", "source_scout")


def _set(column: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(column))))


def change_scope(baseline: DataFrame, current: DataFrame, hashes: DataFrame, recorded: DataFrame) -> DataFrame:
    """One row a case of ``hashes``: mode, reasons, the segments, themes and reader blocks that changed claims reach, and the reviews due.

    ``baseline``, ``current``: case_id, id, semantic_hash, support_hash, full_hash, importance, theme_id, segment_refs,
    block_refs. ``hashes``: case_id, artefact, was, now (null: absent). ``recorded``: case_id, ref of removed claims that a migration or
    repair accounts for. A claim reaches through its old and its new state; its importance is the new one, if there is one.
    """
    keys = ["case_id", "id"]
    changes = full_diff(baseline, current, keys)
    parts = [df.select(*keys, F.lit(i).alias("age"), "importance", "theme_id", "segment_refs", "block_refs") for i, df in enumerate((baseline, current))]
    touched = changes.filter(F.col("change").isin("added", "removed", "modified"))
    reach = touched.join(parts[0].unionByName(parts[1]), keys).groupBy("case_id").agg(_set("segment_refs").alias("segment_refs"), F.array_sort(F.collect_set("theme_id")).alias("theme_refs"), _set("block_refs").alias("block_refs"))
    level = touched.join(parts[0].unionByName(parts[1]), keys).groupBy(*keys).agg(F.max_by("importance", "age").alias("importance")).groupBy("case_id").agg(F.bool_or(F.col("importance").isin("high", "medium")).alias("_weighty"))
    lost = changes.filter("change = 'removed'").join(recorded.withColumnRenamed("ref", "id").select(*keys), keys, "left_anti").select("case_id").distinct().withColumn("_lost", F.lit(True))
    counts = changes.groupBy("case_id").agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "removed", "modified", "mechanical", "unchanged")))
    differs = ~F.col("was").eqNullSafe(F.col("now"))
    artefacts = hashes.groupBy("case_id").agg(
        F.array_compact(F.array(*(F.max(F.when((F.col("artefact") == a) & differs, F.lit(r))) for a, r in STRUCTURAL.items()))).alias("_structural"),
        F.coalesce(F.bool_or((F.col("artefact") == "deepRead") & differs), F.lit(False)).alias("_reader"),
    )
    rows = artefacts
    for other in (counts, reach, level, lost):
        rows = rows.join(other, "case_id", "left")
    rows = rows.na.fill(0, ["added", "removed", "modified", "mechanical", "unchanged"]).withColumn("_structural", F.concat("_structural", F.when(F.col("_lost"), F.array(F.lit("removed_claim_lineage_missing"))).otherwise(F.array().cast("array<string>"))))
    meaning = F.col("added") + F.col("removed") + F.col("modified") > 0
    mode = F.when(F.size("_structural") > 0, "structural_full").when(meaning, "semantic_delta").otherwise("mechanical")
    only = F.when(meaning, "claim_semantics_changed_with_stable_source_boundary").when(F.col("mechanical") > 0, "only_nonsemantic_claim_fields_changed").otherwise("no_evidence_changes")
    none = F.array().cast("array<string>")
    rows = rows.withColumn("mode", mode).withColumn("reasons", F.when(F.size("_structural") > 0, F.array_sort("_structural")).otherwise(F.array(only)))
    rows = rows.select("case_id", "mode", "reasons", "added", "removed", "modified", "mechanical", "unchanged", *(F.coalesce(c, none).alias(c) for c in ("segment_refs", "theme_refs", "block_refs")), "_reader", "_weighty")
    delta = F.col("mode") == "semantic_delta"
    due = {"claim_audit": F.col("mode") != "mechanical", "full_claim_audit": F.col("mode") == "structural_full", "fidelity": delta & (F.size("block_refs") > 0), "reader_advocate": F.col("_reader"), "source_scout": delta & F.coalesce("_weighty", F.lit(False))}
    return rows.select("*", *(c.alias(n) for n, c in due.items())).drop("_reader", "_weighty")


def leaf_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """case_id, id and kinds of leaves that differ: text, evidence_refs, citation_refs, provenance, structure.

    Both: case_id, id, text, evidence_refs, citation_refs, provenance and the columns of :data:`PLACE`. References are compared as lists
    without order. What the older packet did not hold (null references, or :data:`UNAVAILABLE`) differs if the newer leaf has any.
    """
    columns = ["text", "evidence_refs", "citation_refs", "provenance", *PLACE]
    side = lambda df, name: df.select("case_id", "id", F.struct(*columns).alias(name))
    rows = side(before, "a").join(side(after, "b"), ["case_id", "id"], "full")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()

    def refs(c: str) -> Column:
        old, new = F.col(f"a.{c}"), F.coalesce(F.col(f"b.{c}"), F.array().cast("array<string>"))
        return F.when(old.isNull(), F.size(new) > 0).otherwise(F.array_sort(old) != F.array_sort(new))

    moved = F.lit(False)
    for c in PLACE:
        moved = moved | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    source = F.when(F.col("a.provenance") == UNAVAILABLE, F.col("b.provenance").isin(*AUDITED)).otherwise(~F.col("a.provenance").eqNullSafe(F.col("b.provenance")))
    tests = {"text": ~F.col("a.text").eqNullSafe(F.col("b.text")), "evidence_refs": refs("evidence_refs"), "citation_refs": refs("citation_refs"), "provenance": source, "structure": moved}
    kinds = F.when(both, F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items())))).otherwise(F.array(F.lit("structure")))
    return rows.select("case_id", "id", kinds.alias("kinds")).filter(F.size("kinds") > 0)


def role_hashes(leaves: DataFrame) -> DataFrame:
    """case_id, role and hash of what each role is shown: fidelity the text with its sources, the advocate the text alone, the scout the evidence."""
    refs = lambda c: F.array_join(F.array_sort(F.coalesce(c, F.array().cast("array<string>"))), ",")
    shown = {"fidelity": ["id", "text", refs("evidence_refs"), refs("citation_refs"), "provenance"], "reader_advocate": ["id", "text"], "source_scout": ["id", refs("evidence_refs")]}
    # Digests travel as bytes, half of their hexadecimal form, and in one list a case: a list for each role holds each id again.
    digest = lambda columns: F.unhex(F.sha2(F.to_json(F.array(*(F.col(c) if isinstance(c, str) else c for c in columns))), 256))
    each = leaves.select("case_id", "id", *(digest(columns).alias(role) for role, columns in shown.items()))
    lists = each.groupBy("case_id").agg(F.collect_list(F.struct("id", *shown)).alias("_all"))
    ordered = lambda role: F.array_sort(F.transform("_all", lambda x: F.struct(x["id"], x[role].alias("digest"))))
    own = lists.select("case_id", *(F.sha2(F.array_join(F.transform(ordered(role), lambda x: F.lower(F.hex(x["digest"]))), ""), 256).alias(role) for role in shown))
    return own.unpivot(["case_id"], list(shown), "role", "hash")


def reused_reports(reports: DataFrame, now: DataFrame) -> DataFrame:
    """case_id, role, and ``round`` of the latest report on the same inputs, or null: then the role looks again. ``reports``: case_id, role, round, hash; ``now``: :func:`role_hashes`."""
    held = reports.groupBy("case_id", "role", "hash").agg(F.max("round").alias("round"))
    return now.join(held, ["case_id", "role", "hash"], "left").select("case_id", "role", "round")


def targeted_plan(changes: DataFrame, reuse: DataFrame) -> DataFrame:
    """case_id, role, action (rerun or inherit), ``round`` of what is inherited, and the leaves to look at.

    ``changes``: :func:`leaf_changes`; ``reuse``: :func:`reused_reports`. Fidelity looks again at leaves whose text, references or provenance
    changed, the advocate at those with other text, and at none in particular where only what stands around them changed; the scout does not look again.
    """
    cares = {"fidelity": ("text", "evidence_refs", "citation_refs", "provenance"), "reader_advocate": ("text",)}
    scope = None
    for role, kinds in cares.items():
        some = changes.filter(F.arrays_overlap("kinds", F.array(*map(F.lit, kinds)))).groupBy("case_id").agg(F.array_sort(F.collect_list("id")).alias("leaves")).withColumn("role", F.lit(role))
        scope = some if scope is None else scope.unionByName(some)
    rows = reuse.join(scope, ["case_id", "role"], "left").withColumn("leaves", F.coalesce("leaves", F.array().cast("array<string>")))
    again = (F.col("role") != "source_scout") & (F.col("round").isNull() & ((F.size("leaves") > 0) | (F.col("role") == "reader_advocate")))
    return rows.select("case_id", "role", F.when(again, "rerun").otherwise("inherit").alias("action"), F.when(~again, F.coalesce("round", F.lit(1))).alias("round"), F.when(again, F.col("leaves")).otherwise(F.array().cast("array<string>")).alias("leaves"))
