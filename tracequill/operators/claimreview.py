"""Contracts of claim reviews: entries, conflicts, quote repairs, rulings, and the state of a case.

Reviews are rows (case_id, ref, ...), one for each reviewed claim. Contract checks give rows
(case_id, ref, error); a null ref speaks of the case. Everything is joined by (case_id, ref), so a
case of any size spreads over its claims.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gates import clean_pass, finding_codes, listed

# The words a review may use, and the forms of its references.
REF = "^E[0-9]{4,}$"
THEME = "^T[0-9]{3,}$"
SHA256 = "^[a-f0-9]{64}$"
VERDICTS = ("pass", "revise", "split", "merge", "remove")
ATOMICITY = ("pass", "fail")
SUPPORT = ("supported", "partial", "unsupported")
CONFIRMED = ("confirmed", "change")
IMPORTANCE = ("high", "medium", "low")
SPEAKER = ("confirmed", "unknown_safe", "change")
MECHANICAL = "missing_support_quote"
SEMANTIC = ("compound_claim", "support_gap", "overstatement", "importance_misclassified", "theme_misclassified", "speaker_attribution_unsafe", "duplicate_claim", "empty_semantics", "other_semantic")
SELECTIONS = ("primary", "secondary", "original", "unreviewable")


def yes(test: Column) -> Column:
    """``test``, false where unknown."""
    return F.coalesce(test, F.lit(False))


def blank(text: Column) -> Column:
    return ~yes(text.rlike(r"\S"))


def _among(name: str, allowed: tuple[str, ...]) -> Column:
    return yes(F.col(name).isin(*allowed))


def _texts(name: str, allowed: tuple[str, ...] = ()) -> list[tuple[str, Column]]:
    """Rules of a list of texts: there, no empty ones, only allowed ones, none twice."""
    value = F.col(name)
    rules = [(f"{name}_missing", value.isNull()), (f"{name}_empty_text", F.exists(value, lambda x: F.coalesce(x, F.lit("")) == "")), (f"{name}_repeated", F.size(F.array_distinct(value)) < F.size(value))]
    if allowed:
        rules.append((f"{name}_unsupported", F.exists(value, lambda x: (x != "") & ~x.isin(*allowed))))
    return rules


def _proposal(axis: str, proposed_ok: Column) -> list[tuple[str, Column]]:
    """Rules of a decision that confirms, or changes to a proposed value."""
    verdict, proposed = F.col(f"{axis}_verdict"), F.col(f"{axis}_proposed")
    sound = _among(f"{axis}_verdict", CONFIRMED) & (proposed.isNull() | yes(proposed_ok))
    return [
        (f"{axis}_decision", ~sound),
        (f"{axis}_confirmed_with_value", sound & (verdict == "confirmed") & proposed.isNotNull()),
        (f"{axis}_change_without_value", sound & (verdict == "change") & proposed.isNull()),
    ]


def entry_errors(entries: DataFrame, claims: DataFrame) -> DataFrame:
    """``entries`` with ``errors``, the names of the rules an entry breaks, in order.

    Columns: case_id, ref, verdict, atomicity, support, importance_verdict, importance_proposed, theme_verdict,
    theme_proposed, speaker, issues, rationale, merge_refs, replacements, codes (lists of text; null
    merge_refs and replacements are none). ``claims``: case_id, id. Only merges meet the claims.
    """
    nothing = F.array().cast("array<string>")
    rows = entries.withColumn("merge_refs", F.coalesce("merge_refs", nothing)).withColumn("replacements", F.coalesce("replacements", nothing))
    # Entries of one ref may have other targets: what is lost is known by the targets too.
    merges = rows.filter("verdict = 'merge'").select("case_id", "ref", "merge_refs", F.explode("merge_refs").alias("id")).filter("NOT id <=> ref")
    lost = merges.join(claims.select("case_id", "id"), ["case_id", "id"], "left_anti").select(F.col("case_id").alias("_case"), F.col("ref").alias("_ref"), F.col("merge_refs").alias("_refs"), F.lit(True).alias("_lost")).distinct()
    same = F.col("case_id").eqNullSafe(F.col("_case")) & F.col("ref").eqNullSafe(F.col("_ref")) & F.col("merge_refs").eqNullSafe(F.col("_refs"))
    rows = rows.join(lost, same, "left").drop("_case", "_ref", "_refs")
    merge, passed, split = yes(F.col("verdict") == "merge"), yes(F.col("verdict") == "pass"), yes(F.col("verdict") == "split")
    empty = F.exists("replacements", blank)
    rules = [
        ("evidence_ref", ~yes(F.col("ref").rlike(REF))),
        ("verdict", ~_among("verdict", VERDICTS)),
        ("atomicity", ~_among("atomicity", ATOMICITY)),
        ("support", ~_among("support", SUPPORT)),
        *_proposal("importance", F.col("importance_proposed").isin(*IMPORTANCE)),
        *_proposal("theme", F.col("theme_proposed").rlike(THEME)),
        ("speaker", ~_among("speaker", SPEAKER)),
        *_texts("issues"),
        ("rationale", blank(F.col("rationale"))),
        ("merge_target_count", merge & (F.size("merge_refs") != 1)),
        ("merge_into_itself", merge & F.array_contains("merge_refs", F.col("ref"))),
        ("merge_into_unknown", merge & yes(F.col("_lost"))),
        ("targets_without_merge", ~merge & (F.size("merge_refs") > 0)),
        ("replacement_blank", empty),
        ("split_needs_two", ~empty & split & (F.size("replacements") < 2)),
        ("pass_with_replacement", ~empty & passed & (F.size("replacements") > 0)),
        ("pass_contradicts_axes", passed & ~clean_pass()),
        *_texts("codes", (*SEMANTIC, MECHANICAL)),
        ("pass_with_codes", passed & (F.size("codes") > 0)),
        ("nonpass_without_codes", ~passed & (F.coalesce(F.size("codes"), F.lit(0)) == 0)),
    ]
    counted = rows.withColumn("n_issues", F.when(F.col("issues").isNotNull(), F.size("issues")))
    return counted.withColumn("errors", listed(rules)).drop("_lost", "n_issues")


def review_errors(entries: DataFrame, claims: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, ref, error) of a whole review, which must cover ``expected`` (case_id, ref) exactly, each ref once.

    Repeated rows of ``expected`` count once. A case without a row in either has none.
    """
    own = entry_errors(entries, claims).select("case_id", "ref", F.explode("errors").alias("error"))
    seen = entries.groupBy("case_id", "ref").agg(F.count(F.lit(1)).alias("n"))
    both = seen.join(expected.select("case_id", "ref").distinct().withColumn("_due", F.lit(True)), ["case_id", "ref"], "full")
    error = listed([("entry_repeated", F.col("n") > 1), ("outside_scope", F.col("_due").isNull()), ("not_reviewed", F.col("n").isNull())])
    return own.unionByName(both.select("case_id", "ref", F.explode(error).alias("error"))).distinct()


def decisions(entries: DataFrame) -> DataFrame:
    """case_id, ref, verdict, clean, semantic and mechanical codes (sorted) and the remedy of each entry.

    Inferred codes join those given; ``other_semantic`` is not inferred beside a missing quote. Clean entries have no codes.
    """
    given = F.coalesce(F.col("codes"), F.array().cast("array<string>"))
    rows = entries.withColumn("n_issues", F.size("issues")).withColumn("_given", given).withColumn("_clean", clean_pass()).drop("codes")
    rows = finding_codes(rows)
    inferred = F.when(F.array_contains("_given", MECHANICAL), F.array_remove("codes", "other_semantic")).otherwise(F.col("codes"))
    rows = rows.withColumn("codes", F.when(F.col("_clean"), F.array().cast("array<string>")).otherwise(F.array_sort(F.array_union("_given", inferred))))
    remedy = F.struct(
        F.array_sort(F.array_distinct(F.coalesce("merge_refs", F.array().cast("array<string>")))).alias("merge_refs"),
        F.size(F.coalesce("replacements", F.array().cast("array<string>"))).alias("replacements"),
        F.col("importance_proposed").alias("importance"), F.col("theme_proposed").alias("theme"), yes(F.col("speaker") == "change").alias("speaker"),
    )
    return rows.select("case_id", "ref", "verdict", F.col("_clean").alias("clean"), F.filter("codes", lambda c: c.isin(*SEMANTIC)).alias("semantic"), F.array_contains("codes", MECHANICAL).alias("mechanical"), remedy.alias("remedy"))


def conflicts(targets: DataFrame, second: DataFrame) -> DataFrame:
    """case_id, ref, verdicts and ``triggers`` of each target (:func:`decisions` of the first reviewer) against the second's; no trigger is agreement."""
    mine = targets.select("case_id", "ref", F.col("verdict").alias("v1"), F.col("semantic").alias("c1"), F.col("remedy").alias("r1"))
    other = second.select("case_id", "ref", F.col("verdict").alias("v2"), F.col("semantic").alias("c2"), F.col("remedy").alias("r2"))
    rules = [("verdict_conflict", ~F.col("v1").eqNullSafe(F.col("v2"))), ("finding_conflict", F.col("c1") != F.col("c2")), ("remedy_conflict", ~F.col("r1").eqNullSafe(F.col("r2")))]
    return mine.join(other, ["case_id", "ref"]).select("case_id", "ref", "v1", "v2", listed(rules).alias("triggers"))


def quote_additions(before: DataFrame, after: DataFrame) -> DataFrame:
    """(case_id, id, span, outcome) of spans whose quote differs between two editions.

    Editions: case_id, id, span, rest (a digest of all but the quote), quote. Outcomes: ``added``, ``quote_changed``,
    ``quote_not_added``; a case in which anything but quotes differs has one row ``semantics_changed`` instead.
    """
    old = before.select("case_id", "id", "span", F.col("rest").alias("_r"), F.col("quote").alias("_q"), F.lit(True).alias("_o"))
    both = old.join(after.select("case_id", "id", "span", "rest", "quote", F.lit(True).alias("_n")), ["case_id", "id", "span"], "full")
    other = F.col("_o").isNull() | F.col("_n").isNull() | ~F.col("_r").eqNullSafe(F.col("rest"))
    changed = both.filter(other).select("case_id").distinct()
    outcome = F.when(~blank(F.col("_q")), "quote_changed").when(blank(F.col("quote")), "quote_not_added").otherwise("added")
    rows = both.filter(~F.col("_q").eqNullSafe(F.col("quote"))).join(changed, "case_id", "left_anti").select("case_id", "id", "span", outcome.alias("outcome"))
    return rows.unionByName(changed.select("case_id", F.lit(None).cast("string").alias("id"), F.lit(None).cast("int").alias("span"), F.lit("semantics_changed").alias("outcome")))


def fix_errors(before: DataFrame, after: DataFrame, fixes: DataFrame) -> DataFrame:
    """(case_id, ref, error) of quote repairs ``fixes`` (case_id, ref, code, status, spans) against what they changed.

    Only cases with a row in ``fixes`` are checked. A repair names each added quote of its claim once and leaves none missing.
    """
    cases = fixes.select("case_id").distinct()
    changes = quote_additions(before, after).join(cases, "case_id", "left_semi")
    faults = changes.filter("outcome <> 'added'").select("case_id", F.col("id").alias("ref"), F.col("outcome").alias("error"))
    added = changes.filter("outcome = 'added'").groupBy("case_id", F.col("id").alias("ref")).agg(F.array_sort(F.collect_set("span")).alias("added"))
    gaps = after.filter(blank(F.col("quote"))).select("case_id", F.col("id").alias("ref"), F.lit(True).alias("gap")).distinct()
    rows = fixes.withColumn("_fix", F.lit(True)).join(added, ["case_id", "ref"], "full").join(gaps, ["case_id", "ref"], "left")
    spans = F.col("spans")
    bad = spans.isNull() | (F.size(spans) == 0) | yes(F.exists(spans, lambda s: s.isNull() | (s < 0))) | (F.size(F.array_distinct(spans)) < F.size(spans))
    fix, other = F.col("_fix").isNotNull(), ~yes(F.array_sort(spans) == F.coalesce("added", F.array().cast("array<int>")))
    rules = [
        ("code", fix & ~yes(F.col("code") == MECHANICAL)),
        ("status", fix & ~yes(F.col("status") == "mechanically_resolved")),
        ("quote_left_missing", fix & yes(F.col("gap"))),
        ("spans", fix & bad),
        ("spans_not_those_added", fix & ~bad & other),
        ("nothing_added", fix & F.col("added").isNull()),
        ("not_covered", ~fix),
    ]
    twice = fixes.groupBy("case_id", "ref").count().filter("count > 1").select("case_id", "ref", F.lit("entry_repeated").alias("error"))
    return faults.unionByName(rows.select("case_id", "ref", F.explode(listed(rules)).alias("error"))).unionByName(twice).distinct()


def ruling_errors(rulings: DataFrame, disputed: DataFrame) -> DataFrame:
    """(case_id, ref, error) of rulings (case_id, ref, triggers, selection, confidence, rationale) that must cover ``disputed``.

    ``disputed``: :func:`conflicts` with a trigger. Only cases with a ruling are checked.
    """
    due = disputed.join(rulings.select("case_id").distinct(), "case_id", "left_semi").select("case_id", "ref", F.col("triggers").alias("_t"), F.lit(True).alias("_due"))
    rows = rulings.withColumn("_ruled", F.lit(True)).join(due, ["case_id", "ref"], "full")
    ruled, listed_ = F.col("_ruled").isNotNull(), F.coalesce("triggers", F.array().cast("array<string>"))
    rules = [
        ("outside_conflicts", ruled & F.col("_due").isNull()),
        ("not_ruled", ~ruled),
        ("triggers_missing", ruled & (F.size(listed_) == 0)),
        ("triggers_repeated", ruled & (F.size(F.array_distinct(listed_)) < F.size(listed_))),
        ("triggers_differ", ruled & F.col("_due").isNotNull() & (F.array_sort(F.array_distinct(listed_)) != F.array_sort("_t"))),
        ("selection", ruled & ~_among("selection", SELECTIONS)),
        ("confidence", ruled & ~yes(F.col("confidence").between(0, 1) & ~F.isnan("confidence"))),
        ("rationale", ruled & blank(F.col("rationale"))),
    ]
    twice = rulings.groupBy("case_id", "ref").count().filter("count > 1").select("case_id", "ref", F.lit("entry_repeated").alias("error"))
    return rows.select("case_id", "ref", F.explode(listed(rules)).alias("error")).unionByName(twice).distinct()


def binding_errors(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """(case_id, artefact, error): recorded input hashes that are missing, malformed or stale.

    Both: case_id, artefact, hash. ``actual`` names what must be bound; other recorded hashes are ``not_an_input``.
    """
    rows = actual.select("case_id", "artefact", F.col("hash").alias("_h"), F.lit(True).alias("_due")).join(recorded, ["case_id", "artefact"], "full")
    error = F.when(F.col("_due").isNull(), "not_an_input").when(F.col("hash").isNull(), "missing").when(~F.col("hash").rlike(SHA256), "malformed").when(~F.col("hash").eqNullSafe(F.col("_h")), "stale")
    return rows.select("case_id", "artefact", error.alias("error")).filter("error IS NOT NULL")


def claim_states(claims: DataFrame, primary: DataFrame, fixed: DataFrame, secondary: DataFrame, rulings: DataFrame, reviewers: DataFrame, least: float = 0.8) -> DataFrame:
    """case_id, targets, conflicts and state of each case of ``claims``, from a full review to the last ruling.

    States: invalid (a contract is broken, or a later review came before its time), needs_mechanical_fix, needs_secondary,
    needs_adjudication, human_required, repair_required, pass. ``fixed``: (case_id, ref) of valid quote repairs.
    ``reviewers``: case_id, primary, secondary, adjudicator (ids, null where none); all must differ.
    """
    first, second = decisions(primary), decisions(secondary)
    targets = first.filter(F.size("semantic") > 0)
    disputes = conflicts(targets, second)
    open_disputes = disputes.filter(F.size("triggers") > 0)
    count = lambda df, name: df.groupBy("case_id").agg(F.count(F.lit(1)).alias(name))
    known = claims.select("case_id", F.col("id").alias("ref"))
    reviewed = targets.select("case_id", "ref").join(secondary.select("case_id").distinct(), "case_id", "left_semi")
    ruled = disputes.join(rulings.select("case_id", "ref", "selection", "confidence").dropDuplicates(["case_id", "ref"]), ["case_id", "ref"], "left")
    disputed = F.size("triggers") > 0
    human = disputed & (yes(F.col("selection") == "unreviewable") | yes(F.col("confidence") < least))
    final = F.when(~disputed | (F.col("selection") == "primary"), F.col("v1")).when(F.col("selection") == "secondary", F.col("v2")).otherwise("pass")
    outcome = ruled.groupBy("case_id").agg(F.count_if(disputed).alias("conflicts"), F.count_if(human).alias("human"), F.count_if(final != "pass").alias("failures"))
    unfixed = first.filter("mechanical").select("case_id", "ref").join(fixed.select("case_id", "ref"), ["case_id", "ref"], "left_anti")
    parts = [
        count(review_errors(primary, claims, known), "e1"), count(targets, "targets"), count(unfixed, "unfixed"), count(secondary, "second"), count(review_errors(secondary, claims, reviewed), "e2"),
        count(second.filter("mechanical"), "quotes"), outcome, count(rulings, "ruled"), count(ruling_errors(rulings, open_disputes), "e3"), reviewers.select("case_id", "primary", "secondary", "adjudicator"),
    ]
    rows = claims.select("case_id").distinct()
    for part in parts:
        rows = rows.join(part, "case_id", "left")
    n = lambda name: F.coalesce(name, F.lit(0))
    same = lambda a, b: yes(F.col(a) == F.col(b))
    state = (
        F.when(n("e1") > 0, "invalid")
        .when(n("unfixed") > 0, "needs_mechanical_fix")
        .when(n("targets") == 0, F.when((n("second") > 0) | (n("ruled") > 0), "invalid").otherwise("pass"))
        .when(n("second") == 0, F.when(n("ruled") > 0, "invalid").otherwise("needs_secondary"))
        .when((n("e2") > 0) | same("primary", "secondary"), "invalid")
        .when(n("quotes") > 0, "needs_mechanical_fix")
        .when((n("conflicts") == 0) & (n("ruled") > 0), "invalid")
        .when((n("conflicts") > 0) & (n("ruled") == 0), "needs_adjudication")
        .when((n("ruled") > 0) & ((n("e3") > 0) | same("primary", "adjudicator") | same("secondary", "adjudicator")), "invalid")
        .when(n("human") > 0, "human_required")
        .when(n("failures") > 0, "repair_required")
        .otherwise("pass")
    )
    return rows.select("case_id", n("targets").alias("targets"), n("conflicts").alias("conflicts"), state.alias("state"))
