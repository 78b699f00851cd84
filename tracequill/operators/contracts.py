"""Contracts of guides, bundles and reader documents, findings, and renderers."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracequill.functions import canonical as C
from tracequill.functions import text as T
from tracequill.functions.canonical import let
from tracequill.session import written


def first_findings(findings: DataFrame) -> DataFrame:
    """(case_id, pos, message): each message once, at its first place."""
    return findings.groupBy("case_id", "message").agg(F.min("pos").alias("pos"))


def split_severity(findings: DataFrame, diagnostic: list[str]) -> DataFrame:
    """Adds ``severity``: diagnostic where a pattern is found in the message, else hard."""
    known = F.lit(False)
    for pattern in diagnostic:
        known = known | F.col("message").rlike(pattern)
    return findings.withColumn("severity", F.when(known, "diagnostic").otherwise("hard"))


def same_theme_candidates(claims: DataFrame, changed: DataFrame) -> DataFrame:
    """Unchanged claims in the themes that changed claims touch. ``changed``: case_id, id."""
    themes = claims.join(changed, ["case_id", "id"], "left_semi").select("case_id", "theme_id").distinct()
    return claims.join(themes, ["case_id", "theme_id"], "left_semi").join(changed, ["case_id", "id"], "left_anti")


def guide_errors(entries: DataFrame, participants: DataFrame, citations: DataFrame) -> DataFrame:
    """(case_id, id, name, kind, provenance, evidence_refs, citation): repeated names, unknown persons, statements without a source."""
    people = participants.select("case_id", "name").distinct().withColumn("_known", F.lit(True))
    cited = citations.select("case_id", "citation").distinct().withColumn("_cited", F.lit(True))
    n = F.count(F.lit(1)).over(Window.partitionBy("case_id", F.lower("name")))
    rows = entries.withColumn("_n", n).join(people, ["case_id", "name"], "left").join(cited, ["case_id", "citation"], "left")
    rules = [
        ("repeated_name", F.col("_n") > 1),
        ("unknown_person", (F.col("kind") == "person") & F.col("_known").isNull()),
        ("no_evidence", (F.col("provenance") == "source") & (F.size("evidence_refs") <= 0)),
        ("no_citation", (F.col("provenance") == "external") & F.col("_cited").isNull()),
    ]
    errors = F.array_compact(F.array(*(F.when(F.coalesce(r, F.lit(False)), F.lit(x)) for x, r in rules)))
    return rows.withColumn("errors", errors).filter(F.size("errors") > 0).select("case_id", "id", "errors")


def bundle_errors(bundles: DataFrame, claims: DataFrame) -> DataFrame:
    """(case_id, bundle_id, theme_id, refs): unknown refs, refs of another theme, refs in two bundles."""
    rows = bundles.select("case_id", "bundle_id", "theme_id", F.explode("refs").alias("id"))
    known = claims.select("case_id", "id", F.col("theme_id").alias("own_theme"))
    joined = rows.join(known, ["case_id", "id"], "left").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("case_id", "id")))
    error = F.when(F.col("own_theme").isNull(), "unknown_ref").when(F.col("own_theme") != F.col("theme_id"), "other_theme").when(F.col("_n") > 1, "in_two_bundles")
    return joined.withColumn("error", error).filter("error IS NOT NULL").select("case_id", "bundle_id", "id", "error")


def document_errors(leaves: DataFrame, section_order: list[str]) -> DataFrame:
    """Leaves whose section is unknown, whose id is repeated, or whose provenance lacks its references."""
    sourced = F.col("provenance").isin("source_fact", "speaker_view")
    rules = [
        ("unknown_section", ~F.col("section_id").isin(*section_order)),
        ("repeated_id", F.col("repeated")),
        ("no_evidence", sourced & (F.size("evidence_refs") == 0)),
        ("no_citation", (F.col("provenance") == "external") & (F.size("citation_refs") == 0)),
    ]
    errors = F.array_compact(F.array(*(F.when(F.coalesce(r, F.lit(False)), F.lit(x)) for x, r in rules)))
    return leaves.withColumn("errors", errors).filter(F.size("errors") > 0).select("case_id", "id", "errors")


def attribution(claims: DataFrame, aliases: DataFrame, verbs: list[str]) -> DataFrame:
    """Claims whose statement starts with an alias of a participant and a verb; the longest alias wins.

    ``aliases``: case_id, name, alias.
    """
    verb = "|".join(verbs)
    hits = claims.join(aliases, "case_id").filter(F.startswith(F.lower("statement"), F.lower("alias")) & F.substring("statement", F.length("alias") + 1, F.lit(40)).rlike(rf"(?i)^\s*(?:{verb})\b"))
    return hits.groupBy("case_id", "id").agg(F.max_by("name", F.struct(F.length("alias"), "name")).alias("name"))


def importance(statement: Column, index: Column, tags: list[str], keywords: str) -> Column:
    """Heuristic level from figures, tags, keywords and length; every second or third index can rise above low."""
    low = F.lower(statement)
    tagged = F.lit(False)
    for tag in (t for t in tags if len(t) >= 2):
        tagged = tagged | F.contains(low, F.lit(tag.lower()))
    points = lambda test, n: F.when(test, n).otherwise(0)
    score = points(statement.rlike("[0-9]"), 2) + points(tagged, 2) + points(statement.rlike(keywords), 1) + points(T.compact_characters(statement) >= 70, 1)
    return F.when((score >= 4) & (index % 2 == 0), "high").when((score >= 2) & (index % 3 == 0), "medium").otherwise("low")


def contained_quotes(quotes: DataFrame, least: int = 6) -> DataFrame:
    """Adds ``verbatim``: (text, source) with the text's normal form of ``least`` characters or more inside the source's."""
    plain = T.normalized_claim(F.col("text"))
    return quotes.withColumn("verbatim", (F.length(plain) >= least) & F.contains(T.normalized_claim(F.col("source")), plain))


def quote_form(text: Column) -> Column:
    """For searches in quotes: the comparison form; null counts as empty."""
    return T.normalized_claim(F.coalesce(text, F.lit("")))


#: Neighbouring characters that a deleted piece may repeat.
OVERLAP = 6


def _only_deleted(source: str, text: str, filler: re.Pattern) -> bool:
    """Whether ``text`` is ``source`` less fillers and repetitions.

    Each character of ``text`` takes the next equal one of ``source``; equal stretches are passed in blocks.
    What lies between is a deleted piece: it must consist of fillers, or repeat the text before or after it.
    """
    p = k = 0
    while p < len(text):
        while p < len(text) and source[k : k + 64] == text[p : p + 64]:
            k, p = k + len(text[p : p + 64]), p + len(text[p : p + 64])
        while p < len(text) and k < len(source) and source[k] == text[p]:
            k, p = k + 1, p + 1
        if p < len(text):
            at = source.find(text[p], k)
            if at < 0 or not _mechanical(source[k:at], text[max(0, p - OVERLAP) : p], text.endswith(source[k:at], 0, p) and p > 0, source[at : at + OVERLAP], source.startswith(source[k:at], at), filler):
                return False
            k = at
    gone = source[k:]
    return bool(source and text) and (not gone or _mechanical(gone, text[-OVERLAP:], text.endswith(gone), "", False, filler))


def _mechanical(gone: str, before: str, repeated_before: bool, after: str, repeated_after: bool, filler: re.Pattern) -> bool:
    return repeated_before or repeated_after or bool(before and gone.endswith(before)) or bool(after and gone.startswith(after)) or bool(filler.fullmatch(gone))


def deletion_only(quotes: DataFrame, fillers: list[str]) -> DataFrame:
    """Adds ``deleted_only``: ``text`` is ``source`` with nothing but fillers and repetitions gone, and other punctuation.

    ``fillers``: regular expressions of words without quotes or backslashes, already in the form of :func:`quote_form`. An empty side is never such an edit.
    """
    if any(c in f for f in fillers for c in "'\\"):
        raise ValueError("fillers hold no quotes or backslashes")
    rows = quotes.withColumn("_s", quote_form(F.col("source"))).withColumn("_t", quote_form(F.col("text")))
    return rows.withColumn("deleted_only", _edited(F.col("_s"), F.col("_t"), fillers)).drop("_s", "_t")


def _edited(source: Column, text: Column, fillers: list[str]) -> Column:
    """Of two columns in :func:`quote_form`; made in Arrow batches, since a lambda for each character costs many times as much."""
    filler = re.compile("(?:" + "|".join(fillers) + ")+")

    def edited(sources: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([_only_deleted(s, t, filler) for s, t in zip(sources.to_pylist(), texts.to_pylist(), strict=True)], pa.bool_())

    return F.arrow_udf(edited, "boolean")(source, text)


def locators_match(left: Column, right: Column) -> Column:
    """Equal first and last times where both have times, else equal text."""
    times = lambda x: F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"\d{1,2}:\d{2}(?::\d{2})?(?:\.\d+)?"), F.lit(0)), lambda t: F.regexp_replace(t, r"\.\d+$", ""))
    a, b = times(left), times(right)
    both = (F.size(a) > 0) & (F.size(b) > 0)
    ends = (F.get(a, F.lit(0)) == F.get(b, F.lit(0))) & (F.get(a, F.size(a) - 1) == F.get(b, F.size(b) - 1))
    return F.when(both, ends).otherwise(T.normalize_text(F.coalesce(left, F.lit(""))) == T.normalize_text(F.coalesce(right, F.lit(""))))


def controlled_quotes(blocks: DataFrame, spans: DataFrame, fillers: list[str], least: int = 6) -> DataFrame:
    """case_id, id and errors of quote blocks that break a rule.

    ``blocks``: case_id, id, mode, attribution, text, source_locator, source_text, evidence_refs; ``spans``: case_id,
    ref, locator, quote. A verbatim quote lies in a span of its references; a cleaned one names a source text that
    does, at that span's place, and only deletes from it.
    """
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    formed = blocks.withColumn("_s", quote_form(F.col("source_text"))).withColumn("_t", quote_form(F.col("text")))
    formed = written(blocks.sparkSession, formed.withColumn("_deleted", _edited(F.col("_s"), F.col("_t"), fillers)), "quotes")
    named = formed.select("case_id", "id", "_t", "_s", "source_locator", F.explode(F.array_distinct("evidence_refs")).alias("ref"))
    held = named.join(spans.select("case_id", "ref", "locator", quote_form(F.col("quote")).alias("_q")), ["case_id", "ref"])
    found = held.groupBy("case_id", "id").agg(
        F.bool_or(F.contains("_q", "_t")).alias("_verbatim"),
        F.bool_or(locators_match(F.col("source_locator"), F.col("locator")) & F.contains("_q", "_s")).alias("_placed"),
    )
    rows = formed.select("case_id", "id", "mode", "attribution", "source_locator", "source_text", "_t", "_deleted").join(found, ["case_id", "id"], "left")
    known, cleaned = F.coalesce(F.col("mode").isin("verbatim", "spoken_cleanup"), F.lit(False)), F.col("mode") == "spoken_cleanup"
    rules = [
        ("mode", ~known),
        ("attribution", known & blank(F.col("attribution"))),
        ("short", known & (F.length("_t") < least)),
        ("not_verbatim", (F.col("mode") == "verbatim") & ~F.coalesce("_verbatim", F.lit(False))),
        ("no_locator", cleaned & blank(F.col("source_locator"))),
        ("no_source", cleaned & blank(F.col("source_text"))),
        ("misplaced", cleaned & ~F.coalesce("_placed", F.lit(False))),
        ("not_deletion_only", cleaned & ~F.col("_deleted")),
    ]
    errors = F.array_compact(F.array(*(F.when(F.coalesce(r, F.lit(False)), F.lit(x)) for x, r in rules)))
    return rows.withColumn("errors", errors).filter(F.size("errors") > 0).select("case_id", "id", "errors")


def html_cards(rows: DataFrame) -> DataFrame:
    """(case_id, pos, title, body, refs) -> one escaped HTML section for each case."""
    card = F.concat(F.lit("<article><h3>"), T.escape_html(F.col("title")), F.lit("</h3><p>"), T.escape_html(F.col("body")), F.lit("</p><sup>"), F.array_join("refs", " "), F.lit("</sup></article>"))
    found = rows.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("pos", card.alias("card")))).alias("x"))
    return found.select("case_id", F.concat(F.lit("<section>"), F.array_join(F.transform("x", lambda y: y["card"]), ""), F.lit("</section>")).alias("html"))


#: A claim's column and its name in JSON: what carries meaning, in the order of the names.
SEMANTIC = {"claim_role": "claimRole", "importance": "importance", "provenance": "provenance", "speaker": "speaker", "speaker_confidence": "speakerConfidence", "statement": "statement", "theme_id": "themeId", "uncertainty": "uncertainty"}


def snapshots(claims: DataFrame) -> DataFrame:
    """Semantic, support and full hash of each claim, over canonical JSON; absent fields are left out.

    ``claims``: case_id, id, the columns of :data:`SEMANTIC`, and support_spans (array of segmentId, sourceIds, quote). To
    the support hash a span is its segment and its distinct ids in order; spans go by their own hash, so
    neither their order nor quotes matter, but how ids are grouped into spans does.
    """
    named = [F.col(c).alias(n) for c, n in SEMANTIC.items()]
    span = lambda x: C.canonical_json(F.to_json(F.struct(x["segmentId"].alias("segmentId"), F.array_sort(F.array_distinct(x["sourceIds"])).alias("sourceIds"))))
    spans = F.transform(F.coalesce("support_spans", F.array()), lambda x: let(span(x), lambda y: F.struct(F.sha2(y.cast("binary"), 256).alias("h"), y.alias("json"))))
    support = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(spans), lambda x: x["json"]), ","), F.lit("]"))
    whole = F.to_json(F.struct("id", *named, F.col("support_spans").alias("supportSpans")))
    return claims.select("case_id", "id", C.canonical_hash(F.to_json(F.struct(*named))).alias("semantic_hash"), F.sha2(support.cast("binary"), 256).alias("support_hash"), C.canonical_hash(whole).alias("full_hash"))


def with_units(claims: DataFrame, spans: DataFrame, units: DataFrame) -> DataFrame:
    """Claims with their source units nested in span order; unknown units are left out."""
    rows = spans.join(units.select("case_id", F.col("id").alias("source_id"), "text"), ["case_id", "source_id"])
    nested = rows.groupBy("case_id", "id").agg(F.array_sort(F.collect_list(F.struct("ord", "source_id", "text"))).alias("units"))
    return claims.join(nested, ["case_id", "id"], "left")
