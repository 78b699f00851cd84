"""Parts of a quality report: additions without a label, and the review by a person."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .claimreview import blank, yes
from .gates import listed

#: Fixed value: how names of automatic reviewers begin.
AUTOMATIC = r"(?i)^(?:agent[-_]|qr-pilot|ai\b)"


def _cited(refs: Column) -> Column:
    return yes(F.size(refs) > 0)


def unlabelled_additions(blocks: DataFrame) -> DataFrame:
    """case_id, additions: external blocks that cite nothing and editorial blocks that are no editor's note.

    ``blocks``: case_id, document (deep or brief), type, provenance, citation_refs, and those of the parts, paragraph_refs and item_refs
    (arrays of arrays). A deep read's guides need no citation; only its paragraphs are looked at, besides items. Every case with a block has a row.
    """
    deep = yes(F.col("document") == "deep")
    parts = lambda c: yes(F.exists(c, _cited))
    cited = _cited(F.col("citation_refs")) | parts("item_refs") | (deep & parts("paragraph_refs"))
    guide = deep & yes(F.col("type") == "participant_guide")
    external = yes(F.col("provenance") == "external") & ~cited & ~guide
    editorial = yes(F.col("provenance") == "editorial") & ~yes(F.col("type") == "editor_note")
    return blocks.groupBy("case_id").agg(F.sum(external.cast("long") + editorial.cast("long")).alias("additions"))


def human_reviews(cases: DataFrame, reviews: DataFrame, dimensions: list[str], version: str) -> DataFrame:
    """case_id, status (not_required, pending, fail, pass) and errors of each case (case_id, required).

    ``reviews``: case_id, version, reviewer_type, reviewer, reviewed_at, decision, scores (map of text to double). Scores must be
    whole numbers from 1 to 5 and are recorded only. Of a case that needs none, a review counts for nothing.
    """
    rows = cases.join(reviews.withColumn("_there", F.lit(True)), "case_id", "left")
    score = lambda d: F.element_at("scores", d)
    rules = [
        ("version", ~yes(F.col("version") == version)),
        ("reviewer_type", ~yes(F.col("reviewer_type") == "human")),
        ("unsigned", blank(F.col("reviewer")) | blank(F.col("reviewed_at"))),
        ("automatic_reviewer", yes(F.trim("reviewer").rlike(AUTOMATIC))),
        ("decision", ~yes(F.col("decision") == "pass")),
        *((f"score_{d}", ~yes(score(d).between(1, 5) & (score(d) == F.floor(score(d))))) for d in dimensions),
    ]
    needed, there = yes(F.col("required")), F.col("_there").isNotNull()
    rows = rows.withColumn("errors", F.when(needed & there, listed(rules)).otherwise(F.array().cast("array<string>")))
    status = F.when(~needed, "not_required").when(~there, "pending").when(F.size("errors") > 0, "fail").otherwise("pass")
    return rows.select("case_id", status.alias("status"), "errors")
