"""Queries of quality reports: unlabelled additions and reviews by a person."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequill.operators import quality as Q
from tracequill.session import table

from . import fixtures as X

#: Read by Spark and DuckDB alike; ``n`` is the length of a claim's text.
BLOCK = {
    "document": "CASE WHEN n % 2 = 0 THEN 'deep' ELSE 'brief' END",
    "type": "CASE WHEN n % 7 < 2 THEN 'participant_guide' WHEN n % 7 < 4 THEN 'editor_note' WHEN n % 7 = 6 THEN NULL ELSE 'prose' END",
    "provenance": "CASE WHEN n % 5 < 2 THEN 'external' WHEN n % 5 < 4 THEN 'editorial' ELSE 'source_fact' END",
    "citation_refs": "CASE WHEN n % 11 = 0 THEN array('R1') WHEN n % 11 < 5 THEN array() END",
    "paragraph_refs": "CASE WHEN n % 13 < 5 THEN array(array('R1'), array()) WHEN n % 13 < 8 THEN array(array()) END",
    "item_refs": "CASE WHEN n % 17 < 4 THEN array(array(), array('R2')) WHEN n % 17 < 9 THEN array() END",
}
DIMENSIONS = ("clarity", "fidelity", "structure")
REVIEW = {
    "version": "CASE WHEN doc_id % 23 = 0 THEN '1.0.0' ELSE '1.1.0' END",
    "reviewer_type": "CASE WHEN n_chars % 19 = 0 THEN 'agent' ELSE 'human' END",
    "reviewer": "CASE WHEN n_chars % 17 = 0 THEN ' Agent-7' WHEN n_chars % 29 = 0 THEN 'ai two' WHEN n_chars % 31 = 0 THEN '  ' WHEN n_chars % 37 = 0 THEN NULL ELSE 'aidan' END",
    "reviewed_at": "CASE WHEN n_chars % 13 = 0 THEN '' ELSE '2026-01-01' END",
    "decision": "CASE WHEN n_chars % 11 = 0 THEN 'revise' ELSE 'pass' END",
}
SCORES = [f"CASE WHEN (n_chars + {i}) % 41 = 0 THEN 2.5 WHEN (n_chars + {i}) % 43 = 0 THEN 6.0 WHEN (n_chars + {i}) % 47 = 0 THEN NULL ELSE 1.0 + n_chars % 5 END" for i in range(len(DIMENSIONS))]


def a12_unlabelled_additions(spark, sf):
    rows = X.claims(spark, sf).withColumn("n", F.length("statement"))
    kinds = {"citation_refs": "array<string>", "paragraph_refs": "array<array<string>>", "item_refs": "array<array<string>>"}
    return Q.unlabelled_additions(rows.select("case_id", *(F.expr(v).cast(kinds.get(k, "string")).alias(k) for k, v in BLOCK.items())))


def g21_human_review(spark, sf):
    docs = table(spark, sf, "documents")
    cases = docs.select(F.col("doc_id").alias("case_id"), (F.col("n_chars") % 4 != 0).alias("required"))
    scores = F.create_map(*(c for d, v in zip(DIMENSIONS, SCORES, strict=True) for c in (F.lit(d), F.expr(v).cast("double"))))
    reviews = docs.filter("n_chars % 6 <> 0").select(F.col("doc_id").alias("case_id"), *(F.expr(v).alias(k) for k, v in REVIEW.items()), scores.alias("scores"))
    return Q.human_reviews(cases, reviews, list(DIMENSIONS), "1.1.0").select("case_id", "status", F.array_join("errors", ",").alias("errors"))


def _duck(text: str) -> str:
    return text.replace("array(", "list_value(")


_SCORED = ", ".join(f"CASE WHEN s{i} IS NULL OR s{i} NOT IN (1, 2, 3, 4, 5) THEN 'score_{d}' END" for i, d in enumerate(DIMENSIONS))
ORACLE = {
    "a12_unlabelled_additions": f"""WITH {X.CLAIMS}, b AS (SELECT case_id, {', '.join(f'{_duck(v)} AS {k}' for k, v in BLOCK.items())} FROM (SELECT *, length(statement) AS n FROM claims)),
c AS (SELECT *, len(coalesce(citation_refs, [])) + len(flatten(coalesce(item_refs, []))) + CASE WHEN document = 'deep' THEN len(flatten(coalesce(paragraph_refs, []))) ELSE 0 END AS cited FROM b)
SELECT case_id, count(*) FILTER (provenance = 'external' AND cited = 0 AND NOT (document = 'deep' AND coalesce(type, '') = 'participant_guide') OR provenance = 'editorial' AND coalesce(type, '') <> 'editor_note') AS additions FROM c GROUP BY case_id""",
    "g21_human_review": f"""WITH r AS (SELECT doc_id AS case_id, n_chars % 4 <> 0 AS required, n_chars % 6 <> 0 AS there, {', '.join(f'{v} AS {k}' for k, v in REVIEW.items())}, {', '.join(f'{v} AS s{i}' for i, v in enumerate(SCORES))} FROM documents),
e AS (SELECT *, CASE WHEN required AND there THEN list_filter([CASE WHEN version <> '1.1.0' THEN 'version' END, CASE WHEN reviewer_type <> 'human' THEN 'reviewer_type' END, CASE WHEN trim(coalesce(reviewer, '')) = '' OR reviewed_at = '' THEN 'unsigned' END,
  CASE WHEN trim(reviewer) IN ('Agent-7', 'ai two') THEN 'automatic_reviewer' END, CASE WHEN decision <> 'pass' THEN 'decision' END, {_SCORED}], lambda x: x IS NOT NULL) ELSE [] END AS errors FROM r)
SELECT case_id, CASE WHEN NOT required THEN 'not_required' WHEN NOT there THEN 'pending' WHEN len(errors) > 0 THEN 'fail' ELSE 'pass' END AS status, array_to_string(errors, ',') AS errors FROM e""",
}
NAMES = "a12_unlabelled_additions g21_human_review"
QUERIES = {name: globals()[name] for name in NAMES.split()}
