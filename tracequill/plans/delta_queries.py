"""Queries of delta reviews, downgrades and the reader gate; fixtures follow from lengths and digests of texts and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequill.operators import deltaclaims as D
from tracequill.operators import readergate as R
from tracequill.session import table

from . import fixtures as X

#: Read by Spark and DuckDB alike. A few reviews name another type or are on what stayed.
CHANGE = "CASE WHEN n % 4 = 1 THEN 'added' WHEN n % 4 = 2 THEN 'removed' WHEN n % 4 = 3 THEN 'modified' END"
REPORT = {
    "ref": "id",
    "change_type": f"CASE WHEN n % 31 = 0 THEN 'modified' ELSE {CHANGE} END",
    "verdict": "CASE WHEN n % 5 = 0 THEN 'hard_error' WHEN n % 5 = 1 THEN 'revise' ELSE 'pass' END",
    "finding_hash": "md5(statement)",
}
REPORTED = "n % 4 <> 0 AND n % 37 <> 0 OR n % 41 = 0"
KINDS = "CASE WHEN n % 3 = 0 THEN array('asr_ambiguity', 'minor_support_boundary') WHEN n % 7 = 0 THEN array('Wrong-Speaker') WHEN n % 11 = 0 THEN array('', 'style') WHEN n % 13 = 0 THEN NULL ELSE array('asr_ambiguity') END"
HARD = "CASE WHEN n % 23 = 0 THEN 'contradiction' ELSE 'asr_ambiguity' END"
DOWN = {
    "ref": "id",
    "finding_hash": "CASE WHEN n % 29 = 0 THEN 'old' ELSE md5(statement) END",
    "decision": "CASE WHEN n % 43 = 0 THEN 'pass' ELSE 'warning' END",
    "basis": "CASE WHEN n % 47 = 0 THEN NULL ELSE 'non_core_asr_ambiguity' END",
    "constraint": "CASE WHEN n % 53 = 0 THEN 'none' ELSE 'exclude_from_new_reader' END",
    "rationale": "CASE WHEN n % 59 = 0 THEN '\t ' ELSE statement END",
}
DOWNED = "n % 4 <> 0 AND n % 5 = 0 AND n % 2 = 1 OR n % 17 = 0 AND n % 8 <> 0"
PRESENT = "n % 61 <> 0"


def _rows(spark, sf):
    return X.claims(spark, sf).withColumn("n", F.length("statement"))


def _columns(fields):
    return ["case_id", *(F.expr(v).cast("string").alias(k) for k, v in fields.items())]


def _report(rows):
    some = rows.filter(REPORTED)
    entries = some.select(*_columns(REPORT), F.expr(KINDS).cast("array<string>").alias("issue_kinds"))
    entries = entries.unionByName(entries.join(some.filter("n % 67 = 0").select("case_id", F.col("id").alias("ref")), ["case_id", "ref"], "left_semi"))
    hard = rows.filter("n % 19 = 0 AND n % 4 <> 0").select("case_id", F.col("id").alias("ref"), F.expr(HARD).alias("code"))
    return entries, D.weighed(entries, hard)


def _downgrades(rows):
    sure = F.create_map(*(c for i, name in enumerate(D.SAFEGUARDS) for c in (F.lit(name), F.col("n") % (71 + i) != 0)))
    return rows.filter(DOWNED).select(*_columns(DOWN), sure.alias("safeguards"))


def g14_delta_scope(spark, sf):
    rows = _rows(spark, sf)
    changes = rows.filter("n % 4 <> 0").select("case_id", F.col("id").alias("ref"), F.expr(CHANGE).alias("change_type"))
    return D.scope_errors(changes, _report(rows)[0])


def _judged(spark, sf):
    rows = _rows(spark, sf)
    weighed, downs = _report(rows)[1].dropDuplicates(["case_id", "ref"]), _downgrades(rows)
    return weighed, downs, D.downgrade_errors(downs, weighed, rows.filter(PRESENT))


def g14_downgrade_errors(spark, sf):
    return _judged(spark, sf)[2]


def g14_outcomes(spark, sf):
    return D.outcomes(*_judged(spark, sf))


POLICY = R.Policy({"coherence": 2, "terminology": 1, "repetition": 1, "hierarchy": 2, "profileFit": 2, "informationLoad": 1}, ("coherence", "hierarchy", "profileFit"))


def _scores(salt: str) -> dict[str, str]:
    """A score of each dimension from a digit of a key's digest: mostly 4 and 5; one in 256 is out of range."""
    digit = lambda i: f"substr(md5(CAST(o_orderkey AS VARCHAR(20)){salt}), {i}, 1)"
    return {d: f"CASE WHEN {digit(i)} = '0' THEN CASE {digit(i + 8)} WHEN '0' THEN 6 WHEN '1' THEN 1 WHEN '2' THEN 2 ELSE 3 END WHEN {digit(i)} < '3' THEN 3 WHEN {digit(i)} < 'a' THEN 4 ELSE 5 END" for i, d in enumerate(POLICY.weights, 1)}


#: The second reader mostly agrees: only the keys of every third customer are read anew.
FIRST, SECOND = _scores(""), _scores(" || CASE WHEN o_custkey % 3 = 0 THEN 'b' ELSE '' END")
SEVERITY = "CASE WHEN o_orderkey % 37 = 0 THEN 'error' WHEN o_orderkey % 5 = 0 THEN 'warning' ELSE 'note' END"
VERDICT = "CASE WHEN o_orderkey % 3 = 0 THEN 'pass' WHEN o_orderkey % 3 = 1 THEN 'clean_pass' ELSE 'revise' END"


def _reviews(spark, sf, scores):
    given = F.create_map(*(c for d, v in scores.items() for c in (F.lit(d), F.expr(v))))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_custkey"), F.expr(VERDICT).alias("verdict"), given.alias("scores"), F.array(F.expr(SEVERITY)).alias("severities"))


def g10_plain_gate(spark, sf):
    return R.failures(_reviews(spark, sf, FIRST), list(POLICY.weights)).select("case_id", "passed", F.array_join("failing", ",").alias("failing"))


def g10_reader_gate(spark, sf):
    return R.evaluated(_reviews(spark, sf, FIRST), POLICY).select("case_id", "classification", F.round("average", 6).alias("average"), F.array_join("reasons", ";").alias("reasons"), "declared")


def _pairs(spark, sf):
    second = _reviews(spark, sf, SECOND).filter("case_id % 11 <> 0")
    return R.pairs(_reviews(spark, sf, FIRST), second, POLICY)


def g10_reader_pairs(spark, sf):
    return _pairs(spark, sf).select("case_id", "c1", "c2", "status", F.array_join("disputed", ",").alias("disputed"))


def g10_ruling_errors(spark, sf):
    k = F.col("case_id")
    paired = _pairs(spark, sf)
    ruled = paired.filter((F.col("status") == "needs_adjudication") | (k % 29 == 0))
    who = F.when(k % 7 == 0, "ann").when(k % 8 == 0, "di").otherwise("cy")
    named = F.when(k % 5 == 0, F.array_append("disputed", F.lit("coherence"))).otherwise(F.reverse("disputed"))
    rulings = ruled.select("case_id", who.alias("reviewer_id"), (k % 13 != 0).alias("blind"), F.when(k % 17 == 0, "borderline").otherwise("pass").alias("decision"), named.alias("disputed"), F.when(k % 19 == 0, " ").otherwise("read").alias("rationale"))
    assigned = ruled.select("case_id", F.when(k % 7 == 0, "ann").otherwise("cy").alias("adjudicator"), F.array(F.lit("ann"), F.lit("bo")).alias("readers"))
    return R.ruling_errors(rulings, paired, assigned)


def _duck(text: str) -> str:
    return text.replace("array(", "list_value(")


_DELTA = f"""{X.CLAIMS}, sized AS (SELECT *, length(statement) AS n FROM claims),
entries AS (SELECT case_id, id AS ref, n, {REPORT['change_type']} AS change_type, {REPORT['verdict']} AS verdict, {REPORT['finding_hash']} AS finding_hash, {_duck(KINDS)} AS kinds FROM sized WHERE {REPORTED}),
hard AS (SELECT case_id, id AS ref, {HARD} AS code FROM sized WHERE n % 19 = 0 AND n % 4 <> 0),
weighed AS (SELECT e.*, list_distinct(list_filter(list_concat(kinds, CASE WHEN code IS NOT NULL THEN [code] END), lambda k: k <> '')) AS issue_kinds, CASE WHEN verdict = 'hard_error' OR code IS NOT NULL THEN 'blocking' WHEN verdict = 'revise' THEN 'advisory' ELSE 'none' END AS weight FROM entries e LEFT JOIN hard USING (case_id, ref)),
downs AS (SELECT case_id, id AS ref, n, {', '.join(f'{v} AS "{k}"' for k, v in DOWN.items() if k != 'ref')} FROM sized WHERE {DOWNED}),
judged AS (SELECT d.*, w.finding_hash AS was, issue_kinds, d.n % 61 = 0 AS gone FROM downs d LEFT JOIN (SELECT * FROM weighed WHERE weight = 'blocking') w USING (case_id, ref)),
errors AS (SELECT case_id, ref, unnest(CASE WHEN was IS NULL THEN ['not_blocking'] ELSE list_filter([CASE WHEN finding_hash <> was THEN 'stale_finding' END, CASE WHEN decision <> 'warning' THEN 'decision' END, CASE WHEN basis IS NULL THEN 'basis' END, CASE WHEN "constraint" <> 'exclude_from_new_reader' THEN 'constraint' END,
  CASE WHEN gone THEN 'claim_gone' END, CASE WHEN len(issue_kinds) = 0 OR len(list_filter(issue_kinds, lambda k: k NOT IN ('asr_ambiguity', 'minor_support_boundary', 'unsupported_semantic_extension'))) > 0 THEN 'kind_not_downgradable' END,
  CASE WHEN list_contains(issue_kinds, 'Wrong-Speaker') OR list_contains(issue_kinds, 'contradiction') THEN 'kind_never_downgradable' END, {', '.join(f"CASE WHEN n % {71 + i} = 0 THEN 'safeguard_{name}' END" for i, name in enumerate(D.SAFEGUARDS))}, CASE WHEN trim(rationale, chr(9) || ' ') = '' THEN 'rationale' END], lambda x: x IS NOT NULL) END) AS error FROM judged)"""

_DIMS = list(POLICY.weights)


def _reader_sql(name, scores, where="true"):
    """Reviews one row a dimension (``name``_long) and evaluated (``name``)."""
    long = " UNION ALL ".join(f"SELECT o_orderkey AS case_id, {i} AS i, '{d}' AS d, {POLICY.weights[d]} AS w, {scores[d]} AS s FROM orders WHERE {where}" for i, d in enumerate(_DIMS))
    names = lambda test: f"string_agg(d, ',' ORDER BY i) FILTER ({test})"
    return f"""{name}_long AS ({long}),
{name}_sums AS (SELECT case_id, {names('s NOT BETWEEN 1 AND 5')} AS invalid, {names('s = 1')} AS ones, {names('w = 2 AND s BETWEEN 1 AND 2')} AS core, {names('s BETWEEN 1 AND 2')} AS low, count(*) FILTER (s = 3) AS threes, min(s) AS least,
  coalesce(sum(s * w) FILTER (s BETWEEN 1 AND 5) / sum(w) FILTER (s BETWEEN 1 AND 5), 0) AS average FROM {name}_long GROUP BY case_id),
{name} AS (SELECT *, CASE WHEN invalid IS NOT NULL OR severity = 'error' THEN 'revise' WHEN least >= 4 THEN 'clean_pass' WHEN low IS NULL AND average >= 3.8 AND threes <= 2 THEN 'borderline' ELSE 'revise' END AS classification
  FROM {name}_sums JOIN (SELECT o_orderkey AS case_id, {SEVERITY} AS severity, {VERDICT} AS verdict FROM orders) USING (case_id))"""


_PAIRS = f"""{_reader_sql('a', FIRST)}, {_reader_sql('b', SECOND, 'o_orderkey % 11 <> 0')},
differ AS (SELECT case_id, list(x.d ORDER BY x.i) AS dims FROM a_long x JOIN b_long y USING (case_id, i) WHERE x.s <> y.s GROUP BY case_id),
pairs AS (SELECT case_id, a.classification AS c1, b.classification AS c2, CASE WHEN c1 <> 'borderline' THEN CASE WHEN c2 IS NULL THEN 'settled' ELSE 'not_allowed' END WHEN c2 IS NULL THEN 'needs_secondary' WHEN c1 = c2 THEN 'pass' ELSE 'needs_adjudication' END AS status,
  CASE WHEN status = 'needs_adjudication' THEN coalesce(dims, []) ELSE [] END AS disputed FROM a LEFT JOIN b USING (case_id) LEFT JOIN differ USING (case_id))"""
ORACLE = {
    "g14_delta_scope": f"""WITH {_DELTA}, due AS (SELECT case_id, id AS ref, {CHANGE} AS due FROM sized WHERE n % 4 <> 0), seen AS (SELECT *, n % 67 = 0 AS twice FROM entries)
SELECT case_id, ref, unnest(list_filter([CASE WHEN n IS NULL THEN 'not_reviewed' WHEN due IS NULL THEN 'outside_scope' WHEN change_type <> due THEN 'change_type' END, CASE WHEN twice THEN 'entry_repeated' END], lambda x: x IS NOT NULL)) AS error FROM due FULL JOIN seen USING (case_id, ref)""",
    "g14_downgrade_errors": f"WITH {_DELTA} SELECT * FROM errors",
    "g14_outcomes": f"""WITH {_DELTA} SELECT case_id, ref, CASE WHEN weight = 'advisory' THEN 'advisory' WHEN (case_id, ref) IN (SELECT (case_id, ref) FROM downs) AND case_id NOT IN (SELECT case_id FROM errors) THEN 'warning' ELSE 'hard' END AS level FROM weighed WHERE weight <> 'none'""",
    "g10_plain_gate": f"WITH {_reader_sql('a', FIRST)} SELECT case_id, verdict = 'pass' AND least >= 4 AND severity <> 'error' AS passed, coalesce((SELECT string_agg(d, ',' ORDER BY i) FROM a_long l WHERE l.case_id = a.case_id AND s < 4), '') AS failing FROM a",
    "g10_reader_gate": f"""WITH {_reader_sql('a', FIRST)} SELECT case_id, classification, round(average, 6) AS average, concat_ws(';', 'invalid_scores:' || invalid, CASE WHEN severity = 'error' THEN 'error_issue' END, 'score_1:' || ones, 'core_score_2:' || core,
CASE WHEN classification = 'revise' AND ones IS NULL AND core IS NULL THEN 'below_borderline:' || low END, CASE WHEN classification = 'revise' AND average < 3.8 THEN 'low_average' END, CASE WHEN classification = 'revise' AND threes > 2 THEN 'too_many_threes' END) AS reasons, verdict = classification AS declared FROM a""",
    "g10_reader_pairs": f"WITH {_PAIRS} SELECT case_id, c1, c2, status, array_to_string(disputed, ',') AS disputed FROM pairs",
    "g10_ruling_errors": f"""WITH {_PAIRS} SELECT case_id, unnest(list_filter([CASE WHEN case_id % 13 = 0 THEN 'not_blind' END, CASE WHEN case_id % 7 <> 0 AND case_id % 8 = 0 THEN 'not_assigned' END, CASE WHEN case_id % 7 = 0 THEN 'not_independent' END, CASE WHEN case_id % 17 = 0 THEN 'decision' END,
CASE WHEN status <> 'needs_adjudication' THEN 'not_needed' END, CASE WHEN case_id % 5 = 0 THEN 'dimensions' END, CASE WHEN case_id % 19 = 0 THEN 'rationale' END], lambda x: x IS NOT NULL)) AS error FROM pairs WHERE status = 'needs_adjudication' OR case_id % 29 = 0""",
}
NAMES = "g10_plain_gate g10_reader_gate g10_reader_pairs g10_ruling_errors g14_delta_scope g14_downgrade_errors g14_outcomes"
QUERIES = {name: globals()[name] for name in NAMES.split()}
