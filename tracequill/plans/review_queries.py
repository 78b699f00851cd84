"""Queries of claim reviews: entry contracts, quote repairs, rulings, and states of cases.

Reviews are derived from claims by the lengths of their texts (``n``, in a case ``m``). Scalars
of these fixtures are text that Spark and DuckDB both read; the rules under test are written twice.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracequill.operators import claimreview as C
from tracequill.session import written

from . import fixtures as X

#: Reviews that break every rule somewhere.
WILD = {
    "ref": "CASE WHEN n % 41 = 0 THEN 'X1' ELSE id END",
    "verdict": "CASE WHEN n % 3 <> 0 THEN 'pass' WHEN n % 43 = 0 THEN 'maybe' WHEN n % 4 = 0 THEN 'split' WHEN n % 4 = 1 THEN 'merge' WHEN n % 4 = 2 THEN 'remove' ELSE 'revise' END",
    "atomicity": "CASE WHEN n % 12 = 0 THEN 'fail' WHEN n % 53 = 0 THEN NULL ELSE 'pass' END",
    "support": "CASE WHEN n % 47 = 0 THEN NULL WHEN n % 3 = 0 AND n % 5 = 0 THEN 'partial' ELSE 'supported' END",
    "importance_verdict": "CASE WHEN n % 17 = 0 THEN 'change' WHEN n % 59 = 0 THEN 'other' ELSE 'confirmed' END",
    "importance_proposed": "CASE WHEN n % 34 = 0 THEN 'low' WHEN n % 29 = 0 THEN 'high' WHEN n % 61 = 0 THEN 'huge' END",
    "theme_verdict": "CASE WHEN n % 19 = 0 THEN 'change' ELSE 'confirmed' END",
    "theme_proposed": "CASE WHEN n % 38 = 0 THEN 'T009' WHEN n % 37 = 0 THEN 'T1' END",
    "speaker": "CASE WHEN n % 31 = 0 THEN 'nobody' WHEN n % 5 = 1 THEN 'unknown_safe' ELSE 'confirmed' END",
    "issues": "CASE WHEN n % 67 = 0 THEN NULL WHEN n % 21 = 0 THEN array('a', 'a') WHEN n % 33 = 0 THEN array('a', '') WHEN n % 3 = 0 THEN array('a') ELSE array() END",
    "rationale": "CASE WHEN n % 23 = 0 THEN '  ' WHEN n % 71 = 0 THEN NULL ELSE statement END",
    "merge_refs": "CASE WHEN n % 24 = 21 THEN array('E9999') WHEN n % 73 = 0 THEN array('E0001', 'E0002') WHEN n % 11 = 0 THEN NULL WHEN n % 12 = 9 THEN array('E0001') ELSE array() END",
    "replacements": "CASE WHEN n % 24 = 0 THEN array('one', 'two') WHEN n % 36 = 0 THEN array('one', ' ') WHEN n % 25 = 0 THEN array('one') ELSE array() END",
    "codes": "CASE WHEN n % 79 = 0 THEN NULL WHEN n % 15 = 0 THEN array('support_gap', 'support_gap') WHEN n % 27 = 0 THEN array('odd') WHEN n % 6 = 0 THEN array('overstatement') WHEN n % 49 = 0 THEN array('support_gap') ELSE array() END",
}

_KIND = "CASE WHEN n % 4 <> 0 THEN 'clean' WHEN n % 5 = 0 THEN 'split' WHEN n % 5 = 1 THEN 'importance' WHEN n % 5 = 2 THEN 'theme' WHEN n % 5 = 3 AND id <> 'E0001' THEN 'merge' ELSE 'support' END"
#: The first reviewer, and the second who now and then sees it otherwise.
KINDS = (_KIND, f"CASE WHEN n % 7 = 0 THEN 'clean' WHEN n % 7 = 1 THEN 'support' ELSE {_KIND} END")
#: Sound reviews, of a ``kind``.
TAME = {
    "ref": "id",
    "verdict": "CASE kind WHEN 'clean' THEN 'pass' WHEN 'split' THEN 'split' WHEN 'merge' THEN 'merge' ELSE 'revise' END",
    "atomicity": "CASE WHEN kind = 'split' THEN 'fail' ELSE 'pass' END",
    "support": "CASE WHEN kind = 'support' THEN 'partial' ELSE 'supported' END",
    "importance_verdict": "CASE WHEN kind = 'importance' THEN 'change' ELSE 'confirmed' END",
    "importance_proposed": "CASE WHEN kind = 'importance' THEN 'low' END",
    "theme_verdict": "CASE WHEN kind = 'theme' THEN 'change' ELSE 'confirmed' END",
    "theme_proposed": "CASE WHEN kind = 'theme' THEN CASE WHEN n % 3 = 0 THEN 'T009' ELSE 'T008' END END",
    "speaker": "'confirmed'",
    "issues": "array()",
    "rationale": "CASE WHEN n % 211 = 0 THEN '' ELSE 'seen' END",
    "merge_refs": "CASE WHEN kind = 'merge' THEN array('E0001') ELSE array() END",
    "replacements": "CASE WHEN kind = 'split' THEN array('one', 'two') ELSE array() END",
    "codes": "CASE kind WHEN 'clean' THEN array() WHEN 'split' THEN array('compound_claim') WHEN 'merge' THEN array('duplicate_claim') WHEN 'importance' THEN array('importance_misclassified') WHEN 'theme' THEN array('theme_misclassified') ELSE CASE WHEN n % 16 = 0 THEN array('missing_support_quote', 'support_gap') ELSE array('support_gap') END END",
}
LISTS = ("issues", "merge_refs", "replacements", "codes")


def _claims(spark, sf):
    """Claims with ``n`` and ``m``, stored, as reviews, rulings and checks all read them."""
    rows = X.claims(spark, sf).withColumn("n", F.length("statement"))
    return written(spark, rows.withColumn("m", F.sum("n").over(Window.partitionBy("case_id"))), "claims")


def _entries(rows, columns, kind="NULL"):
    rows = rows.withColumn("kind", F.expr(kind))
    return rows.select("case_id", *(F.expr(v).cast("array<string>" if k in LISTS else "string").alias(k) for k, v in columns.items()))


def _duck(text: str) -> str:
    return text.replace("array(", "list_value(")


def _entry_sql(columns, kind="NULL", where="true", table="sized") -> str:
    fields = ", ".join(f"({_duck(v)})::VARCHAR{'[]' if k in LISTS else ''} AS {k}" for k, v in columns.items())
    return f"SELECT case_id, {fields} FROM (SELECT *, {kind} AS kind FROM {table}) WHERE {where}"


SIZED = f"{X.CLAIMS}, sized AS (SELECT *, length(statement) AS n, sum(length(statement)) OVER (PARTITION BY case_id) AS m FROM claims)"

_SOUND = "coalesce({a}_verdict IN ('confirmed', 'change') AND ({a}_proposed IS NULL OR {ok}), false)"


def _axis(a, ok):
    sound = _SOUND.format(a=a, ok=ok)
    return f"CASE WHEN NOT {sound} THEN '{a}_decision' WHEN {a}_verdict = 'confirmed' AND {a}_proposed IS NOT NULL THEN '{a}_confirmed_with_value' WHEN {a}_verdict = 'change' AND {a}_proposed IS NULL THEN '{a}_change_without_value' END"


def _list_rules(c):
    return f"CASE WHEN {c} IS NULL THEN '{c}_missing' END, CASE WHEN list_contains({c}, '') THEN '{c}_empty_text' END, CASE WHEN len(list_distinct({c})) < len({c}) THEN '{c}_repeated' END"


_CLEAN = "coalesce(verdict = 'pass' AND atomicity = 'pass' AND support = 'supported' AND importance_verdict = 'confirmed' AND theme_verdict = 'confirmed' AND speaker IN ('confirmed', 'unknown_safe') AND len(issues) = 0, false) AND importance_proposed IS NULL AND theme_proposed IS NULL"


def errors_sql(entries: str) -> str:
    """Every entry of a relation with its ``errors``; another relation ``claims`` is known."""
    return f"""SELECT e.*, list_filter([CASE WHEN NOT coalesce(regexp_matches(ref, '^E[0-9]{{4,}}$'), false) THEN 'evidence_ref' END,
CASE WHEN verdict IS NULL OR verdict NOT IN ('pass', 'revise', 'split', 'merge', 'remove') THEN 'verdict' END, CASE WHEN atomicity IS NULL OR atomicity NOT IN ('pass', 'fail') THEN 'atomicity' END,
CASE WHEN support IS NULL OR support NOT IN ('supported', 'partial', 'unsupported') THEN 'support' END, {_axis('importance', "importance_proposed IN ('high', 'medium', 'low')")}, {_axis('theme', "regexp_matches(theme_proposed, '^T[0-9]{3,}$')")},
CASE WHEN speaker IS NULL OR speaker NOT IN ('confirmed', 'unknown_safe', 'change') THEN 'speaker' END, {_list_rules('issues')}, CASE WHEN trim(coalesce(rationale, '')) = '' THEN 'rationale' END,
CASE WHEN verdict = 'merge' AND coalesce(len(merge_refs), 0) <> 1 THEN 'merge_target_count' END, CASE WHEN verdict = 'merge' AND list_contains(merge_refs, ref) THEN 'merge_into_itself' END,
CASE WHEN verdict = 'merge' AND len(list_filter(merge_refs, lambda t: t <> ref AND NOT list_contains(k.ids, t))) > 0 THEN 'merge_into_unknown' END,
CASE WHEN coalesce(verdict, '') <> 'merge' AND len(merge_refs) > 0 THEN 'targets_without_merge' END, CASE WHEN len(list_filter(replacements, lambda t: trim(t) = '')) > 0 THEN 'replacement_blank'
WHEN verdict = 'split' AND coalesce(len(replacements), 0) < 2 THEN 'split_needs_two' WHEN verdict = 'pass' AND len(replacements) > 0 THEN 'pass_with_replacement' END, CASE WHEN verdict = 'pass' AND NOT ({_CLEAN}) THEN 'pass_contradicts_axes' END,
{_list_rules('codes')}, CASE WHEN len(list_filter(codes, lambda c: c <> '' AND c NOT IN ('compound_claim', 'support_gap', 'overstatement', 'importance_misclassified', 'theme_misclassified', 'speaker_attribution_unsafe', 'duplicate_claim', 'empty_semantics', 'other_semantic', 'missing_support_quote'))) > 0 THEN 'codes_unsupported' END,
CASE WHEN verdict = 'pass' AND len(codes) > 0 THEN 'pass_with_codes' END, CASE WHEN coalesce(verdict, '') <> 'pass' AND coalesce(len(codes), 0) = 0 THEN 'nonpass_without_codes' END], lambda x: x IS NOT NULL) AS errors
FROM {entries} e LEFT JOIN (SELECT case_id, list(id) AS ids FROM claims GROUP BY case_id) k USING (case_id)"""


def g03_entry_errors(spark, sf):
    rows = _claims(spark, sf)
    return C.entry_errors(_entries(rows, WILD), rows).select("case_id", "ref", F.array_join("errors", ",").alias("errors"))


def _first(rows):
    return _entries(rows, TAME, KINDS[0])


def _second(rows):
    """The second reviewer: targets only, of most cases, and in a few one more or one less."""
    asked = f"(({KINDS[0]}) <> 'clean' AND n % 97 <> 0 OR n % 89 = 0) AND m % 6 <> 0"
    return _entries(rows.filter(asked), TAME, KINDS[1])


_SECOND_WHERE = f"(({KINDS[0]}) <> 'clean' AND n % 97 <> 0 OR n % 89 = 0) AND m % 6 <> 0"
_RULED = {
    "selection": "CASE k % 9 WHEN 0 THEN 'original' WHEN 1 THEN 'secondary' WHEN 2 THEN 'unreviewable' WHEN 3 THEN CASE WHEN m % 5 = 0 THEN 'none' ELSE 'primary' END ELSE 'primary' END",
    "confidence": "CASE WHEN k % 31 = 0 THEN 1.5 WHEN k % 8 = 0 THEN 0.5 ELSE 0.9 END",
    "rationale": "CASE WHEN k % 37 = 0 THEN ' ' ELSE 'heard' END",
}


def _disputes(rows):
    targets = C.decisions(_first(rows)).filter(F.size("semantic") > 0)
    return C.conflicts(targets, C.decisions(_second(rows))).filter(F.size("triggers") > 0)


def _rulings(rows, disputes):
    """Rulings on disputes of most cases; some name other triggers, some are on what nobody disputes, some are left out."""
    lengths = rows.select("case_id", F.col("id").alias("ref"), F.col("n").alias("k"), "m").filter("m % 7 <> 0")
    fields = [F.expr(v).cast("double" if c == "confidence" else "string").alias(c) for c, v in _RULED.items()]
    triggers = F.when(F.col("k") % 41 == 0, F.array(F.lit("verdict_conflict"))).otherwise(F.col("triggers"))
    on = disputes.join(lengths, ["case_id", "ref"]).filter("k % 36 <> 0").select("case_id", "ref", triggers.alias("triggers"), *fields)
    beside = lengths.filter("k % 103 = 0").join(disputes, ["case_id", "ref"], "left_anti").select("case_id", "ref", F.array(F.lit("verdict_conflict")).alias("triggers"), *fields)
    return on.unionByName(beside)


_SEMANTIC = "CASE WHEN clean THEN []::VARCHAR[] ELSE list_sort(list_filter(codes, lambda c: c <> 'missing_support_quote')) END"


def _decided(name):
    return f"SELECT *, {_CLEAN} AS clean, list_contains(codes, 'missing_support_quote') AND NOT ({_CLEAN}) AS mechanical FROM {name}"


DISPUTES = f"""{SIZED}, e1 AS ({_entry_sql(TAME, KINDS[0])}), e2 AS ({_entry_sql(TAME, KINDS[1], _SECOND_WHERE)}),
d1 AS (SELECT *, {_SEMANTIC} AS semantic FROM ({_decided('e1')})), d2 AS (SELECT *, {_SEMANTIC} AS semantic FROM ({_decided('e2')})), targets AS (SELECT * FROM d1 WHERE len(semantic) > 0),
compared AS (SELECT a.case_id, a.ref, a.verdict AS v1, b.verdict AS v2, list_filter([CASE WHEN a.verdict <> b.verdict THEN 'verdict_conflict' END, CASE WHEN a.semantic <> b.semantic THEN 'finding_conflict' END,
  CASE WHEN a.merge_refs <> b.merge_refs OR len(a.replacements) <> len(b.replacements) OR a.importance_proposed IS DISTINCT FROM b.importance_proposed OR a.theme_proposed IS DISTINCT FROM b.theme_proposed THEN 'remedy_conflict' END], lambda x: x IS NOT NULL) AS triggers
  FROM targets a JOIN d2 b USING (case_id, ref)),
disputes AS (SELECT * FROM compared WHERE len(triggers) > 0),
lengths AS (SELECT case_id, id AS ref, n AS k, m FROM sized WHERE m % 7 <> 0),
rulings AS (SELECT case_id, ref, CASE WHEN k % 41 = 0 THEN ['verdict_conflict'] ELSE triggers END AS triggers, {', '.join(f'{v} AS {c}' for c, v in _RULED.items())} FROM disputes JOIN lengths USING (case_id, ref) WHERE k % 36 <> 0
  UNION ALL SELECT case_id, ref, ['verdict_conflict'], {', '.join(_RULED.values())} FROM lengths ANTI JOIN disputes USING (case_id, ref) WHERE k % 103 = 0)"""
RULING_ERRORS = """SELECT case_id, ref, unnest(list_filter([CASE WHEN ruled AND t IS NULL THEN 'outside_conflicts' END, CASE WHEN ruled IS NULL THEN 'not_ruled' END, CASE WHEN ruled AND t IS NOT NULL AND list_sort(triggers) <> list_sort(t) THEN 'triggers_differ' END,
  CASE WHEN ruled AND selection NOT IN ('primary', 'secondary', 'original', 'unreviewable') THEN 'selection' END, CASE WHEN ruled AND confidence > 1 THEN 'confidence' END, CASE WHEN ruled AND trim(rationale) = '' THEN 'rationale' END], lambda x: x IS NOT NULL)) AS error
  FROM (SELECT *, true AS ruled FROM rulings) FULL JOIN (SELECT case_id, ref, triggers AS t FROM disputes SEMI JOIN rulings USING (case_id)) USING (case_id, ref)"""


def g03_ruling_errors(spark, sf):
    rows = _claims(spark, sf)
    disputes = _disputes(rows)
    return C.ruling_errors(_rulings(rows, disputes), disputes)


def _spans(spark, sf):
    """Two editions of one span a claim and the repairs that explain them; lengths say which quotes are missing, given, changed or moved."""
    rows = _claims(spark, sf)
    quote = "CASE WHEN n % 3 = 0 THEN NULL WHEN n % 10 = 1 THEN ' ' ELSE statement END"
    later = f"CASE WHEN n % 6 = 0 OR n % 10 = 1 THEN statement WHEN n % 101 = 0 THEN 'else' WHEN n % 15 = 0 THEN '' ELSE {quote} END"
    span = F.lit(0).alias("span")
    before = rows.select("case_id", "id", span, F.md5("statement").alias("rest"), F.expr(quote).alias("quote"))
    after = rows.select("case_id", "id", span, F.when((F.col("m") % 11 == 0) & (F.col("n") % 2 == 0), "moved").otherwise(F.md5("statement")).alias("rest"), F.expr(later).alias("quote"))
    listed = F.when(F.col("n") % 17 == 0, F.array(F.lit(0), F.lit(0))).when(F.col("n") % 19 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(0)))
    fixes = rows.filter("m % 5 <> 0 AND ((n % 6 = 0 OR n % 10 = 1) AND n % 23 <> 0 OR n % 83 = 0)").select("case_id", F.col("id").alias("ref"), F.when(F.col("n") % 29 == 0, "other").otherwise(C.MECHANICAL).alias("code"), F.when(F.col("n") % 31 == 0, "open").otherwise("mechanically_resolved").alias("status"), listed.alias("spans"))
    return before, after, fixes


def g03_quote_repairs(spark, sf):
    return C.fix_errors(*_spans(spark, sf))


def g01_claim_states(spark, sf):
    rows = _claims(spark, sf)
    fixed = rows.filter("n % 16 = 0 AND n % 13 <> 0").select("case_id", F.col("id").alias("ref"))
    people = rows.select("case_id", "m").distinct().select("case_id", F.lit("ann").alias("primary"), F.when(F.col("m") % 29 == 0, "ann").otherwise("bo").alias("secondary"), F.when(F.col("m") % 23 == 0, "bo").otherwise("cy").alias("adjudicator"))
    return C.claim_states(rows, _first(rows), fixed, _second(rows), _rulings(rows, _disputes(rows)), people)


_QUOTE = "CASE WHEN n % 3 = 0 THEN NULL WHEN n % 10 = 1 THEN ' ' ELSE statement END"
_LATER = f"CASE WHEN n % 6 = 0 OR n % 10 = 1 THEN statement WHEN n % 101 = 0 THEN 'else' WHEN n % 15 = 0 THEN '' ELSE {_QUOTE} END"
ORACLE = {
    "g03_entry_errors": f"WITH {SIZED}, wild AS ({_entry_sql(WILD)}) SELECT case_id, ref, array_to_string(errors, ',') AS errors FROM ({errors_sql('wild')})",
    "g03_ruling_errors": f"WITH {DISPUTES} {RULING_ERRORS}",
    "g03_quote_repairs": f"""WITH {SIZED}, s AS (SELECT *, {_QUOTE} AS q, {_LATER} AS l, m % 11 = 0 AND n % 2 = 0 AS moved, m % 5 <> 0 AND ((n % 6 = 0 OR n % 10 = 1) AND n % 23 <> 0 OR n % 83 = 0) AS fix FROM sized),
c AS (SELECT *, bool_or(moved) OVER (PARTITION BY case_id) AS away, bool_or(fix) OVER (PARTITION BY case_id) AS asked FROM s),
o AS (SELECT *, CASE WHEN away OR q IS NOT DISTINCT FROM l THEN '' WHEN trim(coalesce(q, '')) <> '' THEN 'quote_changed' WHEN trim(coalesce(l, '')) = '' THEN 'quote_not_added' ELSE 'added' END AS outcome FROM c WHERE asked),
f AS (SELECT case_id, id AS ref, unnest(list_filter([CASE WHEN outcome IN ('quote_changed', 'quote_not_added') THEN outcome END, CASE WHEN fix AND n % 29 = 0 THEN 'code' END, CASE WHEN fix AND n % 31 = 0 THEN 'status' END, CASE WHEN fix AND trim(coalesce(l, '')) = '' THEN 'quote_left_missing' END,
  CASE WHEN fix AND n % 17 = 0 THEN 'spans' WHEN fix AND (outcome <> 'added' OR n % 19 = 0) THEN 'spans_not_those_added' END, CASE WHEN fix AND outcome <> 'added' THEN 'nothing_added' END, CASE WHEN NOT fix AND outcome = 'added' THEN 'not_covered' END], lambda x: x IS NOT NULL)) AS error FROM o)
SELECT * FROM f UNION ALL SELECT DISTINCT case_id, NULL, 'semantics_changed' FROM o WHERE away""",
    "g01_claim_states": f"""WITH {DISPUTES}, r1 AS (SELECT DISTINCT case_id FROM ({errors_sql('e1')}) WHERE len(errors) > 0),
r2 AS (SELECT case_id FROM ({errors_sql('e2')}) WHERE len(errors) > 0 UNION SELECT case_id FROM e2 ANTI JOIN targets USING (case_id, ref) UNION SELECT case_id FROM targets SEMI JOIN e2 USING (case_id) ANTI JOIN e2 USING (case_id, ref)),
r3 AS (SELECT DISTINCT case_id FROM ({RULING_ERRORS})), unfixed AS (SELECT DISTINCT d.case_id FROM d1 d JOIN sized s ON s.case_id = d.case_id AND s.id = d.ref WHERE mechanical AND NOT (n % 16 = 0 AND n % 13 <> 0)),
o AS (SELECT c.case_id, count(*) FILTER (len(c.triggers) > 0) AS conflicts, count(*) FILTER (len(c.triggers) > 0 AND (selection = 'unreviewable' OR confidence < 0.8)) AS human,
  count(*) FILTER (CASE WHEN len(c.triggers) = 0 OR selection = 'primary' THEN v1 WHEN selection = 'secondary' THEN v2 ELSE 'pass' END <> 'pass') AS failures FROM compared c LEFT JOIN rulings USING (case_id, ref) GROUP BY c.case_id),
n AS (SELECT case_id, any_value(m) AS m FROM sized GROUP BY case_id),
k AS (SELECT *, coalesce(conflicts, 0) AS cf, (SELECT count(*) FROM targets t WHERE t.case_id = n.case_id) AS targets, case_id IN (SELECT case_id FROM e2) AS second, case_id IN (SELECT case_id FROM rulings) AS ruled FROM n LEFT JOIN o USING (case_id))
SELECT case_id, targets, cf AS conflicts, CASE WHEN case_id IN (SELECT case_id FROM r1) THEN 'invalid' WHEN case_id IN (SELECT case_id FROM unfixed) THEN 'needs_mechanical_fix' WHEN targets = 0 THEN CASE WHEN second OR ruled THEN 'invalid' ELSE 'pass' END
WHEN NOT second THEN CASE WHEN ruled THEN 'invalid' ELSE 'needs_secondary' END WHEN m % 29 = 0 OR case_id IN (SELECT case_id FROM r2) THEN 'invalid' WHEN case_id IN (SELECT case_id FROM d2 WHERE mechanical) THEN 'needs_mechanical_fix'
WHEN cf = 0 AND ruled THEN 'invalid' WHEN cf > 0 AND NOT ruled THEN 'needs_adjudication' WHEN ruled AND (m % 23 = 0 OR case_id IN (SELECT case_id FROM r3)) THEN 'invalid' WHEN human > 0 THEN 'human_required' WHEN failures > 0 THEN 'repair_required' ELSE 'pass' END AS state FROM k""",
}
NAMES = "g01_claim_states g03_entry_errors g03_quote_repairs g03_ruling_errors"
QUERIES = {name: globals()[name] for name in NAMES.split()}
