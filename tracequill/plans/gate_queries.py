"""Queries of review gates, nested documents and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequill.operators import gates as G
from tracequill.operators import leaves as L
from tracequill.session import table, written

from . import fixtures as X

ROLE_RULES = [("question", r"\?$"), ("number", r"[0-9]{2,}"), ("cause", r"(?i)\b(?:because|porque|weil|parce)\b"), ("list", r"[|;]")]
FIELDS = {
    "verdict": ("pass", "pass", "pass", "pass", "split", "merge", "revise"), "atomicity": ("pass", "pass", "fail"), "support": ("supported", "supported", "supported", "partial"),
    "importance_verdict": ("confirmed", "confirmed", "change"), "theme_verdict": ("confirmed", "confirmed", "confirmed", "confirmed", "change"), "speaker": ("confirmed", "unknown_safe", "confirmed", "change"),
}


def _pick(names, k):
    return F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))


# A reviewer proposes another level for long claims and another theme for those with a figure.
def _proposals() -> list:
    return [F.when(F.length("statement") > 200, "low").alias("importance_proposed"), F.when(F.col("statement").rlike("[0-9]"), "T001").alias("theme_proposed")]


_PROPOSED = "CASE WHEN length(statement) > 200 THEN 'low' END AS importance_proposed, CASE WHEN regexp_matches(statement, '[0-9]') THEN 'T001' END AS theme_proposed"


def _entries(spark, sf, step: int):
    k = F.floor((F.col("case_id") * 5 + F.col("pos")) / step)
    calm = (F.col("case_id") + F.col("pos")) % 4 != 0
    fields = [F.when(calm, F.lit(v[0])).otherwise(_pick(v, k)).alias(n) for n, v in FIELDS.items()]
    return X.claims(spark, sf).select("case_id", F.col("id").alias("ref"), *fields, F.when(calm, 0).otherwise(k % 2).cast("int").alias("n_issues"), *_proposals())


def _entry_sql(step: int) -> str:
    k = f"((case_id * 5 + pos) // {step})"
    fields = ", ".join(f"CASE WHEN (case_id + pos) % 4 <> 0 THEN '{v[0]}' ELSE {list(v)}[{k} % {len(v)} + 1] END AS {n}" for n, v in FIELDS.items())
    return f"SELECT case_id, pos, id AS ref, {fields}, CASE WHEN (case_id + pos) % 4 <> 0 THEN 0 ELSE {k} % 2 END AS n_issues, {_PROPOSED} FROM claims"


_CODES = """SELECT *, verdict = 'pass' AND atomicity = 'pass' AND support = 'supported' AND importance_verdict = 'confirmed' AND theme_verdict = 'confirmed' AND speaker IN ('confirmed', 'unknown_safe') AND n_issues = 0 AND importance_proposed IS NULL AND theme_proposed IS NULL AS clean,
array_to_string(list_filter([CASE WHEN atomicity = 'fail' OR verdict = 'split' THEN 'compound_claim' END, CASE WHEN verdict = 'merge' THEN 'duplicate_claim' END, CASE WHEN verdict = 'remove' THEN 'empty_semantics' END,
CASE WHEN importance_verdict = 'change' THEN 'importance_misclassified' END, CASE WHEN speaker = 'change' THEN 'speaker_attribution_unsafe' END, CASE WHEN support IN ('partial', 'unsupported') THEN 'support_gap' END,
CASE WHEN theme_verdict = 'change' THEN 'theme_misclassified' END], lambda x: x IS NOT NULL), ',') AS c0 FROM {t}"""
_FIRST = f"{X.CLAIMS}, e1 AS ({_entry_sql(1)}), f1 AS ({_CODES.format(t='e1')}), g1 AS (SELECT *, CASE WHEN c0 = '' AND NOT clean THEN 'other_semantic' ELSE c0 END AS codes FROM f1)"


def l05_clean_pass(spark, sf):
    return _entries(spark, sf, 1).select("case_id", "ref", G.clean_pass().alias("clean"))


def g02_finding_codes(spark, sf):
    return G.finding_codes(_entries(spark, sf, 1)).select("case_id", "ref", F.array_join("codes", ",").alias("codes"))


def g01_claim_gate(spark, sf):
    second = _entries(spark, sf, 2).filter("case_id % 5 <> 0")
    rulings = X.claims(spark, sf).filter("case_id % 3 <> 0").select("case_id", F.col("id").alias("ref"), _pick(("original", "primary", "secondary", "unreviewable"), F.col("case_id") + F.col("pos")).alias("selection"), F.when(F.col("pos") % 7 == 0, 0.5).otherwise(0.9).alias("confidence"))
    return G.claim_gate(_entries(spark, sf, 1), second, rulings)


def g09_fidelity_reasons(spark, sf):
    k = F.col("case_id") + F.col("pos")
    rows = X.claims(spark, sf).select("case_id", "id", _pick(("supported", "supported", "partial"), k).alias("verdict"), _pick(("correct", "correct", "correct", "wrong"), k).alias("provenance_verdict"), (k % 5 == 0).cast("int").alias("n_unsupported"), F.when(k % 3 == 0, "external").otherwise("source_fact").alias("provenance"), F.concat(F.lit("R"), (k % 6).cast("string")).alias("citation"))
    checked = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), F.explode(F.array(F.lit("R0"), F.lit("R2"), F.lit("R2"))).alias("citation"))
    return G.fidelity_reasons(rows, checked).select("case_id", "id", F.array_join("reasons", ",").alias("reasons"))


def _lite(spark, sf):
    k = F.col("case_id") * 3 + F.col("pos")
    return X.claims(spark, sf).select("case_id", "id", _pick(("fidelity", "scout", "advocate"), k).alias("role"), _pick(("Made-Up", "core_omission", "style", "odd code", "core omission"), F.floor(k / 2)).alias("code"), F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit("k"), (k % 2).cast("string"))).alias("key"), _pick(("hard", "hard", "warning", "diagnostic"), F.floor(k / 3)).alias("severity"))


def g11_lite_findings(spark, sf):
    return G.lite_findings(_lite(spark, sf)).groupBy("case_id", "role", "code", "severity").agg(F.count(F.lit(1)).alias("n"))


def g11_lite_status(spark, sf):
    return G.lite_status(G.lite_findings(_lite(spark, sf)))


def g12_required_roles(spark, sf):
    kinds = F.filter(F.array(F.when(F.col("pos") % 5 == 0, F.lit("text")), F.when(F.col("case_id") % 2 == 0, F.lit("provenance")), F.lit("structure")), lambda x: x.isNotNull())
    return G.required_roles(X.claims(spark, sf).select("case_id", kinds.alias("kinds"))).select("case_id", F.array_join("roles", ",").alias("roles"))


def g17_independence(spark, sf):
    k = F.col("case_id")
    # Read four times: two rows a case are stored, not its reviews counted again.
    held = written(spark, X.reviews(spark, sf).select("case_id", "role").distinct(), "roles")
    rows = held.select("case_id", F.lit(1).alias("round"), "role", F.when(k % 4 == 0, "r1").otherwise(F.concat(F.lit("r"), "role")).alias("reviewer_id"))
    return G.independence_errors(rows.unionByName(rows.filter("case_id % 6 = 1 AND role = 'A'")))


def g23_stage_ledger(spark, sf):
    rows = table(spark, sf, "orders").select((F.floor(F.col("o_orderkey") / 4)).cast("long").alias("case_id"), (F.col("o_orderkey") % 4).alias("seq"), F.col("o_orderkey").alias("k"))
    stage = _pick((*G.STAGES, "other"), F.when(F.col("k") % 11 == 0, F.col("seq") + 2).when(F.col("k") % 13 == 0, F.lit(0)).when(F.col("k") % 29 == 0, F.lit(5)).otherwise(F.col("seq")))
    return G.ledger_errors(rows.select("case_id", "seq", stage.alias("stage"), F.when(F.col("k") % 17 == 0, "new").otherwise("old").alias("source_hash")))


def g26_profile_errors(spark, sf):
    k = F.col("doc_id")
    rows = table(spark, sf, "documents").select("doc_id", F.when(k % 7 != 0, _pick(("alpha", "beta", "omega"), k)).alias("primary"), F.slice(F.array(F.lit("l1"), F.lit("l2"), F.lit("l1"), F.lit("l9")), F.lit(1), (k % 5).cast("int")).alias("lenses"), F.when(k % 4 == 0, "pending").otherwise("automatic").alias("selection"), ((k % 6) / 4).alias("confidence"), F.when(k % 10 == 0, "1").otherwise("2").alias("version"))
    return G.profile_errors(rows, ["alpha", "beta"], ["l1", "l2", "l3"], "2").select("doc_id", F.array_join("errors", ",").alias("errors"))


def a11_density(spark, sf):
    k = F.col("doc_id")
    rows = table(spark, sf, "documents").select("doc_id", *(((k * (i + 3)) % 13 / 2.0 - 1).alias(f"d{i}") for i in range(5)))
    return G.density(rows, [f"d{i}" for i in range(5)]).select("doc_id", "total")


def f18_claim_role(spark, sf):
    return X.claims(spark, sf).select("case_id", "id", G.keyword_role(F.col("statement"), ROLE_RULES).alias("role"))


def _documents(spark, sf):
    """A reader document for each case: themes are modules, claims blocks of two nodes."""
    refs = F.array("id")
    none = F.array().cast("array<string>")
    node = lambda i, text, prov, own: F.struct(F.concat(F.lit(f"n{i}-"), "id").alias("id"), text.alias("text"), prov.alias("provenance"), own.alias("evidence_refs"), none.alias("citation_refs"))
    nodes = F.array(node(1, F.concat("statement", F.lit(" [E0001, E0002]")), F.lit(None).cast("string"), none), node(2, F.substring("statement", 1, 10), F.when(F.col("pos") % 3 == 0, "system"), F.when(F.col("pos") % 2 == 0, F.array(F.lit("E9999"))).otherwise(none)))
    block = F.struct(F.concat(F.lit("b"), "id").alias("id"), _pick(("prose_group", "quote", "timeline"), F.col("pos")).alias("type"), F.col("provenance"), refs.alias("evidence_refs"), none.alias("citation_refs"), nodes.alias("nodes"))
    blocks = X.claims(spark, sf).groupBy("case_id", "theme_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))), lambda x: x["b"]).alias("blocks"))
    modules = blocks.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(F.col("theme_id").alias("id"), "blocks"))).alias("modules"))
    return modules.select("case_id", F.array(F.struct(F.when(F.col("case_id") % 4 == 0, "closing").otherwise("themes").alias("id"), "modules")).alias("sections"))


def p05_leaves(spark, sf):
    return L.flatten(_documents(spark, sf)).select("case_id", "id", "repeated", "section_id", "module_id", "block_id", "type", "provenance", F.array_join("evidence_refs", ",").alias("refs"))


def l02_eligible_leaves(spark, sf):
    return L.eligible(L.flatten(_documents(spark, sf))).select("case_id", "id")


def l03_fidelity_leaves(spark, sf):
    return L.fidelity_leaves(L.flatten(_documents(spark, sf)), ("source_fact",)).select("case_id", "id")


def p04_reference_free(spark, sf):
    return L.reference_free(L.flatten(_documents(spark, sf))).select("case_id", "id", F.md5(F.col("text").cast("binary")).alias("digest"))


def g16_quote_errors(spark, sf):
    claims = X.claims(spark, sf)
    quote = F.when(F.col("pos") % 3 == 0, F.lit("ab!")).when(F.col("pos") % 5 == 0, F.lit("zzzzzzzzz qqq")).otherwise(F.substring("statement", 1, 40))
    spans = claims.select("case_id", F.when(F.col("pos") % 7 == 0, "gone").otherwise(F.concat(F.lit("n1-"), "id")).alias("leaf_id"), quote.alias("quote"))
    return L.quote_errors(L.flatten(_documents(spark, sf)), spans)


def a02_support_rate(spark, sf):
    """Claims whose span is owned, contiguous and quoted exactly."""
    rows = X.span_checks(spark, sf).withColumn("ok", F.col("owned") & F.col("contiguous") & F.col("supported"))
    return rows.groupBy("case_id").agg((F.floor(F.avg(F.col("ok").cast("double")) * 10000 + 0.5) / 10000).alias("rate"), F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("id")))), ",").alias("unsupported"))


def s09_latest_round(spark, sf):
    rows = table(spark, sf, "events").select("user_id", F.concat(F.lit("round-"), F.lpad((F.col("event_id") % 40).cast("string"), 2, "0")).alias("round"), "event_type")
    done = rows.filter("event_type = 'purchase'").select("user_id", "round").distinct()
    return rows.join(done, ["user_id", "round"], "left_semi").groupBy("user_id").agg(F.max("round").alias("latest"))


def g21_quality_report(spark, sf):
    from . import evidence_queries as E
    from . import units as U

    parts = [U.a01_source_stats(spark, sf), E.a04_reference_coverage(spark, sf), E.a05_blind_recall(spark, sf), E.a09_readability(spark, sf), g01_claim_gate(spark, sf).select("case_id", "state")]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "case_id", "left")
    return out.select("case_id", "units", "exclusion_rate", "main_coverage", "recall", "long", "state", ((F.col("state") == "pass") & (F.col("main_coverage") >= 0.5)).alias("ready"))


QUERIES = {n: f for n, f in list(globals().items()) if n[0] in "lgafps" and n[1:3].isdigit()}

_GATE = f"""{_FIRST}, e2 AS ({_entry_sql(2)}), f2 AS ({_CODES.format(t='e2')}), g2 AS (SELECT *, CASE WHEN c0 = '' AND NOT clean THEN 'other_semantic' ELSE c0 END AS codes FROM f2 WHERE case_id % 5 <> 0),
ru AS (SELECT case_id, id AS ref, ['original', 'primary', 'secondary', 'unreviewable'][(case_id + pos) % 4 + 1] AS selection, CASE WHEN pos % 7 = 0 THEN 0.5 ELSE 0.9 END AS confidence FROM claims WHERE case_id % 3 <> 0),
jn AS (SELECT a.case_id, a.verdict AS v1, b.verdict AS v2, b.ref IS NULL AS unseen, b.ref IS NOT NULL AND NOT (a.verdict = b.verdict AND a.codes = CASE WHEN b.clean THEN '' ELSE b.codes END) AS cf, selection, confidence
       FROM g1 a LEFT JOIN g2 b ON a.case_id = b.case_id AND a.ref = b.ref LEFT JOIN ru ON ru.case_id = a.case_id AND ru.ref = a.ref WHERE NOT a.clean),
st AS (SELECT case_id, count(*) AS targets, count(*) FILTER (cf) AS conflicts, count(*) FILTER (unseen) AS un, count(*) FILTER (cf AND selection IS NULL) AS op, count(*) FILTER (cf AND (selection = 'unreviewable' OR confidence < 0.8)) AS hu,
       count(*) FILTER (CASE WHEN NOT cf THEN v1 WHEN selection = 'original' THEN 'pass' WHEN selection = 'primary' THEN v1 WHEN selection = 'secondary' THEN v2 END <> 'pass') AS fl FROM jn GROUP BY case_id),
ga AS (SELECT c.case_id, coalesce(targets, 0) AS targets, coalesce(conflicts, 0) AS conflicts, CASE WHEN targets IS NULL THEN 'pass' WHEN un > 0 THEN 'needs_secondary' WHEN op > 0 THEN 'needs_adjudication' WHEN hu > 0 THEN 'human_required' WHEN fl > 0 THEN 'repair_required' ELSE 'pass' END AS state
       FROM (SELECT DISTINCT case_id FROM claims) c LEFT JOIN st USING (case_id))"""
_LITE = f"""{X.CLAIMS}, li AS (SELECT case_id, ['fidelity', 'scout', 'advocate'][(case_id * 3 + pos) % 3 + 1] AS role, ['fabrication', 'core_omission', 'style', 'odd_code', 'core_omission'][((case_id * 3 + pos) // 2) % 5 + 1] AS code,
CASE WHEN (case_id * 3 + pos) % 4 = 0 THEN '' ELSE 'k' || ((case_id * 3 + pos) % 2) END AS key, ['hard', 'hard', 'warning', 'diagnostic'][((case_id * 3 + pos) // 3) % 4 + 1] AS severity FROM claims),
ro AS (SELECT case_id, key, count(DISTINCT role) AS roles FROM li WHERE severity = 'hard' AND code = 'core_omission' AND key <> '' GROUP BY ALL),
lv AS (SELECT li.*, CASE WHEN severity <> 'hard' THEN severity WHEN code = 'core_omission' THEN CASE WHEN key <> '' AND roles >= 2 THEN 'hard' ELSE 'warning' END WHEN code = 'style' THEN 'diagnostic' WHEN role <> 'fidelity' THEN 'warning' ELSE 'hard' END AS level FROM li LEFT JOIN ro USING (case_id, key)),
lf AS (SELECT case_id, role, CASE WHEN level = 'hard' AND code = 'odd_code' THEN 'unknown_hard_error' ELSE code END AS code, level AS severity FROM lv)"""
_LEAF = f"""{X.CLAIMS}, lf AS (SELECT case_id, pos, theme_id, id, i, 'n' || i || '-' || id AS leaf, CASE WHEN case_id % 4 = 0 THEN 'closing' ELSE 'themes' END AS section_id, ['prose_group', 'quote', 'timeline'][pos % 3 + 1] AS type,
CASE WHEN i = 2 AND pos % 3 = 0 THEN 'system' ELSE provenance END AS provenance, CASE WHEN i = 2 AND pos % 2 = 0 THEN 'E9999' ELSE id END AS refs, CASE WHEN i = 1 THEN statement ELSE trim(regexp_replace(substr(statement, 1, 10), ' {{2,}}', ' ', 'g')) END AS text FROM claims, (VALUES (1), (2)) v(i))"""
ORACLE = {
    "l05_clean_pass": f"WITH {_FIRST} SELECT case_id, ref, clean FROM g1",
    "g02_finding_codes": f"WITH {_FIRST} SELECT case_id, ref, codes FROM g1",
    "g01_claim_gate": f"WITH {_GATE} SELECT * FROM ga",
    "g09_fidelity_reasons": f"""WITH {X.CLAIMS}, k AS (SELECT case_id, id, case_id + pos AS k FROM claims) SELECT case_id, id, array_to_string(list_filter([CASE WHEN k % 3 = 2 THEN 'support' END, CASE WHEN k % 4 = 3 THEN 'provenance' END, CASE WHEN k % 5 = 0 THEN 'unsupported_text' END,
CASE WHEN k % 3 = 0 AND k % 6 NOT IN (0, 2) THEN 'missing_research_check' END], lambda x: x IS NOT NULL), ',') AS reasons FROM k""",
    "g11_lite_findings": f"WITH {_LITE} SELECT case_id, role, code, severity, count(*) AS n FROM lf GROUP BY ALL",
    "g11_lite_status": f"WITH {_LITE}, n AS (SELECT case_id, count(*) FILTER (severity = 'hard') AS hard, count(*) FILTER (severity = 'warning') AS warnings FROM lf GROUP BY case_id) SELECT *, CASE WHEN hard > 0 THEN 'blocked' WHEN warnings > 0 THEN 'pass_with_warnings' ELSE 'pass' END AS status FROM n",
    "g12_required_roles": f"WITH {X.CLAIMS}, n AS (SELECT case_id, bool_or(pos % 5 = 0) AS t FROM claims GROUP BY case_id) SELECT case_id, CASE WHEN t THEN 'fidelity,reader_advocate' WHEN case_id % 2 = 0 THEN 'fidelity' ELSE '' END AS roles FROM n",
    "g17_independence": f"WITH {X.CLAIMS}, c AS (SELECT DISTINCT case_id FROM claims) SELECT case_id, 1 AS round, 'reviewer_reused' AS error, 'r1' AS subject FROM c WHERE case_id % 4 = 0 UNION ALL SELECT case_id, 1, 'role_repeated', 'A' FROM c WHERE case_id % 6 = 1",
    "g23_stage_ledger": f"""WITH o AS (SELECT o_orderkey // 4 AS case_id, o_orderkey % 4 AS seq, o_orderkey AS k FROM orders), s AS (SELECT *, (CASE WHEN k % 11 = 0 THEN seq + 2 WHEN k % 13 = 0 THEN 0 WHEN k % 29 = 0 THEN 5 ELSE seq END) % 6 AS i, CASE WHEN k % 17 = 0 THEN 'new' ELSE 'old' END AS h FROM o),
t AS (SELECT *, CASE WHEN i = 5 THEN 0 ELSE i + 1 END AS at_, {list(G.STAGES) + ['other']}[i + 1] AS stage FROM s), u AS (SELECT *, coalesce(lag(at_) OVER w, 0) AS before, first_value(h) OVER w AS fh FROM t WINDOW w AS (PARTITION BY case_id ORDER BY seq))
SELECT case_id, seq, stage, CASE WHEN at_ = 0 THEN 'unknown_stage' WHEN h <> fh THEN 'source_changed' WHEN at_ <= before THEN 'went_back' WHEN at_ <> before + 1 THEN 'skipped' END AS error FROM u WHERE at_ = 0 OR h <> fh OR at_ <> before + 1""",
    "g26_profile_errors": """WITH p AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN ['alpha', 'beta', 'omega'][doc_id % 3 + 1] END AS p, doc_id % 5 AS n, doc_id % 4 = 0 AS pending, (doc_id % 6) / 4 AS c, doc_id % 10 = 0 AS old FROM documents)
SELECT doc_id, array_to_string(list_filter([CASE WHEN p = 'omega' THEN 'primary' END, CASE WHEN n > 3 THEN 'too_many_lenses' END, CASE WHEN n > 3 THEN 'unknown_lens' END, CASE WHEN n > 2 THEN 'repeated_lens' END, CASE WHEN c > 1 THEN 'confidence' END, CASE WHEN old THEN 'version' END,
CASE WHEN pending AND p IS NOT NULL THEN 'pending_with_primary' END, CASE WHEN NOT pending AND p IS NULL THEN 'selected_without_primary' END], lambda x: x IS NOT NULL), ',') AS errors FROM p""",
    "a11_density": "SELECT doc_id, (" + " + ".join(f"greatest(0, least(4, floor((doc_id * {i + 3}) % 13 / 2 - 1 + 0.5)))" for i in range(5)) + ")::BIGINT AS total FROM documents",
    "f18_claim_role": f"WITH {X.CLAIMS} SELECT case_id, id, CASE " + " ".join(f"WHEN regexp_matches(statement, '{p}') THEN '{r}'" for r, p in ROLE_RULES) + " ELSE 'fact' END AS role FROM claims",
    "p05_leaves": f"WITH {_LEAF} SELECT case_id, leaf AS id, false AS repeated, section_id, theme_id AS module_id, 'b' || id AS block_id, type, provenance, refs FROM lf",
    "l02_eligible_leaves": f"WITH {_LEAF} SELECT case_id, leaf AS id FROM lf WHERE section_id = 'themes' AND type <> 'timeline' AND provenance <> 'system'",
    "l03_fidelity_leaves": f"WITH {_LEAF} SELECT case_id, leaf AS id FROM lf WHERE provenance IN ('source_fact', 'system')",
    "p04_reference_free": f"WITH {_LEAF} SELECT case_id, leaf AS id, md5(text) AS digest FROM lf",
    "g16_quote_errors": f"""WITH {_LEAF}, q AS (SELECT case_id, pos, leaf, {X.plain('text')} AS t FROM lf WHERE i = 1), r AS (SELECT case_id, CASE WHEN pos % 7 = 0 THEN 'gone' ELSE leaf END AS leaf_id, CASE WHEN pos % 7 = 0 THEN 'unknown_leaf' WHEN pos % 3 = 0 THEN 'too_short'
WHEN pos % 5 = 0 THEN CASE WHEN NOT contains(t, 'zzzzzzzzzqqq') THEN 'not_in_leaf' END WHEN length({X.plain('substr((SELECT statement FROM claims c WHERE c.case_id = q.case_id AND c.pos = q.pos), 1, 40)')}) < 6 THEN 'too_short' END AS error FROM q) SELECT * FROM r WHERE error IS NOT NULL""",
    "a02_support_rate": f"WITH {X.SPAN_CHECKS}, c AS (SELECT case_id, id, owned AND contiguous AND supported AS ok FROM checks) SELECT case_id, floor(avg(ok::INT) * 10000 + 0.5) / 10000 AS rate, coalesce(string_agg(id, ',' ORDER BY id) FILTER (NOT ok), '') AS unsupported FROM c GROUP BY case_id",
    "s09_latest_round": "SELECT user_id, max('round-' || lpad((event_id % 40)::VARCHAR, 2, '0')) AS latest FROM events WHERE event_type = 'purchase' GROUP BY user_id",
}
