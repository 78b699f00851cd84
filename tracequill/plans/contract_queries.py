"""Queries of contracts, findings, projections and renderers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequill.operators import contracts as C
from tracequill.operators import leaves as L
from tracequill.operators import releases as R
from tracequill.session import scratch_path, table

from . import fixtures as X
from . import gate_queries as GQ


def _spans(spark, sf):
    """Each claim's span: its unit and the next one."""
    ids = lambda p: F.concat(F.lit("P"), F.lpad(p.cast("string"), 6, "0"))
    rows = X.claims(spark, sf).select("case_id", "id", F.concat(F.lit("S"), (F.col("pos") % 3).cast("string")).alias("segment_id"), F.substring("statement", 1, 12).alias("quote"), F.explode(F.array(*(F.struct(F.lit(o).alias("ord"), ids(F.col("pos") + o).alias("source_id")) for o in (1, 0)))).alias("x"))
    return rows.select("case_id", "id", "segment_id", "quote", "x.ord", "x.source_id")


def u02_first_findings(spark, sf):
    return C.first_findings(X.units(spark, sf).select("case_id", "pos", F.col("text").alias("message")))


def l10_severities(spark, sf):
    rows = C.split_severity(X.units(spark, sf).select("case_id", "pos", F.col("text").alias("message")), ["tion", "^Th", "[0-9]{4}"])
    return rows.groupBy("case_id", "severity").agg(F.count(F.lit(1)).alias("n"))


def j11_same_theme(spark, sf):
    claims = X.claims(spark, sf)
    return C.same_theme_candidates(claims, claims.filter("pos % 9 = 0").select("case_id", "id")).select("case_id", "id")


def j15_guide_errors(spark, sf):
    k = F.col("case_id") + F.col("pos")
    rows = X.claims(spark, sf).select("case_id", "id", F.concat(F.lit("N"), (F.col("pos") % 21).cast("string")).alias("name"), F.when(k % 2 == 0, "person").otherwise("term").alias("kind"), F.when(k % 3 == 0, "external").otherwise("source").alias("provenance"), F.when(k % 5 != 0, F.array(F.lit("E1"))).otherwise(F.array().cast("array<string>")).alias("evidence_refs"), F.concat(F.lit("R"), (k % 4).cast("string")).alias("citation"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"))
    people = docs.select("case_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.concat(F.lit("N"), i.cast("string")))).alias("name"))
    return C.guide_errors(rows, people, docs.select("case_id", F.explode(F.array(F.lit("R0"), F.lit("R3"))).alias("citation"))).select("case_id", "id", F.array_join("errors", ",").alias("errors"))


def g15_bundle_errors(spark, sf):
    claims = X.claims(spark, sf)
    refs = F.array("id", F.when(F.col("pos") % 8 == 1, F.lit("E0001")).otherwise(F.lit("E9999")))
    bundles = claims.filter("pos % 3 <> 1").select("case_id", F.concat(F.lit("CB"), F.col("pos").cast("string")).alias("bundle_id"), F.when(F.col("pos") % 7 == 0, "T009").otherwise(F.col("theme_id")).alias("theme_id"), refs.alias("refs"))
    return C.bundle_errors(bundles, claims)


def j16_document_errors(spark, sf):
    return C.document_errors(L.flatten(GQ._documents(spark, sf)), ["overview", "themes"]).select("case_id", "id", F.array_join("errors", ",").alias("errors"))


def f17_attribution(spark, sf):
    claims = X.claims(spark, sf).withColumn("statement", F.when(F.col("pos") % 3 == 0, F.concat(F.lit("ann lee says "), "statement")).when(F.col("pos") % 3 == 1, F.concat(F.lit("Annual "), "statement")).otherwise(F.concat(F.lit("Ann thinks "), "statement")))
    aliases = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(a).alias("alias")) for n, a in (("Ann Lee", "Ann Lee"), ("Ann Lee", "Ann"), ("Bob", "Annual"))))).alias("x")).select("case_id", "x.*")
    return C.attribution(claims, aliases, ["says", "thinks"])


LEVEL_TAGS, LEVEL_WORDS = ["ION", "heit", "x"], "the |que |und "


def f19_importance(spark, sf):
    return X.claims(spark, sf).select("case_id", "id", C.importance(F.col("statement"), F.col("pos"), LEVEL_TAGS, LEVEL_WORDS).alias("level"))


def l07_contained_quotes(spark, sf):
    rows = X.claims(spark, sf).select("case_id", "id", F.col("statement").alias("source"), F.when(F.col("pos") % 3 == 0, F.lit("a b c")).when(F.col("pos") % 5 == 0, F.concat(F.lit("qqq"), "statement")).otherwise(F.concat(F.substring("statement", 2, 30), F.lit("!!"))).alias("text"))
    return C.contained_quotes(rows).select("case_id", "id", "verbatim")


FILLERS = ["um", "well"]


def _edits(spark, sf):
    """Claims as published texts, and sources with fillers, stutters, additions, lost words or another order, by the text's length."""
    text, n = F.col("statement"), F.length("statement")
    head, tail = F.substr(text, F.lit(1), (n / 2).cast("int")), F.substr(text, (n / 2).cast("int") + 1)
    kind = n % 5
    source = F.when(kind == 0, F.concat(F.lit("um "), head, F.lit(", well "), tail, F.lit(" um"))).when(kind == 1, F.concat(F.substring(text, 1, 4), text)).when(kind == 3, F.concat(F.lit("um "), text, F.lit(" entirely"))).otherwise(text)
    published = F.when(kind == 2, F.concat(text, F.lit(" entirely"))).when(kind == 4, F.concat(tail, head)).otherwise(text)
    return X.claims(spark, sf).select("case_id", "id", "pos", source.alias("source"), published.alias("text"))


def l08_deletion_only(spark, sf):
    return C.deletion_only(_edits(spark, sf), FILLERS).select("case_id", "id", "deleted_only")


def l07_controlled_quotes(spark, sf):
    """Blocks quote their claim's source or the next one's; spans hold the sources, with times."""
    rows = _edits(spark, sf).withColumn("n", F.length("source"))
    at = lambda p: F.concat(F.lpad((p % 60).cast("string"), 2, "0"), F.lit(":07.5–"), F.lpad((p % 60).cast("string"), 2, "0"), F.lit(":59"))
    spans = rows.select("case_id", F.col("id").alias("ref"), at(F.col("pos")).alias("locator"), F.col("source").alias("quote"))
    refs = F.when(F.col("n") % 7 == 0, F.array(F.concat(F.lit("E"), F.lpad((F.col("pos") + 1).cast("string"), 4, "0")))).otherwise(F.array("id", F.lit("E0001")))
    mode = F.when(F.col("n") % 11 == 0, "free").when(F.col("n") % 2 == 0, "verbatim").otherwise("spoken_cleanup")
    locator = F.when(F.col("n") % 13 == 0, "").otherwise(F.replace(at(F.col("pos") + F.when(F.col("n") % 17 == 0, 1).otherwise(0)), F.lit(".5"), F.lit("")))
    blocks = rows.select("case_id", "id", mode.alias("mode"), F.when(F.col("n") % 19 > 0, "Ann").alias("attribution"), "text", locator.alias("source_locator"), F.when(F.col("n") % 23 > 0, F.col("source")).alias("source_text"), refs.alias("evidence_refs"))
    return C.controlled_quotes(blocks, spans, FILLERS).select("case_id", "id", F.array_join("errors", ",").alias("errors"))


def k07_html(spark, sf):
    return C.html_cards(X.claims(spark, sf).select("case_id", "pos", F.col("id").alias("title"), F.col("statement").alias("body"), F.array("theme_id", "id").alias("refs"))).select("case_id", F.md5(F.col("html").cast("binary")).alias("digest"))


def p08_claims_with_units(spark, sf):
    rows = C.with_units(X.claims(spark, sf), _spans(spark, sf), X.units(spark, sf))
    return rows.select("case_id", "id", F.array_join(F.transform("units", lambda u: u["source_id"]), ",").alias("units"), F.md5(F.array_join(F.transform("units", lambda u: u["text"]), " ").cast("binary")).alias("digest"))


def a17_reader_map_build(spark, sf):
    leaves = L.flatten(GQ._documents(spark, sf)).select("case_id", F.explode("evidence_refs").alias("id"), F.col("id").alias("leaf_id"))
    found = leaves.groupBy("case_id", "id").agg(F.array_join(F.array_sort(F.collect_set("leaf_id")), ",").alias("leaves"))
    return X.claims(spark, sf).select("case_id", "id").join(found, ["case_id", "id"], "left").select("case_id", "id", F.coalesce("leaves", F.lit("")).alias("leaves"))


def a19_anchor_coverage(spark, sf):
    book = X.claims(spark, sf).groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("pos") % 3 != 0, F.concat(F.lit('<a id="'), "id", F.lit('">'))))), "\n").alias("book"))
    found = book.select("case_id", F.explode_outer(F.regexp_extract_all("book", F.lit(r'id="(E\d+)"'), 1)).alias("id")).filter("id IS NOT NULL")
    claims = X.claims(spark, sf).select("case_id", "id").join(found.distinct().withColumn("hit", F.lit(1)), ["case_id", "id"], "left")
    return claims.groupBy("case_id").agg((F.floor(F.count("hit") / F.count(F.lit(1)) * 10000 + 0.5) / 10000).alias("coverage"))


def k04_release(spark, sf):
    """Publishes claims and themes, and reads the verified generation back."""
    root, claims = scratch_path(spark, "release"), X.claims(spark, sf)
    R.publish(spark, {"claims": claims, "themes": claims.select("case_id", "theme_id").distinct()}, root, {"schema": "1"})
    found = R.published(spark, root)
    return found["claims"].groupBy("theme_id").agg(F.count(F.lit(1)).alias("claims")).join(found["themes"].groupBy("theme_id").agg(F.count(F.lit(1)).alias("cases")), "theme_id")


QUERIES = {n: f for n, f in list(globals().items()) if n[0] in "ulgjafkp" and n[1:3].isdigit()}

_SPAN = f"""{X.CLAIMS}, sp AS (SELECT case_id, id, pos, statement, provenance, importance, theme_id, 'S' || (pos % 3) AS seg, substr(statement, 1, 12) AS q, 'P' || lpad(pos::VARCHAR, 6, '0') AS u0, 'P' || lpad((pos + 1)::VARCHAR, 6, '0') AS u1 FROM claims)"""
_CARD = "'<article><h3>' || id || '</h3><p>' || replace(replace(replace(replace(replace(statement, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') || '</p><sup>' || theme_id || ' ' || id || '</sup></article>'"
def _mechanical(gone, before, after):
    return f"({gone} = '' OR regexp_full_match({gone}, '(?:um|well)+') OR ({before} <> '' AND (suffix({before}, {gone}) OR suffix({gone}, right({before}, 6)))) OR ({after} <> '' AND (prefix({after}, {gone}) OR prefix({gone}, left({after}, 6)))))"


_EDIT = f"""{X.CLAIMS}, ed AS (SELECT case_id, id, pos, CASE length(statement) % 5 WHEN 0 THEN 'um ' || left(statement, length(statement) // 2) || ', well ' || substr(statement, length(statement) // 2 + 1) || ' um' WHEN 1 THEN left(statement, 4) || statement
  WHEN 3 THEN 'um ' || statement || ' entirely' ELSE statement END AS source, CASE length(statement) % 5 WHEN 2 THEN statement || ' entirely' WHEN 4 THEN substr(statement, length(statement) // 2 + 1) || left(statement, length(statement) // 2) ELSE statement END AS text FROM claims),
pe AS (SELECT case_id, id, {X.plain(X.norm('source'))} AS s, {X.plain(X.norm('text'))} AS t FROM ed),
fo AS (SELECT *, list_reduce(list_concat([{{'p': 0, 'at': 0, 'k': 0, 'ok': true, 'c': ''}}], list_transform(regexp_extract_all(s, '(?s).'), lambda c: {{'p': 0, 'at': 0, 'k': 0, 'ok': true, 'c': c}})), lambda a, x:
  CASE WHEN NOT a.ok THEN a WHEN a.p < length(t) AND x.c = substr(t, a.p + 1, 1) THEN {{'p': a.p + 1, 'at': a.k + 1, 'k': a.k + 1, 'ok': {_mechanical('substr(s, a.at + 1, a.k - a.at)', 'left(t, a.p)', 'substr(s, a.k + 1)')}, 'c': ''}}
  ELSE {{'p': a.p, 'at': a.at, 'k': a.k + 1, 'ok': a.ok, 'c': ''}} END) AS f FROM pe),
de AS (SELECT case_id, id, s <> '' AND t <> '' AND f.ok AND f.p = length(t) AND {_mechanical('substr(s, f.at + 1)', 't', "''")} AS deleted_only FROM fo)"""
ORACLE = {
    "l08_deletion_only": f"WITH {_EDIT} SELECT * FROM de",
    "l07_controlled_quotes": f"""WITH {_EDIT}, q AS (SELECT ed.*, s, t, length(source) AS n, deleted_only FROM ed JOIN pe USING (case_id, id) JOIN de USING (case_id, id)),
bl AS (SELECT *, CASE WHEN n % 11 = 0 THEN 'free' WHEN n % 2 = 0 THEN 'verbatim' ELSE 'spoken_cleanup' END AS mode, CASE WHEN n % 7 = 0 THEN ['E' || lpad((pos + 1)::VARCHAR, 4, '0')] ELSE list_distinct([id, 'E0001']) END AS refs,
  CASE WHEN n % 23 > 0 THEN s ELSE '' END AS st, CASE WHEN n % 17 = 0 THEN pos + 1 ELSE pos END AS lp FROM q),
rf AS (SELECT case_id, id, unnest(refs) AS ref, t, st, n, lp FROM bl),
ok AS (SELECT rf.case_id, rf.id, bool_or(contains(q.s, rf.t)) AS verbatim, bool_or(rf.n % 13 > 0 AND rf.lp % 60 = q.pos % 60 AND contains(q.s, rf.st)) AS placed FROM rf JOIN q ON q.case_id = rf.case_id AND q.id = rf.ref GROUP BY ALL),
e AS (SELECT bl.case_id, bl.id, array_to_string(list_filter([CASE WHEN mode = 'free' THEN 'mode' END, CASE WHEN mode <> 'free' AND n % 19 = 0 THEN 'attribution' END, CASE WHEN mode <> 'free' AND length(t) < 6 THEN 'short' END,
  CASE WHEN mode = 'verbatim' AND NOT coalesce(verbatim, false) THEN 'not_verbatim' END, CASE WHEN mode = 'spoken_cleanup' AND n % 13 = 0 THEN 'no_locator' END, CASE WHEN mode = 'spoken_cleanup' AND n % 23 = 0 THEN 'no_source' END,
  CASE WHEN mode = 'spoken_cleanup' AND NOT coalesce(placed, false) THEN 'misplaced' END, CASE WHEN mode = 'spoken_cleanup' AND NOT (deleted_only AND n % 23 > 0) THEN 'not_deletion_only' END], lambda x: x IS NOT NULL), ',') AS errors FROM bl LEFT JOIN ok USING (case_id, id))
SELECT * FROM e WHERE errors <> ''""",
    "u02_first_findings": f"WITH {X.UNITS} SELECT case_id, text AS message, min(pos) AS pos FROM units GROUP BY ALL",
    "l10_severities": f"WITH {X.UNITS} SELECT case_id, CASE WHEN regexp_matches(text, 'tion|^Th|[0-9]{{4}}') THEN 'diagnostic' ELSE 'hard' END AS severity, count(*) AS n FROM units GROUP BY ALL",
    "j11_same_theme": f"WITH {X.CLAIMS}, t AS (SELECT DISTINCT case_id, theme_id FROM claims WHERE pos % 9 = 0) SELECT case_id, id FROM claims JOIN t USING (case_id, theme_id) WHERE pos % 9 <> 0",
    "j15_guide_errors": f"""WITH {X.CLAIMS}, k AS (SELECT case_id, id, case_id + pos AS k, pos % 21 AS m, count(*) OVER (PARTITION BY case_id, pos % 21) AS n FROM claims), e AS (SELECT case_id, id, array_to_string(list_filter([CASE WHEN n > 1 THEN 'repeated_name' END, CASE WHEN k % 2 = 0 AND m > 9 THEN 'unknown_person' END,
CASE WHEN k % 3 <> 0 AND k % 5 = 0 THEN 'no_evidence' END, CASE WHEN k % 3 = 0 AND k % 4 NOT IN (0, 3) THEN 'no_citation' END], lambda x: x IS NOT NULL), ',') AS errors FROM k) SELECT * FROM e WHERE errors <> ''""",
    "g15_bundle_errors": f"""WITH {X.CLAIMS}, b AS (SELECT case_id, 'CB' || pos AS bundle_id, CASE WHEN pos % 7 = 0 THEN 'T009' ELSE theme_id END AS theme, unnest([id, CASE WHEN pos % 8 = 1 THEN 'E0001' ELSE 'E9999' END]) AS id FROM claims WHERE pos % 3 <> 1),
j AS (SELECT b.*, c.theme_id AS own, count(*) OVER (PARTITION BY b.case_id, b.id) AS n FROM b LEFT JOIN claims c ON c.case_id = b.case_id AND c.id = b.id), e AS (SELECT case_id, bundle_id, id, CASE WHEN own IS NULL THEN 'unknown_ref' WHEN own <> theme THEN 'other_theme' WHEN n > 1 THEN 'in_two_bundles' END AS error FROM j) SELECT * FROM e WHERE error IS NOT NULL""",
    "j16_document_errors": f"WITH {GQ._LEAF} SELECT case_id, leaf AS id, 'unknown_section' AS errors FROM lf WHERE section_id = 'closing'",
    "f17_attribution": f"WITH {X.CLAIMS} SELECT case_id, id, 'Ann Lee' AS name FROM claims WHERE pos % 3 <> 1",
    "f19_importance": f"""WITH {X.CLAIMS}, s AS (SELECT case_id, id, pos, 2 * regexp_matches(statement, '[0-9]')::INT + 2 * (contains(lower(statement), 'ion') OR contains(lower(statement), 'heit'))::INT
  + regexp_matches(statement, '{LEVEL_WORDS}')::INT + ({X.compact('statement')} >= 70)::INT AS s FROM claims)
SELECT case_id, id, CASE WHEN s >= 4 AND pos % 2 = 0 THEN 'high' WHEN s >= 2 AND pos % 3 = 0 THEN 'medium' ELSE 'low' END AS level FROM s""",
    "l07_contained_quotes": f"""WITH {X.CLAIMS}, q AS (SELECT case_id, id, {X.plain('statement')} AS s, CASE WHEN pos % 3 = 0 THEN 'abc' WHEN pos % 5 = 0 THEN 'qqq' || {X.plain('statement')} ELSE {X.plain('substr(statement, 2, 30)')} END AS t FROM claims) SELECT case_id, id, length(t) >= 6 AND contains(s, t) AS verbatim FROM q""",
    "k07_html": f"WITH {X.CLAIMS} SELECT case_id, md5('<section>' || string_agg({_CARD}, '' ORDER BY pos) || '</section>') AS digest FROM claims GROUP BY case_id",
    "p08_claims_with_units": f"WITH {_SPAN} SELECT sp.case_id, sp.id, sp.u0 || CASE WHEN n.id IS NULL THEN '' ELSE ',' || n.id END AS units, md5(sp.statement || CASE WHEN n.id IS NULL THEN '' ELSE ' ' || n.text END) AS digest FROM sp LEFT JOIN units n ON n.case_id = sp.case_id AND n.id = sp.u1",
    "a17_reader_map_build": f"WITH {X.CLAIMS} SELECT case_id, id, CASE WHEN pos % 2 = 0 THEN 'n1-' || id ELSE 'n1-' || id || ',n2-' || id END AS leaves FROM claims",
    "a19_anchor_coverage": f"WITH {X.CLAIMS} SELECT case_id, floor(count(*) FILTER (pos % 3 <> 0) / count(*) * 10000 + 0.5) / 10000 AS coverage FROM claims GROUP BY case_id",
    "k04_release": f"WITH {X.CLAIMS} SELECT theme_id, count(*) AS claims, count(DISTINCT case_id) AS cases FROM claims GROUP BY theme_id",
}
