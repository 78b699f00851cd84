"""Queries of incremental review: change scopes, changed leaves, reports that still hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracequill.operators import rereview as R

from . import fixtures as X

def _n():
    return F.length("text")



def _snapshots(spark, sf):
    """Two editions of all claims. Lengths of their texts say which are new, gone, reworded, moved or only annotated."""
    rows = X.units(spark, sf)
    pos = F.col("pos")
    name = lambda letter, p, k: F.concat(F.lit(letter), F.floor(p / k).cast("string"))

    def edition(new):
        text = F.when((_n() % 13 == 0) & F.lit(new), F.concat("text", F.lit("."))).otherwise(F.col("text"))
        segment = F.when((_n() % 17 == 0) & F.lit(new), name("S", pos + 7, 7)).otherwise(name("S", pos, 7))
        note = F.when((_n() % 5 == 0) & F.lit(new), "noted").otherwise("")
        level = F.element_at(F.array(*map(F.lit, ("high", "medium", "low", "low"))), (F.length(text) % 4 + 1).cast("int"))
        kept = rows.filter(_n() % 23 != 0) if new else rows.filter(_n() % 29 != 0)
        blocks = F.when(_n() % 3 == 0, F.array(name("B", pos, 4), name("B", pos + 4, 4))).otherwise(F.array().cast("array<string>"))
        return kept.select(
            "case_id", F.concat(F.lit("E"), pos.cast("string")).alias("id"), F.sha2(text, 256).alias("semantic_hash"), F.sha2(segment, 256).alias("support_hash"), F.sha2(F.concat_ws("|", text, segment, note), 256).alias("full_hash"),
            level.alias("importance"), name("T", pos, 5).alias("theme_id"), F.array(segment).alias("segment_refs"), blocks.alias("block_refs"),
        )

    return edition(False), edition(True)


def g13_change_scope(spark, sf):
    old, new = _snapshots(spark, sf)
    cases = X.units(spark, sf).groupBy("case_id").agg(F.sum(F.length("text")).alias("n"))
    artefacts = F.array(*(F.struct(F.lit(a).alias("artefact"), F.lit("h").alias("was"), F.when(F.col("n") % k != 0, "h").when(F.col("n") % 2 == 0, "i").alias("now")) for a, k in (("source", 11), ("segments", 7), ("speakerMap", 19), ("deepRead", 3))))
    hashes = cases.select("case_id", F.explode(artefacts).alias("x")).select("case_id", "x.*")
    recorded = X.units(spark, sf).filter(_n() % 46 == 0).select("case_id", F.concat(F.lit("E"), F.col("pos").cast("string")).alias("ref"))
    lists = ("reasons", "segment_refs", "theme_refs", "block_refs")
    found = R.change_scope(old, new, hashes, recorded)
    return found.select(*(F.array_join(c, ",").alias(c) if c in lists else F.col(c) for c in found.columns))


def _leaves(spark, sf):
    """Two editions of reader leaves; of one source the older packet holds no references and no provenance."""
    rows, pos = X.units(spark, sf), F.col("pos")
    known = F.col("heading") != "src3"
    refs = F.array(F.concat(F.lit("E"), pos.cast("string")), F.concat(F.lit("E"), (_n() % 9).cast("string")))
    cited = F.when(_n() % 4 == 0, F.array(F.concat(F.lit("R"), (_n() % 3).cast("string")))).otherwise(F.array().cast("array<string>"))
    source = F.element_at(F.array(*map(F.lit, (*R.AUDITED, "system"))), (_n() % 5 + 1).cast("int"))
    place = [F.concat(F.lit("S"), F.floor(pos / 10).cast("string")).alias("section_id"), F.lit("M").alias("module_id"), F.lit("paragraph").alias("type")]
    block = F.concat(F.lit("B"), F.floor(pos / 3).cast("string"))
    name = F.concat(F.lit("L"), pos.cast("string")).alias("id")
    old = rows.select("case_id", name, "text", F.when(known, refs).alias("evidence_refs"), F.when(known, cited).alias("citation_refs"), F.when(known, source).otherwise(R.UNAVAILABLE).alias("provenance"), *place, block.alias("block_id"))
    moved = F.when(_n() % 7 == 0, F.reverse(refs)).when(_n() % 18 == 0, F.array_append(refs, F.lit("E9999"))).otherwise(refs)
    new = rows.filter(_n() % 37 != 0).select(
        "case_id", name, F.when(_n() % 25 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"), moved.alias("evidence_refs"), F.when(_n() % 8 == 0, F.array().cast("array<string>")).otherwise(cited).alias("citation_refs"),
        F.when(_n() % 27 == 0, "system").otherwise(source).alias("provenance"), *place, F.when(_n() % 33 == 0, "BX").otherwise(block).alias("block_id"),
    )
    return old, new


def j13_reader_leaf_changes(spark, sf):
    return R.leaf_changes(*_leaves(spark, sf)).select("case_id", "id", F.array_join("kinds", ",").alias("kinds"))


def g20_report_reuse(spark, sf):
    """Round 1 saw the older edition, round 2 the newer one without its reworded leaves' last stop."""
    old, new = _leaves(spark, sf)
    between = new.withColumn("text", F.regexp_replace("text", r"\.$", ""))
    reports = R.role_hashes(old).withColumn("round", F.lit(1)).unionByName(R.role_hashes(between).withColumn("round", F.lit(2)))
    return R.reused_reports(reports, R.role_hashes(new))


def g12_targeted_plan(spark, sf):
    old, new = _leaves(spark, sf)
    reuse = R.reused_reports(R.role_hashes(old).withColumn("round", F.lit(1)), R.role_hashes(new))
    return R.targeted_plan(R.leaf_changes(old, new), reuse).withColumn("leaves", F.array_join("leaves", ","))


QUERIES = {f.__name__: f for f in (g13_change_scope, j13_reader_leaf_changes, g20_report_reuse, g12_targeted_plan)}

_LEVEL = "['high', 'medium', 'low', 'low'][length({t}) % 4 + 1]"
_SCOPE = f"""{X.UNITS}, u AS (SELECT *, length(text) AS n, 'E' || pos AS id, CASE WHEN length(text) % 3 = 0 THEN ['B' || (pos // 4), 'B' || ((pos + 4) // 4)] ELSE [] END AS blocks, 'T' || (pos // 5) AS theme FROM units),
o AS (SELECT case_id, id, text AS t, 'S' || (pos // 7) AS s, '' AS note, theme, blocks FROM u WHERE n % 29 <> 0),
w AS (SELECT case_id, id, CASE WHEN n % 13 = 0 THEN text || '.' ELSE text END AS t, CASE WHEN n % 17 = 0 THEN 'S' || ((pos + 7) // 7) ELSE 'S' || (pos // 7) END AS s, CASE WHEN n % 5 = 0 THEN 'noted' ELSE '' END AS note, theme, blocks FROM u WHERE n % 23 <> 0),
d AS (SELECT case_id, id, o.t AS ot, w.t AS wt, CASE WHEN o.t IS NULL THEN 'added' WHEN w.t IS NULL THEN 'removed' WHEN o.t = w.t AND o.s = w.s AND o.note = w.note THEN 'unchanged' WHEN o.t = w.t AND o.s = w.s THEN 'mechanical' ELSE 'modified' END AS change,
  list_filter([o.s, w.s], lambda x: x IS NOT NULL) AS segs, coalesce(o.theme, w.theme) AS theme, coalesce(o.blocks, w.blocks) AS blocks, {_LEVEL.format(t='coalesce(w.t, o.t)')} AS level FROM o FULL JOIN w USING (case_id, id)),
c AS (SELECT case_id, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'mechanical') AS mechanical, count(*) FILTER (change = 'unchanged') AS unchanged,
  array_to_string(list_sort(list_distinct(flatten(list(segs) FILTER (change IN ('added', 'removed', 'modified'))))), ',') AS segment_refs, array_to_string(list_sort(list_distinct(list(theme) FILTER (change IN ('added', 'removed', 'modified')))), ',') AS theme_refs,
  array_to_string(list_sort(list_distinct(flatten(list(blocks) FILTER (change IN ('added', 'removed', 'modified'))))), ',') AS block_refs, bool_or(level IN ('high', 'medium')) FILTER (change IN ('added', 'removed', 'modified')) AS weighty,
  bool_or(change = 'removed' AND length(ot) % 46 <> 0) AS lost FROM d GROUP BY case_id),
h AS (SELECT case_id, sum(n) AS n FROM u GROUP BY case_id),
r AS (SELECT h.case_id, h.n, coalesce(added, 0) AS added, coalesce(removed, 0) AS removed, coalesce(modified, 0) AS modified, coalesce(mechanical, 0) AS mechanical, coalesce(unchanged, 0) AS unchanged, coalesce(segment_refs, '') AS segment_refs, coalesce(theme_refs, '') AS theme_refs,
  coalesce(block_refs, '') AS block_refs, coalesce(weighty, false) AS weighty, array_to_string(list_filter([CASE WHEN coalesce(lost, false) THEN 'removed_claim_lineage_missing' END, CASE WHEN h.n % 7 = 0 THEN 'segments_changed' END, CASE WHEN h.n % 11 = 0 THEN 'source_changed' END, CASE WHEN h.n % 19 = 0 THEN 'speaker_map_changed' END],
  lambda x: x IS NOT NULL), ',') AS hard FROM h LEFT JOIN c USING (case_id)),
m AS (SELECT *, CASE WHEN hard <> '' THEN 'structural_full' WHEN added + removed + modified > 0 THEN 'semantic_delta' ELSE 'mechanical' END AS mode FROM r)"""
_LEAVES = f"""{X.UNITS}, u AS (SELECT case_id, 'L' || pos AS id, text, length(text) AS n, heading <> 'src3' AS known, ['E' || pos, 'E' || (length(text) % 9)] AS refs, CASE WHEN length(text) % 4 = 0 THEN ['R' || (length(text) % 3)] ELSE [] END AS cited,
  ['source_fact', 'speaker_view', 'synthesis', 'external', 'system'][length(text) % 5 + 1] AS src FROM units),
old AS (SELECT case_id, id, text, list_sort(refs) AS refs, cited, src, known FROM u),
new AS (SELECT case_id, id, n, CASE WHEN n % 25 = 0 THEN text || '.' ELSE text END AS text, list_sort(CASE WHEN n % 7 <> 0 AND n % 18 = 0 THEN list_append(refs, 'E9999') ELSE refs END) AS refs, CASE WHEN n % 8 = 0 THEN [] ELSE cited END AS cited, CASE WHEN n % 27 = 0 THEN 'system' ELSE src END AS src FROM u WHERE n % 37 <> 0),
ch AS (SELECT old.case_id, old.id, CASE WHEN new.id IS NULL THEN ['structure'] ELSE list_filter([CASE WHEN old.text <> new.text THEN 'text' END, CASE WHEN NOT known OR old.refs <> new.refs THEN 'evidence_refs' END, CASE WHEN CASE WHEN known THEN old.cited <> new.cited ELSE len(new.cited) > 0 END THEN 'citation_refs' END,
  CASE WHEN CASE WHEN known THEN old.src <> new.src ELSE new.src <> 'system' END THEN 'provenance' END, CASE WHEN n % 33 = 0 THEN 'structure' END], lambda x: x IS NOT NULL) END AS kinds FROM old LEFT JOIN new USING (case_id, id)),
ro AS (SELECT * FROM (VALUES ('fidelity'), ('reader_advocate'), ('source_scout')) v(role))"""


def _shown(table, text="text", known="true"):
    """(case_id, role, shown): what each role saw of an edition."""
    return f"""SELECT case_id, role, string_agg(CASE role WHEN 'fidelity' THEN id || '|' || {text} || '|' || CASE WHEN {known} THEN array_to_string(refs, ',') || '|' || array_to_string(cited, ',') || '|' || src ELSE '|?' END
  WHEN 'reader_advocate' THEN id || '|' || {text} ELSE id || '|' || CASE WHEN {known} THEN array_to_string(refs, ',') ELSE '' END END, chr(1) ORDER BY id) AS shown FROM {table}, ro GROUP BY ALL"""


ORACLE = {
    "g13_change_scope": f"""WITH {_SCOPE} SELECT case_id, mode, CASE WHEN hard <> '' THEN hard WHEN mode = 'semantic_delta' THEN 'claim_semantics_changed_with_stable_source_boundary' WHEN mechanical > 0 THEN 'only_nonsemantic_claim_fields_changed' ELSE 'no_evidence_changes' END AS reasons,
  added, removed, modified, mechanical, unchanged, segment_refs, theme_refs, block_refs, mode <> 'mechanical' AS claim_audit, mode = 'structural_full' AS full_claim_audit, mode = 'semantic_delta' AND block_refs <> '' AS fidelity, n % 3 = 0 AS reader_advocate, mode = 'semantic_delta' AND weighty AS source_scout FROM m""",
    "j13_reader_leaf_changes": f"WITH {_LEAVES} SELECT case_id, id, array_to_string(kinds, ',') AS kinds FROM ch WHERE len(kinds) > 0",
    "g20_report_reuse": f"""WITH {_LEAVES}, s1 AS ({_shown('old', known='known')}), s2 AS ({_shown('new', "regexp_replace(text, '[.]$', '')")}), s3 AS ({_shown('new')})
SELECT s3.case_id, s3.role, CASE WHEN s2.shown = s3.shown THEN 2 WHEN s1.shown = s3.shown THEN 1 END AS round FROM s3 LEFT JOIN s1 USING (case_id, role) LEFT JOIN s2 USING (case_id, role)""",
    "g12_targeted_plan": f"""WITH {_LEAVES}, s1 AS ({_shown('old', known='known')}), s3 AS ({_shown('new')}),
l AS (SELECT case_id, role, string_agg(id, ',' ORDER BY id) AS leaves FROM ch, ro WHERE role = 'fidelity' AND list_has_any(kinds, ['text', 'evidence_refs', 'citation_refs', 'provenance']) OR role = 'reader_advocate' AND list_contains(kinds, 'text') GROUP BY ALL),
p AS (SELECT s3.case_id, s3.role, coalesce(s1.shown = s3.shown, false) AS same, coalesce(leaves, '') AS leaves FROM s3 LEFT JOIN s1 USING (case_id, role) LEFT JOIN l USING (case_id, role)),
a AS (SELECT *, role <> 'source_scout' AND NOT same AND (leaves <> '' OR role = 'reader_advocate') AS again FROM p)
SELECT case_id, role, CASE WHEN again THEN 'rerun' ELSE 'inherit' END AS action, CASE WHEN NOT again THEN 1 END AS round, CASE WHEN again THEN leaves ELSE '' END AS leaves FROM a""",
}
