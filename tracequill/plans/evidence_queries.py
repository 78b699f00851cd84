"""Queries over claims, reviews, snapshots and gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracequill.functions import text as T
from tracequill.operators import evidence as E
from tracequill.session import table

from . import fixtures as X

RELATIONS = ("equivalent", "subsumed", "partial", "unmatched", "disputed")
WEIGHTS = {"clarity": 2.0, "accuracy": 3.0, "structure": 1.0, "tone": 1.0}
LEXICON = {"alpha": ["the", "and", "hereth"], "beta": ["que", "ción"], "gamma": ["und", "der", "heit"], "delta": ["une", "eau", "tion"]}


def _candidates(spark, sf):
    k = F.col("case_id") + F.col("pos")
    pick = lambda names, of: F.element_at(F.array(*map(F.lit, names)), (of % len(names) + 1).cast("int"))
    return X.claims(spark, sf).select(
        "case_id", "id", "importance", pick(RELATIONS, k).alias("relation"), pick(("high", "medium", "low", "excluded"), F.floor(k / 2)).alias("calibrated"),
        F.when(k % 8 == 0, "invalid").otherwise("valid").alias("validity"), (k % 3 != 0).alias("material"), F.when(k % 6 != 0, F.col("theme_id")).alias("theme_id"),
    )


_CAND = f"""{X.CLAIMS}, cand AS (SELECT case_id, id, importance, {list(RELATIONS)}[(case_id + pos) % 5 + 1] AS relation, ['high', 'medium', 'low', 'excluded'][((case_id + pos) // 2) % 4 + 1] AS calibrated,
CASE WHEN (case_id + pos) % 8 = 0 THEN 'invalid' ELSE 'valid' END AS validity, (case_id + pos) % 3 <> 0 AS material, CASE WHEN (case_id + pos) % 6 <> 0 THEN theme_id END AS theme_id FROM claims)"""
_RECALLED = "(relation IN ('equivalent', 'subsumed') OR (relation = 'partial' AND NOT material))"


def _snapshots(spark, sf):
    """Baseline and current hashes: some claims go, come, change meaning or only other fields."""
    rows = X.claims(spark, sf).withColumn("k", F.col("case_id") * 2 + F.col("pos"))
    of = lambda extra, wording: (F.sha2(F.concat_ws("|", "statement", wording), 256), F.sha2(F.concat_ws("|", "id", "theme_id"), 256), F.sha2(F.concat_ws("|", "id", "statement", wording, extra), 256))
    names = ("semantic_hash", "support_hash", "full_hash")
    old = rows.filter("k % 7 <> 0").select("case_id", "id", *(c.alias(n) for n, c in zip(names, of(F.lit("v1"), F.lit("")), strict=True)))
    wording = F.when(F.col("k") % 5 == 0, "new").otherwise("")
    extra = F.when(F.col("k") % 3 == 0, "v2").otherwise("v1")
    new = rows.filter("k % 11 <> 0").select("case_id", "id", *(c.alias(n) for n, c in zip(names, of(extra, wording), strict=True)))
    return old, new


_CHANGE = f"""{X.CLAIMS}, k AS (SELECT *, case_id * 2 + pos AS k FROM claims),
chg AS (SELECT case_id, id, CASE WHEN k % 7 = 0 THEN 'added' WHEN k % 11 = 0 THEN 'removed' WHEN k % 5 = 0 THEN 'modified' WHEN k % 3 = 0 THEN 'mechanical' ELSE 'unchanged' END AS change FROM k WHERE k % 7 <> 0 OR k % 11 <> 0)"""


def j02_span_check(spark, sf):
    """Ownership, contiguity and exact quote of each claim's span."""
    return X.span_checks(spark, sf)


def j03_dangling_refs(spark, sf):
    claims = X.claims(spark, sf)
    refs = claims.select("case_id", "theme_id", F.concat(F.lit("E"), F.lpad((F.col("pos") + F.when(F.col("pos") % 3 == 0, 1).otherwise(0)).cast("string"), 4, "0")).alias("id"))
    return E.dangling(refs, claims.select("case_id", "id"), ["case_id", "id"])


def j04_missing_reviews(spark, sf):
    reviewed = X.reviews(spark, sf).filter("confidence > 0.7").select("case_id", F.col("evidence_ref").alias("id")).distinct()
    return E.dangling(X.claims(spark, sf).select("case_id", "id"), reviewed, ["case_id", "id"])


def j05_body_cited(spark, sf):
    cited = X.reviews(spark, sf).filter("role = 'A' AND verdict = 'covered'").select("case_id", F.col("evidence_ref").alias("id"))
    return X.claims(spark, sf).join(cited, ["case_id", "id"], "left_semi").select("case_id", "id", "importance")


def j06_evidence_diff(spark, sf):
    return E.full_diff(*_snapshots(spark, sf), ["case_id", "id"])


def j07_near_duplicates(spark, sf):
    return E.near_duplicates(_doubled(spark, sf))


def _doubled(spark, sf):
    """Claims, and for some a copy with other punctuation at a later place."""
    claims = X.claims(spark, sf).select("case_id", F.col("pos").cast("long").alias("pos"), "id", "statement")
    again = claims.filter("pos % 8 = 1").select("case_id", (F.col("pos") + 100000).alias("pos"), F.concat(F.lit("D"), "id").alias("id"), F.concat("statement", F.lit("!!")).alias("statement"))
    return claims.unionByName(again)


_DOUBLED = f"""{X.CLAIMS}, dbl AS (SELECT case_id, pos::BIGINT AS pos, id, statement FROM claims UNION ALL SELECT case_id, pos + 100000, 'D' || id, statement || '!!' FROM claims WHERE pos % 8 = 1)"""
_SIMILAR = f"""{_DOUBLED},
tx AS (SELECT *, {X.grams('plain')} AS g FROM (SELECT case_id, {X.plain('statement')} AS plain, min(pos) AS pos FROM dbl GROUP BY ALL)),
px AS (SELECT case_id, pos, len(g) AS n, unnest(list_sort(g)[1:(floor((1 - THRESHOLD) * len(g) + 1e-9) + 1)::BIGINT]) AS x FROM tx),
cd AS (SELECT DISTINCT a.case_id, a.pos AS p, b.pos AS pos FROM px a JOIN px b ON a.case_id = b.case_id AND a.x = b.x AND a.pos < b.pos AND least(a.n, b.n) >= THRESHOLD * greatest(a.n, b.n) - 1e-9),
sim AS (SELECT cd.* FROM cd JOIN tx a ON a.case_id = cd.case_id AND a.pos = p JOIN tx b ON b.case_id = cd.case_id AND b.pos = cd.pos WHERE {X.jaccard('a.g', 'b.g')} >= THRESHOLD)"""


def j08_source_overlap(spark, sf):
    units = X.units(spark, sf)
    old = units.select("case_id", F.col("id").alias("old_id"), F.explode(F.sequence("pos", F.col("pos") + 2)).alias("u"))
    new = units.select("case_id", F.col("id").alias("new_id"), F.explode(F.sequence("pos", F.col("pos") + 1)).alias("u"))
    return old.join(new, ["case_id", "u"]).groupBy("case_id", "old_id", "new_id").agg(F.count(F.lit(1)).alias("shared"))


def j10_effective_decisions(spark, sf):
    rows = E.recall_triggers(_candidates(spark, sf))
    ruling = rows.filter(F.size("triggers") > 0).select("case_id", "id", F.lit("subsumed").alias("ruling")).filter("length(id) % 2 = 1")
    return rows.join(ruling, ["case_id", "id"], "left").select("case_id", "id", F.coalesce("ruling", "relation").alias("relation"))


def j12_duplicate_sources(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(first, "sha").filter("doc_id <> first_id").select("doc_id", "first_id")


def j13_leaf_diff(spark, sf):
    claims = X.claims(spark, sf)
    old = claims.select("case_id", "id", F.col("statement").alias("t0"), F.col("provenance").alias("p0"), F.lit(True).alias("was"))
    new = claims.filter("pos % 7 <> 0").select("case_id", "id", F.when(F.col("pos") % 5 == 0, F.concat("statement", F.lit(" more"))).otherwise(F.col("statement")).alias("t1"), F.when(F.col("pos") % 6 == 0, "editorial").otherwise(F.col("provenance")).alias("p1"), F.lit(True).alias("is"))
    kinds = F.array_compact(F.array(F.when(F.col("is").isNull() | F.col("was").isNull(), F.lit("structure")), F.when(F.col("t0") != F.col("t1"), F.lit("text")), F.when(F.col("p0") != F.col("p1"), F.lit("provenance"))))
    return old.join(new, ["case_id", "id"], "full").withColumn("kinds", F.array_join(kinds, ",")).filter("kinds <> ''").select("case_id", "id", "kinds")


def j14_lineage(spark, sf):
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("preserved", "split", "merged", "retired", "new"))), (k % 5 + 1).cast("int"))
    refs = lambda n, p: F.transform(F.slice(F.sequence(F.lit(1), F.lit(3)), F.lit(1), n.cast("int")), lambda i: F.concat(F.lit(p), i.cast("string")))
    entries = table(spark, sf, "orders").select(k.alias("entry_id"), kind.alias("kind"), refs(k % 3, "E").alias("old_refs"), refs(F.floor(k / 3) % 4, "N").alias("new_refs"))
    return E.lineage_errors(entries)


def j17_quote_containment(spark, sf):
    return E.quoted_in(X.claims(spark, sf).select("case_id", "id", T.normalized_claim(F.col("statement")).alias("plain")))


def j18_theme_omissions(spark, sf):
    claims = X.claims(spark, sf)
    assigned = claims.filter("pos % 3 <> 0").select("case_id", "id")
    declared = claims.filter("pos % 6 = 0").select("case_id", "id")
    left = E.dangling(claims.select("case_id", "id"), assigned, ["case_id", "id"])
    return left.join(declared.withColumn("d", F.lit(True)), ["case_id", "id"], "left").select("case_id", "id", F.when(F.col("d"), "declared").otherwise("undeclared").alias("state"))


def a03_importance_histogram(spark, sf):
    return E.importance_histogram(X.claims(spark, sf))


def a04_reference_coverage(spark, sf):
    cited = X.reviews(spark, sf).filter("role = 'A' AND verdict = 'covered'").select("case_id", F.col("evidence_ref").alias("id"), F.lit(1).alias("c"))
    rows = X.claims(spark, sf).join(cited, ["case_id", "id"], "left")
    main, hit = F.col("importance") != "low", F.col("c").isNotNull()
    found = rows.groupBy("case_id").agg(F.count_if(main).alias("n"), F.count_if(main & hit).alias("k"), F.count_if(hit).alias("h"), F.count(F.lit(1)).alias("m"))
    return found.select("case_id", E.ratio(F.col("k"), F.col("n"), 1.0).alias("main_coverage"), E.ratio(F.col("h"), F.col("m"), 1.0).alias("coverage"))


def a05_blind_recall(spark, sf):
    rows = _candidates(spark, sf)
    hit, main = F.col("relation").isin("equivalent", "subsumed"), F.col("importance") != "low"
    found = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("k"), F.count_if(main).alias("m"), F.count_if(hit & main).alias("h"))
    return found.select("case_id", E.ratio(F.col("k"), F.col("n"), 0.0).alias("recall"), E.ratio(F.col("h"), F.col("m"), 0.0).alias("main_recall"))


def a06_calibrated_recall(spark, sf):
    kept = F.col("calibrated") != "excluded"
    of = lambda level: (F.count_if(E.recalled() & (F.col("calibrated") == level)), F.count_if(F.col("calibrated") == level))
    found = _candidates(spark, sf).groupBy("case_id").agg(*(c.alias(f"{x}_{level}") for level in ("high", "medium") for x, c in zip("kn", of(level), strict=True)), F.count_if(E.recalled() & kept).alias("k_all"), F.count_if(kept).alias("n_all"))
    rates = {x: E.ratio(F.col(f"k_{x}"), F.col(f"n_{x}"), 1.0) for x in ("high", "medium", "all")}
    return found.select("case_id", *(c.alias(x) for x, c in rates.items()), ((rates["high"] >= 1) & (rates["medium"] >= 0.98) & (rates["all"] >= 0.95)).alias("passed"))


def a07_theme_recall(spark, sf):
    return E.theme_recall(_candidates(spark, sf))


def a08_block_load(spark, sf):
    rows = X.reviews(spark, sf).filter("verdict = 'covered'").select("case_id", "evidence_ref", F.explode("blocks").alias("block"))
    return rows.groupBy("case_id", "block").agg(F.count_distinct("evidence_ref").alias("claims")).withColumn("dense", F.col("claims") > 10)


def a09_readability(spark, sf):
    n = T.compact_characters(F.col("text"))
    return X.units(spark, sf).groupBy("case_id").agg(F.count_if(n < 120).alias("short"), F.count_if(n > 450).alias("long"), F.count_if(n > 650).alias("very_long"), F.max(n).cast("long").alias("longest"))


def a10_exact_duplicate_groups(spark, sf):
    rows = _doubled(spark, sf).withColumn("key", T.normalized_claim(F.col("statement")))
    found = rows.groupBy("case_id", "key").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"), F.count(F.lit(1)).alias("n"))
    return found.filter("n > 1").select("case_id", "ids", "n")


def a13_verdict_counts(spark, sf):
    return X.reviews(spark, sf).groupBy("case_id", "verdict").agg(F.count_distinct("evidence_ref").alias("claims"))


def a14_reader_scores(spark, sf):
    names = list(WEIGHTS)
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("review_id"), F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), (F.floor(F.col("o_orderkey") / (i + 1)) % (3 + i) + 3 - F.col("o_orderkey") % 2).cast("int").alias("score")) for i, d in enumerate(names)))).alias("x"))
    return E.reader_scores(rows.select("review_id", "x.*"), WEIGHTS, ["accuracy"])


def a15_two_roles(spark, sf):
    rows = X.reviews(spark, sf).filter("verdict = 'missing'").groupBy("case_id", "theme_id").agg(F.count_distinct("role").alias("roles"))
    return rows.select("case_id", "theme_id", F.when(F.col("roles") >= 2, "hard").otherwise("warning").alias("severity"))


def a16_reader_map(spark, sf):
    rows = X.reviews(spark, sf).select("case_id", "evidence_ref", F.explode("blocks").alias("block"))
    return rows.groupBy("case_id", "evidence_ref").agg(F.array_join(F.array_sort(F.collect_set("block")), ",").alias("blocks"))


def a18_audit_coverage(spark, sf):
    k = F.col("pos")
    rows = X.claims(spark, sf).select("case_id", "id", F.sequence(k, k + 3).alias("want"), F.sequence(k + k % 3, k + 3).alias("have"))
    return rows.select("case_id", "id", T.rounded(F.size(F.array_intersect("want", "have")) / F.size("want")).alias("coverage"))


def a20_table_hash(spark, sf):
    rows = X.claims(spark, sf).select("case_id", F.struct("pos", F.sha2(F.concat_ws("|", "id", "statement"), 256).alias("h")).alias("x"))
    return rows.groupBy("case_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["h"]), ","), 256).alias("hash"))


def a22_theme_build(spark, sf):
    rows = X.claims(spark, sf).filter("theme_id <> 'T002' OR pos % 2 = 0")
    return rows.select("case_id", "id", F.concat(F.lit("T"), F.lpad(F.dense_rank().over(Window.partitionBy("case_id").orderBy("theme_id")).cast("string"), 3, "0")).alias("new_theme"))


def w10_greedy_merge(spark, sf):
    return E.greedy_merge(_doubled(spark, sf))


def o01_profile_decision(spark, sf):
    return E.profile_decision(_profile_scores(spark, sf).drop("raw"))


def _profile_scores(spark, sf):
    meta = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), F.concat_ws(" ", "lang", "source").alias("meta"))
    return E.profile_scores(X.units(spark, sf), LEXICON, meta)


def f21_profile_scores(spark, sf):
    return _profile_scores(spark, sf).select("case_id", "profile", "score")


def o02_top_lenses(spark, sf):
    rows = _profile_scores(spark, sf).filter("raw > 0").withColumn("k", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("raw"), "profile")))
    return rows.filter("k <= 3").select("case_id", "profile", "k")


def o04_first_refs(spark, sf):
    rows = X.claims(spark, sf).withColumn("k", F.row_number().over(Window.partitionBy("case_id", "theme_id").orderBy("pos")))
    return rows.filter("k <= 4").select("case_id", "theme_id", "id")


def u01_set_operations(spark, sf):
    rows = X.reviews(spark, sf).filter("role = 'A'").select("case_id", "evidence_ref", "blocks", F.array(F.lit("B1"), F.lit("B3"), F.lit("B1")).alias("other"))
    show = lambda c: F.array_join(F.array_sort(c), ",")
    return rows.select("case_id", "evidence_ref", show(F.array_union("blocks", "other")).alias("either"), show(F.array_intersect("blocks", "other")).alias("both"), show(F.array_except("blocks", "other")).alias("only"))


def u03_append_only(spark, sf):
    old, new = _snapshots(spark, sf)
    lost = old.join(new, ["case_id", "full_hash"], "left_anti").groupBy("case_id").agg(F.count(F.lit(1)).alias("lost"))
    return old.select("case_id").distinct().join(lost, "case_id", "left").select("case_id", F.coalesce("lost", F.lit(0)).alias("lost"), F.col("lost").isNull().alias("append_only"))


def u04_change_set_equality(spark, sf):
    found = j06_evidence_diff(spark, sf).filter("change = 'modified'").select("case_id", "id")
    declared = X.claims(spark, sf).filter("(case_id * 2 + pos) % 10 = 0").select("case_id", "id")
    return found.exceptAll(declared).withColumn("side", F.lit("undeclared")).unionByName(declared.exceptAll(found).withColumn("side", F.lit("unfounded")))


def g04_quote_repair(spark, sf):
    units = X.units(spark, sf)
    spans = units.select("case_id", F.col("pos").alias("span_id"), F.when(F.col("pos") % 3 == 0, "given").alias("quote"), F.explode(F.array(*(F.struct(F.lit(o).alias("ord"), (F.col("pos") + o * F.when(F.col("pos") % 5 == 0, 2).otherwise(1)).alias("pos")) for o in range(2)))).alias("x"))
    return E.quote_repair(spans.select("case_id", "span_id", "quote", "x.ord", "x.pos"), units).select("case_id", "span_id", "action", F.md5(F.col("quote").cast("binary")).alias("digest"))


def g06_coverage_consensus(spark, sf):
    pairs = E.consensus_pairs(X.reviews(spark, sf))
    ruled = X.claims_of(X.places(spark, sf)).filter("cast(substr(id, 2) AS int) % 8 = 1").select("case_id", F.col("id").alias("evidence_ref")).distinct()
    out = E.coverage_consensus(pairs, ruled.withColumn("verdict", F.lit("covered")))
    return out.select("case_id", "evidence_ref", "verdict", "disputed", F.array_join("triggers", ",").alias("triggers"), F.array_join(F.array_sort("shared_blocks"), ",").alias("shared"))


def g07_policy_status(spark, sf):
    bad = E.consensus_pairs(X.reviews(spark, sf)).groupBy("case_id").agg(F.count_if((F.col("a.verdict") == F.col("b.verdict")) & (F.col("a.verdict") == "missing")).alias("hard"))
    attempt = F.col("case_id") % 4 + 1
    return bad.select("case_id", "hard", F.when(F.col("hard") == 0, "pass").when(attempt > 2, "human_required").otherwise("repair_required").alias("status"))


def g08_recall_triggers(spark, sf):
    return E.recall_triggers(_candidates(spark, sf)).filter(F.size("triggers") > 0).select("case_id", "id", F.array_join("triggers", ",").alias("triggers"))


def g13_change_mode(spark, sf):
    changes = j06_evidence_diff(spark, sf)
    structure = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), (F.col("doc_id") % 9 == 0).alias("structural"))
    return E.change_mode(changes, structure)


def g22_numbering(spark, sf):
    rows = table(spark, sf, "documents").select("lang", "doc_id").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")))
    return rows.groupBy("lang").agg((F.max("n") == F.max("doc_id") - F.min("doc_id") + 1).alias("contiguous"), F.max("n").cast("long").alias("cases"))


def k03_next_identity(spark, sf):
    number = F.regexp_extract(F.concat(F.lit("qr-"), F.lpad((F.col("doc_id") % 9000).cast("string"), 4, "0"), F.lit("-"), "lang"), r"^qr-(\d{4})-", 1).cast("int")
    return table(spark, sf, "documents").groupBy("source").agg(F.lpad((F.max(number) + 1).cast("string"), 4, "0").alias("next"))


def k05_staleness(spark, sf):
    docs = table(spark, sf, "documents")
    of = lambda shift: F.map_from_arrays(F.filter(F.array(*(F.when((F.col("doc_id") + i + shift) % 5 != 0, F.lit(f"k{i}")) for i in range(4))), lambda x: x.isNotNull()), F.transform(F.filter(F.array(*(F.when((F.col("doc_id") + i + shift) % 5 != 0, F.lit(i)) for i in range(4))), lambda x: x.isNotNull()), lambda i: F.concat(F.lit("h"), ((F.col("doc_id") + i * (1 + shift)) % 3).cast("string"))))
    return E.staleness(docs.select(F.col("doc_id").alias("case_id"), of(0).alias("hashes")), docs.select(F.col("doc_id").alias("case_id"), of(1).alias("hashes")))


def k09_page_breaks(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.length("html").alias("height"), F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: (i * (350 + F.col("page_id") % 700)).cast("int")).alias("breaks"))
    return E.page_breaks(rows, 2400, 3000).select("page_id", F.array_join(F.transform("boundaries", lambda x: x.cast("string")), ",").alias("boundaries"))


def k10_catalog(spark, sf):
    docs, claims = table(spark, sf, "documents"), X.claims(spark, sf).groupBy("case_id").agg(F.count(F.lit(1)).alias("claims"))
    rows = docs.join(claims, docs["doc_id"] == claims["case_id"], "left")
    return rows.select("doc_id", F.concat_ws(" | ", F.lpad(F.col("doc_id").cast("string"), 6, "0"), "source", "lang", F.coalesce("claims", F.lit(0)).cast("string")).alias("line")).orderBy(F.desc("doc_id"))


def k11_editions(spark, sf):
    return X.claims(spark, sf).groupBy("case_id").pivot("importance", ["high", "medium", "low"]).agg(F.count(F.lit(1)))


def k06_markdown(spark, sf):
    line = F.concat(F.lit("- "), T.markdown_cell(F.col("statement")), F.lit(" ["), "id", F.lit("]"))
    rows = X.claims(spark, sf).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("x"))
    return rows.select("case_id", F.md5(F.concat(F.lit("# Case\n"), F.array_join(F.transform("x", lambda y: y["line"]), "\n")).cast("binary")).alias("digest"))


def k13_first_use_notes(spark, sf):
    rows = X.units(spark, sf).select("case_id", "pos", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\p{Lu}\p{Ll}{5})"), 1))).alias("term"))
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("case_id", "term").orderBy("pos"))).filter("k = 1").select("case_id", "term", "pos")


NAMES = [n for n in list(globals()) if n[0] in "jawoufgk" and n[1:3].isdigit()]
QUERIES = {n: globals()[n] for n in NAMES}

_PROF = f"""{X.UNITS}, pm AS (SELECT case_id, {', '.join(f"max(contains(lower(text), '{t}')::INT) AS {p}_{i}" for p, ts in LEXICON.items() for i, t in enumerate(ts))} FROM units GROUP BY case_id),
pr AS (SELECT case_id, {', '.join(f"2.5::DOUBLE * ({' + '.join(f'contains(lower(lang || chr(32) || source), {chr(39)}{t}{chr(39)})::INT' for t in ts)}) + {' + '.join(f'{p}_{i}' for i in range(len(ts)))} AS {p}" for p, ts in LEXICON.items())} FROM pm JOIN documents ON doc_id = case_id),
ps AS (SELECT case_id, profile, raw, floor(least(0.95, 0.2::DOUBLE + raw / greatest(1.0::DOUBLE, {', '.join(LEXICON)}) * 0.75) * 1000 + 0.5) / 1000 AS score FROM (SELECT *, unnest({list(LEXICON)}) AS profile, unnest([{', '.join(LEXICON)}]) AS raw FROM pr))"""
_PAIR = f"""{X.REVIEWS}, pr AS (SELECT a.case_id, a.evidence_ref, a.verdict AS va, b.verdict AS vb, list_sort(list_intersect(a.blocks, b.blocks)) AS shared,
array_to_string(CASE WHEN a.verdict = b.verdict AND a.verdict <> 'covered' THEN [] ELSE list_filter([CASE WHEN a.verdict <> b.verdict THEN 'verdict_conflict' END, CASE WHEN a.verdict = 'covered' AND b.verdict = 'covered' AND len(list_intersect(a.blocks, b.blocks)) = 0 THEN 'block_conflict' END,
CASE WHEN a.confidence < 0.8 OR b.confidence < 0.8 THEN 'low_confidence' END, CASE WHEN 'contradicted' IN (a.verdict, b.verdict) THEN 'contradiction' END, CASE WHEN a.issue_type <> 'none' OR b.issue_type <> 'none' THEN 'issue_type' END], lambda x: x IS NOT NULL) END, ',') AS triggers
FROM reviews a JOIN reviews b ON a.case_id = b.case_id AND a.evidence_ref = b.evidence_ref AND a.role = 'A' AND b.role = 'B')"""
_TRIG = f"""{_CAND}, tr AS (SELECT *, array_to_string(list_filter([CASE WHEN importance = 'high' AND (validity <> 'valid' OR calibrated = 'excluded') THEN 'high_exclusion' END, CASE WHEN importance = 'high' AND validity = 'valid' AND calibrated NOT IN ('excluded', 'high') THEN 'high_downgrade' END,
CASE WHEN importance = 'high' AND relation = 'partial' AND NOT material THEN 'high_nonmaterial_partial' END, CASE WHEN importance = 'high' AND relation = 'disputed' THEN 'high_boundary' END,
CASE WHEN (importance = 'medium' OR calibrated = 'medium') AND relation IN ('partial', 'unmatched') THEN 'medium_boundary' END], lambda x: x IS NOT NULL), ',') AS triggers FROM cand)"""
_RATE = "CASE WHEN {n} = 0 THEN {e} ELSE floor({k} / {n} * 10000 + 0.5) / 10000 END"


def _rate(k: str, n: str, e: float) -> str:
    return _RATE.format(k=k, n=n, e=e)


_SC = [f"((o_orderkey // {i + 1}) % {3 + i} + 3 - o_orderkey % 2)" for i in range(4)]
_HASH = "map_from_entries(list_transform(list_filter(range(0, 4), lambda i: (doc_id + i + {s}) % 5 <> 0), lambda i: ('k' || i, 'h' || ((doc_id + i * (1 + {s})) % 3))))"
ORACLE = {
    "j02_span_check": f"WITH {X.SPAN_CHECKS} SELECT * FROM checks",
    "j03_dangling_refs": f"WITH {X.CLAIMS}, r AS (SELECT case_id, theme_id, 'E' || lpad((pos + CASE WHEN pos % 3 = 0 THEN 1 ELSE 0 END)::VARCHAR, 4, '0') AS id FROM claims) SELECT * FROM r ANTI JOIN claims USING (case_id, id)",
    "j04_missing_reviews": f"WITH {X.REVIEWS} SELECT case_id, id FROM claims c WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.case_id = c.case_id AND r.evidence_ref = c.id AND confidence > 0.7)",
    "j05_body_cited": f"WITH {X.REVIEWS} SELECT case_id, id, importance FROM claims c WHERE EXISTS (SELECT 1 FROM reviews r WHERE r.case_id = c.case_id AND r.evidence_ref = c.id AND role = 'A' AND verdict = 'covered')",
    "j06_evidence_diff": f"WITH {_CHANGE} SELECT * FROM chg",
    "j07_near_duplicates": f"""WITH {_SIMILAR.replace('THRESHOLD', '0.9')}, f AS (SELECT case_id, pos, min(p) AS p FROM sim GROUP BY ALL)
SELECT DISTINCT d.case_id, d.id FROM dbl d JOIN tx ON d.case_id = tx.case_id AND {X.plain('d.statement')} = tx.plain LEFT JOIN f ON f.case_id = tx.case_id AND f.pos = tx.pos WHERE len(tx.g) > 0 AND d.pos > least(tx.pos, coalesce(f.p, tx.pos))""",
    "w10_greedy_merge": f"""WITH RECURSIVE {_SIMILAR.replace('THRESHOLD', '0.93')}, vx AS (SELECT case_id, pos, list(p) FILTER (p IS NOT NULL) AS nb, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS i
  FROM (SELECT case_id, pos, p FROM sim UNION ALL SELECT case_id, p, NULL FROM sim) GROUP BY case_id, pos),
st(case_id, i, kept) AS (SELECT DISTINCT case_id, 0::BIGINT, []::BIGINT[] FROM vx UNION ALL
  SELECT v.case_id, v.i, CASE WHEN list_has_any(kept, coalesce(nb, [])) THEN kept ELSE list_append(kept, v.pos) END FROM st JOIN vx v ON v.case_id = st.case_id AND v.i = st.i + 1),
kp AS (SELECT case_id, arg_max(kept, i) AS kept FROM st GROUP BY case_id),
ld AS (SELECT v.case_id, v.pos, list_min(list_intersect(nb, kept)) AS lead FROM vx v JOIN kp ON v.case_id = kp.case_id WHERE NOT list_contains(kept, v.pos)),
pl AS (SELECT tx.case_id, tx.plain, coalesce(ld.lead, tx.pos) AS lead FROM tx LEFT JOIN ld ON ld.case_id = tx.case_id AND ld.pos = tx.pos)
SELECT d.case_id, d.id, k.id AS kept_id FROM dbl d JOIN pl ON pl.case_id = d.case_id AND pl.plain = {X.plain('d.statement')} JOIN dbl k ON k.case_id = d.case_id AND k.pos = pl.lead""",
    "j08_source_overlap": f"WITH {X.UNITS}, o AS (SELECT case_id, id AS old_id, unnest(range(pos, pos + 3)) AS u FROM units), n AS (SELECT case_id, id AS new_id, unnest(range(pos, pos + 2)) AS u FROM units) SELECT case_id, old_id, new_id, count(*) AS shared FROM o JOIN n USING (case_id, u) GROUP BY ALL",
    "j10_effective_decisions": f"WITH {_TRIG} SELECT case_id, id, CASE WHEN triggers <> '' AND length(id) % 2 = 1 THEN 'subsumed' ELSE relation END AS relation FROM tr",
    "j12_duplicate_sources": "SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents) WHERE doc_id <> first_id",
    "j13_leaf_diff": f"""WITH {X.CLAIMS}, k AS (SELECT case_id, id, array_to_string(list_filter([CASE WHEN pos % 7 = 0 THEN 'structure' END, CASE WHEN pos % 7 <> 0 AND pos % 5 = 0 THEN 'text' END, CASE WHEN pos % 7 <> 0 AND pos % 6 = 0 THEN 'provenance' END], lambda x: x IS NOT NULL), ',') AS kinds FROM claims) SELECT * FROM k WHERE kinds <> ''""",
    "j14_lineage": """WITH e AS (SELECT o_orderkey AS entry_id, ['preserved', 'split', 'merged', 'retired', 'new'][o_orderkey % 5 + 1] AS kind, o_orderkey % 3 AS o, (o_orderkey // 3) % 4 AS n FROM orders), f AS (SELECT *, least(n, 3) AS m FROM e)
SELECT entry_id, kind FROM f WHERE NOT CASE kind WHEN 'preserved' THEN o = 1 AND m = 1 WHEN 'split' THEN o = 1 AND m >= 2 WHEN 'merged' THEN o >= 2 AND m = 1 WHEN 'retired' THEN o >= 1 AND m = 0 ELSE o = 0 AND m >= 1 END""",
    "j17_quote_containment": f"WITH {X.CLAIMS}, p AS (SELECT *, {X.plain('statement')} AS plain FROM claims), q AS (SELECT case_id, id AS quote_id, plain AS q FROM p WHERE length(plain) >= 6) SELECT case_id, quote_id, min(id) AS first_match, count(*) AS matches FROM q JOIN p USING (case_id) WHERE contains(plain, q) GROUP BY ALL",
    "j18_theme_omissions": f"WITH {X.CLAIMS} SELECT case_id, id, CASE WHEN pos % 6 = 0 THEN 'declared' ELSE 'undeclared' END AS state FROM claims WHERE pos % 3 = 0",
    "a03_importance_histogram": f"WITH {X.CLAIMS} SELECT case_id, theme_id, count(*) FILTER (importance = 'high') AS high, count(*) FILTER (importance = 'medium') AS medium, count(*) FILTER (importance = 'low') AS low FROM claims GROUP BY ALL",
    "a04_reference_coverage": f"WITH {X.REVIEWS}, c AS (SELECT case_id, importance <> 'low' AS main, verdict = 'covered' AS hit FROM reviews WHERE role = 'A'), n AS (SELECT case_id, count(*) FILTER (main) AS n, count(*) FILTER (main AND hit) AS k, count(*) FILTER (hit) AS h, count(*) AS m FROM c GROUP BY ALL) SELECT case_id, {_rate('k', 'n', 1.0)} AS main_coverage, {_rate('h', 'm', 1.0)} AS coverage FROM n",
    "a05_blind_recall": f"WITH {_CAND}, n AS (SELECT case_id, count(*) AS n, count(*) FILTER (relation IN ('equivalent', 'subsumed')) AS k, count(*) FILTER (importance <> 'low') AS m, count(*) FILTER (importance <> 'low' AND relation IN ('equivalent', 'subsumed')) AS h FROM cand GROUP BY ALL) SELECT case_id, {_rate('k', 'n', 0.0)} AS recall, {_rate('h', 'm', 0.0)} AS main_recall FROM n",
    "a06_calibrated_recall": f"""WITH {_CAND}, n AS (SELECT case_id, count(*) FILTER (calibrated = 'high') AS nh, count(*) FILTER (calibrated = 'high' AND {_RECALLED}) AS kh, count(*) FILTER (calibrated = 'medium') AS nm, count(*) FILTER (calibrated = 'medium' AND {_RECALLED}) AS km,
count(*) FILTER (calibrated <> 'excluded') AS na, count(*) FILTER (calibrated <> 'excluded' AND {_RECALLED}) AS ka FROM cand GROUP BY ALL), r AS (SELECT case_id, {_rate('kh', 'nh', 1.0)} AS high, {_rate('km', 'nm', 1.0)} AS medium, {_rate('ka', 'na', 1.0)} AS "all" FROM n) SELECT *, high >= 1 AND medium >= 0.98 AND "all" >= 0.95 AS passed FROM r""",
    "a07_theme_recall": f"""WITH {_CAND}, n AS (SELECT case_id, coalesce(theme_id, 'unassigned') AS theme_id, count(*) AS candidates, count(*) FILTER ({_RECALLED}) AS matched, count(*) FILTER (NOT {_RECALLED} AND material) AS material_misses FROM cand WHERE calibrated IN ('high', 'medium') GROUP BY ALL)
SELECT *, floor(matched / candidates * 10000 + 0.5) / 10000 AS recall, candidates >= 3 AND material_misses >= 2 AND matched / candidates < 0.95 AS gap FROM n""",
    "a08_block_load": f"WITH {X.REVIEWS} SELECT case_id, block, count(DISTINCT evidence_ref) AS claims, count(DISTINCT evidence_ref) > 10 AS dense FROM (SELECT case_id, evidence_ref, unnest(blocks) AS block FROM reviews WHERE verdict = 'covered') GROUP BY case_id, block",
    "a09_readability": f"WITH {X.UNITS}, n AS (SELECT case_id, {X.compact('text')} AS n FROM units) SELECT case_id, count(*) FILTER (n < 120) AS short, count(*) FILTER (n > 450) AS long, count(*) FILTER (n > 650) AS very_long, max(n) AS longest FROM n GROUP BY case_id",
    "a10_exact_duplicate_groups": f"WITH {_DOUBLED}, k AS (SELECT case_id, id, {X.plain('statement')} AS key FROM dbl) SELECT case_id, string_agg(id, ',' ORDER BY id) AS ids, count(*) AS n FROM k GROUP BY case_id, key HAVING count(*) > 1",
    "a13_verdict_counts": f"WITH {X.REVIEWS} SELECT case_id, verdict, count(DISTINCT evidence_ref) AS claims FROM reviews GROUP BY ALL",
    "a14_reader_scores": f"""WITH s AS (SELECT o_orderkey AS review_id, unnest([2.0, 3.0, 1.0, 1.0]::DOUBLE[]) AS w, unnest([{', '.join(_SC)}]) AS score, unnest([false, true, false, false]) AS core FROM orders),
g AS (SELECT review_id, sum(score * w) FILTER (score BETWEEN 1 AND 5) / sum(w) FILTER (score BETWEEN 1 AND 5) AS a, count(*) FILTER (score = 3) AS threes, min(score) AS least, count(*) FILTER (score NOT BETWEEN 1 AND 5) AS invalid, count(*) FILTER (core AND score <= 2) AS core_low FROM s GROUP BY review_id)
SELECT review_id, floor(a * 10000 + 0.5) / 10000 AS average, threes, core_low, CASE WHEN invalid = 0 AND least >= 4 THEN 'clean_pass' WHEN invalid = 0 AND least >= 3 AND a >= 3.8 AND threes <= 2 THEN 'borderline' ELSE 'revise' END AS classification FROM g""",
    "a15_two_roles": f"WITH {X.REVIEWS} SELECT case_id, theme_id, CASE WHEN count(DISTINCT role) >= 2 THEN 'hard' ELSE 'warning' END AS severity FROM reviews WHERE verdict = 'missing' GROUP BY case_id, theme_id",
    "a16_reader_map": f"WITH {X.REVIEWS}, b AS (SELECT DISTINCT case_id, evidence_ref, unnest(blocks) AS block FROM reviews) SELECT case_id, evidence_ref, string_agg(block, ',' ORDER BY block) AS blocks FROM b GROUP BY ALL",
    "a18_audit_coverage": f"WITH {X.CLAIMS} SELECT case_id, id, floor((4 - pos % 3) / 4 * 10000 + 0.5) / 10000 AS coverage FROM claims",
    "a20_table_hash": f"WITH {X.CLAIMS} SELECT case_id, sha256(string_agg(sha256(id || '|' || statement), ',' ORDER BY pos)) AS hash FROM claims GROUP BY case_id",
    "a22_theme_build": f"WITH {X.CLAIMS} SELECT case_id, id, 'T' || lpad((dense_rank() OVER (PARTITION BY case_id ORDER BY theme_id))::VARCHAR, 3, '0') AS new_theme FROM claims WHERE theme_id <> 'T002' OR pos % 2 = 0",
    "o01_profile_decision": f"""WITH {_PROF}, r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS s2, lead(profile) OVER w AS runner_up FROM ps WINDOW w AS (PARTITION BY case_id ORDER BY score DESC, profile))
SELECT case_id, CASE WHEN score >= 0.75 AND score - s2 >= 0.15 THEN profile END AS "primary", profile AS top, runner_up, floor((score - s2) * 1000 + 0.5) / 1000 AS lead, NOT (score >= 0.75 AND score - s2 >= 0.15) AS pending FROM r WHERE k = 1""",
    "f21_profile_scores": f"WITH {_PROF} SELECT case_id, profile, score FROM ps",
    "o02_top_lenses": f"WITH {_PROF}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY raw DESC, profile) AS k FROM ps WHERE raw > 0) SELECT case_id, profile, k FROM r WHERE k <= 3",
    "o04_first_refs": f"WITH {X.CLAIMS} SELECT case_id, theme_id, id FROM claims QUALIFY row_number() OVER (PARTITION BY case_id, theme_id ORDER BY pos) <= 4",
    "u01_set_operations": f"WITH {X.REVIEWS}, s AS (SELECT case_id, evidence_ref, list_distinct(blocks) AS b, ['B1', 'B3'] AS o FROM reviews WHERE role = 'A') SELECT case_id, evidence_ref, array_to_string(list_sort(list_distinct(list_concat(b, o))), ',') AS either, array_to_string(list_sort(list_intersect(b, o)), ',') AS both, array_to_string(list_sort(list_filter(b, lambda x: NOT list_contains(o, x))), ',') AS only FROM s",
    "u03_append_only": f"WITH {_CHANGE} SELECT case_id, count(*) FILTER (change IN ('removed', 'modified', 'mechanical')) AS lost, count(*) FILTER (change IN ('removed', 'modified', 'mechanical')) = 0 AS append_only FROM chg WHERE change <> 'added' GROUP BY case_id",
    "u04_change_set_equality": f"""WITH {_CHANGE}, d AS (SELECT case_id, id FROM k WHERE k % 10 = 0), f AS (SELECT case_id, id FROM chg WHERE change = 'modified')
SELECT *, 'undeclared' AS side FROM f ANTI JOIN d USING (case_id, id) UNION ALL SELECT *, 'unfounded' FROM d ANTI JOIN f USING (case_id, id)""",
    "g04_quote_repair": f"""WITH {X.UNITS}, s AS (SELECT u.case_id, u.pos AS span_id, v.pos IS NOT NULL AND u.pos % 5 <> 0 AS ok, {X.norm("u.text || chr(32) || coalesce(v.text, '')")} AS t FROM units u LEFT JOIN units v ON v.case_id = u.case_id AND v.pos = u.pos + CASE WHEN u.pos % 5 = 0 THEN 2 ELSE 1 END)
SELECT case_id, span_id, CASE WHEN span_id % 3 = 0 THEN 'kept' WHEN ok THEN 'filled' ELSE 'refused' END AS action, md5(CASE WHEN span_id % 3 = 0 THEN 'given' WHEN ok THEN t END) AS digest FROM s""",
    "g06_coverage_consensus": f"""WITH {_PAIR} SELECT case_id, evidence_ref, CASE WHEN triggers = '' THEN va WHEN substr(evidence_ref, 2)::INT % 8 = 1 THEN 'covered' ELSE 'unresolved' END AS verdict, triggers <> '' AS disputed, triggers, array_to_string(shared, ',') AS shared FROM pr""",
    "g07_policy_status": f"""WITH {_PAIR}, n AS (SELECT case_id, count(*) FILTER (va = vb AND va = 'missing') AS hard FROM pr GROUP BY case_id) SELECT case_id, hard, CASE WHEN hard = 0 THEN 'pass' WHEN case_id % 4 + 1 > 2 THEN 'human_required' ELSE 'repair_required' END AS status FROM n""",
    "g08_recall_triggers": f"WITH {_TRIG} SELECT case_id, id, triggers FROM tr WHERE triggers <> ''",
    "g13_change_mode": f"""WITH {_CHANGE}, n AS (SELECT case_id, count(*) FILTER (change IN ('added', 'removed', 'modified')) AS m, count(*) FILTER (change = 'mechanical') AS x, case_id % 9 = 0 AS s FROM chg GROUP BY case_id)
SELECT case_id, CASE WHEN s THEN 'structural_full' WHEN m > 0 THEN 'semantic_delta' ELSE 'mechanical' END AS mode, CASE WHEN s THEN 'source_changed' WHEN m > 0 THEN 'claim_semantics_changed' WHEN x > 0 THEN 'only_other_fields_changed' ELSE 'no_changes' END AS reason, s OR m > 0 AS claim_audit, s AS full_audit FROM n""",
    "g22_numbering": "SELECT lang, count(*) = max(doc_id) - min(doc_id) + 1 AS contiguous, count(*) AS cases FROM documents GROUP BY lang",
    "k03_next_identity": "SELECT source, lpad((max(doc_id % 9000) + 1)::VARCHAR, 4, '0') AS next FROM documents GROUP BY source",
    "k05_staleness": f"""WITH a AS (SELECT doc_id, unnest(map_entries({_HASH.format(s=0)})) AS e FROM documents), b AS (SELECT doc_id, unnest(map_entries({_HASH.format(s=1)})) AS e FROM documents),
x AS (SELECT doc_id, e.key AS key, e.value AS was FROM a), y AS (SELECT doc_id, e.key AS key, e.value AS now_ FROM b), j AS (SELECT doc_id AS case_id, key, CASE WHEN now_ IS NULL THEN 'missing' WHEN was IS NULL THEN 'added' WHEN was <> now_ THEN 'stale' END AS state FROM x FULL JOIN y USING (doc_id, key)) SELECT * FROM j WHERE state IS NOT NULL""",
    "k09_page_breaks": """WITH RECURSIVE p AS (SELECT page_id, length(html) AS h, list_transform(range(1, 41), lambda i: i * (350 + page_id % 700)) AS b FROM pages),
w(page_id, n, s) AS (SELECT page_id, 0, 0::BIGINT FROM p UNION ALL SELECT w.page_id, n + 1, coalesce(list_max(list_filter(b, lambda x: x > s + 200 AND x <= s + 2400 AND x < h)), list_max(list_filter(b, lambda x: x > s + 200 AND x <= s + 3000 AND x < h)), least(s + 3000, h)) FROM w JOIN p USING (page_id) WHERE h - s > 3000)
SELECT page_id, string_agg(s::VARCHAR, ',' ORDER BY n) || ',' || any_value(h) AS boundaries FROM w JOIN p USING (page_id) GROUP BY page_id""",
    "k10_catalog": f"WITH {X.CLAIMS}, c AS (SELECT case_id, count(*) AS n FROM claims GROUP BY case_id) SELECT doc_id, lpad(doc_id::VARCHAR, 6, '0') || ' | ' || source || ' | ' || lang || ' | ' || coalesce(n, 0) AS line FROM documents LEFT JOIN c ON case_id = doc_id",
    "k11_editions": f"WITH {X.CLAIMS} SELECT case_id, nullif(count(*) FILTER (importance = 'high'), 0) AS high, nullif(count(*) FILTER (importance = 'medium'), 0) AS medium, nullif(count(*) FILTER (importance = 'low'), 0) AS low FROM claims GROUP BY case_id",
    "k06_markdown": f"WITH {X.CLAIMS} SELECT case_id, md5('# Case' || chr(10) || string_agg('- ' || replace(statement, '|', '\\|') || ' [' || id || ']', chr(10) ORDER BY pos)) AS digest FROM claims GROUP BY case_id",
    "k13_first_use_notes": f"WITH {X.UNITS}, t AS (SELECT case_id, pos, unnest(regexp_extract_all(text, '\\p{{Lu}}\\p{{Ll}}{{5}}')) AS term FROM units) SELECT case_id, term, min(pos) AS pos FROM t GROUP BY ALL",
}
