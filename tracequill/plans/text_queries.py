"""Queries of the text functions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from tracequill.functions import text as T
from tracequill.session import table

from . import fixtures as X


def f01_normalize_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.normalize_text(F.col("html")).cast("binary")).alias("digest"), F.length(T.normalize_text(F.col("html"))).cast("long").alias("n"))


def f02_compact_characters(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.compact_characters(F.col("text")).cast("long").alias("n"))


#: Accented letters of which the accent is taken apart, and full-width digits.
_APART = {i: two for i in range(0xC0, 0x180) if len(two := unicodedata.normalize("NFD", chr(i))) == 2} | {0x30 + i: chr(0xFF10 + i) for i in range(10)}


def _taken_apart(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else x.translate(_APART).replace("fi", "ﬁ") for x in texts.to_pylist()], pa.string())


def _unusual(text):
    """``text`` with its accents apart, full-width digits and a ligature."""
    return F.arrow_udf(_taken_apart, "string")(text)


def f03_compatibility_forms(spark, sf):
    return X.claims(spark, sf).select("case_id", "id", T.normalized_claim(_unusual(F.col("statement"))).alias("plain"))


def f04_review_text(spark, sf):
    return X.claims(spark, sf).select("case_id", "id", F.md5(T.normalize_review_text(_unusual(F.col("statement"))).cast("binary")).alias("digest"))


def f03_normalized_claim(spark, sf):
    return X.claims(spark, sf).select("case_id", "id", T.normalized_claim(F.col("statement")).alias("plain"))


def f05_bigrams(spark, sf):
    return X.claims(spark, sf).select("case_id", "id", F.array_join(F.array_sort(T.bigrams(F.col("statement"))), "/").alias("grams"))


def f06_similarity(spark, sf):
    order = Window.partitionBy("case_id").orderBy("pos")
    rows = X.claims(spark, sf).withColumn("g", T.bigrams(F.col("statement"))).withColumn("before", F.lag("g").over(order)).filter("before IS NOT NULL")
    return rows.select("case_id", "id", T.rounded(T.jaccard(F.col("g"), F.col("before"))).alias("similarity"))


def f07_timestamps(spark, sf):
    ms = F.col("event_id") * 7919 + 1
    rows = table(spark, sf, "events").select("event_id", T.format_timestamp(ms).alias("stamp"))
    return rows.select("event_id", "stamp", T.parse_timestamp(F.replace("stamp", F.lit("."), F.lit(","))).alias("ms"))


def f08_adaptive_targets(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 21).alias("density"), (T.compact_characters(F.col("text")) * 10).cast("long").alias("characters"))
    return rows.select("doc_id", *(c.cast("long").alias(n) for n, c in T.adaptive_targets(F.col("density"), F.col("characters")).items()))


def f09_reading_minutes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.reading_minutes(T.compact_characters(F.col("text"))).alias("minutes"))


def f10_round_rate(spark, sf):
    rows = table(spark, sf, "documents").groupBy("lang").agg((F.sum(F.length("text")) / F.sum(F.col("n_chars") + 3)).alias("r"))
    return rows.select("lang", T.rounded(F.col("r")).alias("rate"))


def f11_end_sentence(spark, sf):
    return X.units(spark, sf).select("case_id", "pos", T.end_sentence(T.plain_markdown(F.col("text"))).alias("sentence"))


def f12_escape_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.escape_html(F.col("html")).cast("binary")).alias("a"), F.md5(T.escape_html(F.col("html"), "&#039;").cast("binary")).alias("b"))


def f13_markdown_cell(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.markdown_cell(F.col("text")).cast("binary")).alias("cell"), T.href(F.concat_ws("/", "source", F.concat(F.col("lang"), F.lit(" é")))).alias("href"))


def f14_content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.content_hash(F.col("doc_id"), F.col("lang"), F.col("source"), F.lit(None)).alias("hash"))


def f15_valid_dates(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.format_string("%04d-%02d-%02d", (1995 + F.col("o_orderkey") % 6).cast("int"), (F.col("o_orderkey") % 14).cast("int"), (F.col("o_orderkey") % 33).cast("int")).alias("d"))
    return rows.select("o_orderkey", T.valid_date(F.col("d")).alias("full"), T.valid_date(F.substring("d", 1, 7), True).alias("month"))


def f20_term_hits(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.term_hits(F.col("text"), TERMS).cast("long").alias("hits"))


def f22_guide_characters(spark, sf):
    return X.claims(spark, sf).groupBy("case_id", "theme_id").agg(F.sum(T.compact_characters(F.col("statement"))).cast("long").alias("characters"))


def f23_percentage(spark, sf):
    return X.claims(spark, sf).groupBy("case_id").agg(T.percentage(F.avg((F.col("importance") == "high").cast("double"))).alias("share"))


def l04_corruption(spark, sf):
    rows = X.units(spark, sf).select("case_id", "pos", F.when(F.col("pos") % 9 == 0, F.concat("text", F.lit("??"))).when(F.col("pos") % 10 == 0, F.concat("text", F.lit("�"))).otherwise(F.col("text")).alias("text"))
    return rows.filter(T.corrupted(F.col("text"))).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))


def l09_readable_paragraphs(spark, sf):
    text = F.col("text")
    return X.units(spark, sf).filter((T.compact_characters(text) >= 35) & ~text.rlike(r"^(?:[-*+]|\d+[.)])\s") & ~text.rlike("https?://")).select("case_id", "pos")


TERMS = ["the", "que", "und", "tion", "mail", "token", "xyzzy"]
NAMES = "f01_normalize_text f02_compact_characters f03_normalized_claim f03_compatibility_forms f04_review_text f05_bigrams f06_similarity f07_timestamps f08_adaptive_targets f09_reading_minutes f10_round_rate f11_end_sentence f12_escape_html f13_markdown_cell f14_content_hash f15_valid_dates f20_term_hits f22_guide_characters f23_percentage l04_corruption l09_readable_paragraphs"
QUERIES = {n: globals()[n] for n in NAMES.split()}

_ESC = "replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '{q}')"
_STAMP = "lpad((m // 3600000)::VARCHAR, greatest(2, length((m // 3600000)::VARCHAR))::INT, '0') || ':' || lpad((m % 3600000 // 60000)::VARCHAR, 2, '0') || ':' || lpad((m % 60000 // 1000)::VARCHAR, 2, '0') || '.' || lpad((m % 1000)::VARCHAR, 3, '0')"
ORACLE = {
    "f03_compatibility_forms": f"WITH {X.CLAIMS} SELECT case_id, id, {X.plain('nfc_normalize(statement)')} AS plain FROM claims",
    "f04_review_text": f"WITH {X.CLAIMS} SELECT case_id, id, md5(regexp_replace(nfc_normalize(statement), '\\s+', '', 'g')) AS digest FROM claims",
    "f01_normalize_text": f"SELECT page_id, md5({X.norm('html')}) AS digest, length({X.norm('html')}) AS n FROM pages",
    "f02_compact_characters": f"SELECT doc_id, {X.compact('text')} AS n FROM documents",
    "f03_normalized_claim": f"WITH {X.CLAIMS} SELECT case_id, id, {X.plain('statement')} AS plain FROM claims",
    "f05_bigrams": f"WITH {X.CLAIMS}, p AS (SELECT case_id, id, {X.plain('statement')} AS s FROM claims) SELECT case_id, id, array_to_string(list_sort({X.grams('s')}), '/') AS grams FROM p",
    "f06_similarity": f"WITH {X.CLAIMS}, p AS (SELECT case_id, pos, id, {X.plain('statement')} AS s FROM claims), g AS (SELECT case_id, pos, id, {X.grams('s')} AS g FROM p), b AS (SELECT *, lag(g) OVER (PARTITION BY case_id ORDER BY pos) AS h FROM g) SELECT case_id, id, floor(({X.jaccard('g', 'h')}) * 10000 + 0.5) / 10000 AS similarity FROM b WHERE h IS NOT NULL",
    "f07_timestamps": f"WITH e AS (SELECT event_id, event_id * 7919 + 1 AS m FROM events) SELECT event_id, {_STAMP} AS stamp, m AS ms FROM e",
    "f08_adaptive_targets": f"""WITH d AS (SELECT doc_id, doc_id % 21 AS d, ({X.compact('text')} * 10)::BIGINT AS c FROM documents)
SELECT doc_id, least(c, (floor(least(18000, greatest(12000, 4000 + 500 * d + 0.12::DOUBLE * c)) / 500 + 0.5) * 500)::BIGINT) AS reader_target, least(c, 12000) AS reader_minimum, least(c, 18000) AS reader_maximum, least(8000, 3000 + 250 * d) AS brief_target FROM d""",
    "f09_reading_minutes": f"SELECT doc_id, greatest(1, ceil({X.compact('text')} / 450))::BIGINT AS minutes FROM documents",
    "f10_round_rate": "SELECT lang, floor(sum(length(text)) / sum(n_chars + 3) * 10000 + 0.5) / 10000 AS rate FROM documents GROUP BY lang",
    "f11_end_sentence": f"WITH {X.UNITS}, p AS (SELECT case_id, pos, trim(regexp_replace(regexp_replace(text, '\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '[*_`#>]+', '', 'g')) AS t FROM units) SELECT case_id, pos, CASE WHEN t = '' OR regexp_matches(t, '[.。！？!?…]$') THEN t ELSE t || '.' END AS sentence FROM p",
    "f12_escape_html": f"SELECT page_id, md5({_ESC.format(q='&#39;')}) AS a, md5({_ESC.format(q='&#039;')}) AS b FROM pages",
    "f13_markdown_cell": "SELECT doc_id, md5(replace(replace(text, chr(10), ' '), '|', '\\|')) AS cell, source || '/' || lang || '%20%C3%A9' AS href FROM documents",
    "f14_content_hash": """SELECT doc_id, sha256('["' || doc_id || '","' || lang || '","' || source || '",null]') AS hash FROM documents""",
    "f15_valid_dates": """WITH o AS (SELECT o_orderkey, printf('%04d-%02d-%02d', (1995 + o_orderkey % 6)::INT, (o_orderkey % 14)::INT, (o_orderkey % 33)::INT) AS d FROM orders)
SELECT o_orderkey, try_cast(d AS DATE) IS NOT NULL AS full, o_orderkey % 14 BETWEEN 1 AND 12 AS month FROM o""",
    "f20_term_hits": "SELECT doc_id, (" + " + ".join(f"contains(lower(text), '{t}')::BIGINT" for t in TERMS) + ")::BIGINT AS hits FROM documents",
    "f22_guide_characters": f"WITH {X.CLAIMS} SELECT case_id, theme_id, sum({X.compact('statement')})::BIGINT AS characters FROM claims GROUP BY ALL",
    "f23_percentage": f"WITH {X.CLAIMS} SELECT case_id, printf('%.1f', avg((importance = 'high')::INT) * 100) || '%' AS share FROM claims GROUP BY ALL",
    "l04_corruption": f"WITH {X.UNITS}, c AS (SELECT case_id, pos FROM units WHERE pos % 9 = 0 OR pos % 10 = 0 OR regexp_matches(text, '\\?\\?')) SELECT case_id, count(*) AS n FROM c GROUP BY ALL",
    "l09_readable_paragraphs": f"WITH {X.UNITS} SELECT case_id, pos FROM units WHERE {X.compact('text')} >= 35 AND NOT regexp_matches(text, '^(?:[-*+]|\\d+[.)])\\s') AND NOT regexp_matches(text, 'https?://')",
}
