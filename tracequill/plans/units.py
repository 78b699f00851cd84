"""Queries of sources, exclusions, segmentation and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracequill.functions import text as T
from tracequill.operators import segments as S
from tracequill.session import scratch_path, table
from tracequill.sources import parse

from . import fixtures as X


def _included(spark, sf):
    return S.exclusions(X.units(spark, sf)).filter("kind IS NULL").drop("kind")


def _segmented(spark, sf):
    return S.segmented(_included(spark, sf))


def _rewritten(spark, sf):
    """Units with greetings, promotions, stage cues and repeats put in by position."""
    text = F.when(F.col("pos") % 11 == 2, F.lit("Okay!")).when(F.col("pos") % 13 == 3, F.lit("use code SAVE")).when(F.col("pos") % 17 == 4, F.lit("[music]")).when(F.col("pos") % 5 == 0, F.lit("same")).when(F.col("pos") % 5 == 1, F.lit("same")).otherwise(F.col("text"))
    return X.units(spark, sf).withColumn("text", text)


def article_units(spark, sf):
    return X.units(spark, sf)


def s02_timed_units(spark, sf):
    stamp = lambda ms: F.replace(T.format_timestamp(ms), F.lit("."), F.lit(","))
    start = (F.col("turn") * 7 + F.col("conv_id") % 5).cast("long") * 1000
    block = F.concat((F.col("turn") + 1).cast("string"), F.lit("\n"), stamp(start), F.lit(" --> "), stamp(start + 4000), F.lit("\n<b>"), "text", F.lit("</b>"))
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("case_id"), F.struct("turn", block.alias("b")).alias("x"))
    texts = turns.groupBy("case_id").agg(F.array_sort(F.collect_list("x")).alias("x")).select("case_id", F.concat(F.lit("﻿WEBVTT\n\n"), F.array_join(F.transform("x", lambda y: y["b"]), "\n\n")).alias("text"))
    return parse.timed_units(texts).select("case_id", "id", "pos", "start_ms", "end_ms", "text", "label")


def s03_article_units(spark, sf):
    return X.units(spark, sf)


def s04_json_lines(spark, sf):
    lines = table(spark, sf, "documents").select(F.col("doc_id").alias("line_no"), F.when(F.col("doc_id") % 10 == 3, "{bad").otherwise(F.to_json(F.struct("lang", "n_chars"))).alias("line"))
    return parse.json_lines(lines, "lang string, n_chars long").select("line_no", F.when(F.col("error").isNull(), F.col("row.lang")).alias("lang"), F.when(F.col("error").isNull(), F.col("row.n_chars")).alias("n_chars"), "error")


def s10_legacy_timeline(spark, sf):
    mixed = F.when(F.col("doc_id") % 3 == 0, "01:00:00").otherwise("09:30")
    text = F.concat(F.lit("x【3. time】\n* 01:10–02:20： First\nother\n- 03:00-"), mixed, F.lit("：<i>Second</i>  part\n【4. end】\n* 05:00–06:00： no"))
    return parse.legacy_timeline(table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), text.alias("text"))).drop("line_pos")


def l01_exclusions(spark, sf):
    return S.exclusions(_rewritten(spark, sf)).select("case_id", "pos", "kind")


def w02_segments(spark, sf):
    return _segmented(spark, sf).select("case_id", "pos", "segment")


def _timed(spark, sf):
    """Included units with times and headings that follow from the lengths of their texts: some wait 8 seconds before, some a moment longer."""
    n = F.length("text")
    until = Window.partitionBy("case_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = _included(spark, sf).withColumn("end_ms", F.sum(n * 60 + F.when(n % 9 == 0, 8001).when(n % 9 == 1, 8000).otherwise(0)).over(until))
    heading = F.when(n % 31 == 0, "").otherwise(F.concat(F.lit("H"), F.sum((n % 23 == 0).cast("int")).over(until).cast("string")))
    return rows.withColumn("heading", heading).withColumn("start_ms", F.col("end_ms") - n * 60)


def w02_timed_segments(spark, sf):
    return S.segmented(_timed(spark, sf)).select("case_id", "pos", "segment")


def w02_streamed_segments(spark, sf):
    """The timed units as a stream: a first run takes them all, a last one moves the watermark past them."""
    from tracequill.streaming.segments import streamed_segments

    rows = _timed(spark, sf).select(F.col("case_id").cast("long"), F.timestamp_millis(F.col("start_ms") + 86_400_000).alias("at"), "pos", "text", "heading", "start_ms", "end_ms")
    arrived, sink, progress = (scratch_path(spark, tag) for tag in ("arrived", "placed", "progress"))
    rows.write.parquet(arrived)
    last = spark.read.schema(rows.schema).parquet(arrived).agg((F.max("at") + F.expr("INTERVAL 1 DAY")).alias("at")).selectExpr("-1L AS case_id", "at", "0 AS pos", "'' AS text", "'' AS heading", "0L AS start_ms", "0L AS end_ms")
    for step in (None, last):
        if step is not None:
            step.write.mode("append").parquet(arrived)
        stream = streamed_segments(spark.readStream.schema(rows.schema).parquet(arrived), "1 hour")
        stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(sink)


def w04_context(spark, sf):
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return S.segment_table(_segmented(spark, sf)).select("case_id", "segment", join("context_before").alias("context_before"), join("context_after").alias("context_after"))


def w06_locators(spark, sf):
    return S.segment_table(_segmented(spark, sf)).select("case_id", "segment", "first_id", "last_id", F.size("source_ids").cast("long").alias("n_units"), F.md5(F.col("text").cast("binary")).alias("digest"))


def w03_contiguity(spark, sf):
    units = X.units(spark, sf)
    spans = units.select("case_id", F.col("pos").alias("span_id"), F.explode(F.array(*(F.struct(F.lit(o).alias("ord"), (F.col("pos") + F.when((F.col("pos") % 3 == 0) & (F.lit(o) == 2), 3).otherwise(o)).alias("want")) for o in range(3)))).alias("x")).select("case_id", "span_id", "x.*")
    known = units.select("case_id", F.col("pos").alias("want"), "pos")
    return S.contiguous(spans.join(known, ["case_id", "want"], "left"))


def w05_uniform_sample(spark, sf):
    return S.uniform_sample(X.units(spark, sf), 8).select("case_id", "pos")


def w07_unit_groups(spark, sf):
    return S.unit_groups(_segmented(spark, sf)).select("case_id", "segment", "first_pos", "last_pos", "characters")


def w08_compact_ranges(spark, sf):
    refs = X.units(spark, sf).filter("pos % 5 <> 0").select(F.col("case_id").alias("key"), F.col("pos").alias("ord"), F.col("id").alias("ref"))
    return S.compact_ranges(refs).select("key", F.array_join("ranges", " ").alias("ranges"))


def w09_earliest_mention(spark, sf):
    terms = spark.createDataFrame([(t,) for t in MENTIONED], "term string")
    hits = X.units(spark, sf).join(F.broadcast(terms), F.contains(F.lower("text"), F.col("term")))
    return hits.groupBy("case_id", "term").agg(F.min_by("id", "pos").alias("first_id"))


def w11_order_contiguity(spark, sf):
    marked = X.claims(spark, sf).select("case_id", (F.dense_rank().over(Window.partitionBy("case_id").orderBy("theme_id")) + F.when(F.col("case_id") % 7 == 0, 1).otherwise(0)).alias("o"))
    return marked.groupBy("case_id").agg(((F.min("o") == 1) & (F.max("o") == F.count_distinct("o"))).alias("contiguous"))


def f16_speakers(spark, sf):
    units = _segmented(spark, sf).withColumn("text", F.when(F.col("segment") % 3 == 0, F.col("text")).otherwise(F.concat(F.lit("Ann"), (F.col("segment") % 2).cast("string"), F.lit(": "), "text")))
    people = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), F.lit("Ann1 Lee").alias("name"))
    return S.speakers(units, people)


def a01_source_stats(spark, sf):
    rows = S.exclusions(_rewritten(spark, sf))
    n = T.compact_characters(F.col("text"))
    gone = F.col("kind").isNotNull()
    found = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("units"), F.count_if(gone).alias("excluded"), F.sum(F.when(gone, 0).otherwise(n)).cast("long").alias("effective_characters"), F.sum(F.when(gone, n).otherwise(0)).cast("long").alias("excluded_characters"))
    return found.withColumn("exclusion_rate", T.rounded(F.col("excluded") / F.col("units")))


def j01_ledger_findings(spark, sf):
    """Units that no segment owns, and ledger rows for units that do not exist."""
    units = X.units(spark, sf)
    ledger = units.filter("pos % 9 <> 5").select("case_id", (F.col("pos") + F.when(F.col("pos") % 14 == 0, 1000).otherwise(0)).alias("pos"))
    missing = units.join(ledger, ["case_id", "pos"], "left_anti").select("case_id", "pos", F.lit("unmapped").alias("finding"))
    unknown = ledger.join(units, ["case_id", "pos"], "left_anti").select("case_id", "pos", F.lit("unknown_unit").alias("finding"))
    twice = ledger.groupBy("case_id", "pos").count().filter("count > 1").select("case_id", "pos", F.lit("owned_twice").alias("finding"))
    return missing.unionByName(unknown).unionByName(twice)


def session_gaps(spark, sf):
    """Sessions of events by user: a gap of more than 8 hours breaks."""
    from tracequill.streaming import sessions

    return sessions.sessionized(table(spark, sf, "events"), "8 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("start"), "events")


MENTIONED = ["anthe", "cióndo", "enkeit", "quele", "tion"]
NAMES = "s02_timed_units s03_article_units s04_json_lines s10_legacy_timeline l01_exclusions w02_segments w02_timed_segments w02_streamed_segments w03_contiguity w04_context w05_uniform_sample w06_locators w07_unit_groups w08_compact_ranges w09_earliest_mention w11_order_contiguity f16_speakers a01_source_stats j01_ledger_findings session_gaps"
QUERIES = {n: globals()[n] for n in NAMES.split()}

_MS = "lpad((({m}) // 3600000)::VARCHAR, 2, '0') || ':' || lpad((({m}) % 3600000 // 60000)::VARCHAR, 2, '0') || ':' || lpad((({m}) % 60000 // 1000)::VARCHAR, 2, '0')"
_KEPT = f"""{X.UNITS},
l AS (SELECT *, lag(text) OVER (PARTITION BY case_id ORDER BY pos) AS before FROM (SELECT * FROM units WHERE NOT (regexp_matches(text, '^(?:\\[[^\\]]{{1,24}}\\]|\\([^)]{{1,24}}\\))$') AND regexp_matches(text, '(?i)music|applause|laugh|noise'))
   AND NOT ({X.compact('text')} <= 12 AND regexp_matches(text, '(?i)^(?:hello|hi|hey|ok(?:ay)?|thanks|thank you|hola|salut|merci|danke|gracias)[!,. ]*$'))
   AND NOT ({X.compact('text')} <= 80 AND regexp_matches(text, '(?i)(?:subscribe.{{0,12}}channel|(?:promo|discount|coupon) code|sponsored by|use code)')))),
kept AS (SELECT *, {X.compact('text')} AS n, regexp_matches(text, '[。！？!?]$') AS e, row_number() OVER (PARTITION BY case_id ORDER BY pos) AS i FROM l WHERE before IS NULL OR before <> text)"""
_SEG = f"""RECURSIVE {_KEPT},
seg(case_id, i, pos, segment, u, c, e) AS (SELECT case_id, i, pos, 1, 1, n, e FROM kept WHERE i = 1 UNION ALL
  SELECT k.case_id, k.i, k.pos, CASE WHEN b THEN segment + 1 ELSE segment END, CASE WHEN b THEN 1 ELSE u + 1 END, CASE WHEN b THEN k.n ELSE c + k.n END, k.e
  FROM (SELECT *, u >= 48 OR c >= 1200 OR (c >= 650 AND e) AS b FROM seg) s JOIN kept k ON k.case_id = s.case_id AND k.i = s.i + 1),
segs AS (SELECT seg.case_id, seg.pos, segment, id, text, n, kept.i FROM seg JOIN kept ON seg.case_id = kept.case_id AND seg.pos = kept.pos)"""
_TIMED = f"""RECURSIVE {_KEPT},
tm AS (SELECT *, sum(length(text) * 60 + CASE WHEN length(text) % 9 = 0 THEN 8001 WHEN length(text) % 9 = 1 THEN 8000 ELSE 0 END) OVER w AS z, CASE WHEN length(text) % 31 = 0 THEN '' ELSE 'H' || sum((length(text) % 23 = 0)::INT) OVER w END AS h
  FROM (SELECT * EXCLUDE (heading) FROM kept) WINDOW w AS (PARTITION BY case_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
seg(case_id, i, pos, segment, u, c, e, z, h) AS (SELECT case_id, i, pos, 1, 1, n, e, z, h FROM tm WHERE i = 1 UNION ALL
  SELECT case_id, i, pos, CASE WHEN b THEN segment + 1 ELSE segment END, CASE WHEN b THEN 1 ELSE u + 1 END, CASE WHEN b THEN n ELSE c + n END, e, z, h
  FROM (SELECT k.case_id, k.i, k.pos, k.n, k.e, k.z, k.h, segment, u, c, u >= 48 OR c >= 1200 OR (c >= 650 AND s.e) OR k.z - length(k.text) * 60 - s.z > 8000 OR (s.h <> '' AND k.h <> '' AND s.h <> k.h) AS b
        FROM seg s JOIN tm k ON k.case_id = s.case_id AND k.i = s.i + 1))"""
_REW = f"""{X.UNITS}, rw AS (SELECT case_id, pos, CASE WHEN pos % 11 = 2 THEN 'Okay!' WHEN pos % 13 = 3 THEN 'use code SAVE' WHEN pos % 17 = 4 THEN '[music]' WHEN pos % 5 IN (0, 1) THEN 'same' ELSE text END AS text FROM units),
lo AS (SELECT *, CASE WHEN pos % 11 = 2 THEN 'greeting' WHEN pos % 13 = 3 THEN 'advertisement' WHEN pos % 17 = 4 THEN 'noise' END AS local FROM rw),
ex AS (SELECT case_id, pos, text, CASE WHEN local IS NULL AND lag(text) OVER (PARTITION BY case_id, local IS NULL ORDER BY pos) = text THEN 'duplicate' ELSE local END AS kind FROM lo)"""
ORACLE = {
    "s02_timed_units": f"""WITH c AS (SELECT conv_id AS case_id, turn, (turn * 7 + conv_id % 5) * 1000 AS s, {X.norm('text')} AS text FROM conversations), n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY turn)::INT AS pos FROM c WHERE text <> '')
SELECT case_id, 'C' || lpad(pos::VARCHAR, 6, '0') AS id, pos, s AS start_ms, s + 4000 AS end_ms, text, {_MS.format(m='s')} || '–' || {_MS.format(m='s + 4000')} AS label FROM n""",
    "s03_article_units": f"WITH {X.UNITS} SELECT case_id, pos, id, text, heading FROM units",
    "s04_json_lines": "SELECT doc_id AS line_no, CASE WHEN doc_id % 10 <> 3 THEN lang END AS lang, CASE WHEN doc_id % 10 <> 3 THEN n_chars END AS n_chars, CASE WHEN doc_id % 10 = 3 THEN 'line ' || doc_id || ' is not valid JSON' END AS error FROM documents",
    "s10_legacy_timeline": """SELECT doc_id AS case_id, CASE WHEN doc_id % 3 = 0 THEN a ELSE b END AS start_ms, CASE WHEN doc_id % 3 = 0 THEN c ELSE d END AS end_ms, title FROM documents,
(VALUES (4200000, 70000, 8400000, 140000, 'First'), (10800000, 180000, 3600000, 570000, 'Second part')) v(a, b, c, d, title)""",
    "l01_exclusions": f"WITH {_REW} SELECT case_id, pos, kind FROM ex",
    "w02_segments": f"WITH {_SEG} SELECT case_id, pos, segment FROM segs",
    "w02_timed_segments": f"WITH {_TIMED} SELECT case_id, pos, segment FROM seg",
    "w02_streamed_segments": f"WITH {_TIMED} SELECT case_id, pos, segment FROM seg",
    "w03_contiguity": f"""WITH {X.UNITS}, m AS (SELECT case_id, max(pos) AS last FROM units GROUP BY case_id) SELECT case_id, pos AS span_id, pos % 3 <> 0 AND pos + 2 <= last AS contiguous FROM units JOIN m USING (case_id)""",
    "w04_context": f"""WITH {_SEG}, b AS (SELECT case_id, segment, min(i) AS lo, max(i) AS hi FROM segs GROUP BY ALL)
SELECT case_id, segment, coalesce((SELECT string_agg(k.pos::VARCHAR, ',' ORDER BY k.pos) FROM kept k WHERE k.case_id = b.case_id AND k.i BETWEEN lo - 2 AND lo - 1), '') AS context_before,
       coalesce((SELECT string_agg(k.pos::VARCHAR, ',' ORDER BY k.pos) FROM kept k WHERE k.case_id = b.case_id AND k.i BETWEEN hi + 1 AND hi + 2), '') AS context_after FROM b""",
    "w05_uniform_sample": f"""WITH {X.UNITS}, r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY case_id) AS n FROM units)
SELECT case_id, pos FROM r WHERE n <= 8 OR list_contains(list_transform(range(0, 8), lambda k: floor(k * (n - 1) / 7 + 0.5)::BIGINT), i)""",
    "w06_locators": f"WITH {_SEG} SELECT case_id, segment, min_by(id, pos) AS first_id, max_by(id, pos) AS last_id, count(*) AS n_units, md5({X.norm(chr(40) + 'string_agg(text, chr(32) ORDER BY pos)' + chr(41))}) AS digest FROM segs GROUP BY case_id, segment",
    "w07_unit_groups": f"""WITH {_SEG}, q AS (SELECT *, regexp_matches(text, '[。！？!?.]$') AS e2, row_number() OVER (PARTITION BY case_id, segment ORDER BY pos) AS j FROM segs),
g(case_id, segment, j, pos, k, c, e2) AS (SELECT case_id, segment, j, pos, 0, n, e2 FROM q WHERE j = 1 UNION ALL
  SELECT q.case_id, q.segment, q.j, q.pos, CASE WHEN q.pos <> g.pos + 1 OR c + q.n > 150 OR (c >= 65 AND g.e2) THEN k + 1 ELSE k END, CASE WHEN q.pos <> g.pos + 1 OR c + q.n > 150 OR (c >= 65 AND g.e2) THEN q.n ELSE c + q.n END, q.e2
  FROM g JOIN q ON q.case_id = g.case_id AND q.segment = g.segment AND q.j = g.j + 1)
SELECT case_id, segment, min(pos) AS first_pos, max(pos) AS last_pos, max(c)::BIGINT AS characters FROM g GROUP BY case_id, segment, k HAVING max(c) >= 8""",
    "w08_compact_ranges": f"""WITH {X.UNITS}, s AS (SELECT case_id, id, pos, pos - row_number() OVER (PARTITION BY case_id ORDER BY pos) AS g FROM units WHERE pos % 5 <> 0),
r AS (SELECT case_id, g, min(pos) AS at_, CASE WHEN count(*) = 1 THEN min(id) ELSE min(id) || '–' || max(id) END AS t FROM s GROUP BY case_id, g) SELECT case_id AS key, string_agg(t, ' ' ORDER BY at_) AS ranges FROM r GROUP BY case_id""",
    "w09_earliest_mention": f"WITH {X.UNITS}, t AS (SELECT unnest({MENTIONED}) AS term) SELECT case_id, term, min_by(id, pos) AS first_id FROM units JOIN t ON contains(lower(text), term) GROUP BY case_id, term",
    "w11_order_contiguity": f"WITH {X.CLAIMS} SELECT case_id, case_id % 7 <> 0 AS contiguous FROM claims GROUP BY case_id",
    "f16_speakers": f"""WITH {_SEG}, p AS (SELECT case_id, segment, count(*) AS n FROM segs GROUP BY ALL),
x AS (SELECT case_id, segment, regexp_extract(text, '^\\s*([\\p{{L}}\\p{{N}}·・]{{1,24}})\\s*[：:]', 1) AS p FROM segs WHERE segment % 3 = 0),
y AS (SELECT case_id, segment, count(*) FILTER (p <> '') AS k, count(*) AS n, count(DISTINCT p) FILTER (p <> '') AS d, min(p) FILTER (p <> '') AS p FROM x GROUP BY ALL)
SELECT case_id, segment, CASE WHEN segment % 2 = 1 THEN 'Ann1 Lee' END AS name, CASE WHEN segment % 2 = 1 THEN 'confirmed' ELSE 'unknown' END AS status,
       CASE WHEN segment % 2 = 1 THEN 1.0 WHEN n >= 2 THEN 0.8 ELSE 0.6 END::DOUBLE AS confidence FROM p WHERE segment % 3 <> 0
UNION ALL SELECT case_id, segment, NULL, 'unknown', CASE WHEN d <> 1 THEN 0.0 WHEN k >= greatest(2, ceil(n * 0.6)) THEN 0.8 ELSE 0.6 END::DOUBLE FROM y""",
    "a01_source_stats": f"""WITH {_REW} SELECT case_id, count(*) AS units, count(kind) AS excluded, coalesce(sum({X.compact('text')}) FILTER (kind IS NULL), 0)::BIGINT AS effective_characters,
coalesce(sum({X.compact('text')}) FILTER (kind IS NOT NULL), 0)::BIGINT AS excluded_characters, floor(count(kind) / count(*) * 10000 + 0.5) / 10000 AS exclusion_rate FROM ex GROUP BY case_id""",
    "j01_ledger_findings": f"""WITH {X.UNITS}, g AS (SELECT case_id, pos + CASE WHEN pos % 14 = 0 THEN 1000 ELSE 0 END AS pos FROM units WHERE pos % 9 <> 5)
SELECT case_id, pos, 'unmapped' AS finding FROM units ANTI JOIN g USING (case_id, pos) UNION ALL SELECT case_id, pos, 'unknown_unit' FROM g ANTI JOIN units USING (case_id, pos)
UNION ALL SELECT case_id, pos, 'owned_twice' FROM g GROUP BY ALL HAVING count(*) > 1""",
    "session_gaps": """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 8 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, count(*) AS events FROM s GROUP BY user_id, g""",
}
