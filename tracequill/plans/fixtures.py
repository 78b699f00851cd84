"""Evidence tables derived from the test tables by fixed rules, in Spark and in DuckDB SQL.

The test tables hold no claims, spans or reviews, so these are derived: document
lines are source units, every unit carries a claim, verdicts come from remainders.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequill.functions import text as T
from tracequill.operators import segments
from tracequill.session import spread, table, written
from tracequill.sources import parse

NORM_SQL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), "
    "'&nbsp;', ' ', 'gi'), '&amp;', '&', 'gi'), '&lt;', '<', 'gi'), '&gt;', '>', 'gi'), '[\\s\\x{{0B}}\\x{{A0}}\\x{{2028}}\\x{{3000}}]+', ' ', 'g'))"
)
COMPACT_SQL = "length(regexp_replace({x}, '[\\s\\x{{0B}}\\x{{A0}}\\x{{3000}}]', '', 'g'))"
PLAIN_SQL = "lower(regexp_replace({x}, '[\\p{{P}}\\p{{S}}\\s]', '', 'g'))"


def norm(x: str) -> str:
    return NORM_SQL.format(x=x)


def compact(x: str) -> str:
    return COMPACT_SQL.format(x=x)


def plain(x: str) -> str:
    return PLAIN_SQL.format(x=x)


GRAMS_SQL = "CASE WHEN length({x}) = 0 THEN []::VARCHAR[] WHEN length({x}) <= 2 THEN [{x}] ELSE list_distinct(list_transform(range(1, length({x})), lambda i: substr({x}, i::INT, 2))) END"


def grams(x: str) -> str:
    return GRAMS_SQL.format(x=x)


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"


def sources(spark, sf_dir: str) -> DataFrame:
    """Documents as articles: the source is the heading, each line a paragraph."""
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select(F.col("doc_id").alias("case_id"), F.concat(F.lit("# "), F.col("source"), F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("text"))


_HELD: list[dict[str, DataFrame]] = []


@contextmanager
def held() -> Iterator[None]:
    """Inside, the units of a folder are parsed once and stored, for a query that reads them several times."""
    _HELD.append({})
    try:
        yield
    finally:
        _HELD.pop()


def units(spark, sf_dir: str) -> DataFrame:
    if _HELD and sf_dir in _HELD[-1]:
        return _HELD[-1][sf_dir]
    found = parse.article_units(sources(spark, sf_dir)).select("case_id", "pos", "id", "text", "heading")
    if _HELD:
        found = _HELD[-1][sf_dir] = written(spark, found, "units")
    return found


def places(spark, sf_dir: str) -> DataFrame:
    """case_id and pos of the units: what is stored inside :func:`held` for queries that read no text."""
    if not _HELD or sf_dir in _HELD[-1]:
        return units(spark, sf_dir).select("case_id", "pos")
    key = f"places of {sf_dir}"
    if key not in _HELD[-1]:
        _HELD[-1][key] = written(spark, parse.article_units(sources(spark, sf_dir)).select("case_id", "pos"), "places")
    return _HELD[-1][key]


UNITS = f"""raw AS (SELECT doc_id AS case_id, source AS heading, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents),
units AS (SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY ln)::INT AS pos,
                 'P' || lpad(row_number() OVER (PARTITION BY case_id ORDER BY ln)::VARCHAR, 6, '0') AS id, {norm('line')} AS text, heading FROM raw WHERE {norm('line')} <> '')"""


def claims(spark, sf_dir: str) -> DataFrame:
    """Every unit is a claim over itself and the next unit; importance and theme by remainders."""
    return claims_of(units(spark, sf_dir))


def claims_of(rows: DataFrame) -> DataFrame:
    """Claims of units; of rows without texts, claims without statements."""
    statement = [F.col("text").alias("statement")] if "text" in rows.columns else []
    return rows.select(
        "case_id", "pos", F.concat(F.lit("E"), F.lpad(F.col("pos").cast("string"), 4, "0")).alias("id"), *statement,
        F.element_at(F.array(*map(F.lit, ("high", "medium", "low"))), (F.col("pos") % 3 + 1)).alias("importance"),
        F.concat(F.lit("T"), F.lpad((F.col("pos") % 5 + 1).cast("string"), 3, "0")).alias("theme_id"),
        F.when((F.col("case_id") + F.col("pos")) % 2 == 0, "source_fact").otherwise("speaker_view").alias("provenance"),
    )


CLAIMS = f"""{UNITS},
claims AS (SELECT case_id, pos, 'E' || lpad(pos::VARCHAR, 4, '0') AS id, text AS statement, ['high', 'medium', 'low'][pos % 3 + 1] AS importance,
                  'T' || lpad((pos % 5 + 1)::VARCHAR, 3, '0') AS theme_id, CASE WHEN (case_id + pos) % 2 = 0 THEN 'source_fact' ELSE 'speaker_view' END AS provenance FROM units)"""

VERDICTS = ("covered", "partial", "missing", "contradicted")


def reviews(spark, sf_dir: str) -> DataFrame:
    """Two reviewers' verdicts on each claim, with confidence, issue type and reader blocks."""
    rows = claims_of(places(spark, sf_dir)).withColumn("n", F.col("case_id") * 3 + F.col("pos"))
    out = []
    for role, step in (("A", 1), ("B", 2)):
        k = F.floor(F.col("n") / step)
        out.append(
            rows.select(
                "case_id", F.col("id").alias("evidence_ref"), "importance", "theme_id", F.lit(role).alias("role"),
                F.element_at(F.array(*map(F.lit, VERDICTS)), F.when(k % 7 < 4, F.lit(1)).otherwise((k % 4 + 1)).cast("int")).alias("verdict"),
                F.when(k % 11 == 0, 0.6).otherwise(0.9).alias("confidence"), F.when(k % 13 == 0, "wording").otherwise("none").alias("issue_type"),
                F.array(F.concat(F.lit("B"), (F.col("n") % 6).cast("string")), F.concat(F.lit("B"), ((F.col("n") + step) % 9).cast("string"))).alias("blocks"),
            )
        )
    return out[0].unionByName(out[1])


_REVIEW = """SELECT case_id, id AS evidence_ref, importance, theme_id, '{role}' AS role,
  ['covered', 'partial', 'missing', 'contradicted'][CASE WHEN ((case_id * 3 + pos) // {step}) % 7 < 4 THEN 1 ELSE ((case_id * 3 + pos) // {step}) % 4 + 1 END] AS verdict,
  CASE WHEN ((case_id * 3 + pos) // {step}) % 11 = 0 THEN 0.6 ELSE 0.9 END::DOUBLE AS confidence, CASE WHEN ((case_id * 3 + pos) // {step}) % 13 = 0 THEN 'wording' ELSE 'none' END AS issue_type,
  ['B' || ((case_id * 3 + pos) % 6), 'B' || ((case_id * 3 + pos + {step}) % 9)] AS blocks FROM claims"""
REVIEWS = f"{CLAIMS},\nreviews AS ({_REVIEW.format(role='A', step=1)} UNION ALL {_REVIEW.format(role='B', step=2)})"


def text_column(name: str):
    return T.normalize_text(F.col(name))


def span_checks(spark, sf_dir: str) -> DataFrame:
    """case_id, id, owned, contiguous and supported of each claim.

    A claim's span is its unit and the next (of every fifth, the one after), a segment is ten units, and the quote is
    the span's text, of every third claim without its stops and commas.
    """
    rows = units(spark, sf_dir).select("case_id", "pos", "text")
    at = lambda i, pos: F.struct(F.lit(i).alias("ord"), pos.alias("pos"))
    claimed = claims(spark, sf_dir).select("case_id", "id", F.col("pos").alias("span_id"), F.explode(F.array(at(0, F.col("pos")), at(1, F.col("pos") + F.when(F.col("pos") % 5 == 0, 2).otherwise(1)))).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("ord", "text")))), lambda x: x["text"]), " ")
    joined = claimed.select("case_id", "id", "span_id", "x.*").join(rows.withColumn("found", F.col("pos")), ["case_id", "pos"], "left")
    owned = F.bool_and(F.coalesce(F.floor(F.col("found") / 10) == F.floor(F.col("span_id") / 10), F.lit(False)))
    spans = joined.groupBy("case_id", "id", "span_id").agg(T.normalize_text(body).alias("body"), owned.alias("owned"))
    quote = F.when(F.col("span_id") % 3 == 0, F.regexp_replace("body", "[.,]", "")).otherwise(F.col("body"))
    steps = segments.contiguous(joined.select("case_id", "span_id", "ord", F.col("found").alias("pos")))
    return spans.join(steps, ["case_id", "span_id"]).select("case_id", "id", "owned", "contiguous", F.contains("body", quote).alias("supported"))


SPAN_CHECKS = f"""{CLAIMS},
span AS (SELECT c.case_id, c.id, c.pos, v.pos AS after, {norm("u.text || coalesce(' ' || v.text, '')")} AS body FROM claims c JOIN units u ON u.case_id = c.case_id AND u.pos = c.pos
  LEFT JOIN units v ON v.case_id = c.case_id AND v.pos = c.pos + CASE WHEN c.pos % 5 = 0 THEN 2 ELSE 1 END),
checks AS (SELECT case_id, id, coalesce(after // 10 = pos // 10, false) AS owned, coalesce(after = pos + 1, false) AS contiguous,
  contains(body, CASE WHEN pos % 3 = 0 THEN regexp_replace(body, '[.,]', '', 'g') ELSE body END) AS supported FROM span)"""
