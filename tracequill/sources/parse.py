"""Parsers of source texts into ordered units; one row per document in, one per unit out."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracequill.functions import text as T

TIMED, ARTICLE = ("srt", "vtt"), ("txt", "md")


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """path, format and the whole text of every file below ``path``."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.withColumn("format", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))


def parse_sources(sources: DataFrame) -> DataFrame:
    """Units of (case_id, format, text) by format; any other format is an error."""
    known = F.when(F.col("format").isin(*TIMED, *ARTICLE), F.col("format")).otherwise(F.raise_error(F.concat(F.lit("unsupported source format: "), F.col("format"))))
    checked = sources.withColumn("format", known)
    timed = timed_units(checked.filter(F.col("format").isin(*TIMED))).select("case_id", "pos", "id", "text", "label", "start_ms", "end_ms", F.lit(None).cast("string").alias("heading"))
    article = article_units(checked.filter(F.col("format").isin(*ARTICLE))).select(
        "case_id", "pos", "id", "text", "label", F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"), "heading"
    )
    return timed.unionByName(article)


def _numbered(units: DataFrame, letter: str, order: str) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("case_id").orderBy(order))
    return units.withColumn("pos", pos).withColumn("id", F.concat(F.lit(letter), F.lpad(F.col("pos").cast("string"), 6, "0")))


def timed_units(sources: DataFrame) -> DataFrame:
    """Cues of (case_id, text) in SRT or VTT; numbered after those without time or text are gone."""
    clean = F.regexp_replace(F.regexp_replace("text", r"^﻿", ""), r"(?i)^WEBVTT[^\n]*\n+", "")
    blocks = sources.select("case_id", F.posexplode(F.split(clean, r"\r?\n\s*\r?\n")).alias("block_pos", "block"))
    lines = F.transform(F.split("block", r"\r?\n"), lambda x: F.trim(x))
    stamp = r"(\d{1,2}:\d{2}(?::\d{2})?[,.]\d{3})\s*-->\s*(\d{1,2}:\d{2}(?::\d{2})?[,.]\d{3})"
    timed = blocks.withColumn("lines", lines).withColumn("at", F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit("-->"))), F.lit(True)))
    timed = timed.filter((F.col("at") > 0) & ~F.element_at("lines", 1).rlike(r"(?i)^NOTE\b")).withColumn("head", F.element_at("lines", F.col("at").cast("int")))
    rest = F.slice("lines", F.col("at").cast("int") + 1, F.size("lines"))
    cues = timed.select(
        "case_id", "block_pos",
        T.parse_timestamp(F.regexp_extract("head", stamp, 1)).alias("start_ms"), T.parse_timestamp(F.regexp_extract("head", stamp, 2)).alias("end_ms"),
        T.normalize_text(F.array_join(rest, " ")).alias("text"),
    ).filter("start_ms IS NOT NULL AND end_ms IS NOT NULL AND text <> ''")
    label = F.concat(T.format_timestamp(F.col("start_ms"), False), F.lit("–"), T.format_timestamp(F.col("end_ms"), False))
    return _numbered(cues, "C", "block_pos").withColumn("label", label).drop("block_pos")


_TITLE = re.compile(r"#{1,6}\s+([^\n\r\x85\u2028\u2029]+)[\r\x85\u2028\u2029]?\Z", re.A)
_INK = re.compile("[^" + T.SPACE[1:], re.A)


def _paragraphs(text: str) -> Iterator[tuple[str, str | None]]:
    """Normalised paragraphs with the title above each, or None."""
    text, title, open_lines = text.removeprefix("\ufeff"), None, []
    for line in [*(re.split(r"\r?\n", text) if "\r" in text else text.split("\n")), ""]:
        head = _TITLE.match(line) if line.startswith("#") else None
        if not head and _INK.search(line):
            open_lines.append(line)
            continue
        if open_lines:
            if body := T.normal_text(" ".join(open_lines)):
                yield body, title
            open_lines = []
        if head:
            title = T.normal_text(head[1])


def _listed(texts: pa.Array) -> pa.Array:
    bodies, titles, ends = [], [], [0]
    for raw in texts.cast(pa.binary()).to_pylist():
        for body, title in _paragraphs((raw or b"").decode("utf-8", "replace")):
            bodies.append(body)
            titles.append(title)
        ends.append(len(bodies))
    rows = pa.StructArray.from_arrays([pa.array(bodies, pa.string()), pa.array(titles, pa.string())], ["text", "title"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def article_units(sources: DataFrame, default_heading: str = "Body") -> DataFrame:
    """Paragraphs of (case_id, text): blank lines and ``#`` headings end one; each keeps the heading above it.

    Found in one row each, so nothing is shuffled, in Arrow batches: lambdas over lines and patterns cost several times as much for each line.
    """
    paragraphs = F.arrow_udf(_listed, "array<struct<text:string,title:string>>")(F.col("text"))
    found = sources.select("case_id", F.posexplode(paragraphs).alias("at", "x"))
    found = found.select("case_id", "at", F.struct("x.text", F.coalesce("x.title", F.lit(default_heading)).alias("heading")).alias("x"))
    units = found.select("case_id", F.col("x.heading").alias("heading"), F.col("x.text").alias("text"), (F.col("at") + 1).alias("pos"))
    return units.withColumn("id", F.concat(F.lit("P"), F.lpad(F.col("pos").cast("string"), 6, "0"))).withColumn("label", F.concat(F.col("heading"), F.lit(" · "), F.col("pos").cast("string")))


def section_of(text: Column, number: int) -> Column:
    """What stands between the bracketed headings ``number`` and ``number + 1``."""
    return F.trim(F.regexp_extract(text, rf"(?s)【{number}\.[^】]+】(.*?)(?:【{number + 1}\.[^】]+】|\z)", 1))


def legacy_timeline(sources: DataFrame, section: int = 3) -> DataFrame:
    """Entries ``- from–to：title`` of a section. Where any time has hours, two-part times are HH:MM, else MM:SS."""
    lines = sources.select("case_id", F.posexplode(F.split(section_of(F.col("text"), section), r"\r?\n")).alias("line_pos", "line"))
    pattern = r"^\s*[*-]\s+(\d{1,2}:\d{2}(?::\d{2})?)[-–—](\d{1,2}:\d{2}(?::\d{2})?)：\s*(.+)$"
    found = lines.select("case_id", "line_pos", *(F.regexp_extract("line", pattern, i).alias(n) for i, n in ((1, "start"), (2, "stop"), (3, "title")))).filter("start <> ''")
    case = Window.partitionBy("case_id")
    full = F.max((F.size(F.split("start", ":")) == 3) | (F.size(F.split("stop", ":")) == 3)).over(case)

    def ms(value: str) -> Column:
        return F.when(F.col("_full") & (F.size(F.split(value, ":")) == 2), T.parse_timestamp(F.concat(F.col(value), F.lit(":00")))).otherwise(T.parse_timestamp(F.col(value)))

    return found.withColumn("_full", full).select("case_id", "line_pos", ms("start").alias("start_ms"), ms("stop").alias("end_ms"), T.normalize_text(F.col("title")).alias("title"))


def png_size(files: DataFrame) -> DataFrame:
    """Width and height from the header of PNG files (path, content)."""
    number = lambda at: F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("long")
    is_png = F.hex(F.substring("content", 1, 8)) == "89504E470D0A1A0A"
    return files.filter(is_png).select("path", number(17).alias("width"), number(21).alias("height"))


def json_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Parsed rows of (line_no, line), with ``error`` naming the lines that are no JSON of the schema."""
    parsed = lines.filter("trim(line) <> ''").withColumn("row", F.from_json("line", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    error = F.when(F.col("row._bad").isNotNull() | F.col("row").isNull(), F.concat(F.lit("line "), F.col("line_no"), F.lit(" is not valid JSON")))
    return parsed.select("line_no", F.col("row").dropFields("_bad").alias("row"), error.alias("error"))
