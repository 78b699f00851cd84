"""Exclusion, segmentation and context of ordered source units (case_id, pos, id, text, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracequill.functions import text as T
from tracequill.functions.folds import first_at_least, least_after, orbit, settled, sums_before

#: Defaults of our own; callers give theirs.
GREETING = r"(?i)^(?:hello|hi|hey|ok(?:ay)?|thanks|thank you|hola|salut|merci|danke|gracias)[!,. ]*$"
PROMOTION = r"(?i)(?:subscribe.{0,12}channel|(?:promo|discount|coupon) code|sponsored by|use code)"
STAGE = r"^(?:\[[^\]]{1,24}\]|\([^)]{1,24}\))$"
SOUND = r"(?i)music|applause|laugh|noise"


def exclusions(units: DataFrame, greeting: str = GREETING, promotion: str = PROMOTION, sound: str = SOUND) -> DataFrame:
    """Adds ``kind``: noise, greeting, advertisement, duplicate (of the last unit that stayed) or null; first match wins.

    A run of equal units compares equal to its predecessor, so the last survivor of the
    row-local rules stands for the running comparison. One shuffle, by case.
    """
    text, n = F.col("_norm"), F.col("_size")
    local = (
        F.when(text == "", "noise")
        .when(text.rlike(STAGE) & text.rlike(sound), "noise")
        .when((n <= 12) & text.rlike(greeting), "greeting")
        .when((n <= 80) & text.rlike(promotion), "advertisement")
    )
    marked = settled(units.withColumn("_norm", T.normalize_text(F.col("text")))).withColumn("_size", T.compact_characters(text)).withColumn("_local", local).drop("_size")
    earlier = Window.partitionBy("case_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_local").isNull(), F.col("_norm")), ignorenulls=True).over(earlier)
    again = F.col("_local").isNull() & F.coalesce(last == F.col("_norm"), F.lit(False))
    return marked.withColumn("kind", F.when(again, "duplicate").otherwise(F.col("_local"))).drop("_local", "_norm")


def _cases(units: DataFrame, keys: list[str]) -> DataFrame:
    """One row a case: its units in order, their characters ``_n`` and the sums before each ``_c`` (and in all)."""
    others = [c for c in units.columns if c not in (*keys, "pos")]
    rows = units.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", *others))).alias("_u"))
    rows = settled(rows.withColumn("_n", F.transform("_u", lambda x: T.compact_characters(x["text"]).cast("long"))))
    return rows.withColumn("_c", F.expr(f"array_append({sums_before('_n')}, aggregate(_n, 0L, (a, x) -> a + x))")).drop("_n")


def _runs(rows: DataFrame, after: str) -> DataFrame:
    """Adds ``_runs``: (start, stop) of the runs that greedy breaking makes.

    ``after``: SQL text of where a run from unit ``i`` ends. ``_ends`` and ``_hard`` say whether a unit ends a
    sentence and whether a run must break before it; ``_sentence`` and ``_break`` become the first such place from each place on, after it.
    """
    rows = rows.withColumn("_s", F.expr("transform(sequence(0, size(_ends)), j -> cast(CASE WHEN j > 0 AND _ends[j - 1] THEN j ELSE size(_ends) END AS bigint))"))
    rows = settled(rows.withColumn("_h", F.expr("transform(_hard, (h, j) -> cast(CASE WHEN h THEN j ELSE size(_hard) END AS bigint))")))
    rows = rows.withColumn("_sentence", F.expr(f"zip_with(_s, {least_after('_s', 'size(_u)')}, (a, b) -> least(a, b))")).withColumn("_break", F.expr(least_after("_h", "size(_u)"))).drop("_s", "_h", "_ends", "_hard")
    rows = settled(settled(rows).withColumn("_after", F.expr(f"transform(sequence(0, size(_u)), i -> cast(CASE WHEN i = size(_u) THEN i ELSE {after} END AS int))")))
    return settled(rows.withColumn("_runs", F.expr(f"transform({orbit('_after')}, s -> named_struct('start', s, 'stop', _after[s]))"))).drop("_sentence", "_break", "_after")


def segmented(included: DataFrame, maximum: int = 1200, preferred: int = 650, most_units: int = 48, max_gap_ms: int = 8000) -> DataFrame:
    """Adds ``segment`` (1, 2, ... in a case) by greedy breaking.

    Where a segment ends depends on where it starts alone: prefix sums of characters, the next sentence
    end and the next heading or time gap give each unit the end of a segment that would start
    there, and pointer doubling follows these from the first unit. One shuffle by case, n log n in a case.
    """
    columns = included.columns
    rows = _cases(included, ["case_id"])

    def hard(x, i):
        test = F.lit(False)
        last = F.get("_u", i - 1)
        if "heading" in columns:
            test = test | ((x["heading"] != last["heading"]) & (x["heading"] != "") & (last["heading"] != ""))
        if "start_ms" in columns:
            test = test | (x["start_ms"] - last["end_ms"] > max_gap_ms)
        return F.coalesce((i > 0) & test, F.lit(False))

    rows = settled(rows.withColumn("_ends", F.transform("_u", lambda x: x["text"].rlike(T.SENTENCE_END))).withColumn("_hard", F.transform("_u", hard)))
    after = f"least(i + {most_units}, size(_u), {first_at_least('_c', f'_c[i] + {maximum}', 'm')}, _sentence[least(size(_u), {first_at_least('_c', f'_c[i] + {preferred}', 'p')})], _break[i])"
    placed = F.flatten(F.transform("_runs", lambda r, k: F.transform(F.slice("_u", r["start"] + 1, r["stop"] - r["start"]), lambda x: F.struct(x.alias("x"), (k + 1).alias("segment")))))
    out = _runs(rows, after).select("case_id", F.explode(placed).alias("_p"))
    return out.select(*(F.col("case_id") if c == "case_id" else F.col(f"_p.x.{c}").alias(c) for c in columns), F.col("_p.segment").cast("int").alias("segment"))


def segment_table(units: DataFrame, context: int = 2) -> DataFrame:
    """One row per segment of :func:`segmented`: ids, text, first and last unit, and context units before and after."""
    order = Window.partitionBy("case_id").orderBy("pos")
    near = units.withColumn("_before", F.array_sort(F.collect_list("pos").over(order.rowsBetween(-context, -1)))).withColumn("_after", F.collect_list("pos").over(order.rowsBetween(1, context)))
    grouped = near.groupBy("case_id", "segment").agg(
        F.array_sort(F.collect_list(F.struct("pos", "id", "text"))).alias("u"),
        F.min_by("_before", "pos").alias("context_before"),
        F.max_by("_after", "pos").alias("context_after"),
        F.min_by("id", "pos").alias("first_id"),
        F.max_by("id", "pos").alias("last_id"),
    )
    text = T.normalize_text(F.array_join(F.transform("u", lambda x: x["text"]), " "))
    return grouped.select("case_id", "segment", F.transform("u", lambda x: x["id"]).alias("source_ids"), text.alias("text"), "context_before", "context_after", "first_id", "last_id")


def speakers(units: DataFrame, participants: DataFrame, minimum: float = 0.85) -> DataFrame:
    """case_id, segment, name, status and confidence from a prefix that all prefixed units share.

    ``participants``: case_id, name. A participant that contains the prefix confirms it.
    """
    prefixed = units.withColumn("_p", T.speaker_prefix(F.col("text")))
    found = prefixed.groupBy("case_id", "segment").agg(F.count(F.lit(1)).alias("n"), F.count("_p").alias("k"), F.count_distinct("_p").alias("d"), F.min("_p").alias("prefix"))
    found = found.withColumn("prefix", F.when(F.col("d") == 1, F.col("prefix")))
    names = participants.withColumnRenamed("case_id", "_case")
    known = found.join(names, (F.col("case_id") == F.col("_case")) & F.contains("name", F.col("prefix")), "left").groupBy("case_id", "segment", "n", "k", "prefix").agg(F.min("name").alias("known"))
    level = F.when(F.col("k") >= F.greatest(F.lit(2), F.ceil(F.col("n") * 0.6)), 0.8).otherwise(0.6)
    confidence = F.when(F.col("prefix").isNull(), 0.0).when(F.col("known").isNotNull(), 1.0).otherwise(level)
    status = F.when(F.col("prefix").isNull(), "unknown").when(F.col("known").isNotNull(), "confirmed").when(level < minimum, "unknown").otherwise("inferred")
    return known.select("case_id", "segment", F.when(status == "confirmed", F.col("known")).when(status == "inferred", F.col("prefix")).alias("name"), status.alias("status"), confidence.alias("confidence"))


def uniform_sample(units: DataFrame, n: int = 32) -> DataFrame:
    """At most ``n`` evenly spread units of each case: index round(i * (N - 1) / (n - 1))."""
    case = Window.partitionBy("case_id")
    ranked = units.withColumn("_i", F.row_number().over(case.orderBy("pos")) - 1).withColumn("_n", F.count(F.lit(1)).over(case))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_n") - 1) / (n - 1) + 0.5).cast("int"))
    return ranked.filter((F.col("_n") <= n) | F.array_contains(wanted, F.col("_i"))).drop("_i", "_n")


def contiguous(spans: DataFrame) -> DataFrame:
    """(case_id, span_id, ord, pos) -> case_id, span_id, contiguous: positions grow by exactly one in span order; unknown ones do not."""
    step = F.col("pos") - F.lag("pos").over(Window.partitionBy("case_id", "span_id").orderBy("ord"))
    first = F.row_number().over(Window.partitionBy("case_id", "span_id").orderBy("ord")) == 1
    ok = F.col("pos").isNotNull() & (first | F.coalesce(step == 1, F.lit(False)))
    return spans.withColumn("_ok", ok).groupBy("case_id", "span_id").agg(F.bool_and("_ok").alias("contiguous"))


def compact_ranges(refs: DataFrame) -> DataFrame:
    """(key, ord, ref) -> key, ranges: neighbours that count up by one under one prefix become ``first–last``; order is kept."""
    first = refs.groupBy("key", "ref").agg(F.min("ord").alias("ord"))
    number = F.regexp_extract("ref", r"^[A-Za-z]+(\d+)$", 1)
    parsed = first.withColumn("p", F.regexp_extract("ref", r"^([A-Za-z]+)\d+$", 1)).withColumn("n", number.try_cast("long"))
    order = Window.partitionBy("key").orderBy("ord")
    joins = (F.col("p") == F.lag("p").over(order)) & (F.col("n") == F.lag("n").over(order) + 1)
    islands = parsed.withColumn("g", F.sum((~F.coalesce(joins, F.lit(False))).cast("int")).over(order))
    runs = islands.groupBy("key", "g").agg(F.min_by("ref", "ord").alias("a"), F.max_by("ref", "ord").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.concat("a", F.lit("–"), "b"))
    return runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("g", text.alias("t")))).alias("x")).select("key", F.transform("x", lambda y: y["t"]).alias("ranges"))


def unit_groups(units: DataFrame, maximum: int = 150, enough: int = 65, least: int = 8, sentence_end: str = T.SENTENCE_END + r"|\.$") -> DataFrame:
    """Greedy groups of neighbouring units of (case_id, segment, pos, text) for seeding claims; short ones go.

    A group breaks at a gap in ``pos``, before it exceeds ``maximum`` characters, and after a sentence end from ``enough`` characters on.
    """
    rows = _cases(units.select("case_id", "segment", "pos", "text"), ["case_id", "segment"])
    gap = lambda x, i: F.coalesce((i > 0) & (x["pos"] != F.get("_u", i - 1)["pos"] + 1), F.lit(False))
    rows = settled(rows.withColumn("_ends", F.transform("_u", lambda x: x["text"].rlike(sentence_end))).withColumn("_hard", F.transform("_u", gap)))
    after = f"least(size(_u), greatest(i + 1, {first_at_least('_c', f'_c[i] + {maximum + 1}', 'm')} - 1), _sentence[least(size(_u), {first_at_least('_c', f'_c[i] + {enough}', 'p')})], _break[i])"
    run = F.col("_r")
    found = _runs(rows, after).select("*", F.explode("_runs").alias("_r"))
    at = lambda c, i: F.get(c, i)
    out = found.select("case_id", "segment", at("_u", run["start"])["pos"].alias("first_pos"), at("_u", run["stop"] - 1)["pos"].alias("last_pos"), (at("_c", run["stop"]) - at("_c", run["start"])).alias("characters"))
    return out.filter(F.col("characters") >= least)
