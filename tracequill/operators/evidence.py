"""Joins and aggregations over claims, spans, reviews and snapshots."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tracequill.functions import text as T
from tracequill.functions.folds import settled
from tracequill.operators.terms import Lookup
from tracequill.session import written

#: Characters of a case's texts that :func:`quoted_in` holds in one task.
CASE_LETTERS = 4_000_000


def dangling(refs: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """References without a target; the other way round it is a completeness check."""
    return refs.join(known, keys, "left_anti")


def full_diff(baseline: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Change of each key: added, removed, unchanged, mechanical (same meaning and support) or modified.

    Both sides: keys, full_hash, semantic_hash, support_hash.
    """
    hashes = ("full_hash", "semantic_hash", "support_hash")
    old = baseline.select(*keys, *(F.col(h).alias(f"old_{h}") for h in hashes), F.lit(True).alias("was"))
    new = current.select(*keys, *hashes, F.lit(True).alias("is"))
    same = {h: F.col(h).eqNullSafe(F.col(f"old_{h}")) for h in hashes}
    change = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("is").isNull(), "removed")
        .when(same["full_hash"], "unchanged")
        .when(same["semantic_hash"] & same["support_hash"], "mechanical")
        .otherwise("modified")
    )
    return old.join(new, keys, "full").select(*keys, change.alias("change"))


#: Hash buckets of grams whose counts order prefixes; a bounded table, whatever the corpus.
GRAM_BUCKETS = 4096


def _prefix(grams: str, often: list[int], threshold: float) -> Column:
    """The rarest floor((1 - t) n) + 1 of an array's ``n`` grams, by the counts of their buckets; made in Arrow batches."""

    def prefixes(sets: pa.Array) -> pa.Array:
        places: dict[str, tuple[int, str]] = {}
        out = []
        for own in (own or [] for own in sets.to_pylist()):
            for x in own:
                if x not in places:
                    places[x] = often[zlib.crc32(x.encode()) % GRAM_BUCKETS], x
            out.append(sorted(own, key=places.__getitem__)[: math.floor((1 - threshold) * len(own) + 1e-9) + 1])
        return pa.array(out, pa.list_(pa.string()))

    return F.arrow_udf(prefixes, "array<string>")(F.col(grams))


def similar_pairs(rows: DataFrame, threshold: float) -> DataFrame:
    """(case_id, p, pos), p < pos, of rows of a case whose gram sets have a Jaccard similarity of ``threshold`` or more. ``rows``: case_id, pos, g; a written table.

    Prefix filter: such sets share one of their first floor((1 - t) n) + 1 grams in any one order. Grams go by
    how often their hash bucket occurs, rarest first, so common ones join nothing. The prefix is cut in the row, and no other gram is ever a row.
    """
    bucket = F.pmod(F.crc32(F.col("x").cast("binary")), F.lit(GRAM_BUCKETS)).cast("int")
    counted = rows.select(F.explode("g").alias("x")).groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()  # GRAM_BUCKETS rows at most
    often = [0] * GRAM_BUCKETS
    for r in counted:
        often[r.b] = r.n
    n = F.size("g")
    first = written(rows.sparkSession, rows.filter(n > 0).select("case_id", "pos", n.alias("n"), F.explode(_prefix("g", often, threshold)).alias("gram")), "prefixes")
    left = first.select("case_id", "gram", F.col("pos").alias("p"), F.col("n").alias("m"))
    close = F.least("m", "n") >= threshold * F.greatest("m", "n") - 1e-9
    pairs = left.join(first, ["case_id", "gram"]).filter((F.col("p") < F.col("pos")) & close).select("case_id", "p", "pos").distinct()
    earlier = rows.select("case_id", F.col("pos").alias("p"), F.col("g").alias("h"))
    return pairs.join(rows, ["case_id", "pos"]).join(earlier, ["case_id", "p"]).filter(T.jaccard(F.col("g"), F.col("h")) >= threshold).select("case_id", "p", "pos")


def _texts(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two tables: case_id, pos, id and plain (a normalised text) of each claim; case_id, plain, pos (of its first claim) and g (its grams) of each distinct text."""
    own = written(claims.sparkSession, claims.select("case_id", "pos", "id", T.normalized_claim(F.col("statement")).alias("plain")), "claims")
    first = own.groupBy("case_id", "plain").agg(F.min("pos").alias("pos"))
    return own, written(claims.sparkSession, first.select("case_id", "plain", "pos", T.grams(F.col("plain")).alias("g")), "claim-texts")


def near_duplicates(claims: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(case_id, id) of claims that are near duplicates of any earlier claim of the case, by Jaccard of bigrams.

    Equal texts are one until the end: a claim is a near duplicate if its text has an earlier claim, or a similar text has.
    """
    own, texts = _texts(claims)
    near = similar_pairs(texts, threshold)
    least = near.groupBy("case_id", "pos").agg(F.min("p").alias("p"))
    earliest = texts.join(least, ["case_id", "pos"], "left").filter(F.size("g") > 0)
    known = earliest.select("case_id", "plain", F.least("pos", F.coalesce("p", "pos")).alias("_first"))
    return own.join(known, ["case_id", "plain"]).filter(F.col("pos") > F.col("_first")).select("case_id", "id").distinct()


def _held(texts: list[tuple[str | None, str]], least: int) -> Iterator[tuple[str | None, str | None, int]]:
    """quote_id, first_match and matches of one case's (id, plain)."""
    same: dict[str, list] = {}
    for name, plain in texts:
        same.setdefault(plain, []).append(name)
    first = {plain: min((x for x in ids if x is not None), default=None) for plain, ids in same.items()}
    found = {plain: [None, 0] for plain in same if len(plain) >= least}
    lookup = Lookup(found)
    for plain in found:
        for quote in lookup.found(plain):
            own = found[quote]
            own[1] += len(same[plain])
            if own[0] is None or (first[plain] is not None and first[plain] < own[0]):
                own[0] = first[plain]
    total: dict[str | None, list] = {}
    for plain, (at, n) in found.items():
        for name in same[plain]:
            own = total.setdefault(name, [None, 0])
            own[1] += n
            if own[0] is None or (at is not None and at < own[0]):
                own[0] = at
    for name, (at, n) in total.items():
        yield name, at, n


def _by_grams(texts: DataFrame, least: int) -> DataFrame:
    """:func:`quoted_in` of cases of any size: the first grams of quotes are held against every gram of the case's different texts."""
    letters = F.col("letters")
    same = texts.groupBy("case_id", "plain").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    held = settled(same.filter(F.length("plain") >= least).withColumn("of", F.sha2("plain", 256)))
    held = settled(held.withColumn("letters", F.split("plain", "")))
    starts = F.sequence(F.lit(1), F.length("plain") - least + 1)
    gram = lambda i: F.concat(*(F.element_at(letters, i + k) for k in range(least)))
    grams = held.select("case_id", "of", F.explode(F.array_distinct(F.transform(starts, gram))).alias("gram"))
    quotes = held.select("case_id", F.col("plain").alias("quote"), F.array_join(F.slice(letters, 1, least), "").alias("gram"))
    whole = quotes.join(grams, ["case_id", "gram"]).join(held.select("case_id", "of", "plain", "id", "n"), ["case_id", "of"]).filter(F.contains("plain", "quote"))
    found = whole.groupBy("case_id", F.col("quote").alias("plain")).agg(F.min("id").alias("at"), F.sum("n").alias("n"))
    rows = texts.join(found, ["case_id", "plain"])
    return rows.groupBy("case_id", F.col("id").alias("quote_id")).agg(F.min("at").alias("first_match"), F.sum("n").alias("matches"))


def quoted_in(quotes: DataFrame, least: int = 6, most: int = CASE_LETTERS) -> DataFrame:
    """(case_id, id, plain) -> case_id, quote_id, first_match and matches: the claims of the case that contain a quote's text.

    Quotes have ``least`` characters or more. A case's texts come to one task and are matched there; cases of over ``most``
    characters pass through and are matched by their grams over all tasks, so no task holds more than one such share.
    """
    spark = quotes.sparkSession
    rows = quotes.select("case_id", "id", "plain").filter(F.col("case_id").isNotNull() & (F.length("plain") >= least))
    types = {f.name: f.dataType for f in rows.schema}
    out = ST.StructType([ST.StructField(c, t) for c, t in (("case_id", types["case_id"]), ("quote_id", types["id"]), ("first_match", types["id"]), ("matches", ST.LongType()), ("plain", ST.StringType()))])

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        case, texts, letters, kinds = None, [], 0, None
        done: list[tuple] = []

        def close() -> None:
            done.extend((case, *found, None) for found in _held(texts, least))

        def sent() -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else [()] * 5
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], names=out.names)
            done.clear()
            return batch

        for batch in batches:
            kinds = [*(batch.schema.field(c).type for c in ("case_id", "id", "id")), pa.int64(), pa.string()]
            for this, name, plain in zip(*(batch.column(c).to_pylist() for c in ("case_id", "id", "plain")), strict=True):
                if this != case:
                    close()
                    case, texts, letters = this, [], 0
                    if len(done) >= 10_000:
                        yield sent()
                letters += len(plain)
                texts.append((name, plain))
                if letters > most:  # this and all that follow of the case
                    done.extend((case, name, None, None, plain) for name, plain in texts)
                    texts = []
            if done:
                yield sent()
        if kinds:
            close()
            yield sent()

    by_case = rows.repartition("case_id").sortWithinPartitions("case_id").mapInArrow(matched, out)
    stored = written(spark, by_case, "quoted")
    small, large = stored.filter("plain IS NULL").drop("plain"), stored.filter("plain IS NOT NULL")
    if large.isEmpty():
        return small
    return small.unionByName(_by_grams(large.select("case_id", F.col("quote_id").alias("id"), "plain"), least))


def leaders(pairs: DataFrame) -> DataFrame:
    """(case_id, pos, lead) of all rows that the greedy order drops: ``lead`` is the first kept row that each resembles.

    ``pairs``: case_id, p, pos of similar rows, p earlier. A row is kept if no kept row before it is
    similar. In each round rows whose earlier similar rows are all decided are decided; rounds follow the
    longest chain of rows that wait for one another, and only undecided pairs go on.
    """
    spark = pairs.sparkSession
    edges = written(spark, pairs, "similar")
    open_, dropped = edges, edges.select("case_id", "pos").limit(0)
    while not open_.isEmpty():
        waiting = open_.select("case_id", "pos").distinct()
        free = open_.select("case_id", "p").distinct().join(waiting.withColumnRenamed("pos", "p"), ["case_id", "p"], "left_anti")
        gone = written(spark, open_.join(free, ["case_id", "p"], "left_semi").select("case_id", "pos").distinct(), "dropped")
        dropped = dropped.unionByName(gone)
        rest = open_.join(gone, ["case_id", "pos"], "left_anti").join(gone.withColumnRenamed("pos", "p"), ["case_id", "p"], "left_anti")
        open_ = written(spark, rest, "undecided")
    kept = edges.select("case_id", F.col("p").alias("pos")).distinct().join(dropped, ["case_id", "pos"], "left_anti")
    led = edges.join(dropped, ["case_id", "pos"], "left_semi").join(kept.withColumnRenamed("pos", "p"), ["case_id", "p"], "left_semi")
    return led.groupBy("case_id", "pos").agg(F.min("p").alias("lead"))


def greedy_merge(claims: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(case_id, id, kept_id): in order of arrival each claim joins the kept claim of equal text, else the first kept one it resembles, else it is kept.

    Equal texts are one; similar ones are found by :func:`similar_pairs` and decided by rounds (:func:`leaders`), so a case may hold any number of claims.
    """
    own, texts = _texts(claims)
    led = leaders(similar_pairs(texts, threshold))
    places = texts.join(led, ["case_id", "pos"], "left").select("case_id", "plain", F.coalesce("lead", "pos").alias("_lead"))
    named = own.groupBy("case_id", F.col("pos").alias("_lead")).agg(F.min("id").alias("kept_id"))
    return own.join(places, ["case_id", "plain"]).join(named, ["case_id", "_lead"]).select("case_id", "id", "kept_id")


def importance_histogram(claims: DataFrame) -> DataFrame:
    counts = [F.count_if(F.col("importance") == level).alias(level) for level in ("high", "medium", "low")]
    return claims.groupBy("case_id", "theme_id").agg(*counts)


def ratio(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(T.rounded(part / whole))


def consensus_pairs(reviews: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Both reviewers of each claim side by side, shared blocks and conflict triggers.

    Agreement on anything but ``covered`` raises no trigger: it is a finding, no dispute.
    """
    side = lambda role: reviews.filter(F.col("role") == role).select("case_id", "evidence_ref", F.struct("verdict", "confidence", "issue_type", "blocks").alias(role.lower()), F.col("importance").alias(f"importance_{role.lower()}"), F.col("theme_id").alias(f"theme_{role.lower()}"))
    both = side("A").join(side("B"), ["case_id", "evidence_ref"], "full")
    shared = F.array_intersect(F.coalesce("a.blocks", F.array().cast("array<string>")), F.coalesce("b.blocks", F.array().cast("array<string>")))
    agreed_gap = F.coalesce((F.col("a.verdict") == F.col("b.verdict")) & (F.col("a.verdict") != "covered"), F.lit(False))
    rules = [
        ("verdict_conflict", ~F.coalesce(F.col("a.verdict") == F.col("b.verdict"), F.lit(False))),
        ("block_conflict", F.coalesce((F.col("a.verdict") == "covered") & (F.col("b.verdict") == "covered"), F.lit(False)) & (F.size(shared) == 0)),
        ("low_confidence", (F.coalesce("a.confidence", F.lit(0.0)) < threshold) | (F.coalesce("b.confidence", F.lit(0.0)) < threshold)),
        ("contradiction", F.coalesce(F.col("a.verdict") == "contradicted", F.lit(False)) | F.coalesce(F.col("b.verdict") == "contradicted", F.lit(False))),
        ("issue_type", (F.coalesce("a.issue_type", F.lit("none")) != "none") | (F.coalesce("b.issue_type", F.lit("none")) != "none")),
    ]
    triggers = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)))
    return both.select(
        "case_id", "evidence_ref", F.coalesce("importance_a", "importance_b").alias("importance"), F.coalesce("theme_a", "theme_b").alias("theme_id"), "a", "b",
        shared.alias("shared_blocks"), F.when(agreed_gap, F.array().cast("array<string>")).otherwise(triggers).alias("triggers"),
    )


def coverage_consensus(pairs: DataFrame, adjudications: DataFrame) -> DataFrame:
    """Final verdict: the adjudicator's where there are triggers (else ``unresolved``), A's and B's where they agree. Triggers are kept."""
    ruled = adjudications.select("case_id", "evidence_ref", F.col("verdict").alias("ruling"))
    disputed = F.size("triggers") > 0
    final = F.when(disputed, F.coalesce("ruling", F.lit("unresolved"))).otherwise(F.col("a.verdict"))
    joined = pairs.join(ruled, ["case_id", "evidence_ref"], "left")
    return joined.select("case_id", "evidence_ref", "importance", "theme_id", final.alias("verdict"), disputed.alias("disputed"), "shared_blocks", "triggers")


def recall_triggers(rows: DataFrame) -> DataFrame:
    """Adjudication targets among aligned candidates.

    ``rows``: importance, calibrated, validity, relation, material (boolean).
    """
    high = F.col("importance") == "high"
    out = (F.col("validity") != "valid") | (F.col("calibrated") == "excluded")
    rules = [
        ("high_exclusion", high & out),
        ("high_downgrade", high & ~out & (F.col("calibrated") != "high")),
        ("high_nonmaterial_partial", high & (F.col("relation") == "partial") & ~F.col("material")),
        ("high_boundary", high & (F.col("relation") == "disputed")),
        ("medium_boundary", ((F.col("importance") == "medium") | (F.col("calibrated") == "medium")) & F.col("relation").isin("partial", "unmatched")),
    ]
    return rows.withColumn("triggers", F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules))))


def recalled() -> Column:
    return F.col("relation").isin("equivalent", "subsumed") | ((F.col("relation") == "partial") & ~F.col("material"))


def theme_recall(rows: DataFrame) -> DataFrame:
    """Recall, material misses and gap by theme of the calibrated high and medium candidates."""
    main = rows.filter(F.col("calibrated").isin("high", "medium")).withColumn("theme_id", F.coalesce("theme_id", F.lit("unassigned")))
    found = main.groupBy("case_id", "theme_id").agg(F.count(F.lit(1)).alias("candidates"), F.count_if(recalled()).alias("matched"), F.count_if(~recalled() & F.col("material")).alias("material_misses"))
    rate = F.col("matched") / F.col("candidates")
    return found.select("*", T.rounded(rate).alias("recall"), ((F.col("candidates") >= 3) & (F.col("material_misses") >= 2) & (rate < 0.95)).alias("gap"))


def reader_scores(scores: DataFrame, weights: dict[str, float], core: list[str], clean: int = 4, borderline: int = 3, average: float = 3.8, most_threes: int = 2) -> DataFrame:
    """Weighted average and class (clean_pass, borderline, revise) of (review_id, dimension, score) rows."""
    weight = F.lit(0.0)
    for dimension, value in weights.items():
        weight = F.when(F.col("dimension") == dimension, F.lit(value)).otherwise(weight)
    ok = F.col("score").between(1, 5)
    found = scores.groupBy("review_id").agg(
        (F.sum(F.when(ok, F.col("score") * weight)) / F.sum(F.when(ok, weight))).alias("average"),
        F.count_if(F.col("score") == 3).alias("threes"), F.min("score").alias("least"), F.count_if(~ok).alias("invalid"),
        F.count_if(F.col("dimension").isin(core) & (F.col("score") <= 2)).alias("core_low"),
    )
    kind = (
        F.when((F.col("invalid") == 0) & (F.col("least") >= clean), "clean_pass")
        .when((F.col("invalid") == 0) & (F.col("least") >= borderline) & (F.col("average") >= average) & (F.col("threes") <= most_threes), "borderline")
        .otherwise("revise")
    )
    return found.select("review_id", T.rounded(F.col("average")).alias("average"), "threes", "core_low", kind.alias("classification"))


def quote_repair(spans: DataFrame, units: DataFrame) -> DataFrame:
    """Fill missing quotes of contiguous spans from their units; ``action``: kept, filled or refused.

    ``spans``: case_id, span_id, ord, pos, quote.
    """
    from .segments import contiguous

    joined = spans.join(units.select("case_id", "pos", "text"), ["case_id", "pos"], "left")
    text = joined.groupBy("case_id", "span_id").agg(F.max("quote").alias("quote"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("u"))
    known = spans.join(units.select("case_id", "pos", F.col("pos").alias("found")), ["case_id", "pos"], "left").select("case_id", "span_id", "ord", F.col("found").alias("pos"))
    whole = T.normalize_text(F.array_join(F.transform("u", lambda x: x["text"]), " "))
    rows = text.join(contiguous(known), ["case_id", "span_id"])
    action = F.when(F.col("quote").isNotNull(), "kept").when(F.col("contiguous"), "filled").otherwise("refused")
    return rows.select("case_id", "span_id", action.alias("action"), F.when(action == "filled", whole).otherwise(F.col("quote")).alias("quote"))


def lineage_errors(entries: DataFrame) -> DataFrame:
    """Entries (entry_id, kind, old_refs, new_refs) whose numbers of refs do not fit their kind."""
    old, new = F.size("old_refs"), F.size("new_refs")
    fits = (
        F.when(F.col("kind").isin("preserved", "rewritten"), (old == 1) & (new == 1))
        .when(F.col("kind") == "split", (old == 1) & (new >= 2))
        .when(F.col("kind") == "merged", (old >= 2) & (new == 1))
        .when(F.col("kind") == "retired", (old >= 1) & (new == 0))
        .when(F.col("kind") == "new", (old == 0) & (new >= 1))
        .otherwise(F.lit(False))
    )
    return entries.filter(~fits).select("entry_id", "kind")


def change_mode(changes: DataFrame, structure: DataFrame) -> DataFrame:
    """Review mode of each case from its claim changes and whether its structure (boolean) changed."""
    found = changes.groupBy("case_id").agg(F.count_if(F.col("change").isin("added", "removed", "modified")).alias("meaning"), F.count_if(F.col("change") == "mechanical").alias("mechanical"))
    mode = F.when(F.col("structural"), "structural_full").when(F.col("meaning") > 0, "semantic_delta").otherwise("mechanical")
    reason = (
        F.when(F.col("structural"), "source_changed")
        .when(F.col("meaning") > 0, "claim_semantics_changed")
        .when(F.col("mechanical") > 0, "only_other_fields_changed")
        .otherwise("no_changes")
    )
    return found.join(structure, "case_id").select("case_id", mode.alias("mode"), reason.alias("reason"), (mode != "mechanical").alias("claim_audit"), F.col("structural").alias("full_audit"))


def profile_decision(scores: DataFrame, least: float = 0.75, lead: float = 0.15) -> DataFrame:
    """(case_id, profile, score): the top profile if high enough and far enough ahead, else pending."""
    order = Window.partitionBy("case_id").orderBy(F.desc("score"), "profile")
    ranked = scores.withColumn("k", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).withColumn("runner_up", F.lead("profile").over(order)).filter("k = 1")
    ahead = F.col("score") - F.coalesce("second", F.lit(0.0))
    accepted = (F.col("score") >= least) & (ahead >= lead)
    return ranked.select("case_id", F.when(accepted, F.col("profile")).alias("primary"), F.col("profile").alias("top"), "runner_up", T.rounded(ahead, 3).alias("lead"), (~accepted).alias("pending"))


def profile_scores(units: DataFrame, lexicon: dict[str, list[str]], metadata: DataFrame) -> DataFrame:
    """case_id, profile, score = 0.2 + 0.75 * raw / max(1, greatest raw), at most 0.95; raw = 2.5 * hits in metadata + hits in text.

    ``metadata``: case_id, meta. Texts of a case are searched unit by unit, a term counts once.
    """
    low = F.lower("text")
    flags = {(p, t): f"h{i}" for i, (p, t) in enumerate((p, t) for p, ts in lexicon.items() for t in ts)}
    found = units.groupBy("case_id").agg(*(F.max(F.contains(low, F.lit(t.lower())).cast("int")).alias(name) for (_, t), name in flags.items()))
    joined = found.join(metadata, "case_id")
    raw = {p: 2.5 * T.term_hits(F.col("meta"), ts) + sum((F.col(flags[p, t]) for t in ts), F.lit(0)) for p, ts in lexicon.items()}
    most = F.greatest(F.lit(1.0), *raw.values()) if len(raw) else F.lit(1.0)
    rows = joined.select("case_id", F.explode(F.array(*(F.struct(F.lit(p).alias("profile"), T.rounded(F.least(F.lit(0.95), 0.2 + r / most * 0.75), 3).alias("score"), r.alias("raw")) for p, r in raw.items()))).alias("x"))
    return rows.select("case_id", "x.*")


def staleness(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """(case_id, hashes map) on both sides -> key-wise state: stale, missing or added."""
    old = declared.select("case_id", F.explode("hashes").alias("key", "was"))
    new = actual.select("case_id", F.explode("hashes").alias("key", "now"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "added").when(F.col("was") != F.col("now"), "stale")
    return old.join(new, ["case_id", "key"], "full").withColumn("state", state).filter("state IS NOT NULL").select("case_id", "key", "state")


def page_breaks(pages: DataFrame, target: int, maximum: int, least: int = 200) -> DataFrame:
    """(page_id, height, breaks array) -> boundaries: greedy, the last safe break within target, else within maximum, else a hard cut."""
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("height") / least).cast("int")))
    rows = pages.select("page_id", "height", F.array_sort(F.array_distinct("breaks")).alias("breaks"), steps.alias("steps"))
    within = "filter(breaks, b -> b > element_at(a, -1) + {least} AND b <= element_at(a, -1) + {reach} AND b > 0 AND b < height)"
    best = f"coalesce(array_max({within.format(least=least, reach=target)}), array_max({within.format(least=least, reach=maximum)}), least(element_at(a, -1) + {maximum}, height))"
    fold = f"aggregate(steps, array(0), (a, s) -> CASE WHEN height - element_at(a, -1) > {maximum} THEN array_append(a, cast({best} AS int)) ELSE a END, a -> array_append(a, cast(height AS int)))"
    return rows.select("page_id", F.expr(fold).alias("boundaries"))
