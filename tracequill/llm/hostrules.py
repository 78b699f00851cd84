"""Host-level quality rules with an empirical beta prior.

Every document gets rule measures (:func:`document_measures`); rule failures are
counted per host, each host's failure rate is shrunk towards the corpus by a beta
prior fitted by the method of moments over all hosts, and the host verdict is
joined back to its documents. A host whose shrunk rate of a rule is above
``MAX_HOST_RATE`` is rejected with all its documents. A host is flagged for a rule if its shrunk rate
lies above the prior's mean by ``MARGIN`` posterior deviations or more; documents of a
flagged host that fail a soft rule (symbols, repeated lines) themselves are rejected, while
elsewhere a soft failure alone rejects nothing.

Defined results: null text counts as empty (no words, base rule fails); a null
host is a host of its own; repeated rows count as often as they occur; an empty
table gives an empty result; extra columns of the input are ignored. A long text is
measured whole, with memory in proportion to it; a rate exactly at a limit is not above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracequill.session import written

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW_WORDS = 8
MAX_SYMBOLS_PER_100_WORDS = 10
MAX_DUP_LINES_PER_100_LINES = 30
#: In fewer lines a repeated one says nothing.
MIN_LINES = 5
SYMBOLS = b"#*$%&|<>"
#: A host is rejected if its shrunk rate of a rule's failures is above this.
MAX_HOST_RATE = 0.5
#: A host is flagged if its shrunk rate is so many posterior deviations above the prior's mean.
MARGIN = 1.0
#: Up to so many hosts (name, counts and verdict: under 200 bytes each) the verdicts are broadcast; beyond, a salted join.
MAX_BROADCAST_HOSTS = 50_000
SALTS = 32
RULES = ("base", "symbols", "dup_lines")

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_MEASURES = "doc_id long, host string, " + ", ".join(f"{c} long" for c in _COUNTS)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def repeat_words(words: list[bytes], width: int = WINDOW_WORDS) -> int:
    """Words inside windows of ``width`` words that occur twice or more in ``words``."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = mixed * _ODD + at[k : k + n]
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0  # unequal mixes mean unequal windows
    windows = np.lib.stride_tricks.sliding_window_view(at, width)
    order = np.lexsort(windows.T[::-1])
    same = (windows[order[1:]] == windows[order[:-1]]).all(axis=1)
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    steps = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + width, -1)
    return int((np.cumsum(steps[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words."""
    words = text.split()
    if not words:
        return 0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0, 0
    solid = text.translate(None, b" \t\n\x0b\x0c\r")
    tails = np.frombuffer(solid, np.uint8) & 0xC0 == 0x80
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        len(solid) - int(tails.sum()),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
    )


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [measure(x.as_py() or b"") for x in batch.column(2)]
        cols = zip(*rows, strict=True) if rows else [[]] * 6
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols)],
            ["doc_id", "host", *_COUNTS],
        )


def document_measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row of measures for every row of ``docs``; no shuffle."""
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("binary").alias("text")
    )
    return _failures(narrow.mapInArrow(_measure_batches, _MEASURES))


def _failures(measured: DataFrame) -> DataFrame:
    return measured.select(
        "*",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        (100 * F.col("n_symbols") > MAX_SYMBOLS_PER_100_WORDS * F.col("n_words")).alias("symbols_failed"),
        ((F.col("n_lines") >= MIN_LINES) & (100 * F.col("n_dup_lines") > MAX_DUP_LINES_PER_100_LINES * F.col("n_lines"))).alias("dup_lines_failed"),
    )


def host_verdicts(measures: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, n_docs and, for each rule, the shrunk failure rate; host_ok.

    With rates r of all hosts, mean m and variance v over hosts: s = m(1-m)/v - 1
    documents of prior weight, held within 1 and 1000; shrunk = (failures + s*m) / (n + s),
    with the deviation of a beta distribution of n + s documents.
    """
    counts = measures.groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), *(F.sum(F.col(f"{r}_failed").cast("long")).alias(f"{r}_n") for r in RULES)
    )
    moments = counts.agg(
        *(
            f(F.col(f"{r}_n") / F.col("n_docs")).alias(f"{r}_{tag}")
            for r in RULES
            for tag, f in (("m", F.avg), ("v", F.var_pop))
        )
    )
    row = moments.first()
    out = counts
    ok, flagged = F.lit(True), F.lit(False)
    for r in RULES:
        mean, var = float(row[f"{r}_m"] or 0.0), float(row[f"{r}_v"] or 0.0)
        weight = prior_weight(mean, var)
        rate = (F.col(f"{r}_n") + F.lit(weight * mean)) / (F.col("n_docs") + F.lit(weight))
        out = out.withColumn(f"{r}_rate", F.round(rate, 9))
        own = F.col(f"{r}_rate")
        ok = ok & (own <= F.lit(max_rate))
        over = own - F.lit(MARGIN) * F.sqrt(own * (1 - own) / (F.col("n_docs") + F.lit(weight + 1)))
        flagged = flagged | (F.round(over, 9) > F.round(F.lit(mean), 9))
    return out.withColumn("host_ok", ok).withColumn("host_flagged", flagged)


def prior_weight(mean: float, var: float) -> float:
    if var <= 0.0:
        return 1000.0
    return min(1000.0, max(1.0, mean * (1.0 - mean) / var - 1.0))


def join_hosts(measures: DataFrame, verdicts: DataFrame, max_broadcast: int = MAX_BROADCAST_HOSTS, salts: int = SALTS) -> DataFrame:
    """Host verdicts on every document; a host with a third of the rows is dealt over ``salts`` keys."""
    keep = verdicts.select(F.col("host").alias("_host"), "host_ok", "host_flagged", *(f"{r}_rate" for r in RULES))
    on = F.col("host").eqNullSafe(F.col("_host"))
    if keep.limit(max_broadcast + 1).count() <= max_broadcast:
        return measures.join(F.broadcast(keep), on, "left").drop("_host")
    spread = measures.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    many = keep.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(many, on & (F.col("_salt") == F.col("_deal")), "left").drop("_host", "_salt", "_deal")


def judged(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE, max_broadcast: int = MAX_BROADCAST_HOSTS) -> DataFrame:
    """Measures, host rates and ``kept`` for every row of ``docs``."""
    spark = docs.sparkSession
    measures = written(spark, document_measures(docs, host), "hostrules")
    verdicts = written(spark, host_verdicts(measures, max_rate), "hosts")
    return join_hosts(measures, verdicts, max_broadcast).withColumn("kept", kept())


def kept() -> F.Column:
    soft = F.col("symbols_failed") | F.col("dup_lines_failed")
    return ~F.col("base_failed") & F.col("host_ok") & ~(F.col("host_flagged") & soft)


def filtered(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE, max_broadcast: int = MAX_BROADCAST_HOSTS) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns: one pass over the texts, no shuffle of them.

    The rows are written with their measures once; hosts are judged on that table.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(x.as_py() or b"") for x in batch.column(2)]
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols)], ["row", "host", *_COUNTS])

    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(host).cast("string").alias("host"), F.col("text").cast("binary").alias("text"))
    schema = T.StructType([packed.schema["row"], T.StructField("host", T.StringType()), *(T.StructField(c, T.LongType()) for c in _COUNTS)])
    measured = written(spark, _failures(packed.mapInArrow(run, schema)), "hostrules-rows")
    verdicts = written(spark, host_verdicts(measured.drop("row"), max_rate), "hosts")
    return join_hosts(measured.filter(~F.col("base_failed")), verdicts, max_broadcast).filter(kept()).select("row.*")


def op8_host_rules(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "host_flagged", *(F.round(f"{r}_rate", 6).alias(f"{r}_rate") for r in RULES),
    )


_RATE_SQL = ", ".join(f"sum({r}_failed::BIGINT) AS {r}_n" for r in RULES)
_MOMENT_SQL = ", ".join(f"avg({r}_n / n_docs) AS {r}_m, var_pop({r}_n / n_docs) AS {r}_v" for r in RULES)
_WEIGHT = "CASE WHEN {r}_v <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, {r}_m * (1 - {r}_m) / {r}_v - 1)) END"
_SHRUNK_SQL = ", ".join(f"round(({r}_n + ({_WEIGHT.format(r=r)}) * {r}_m) / (n_docs + {_WEIGHT.format(r=r)}), 9) AS {r}_rate, n_docs + {_WEIGHT.format(r=r)} + 1 AS {r}_w, {r}_m" for r in RULES)
_OK_SQL = " AND ".join(f"{r}_rate <= {MAX_HOST_RATE}" for r in RULES)
_FLAG_SQL = " OR ".join(f"round({r}_rate - {MARGIN} * sqrt({r}_rate * (1 - {r}_rate) / {r}_w), 9) > round({r}_m, 9)" for r in RULES)
_RATES_SQL = ", ".join(f"round({r}_rate, 6) AS {r}_rate" for r in RULES)

OP8_SQL = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, host, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 6), lambda i: ws[i:i+7])) AS win,
             unnest(range(1, len(ws) - 6)) AS st FROM w WHERE len(ws) >= 8),
twice AS (SELECT doc_id, st FROM (SELECT doc_id, st, count(*) OVER (PARTITION BY doc_id, win) AS n FROM p) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(st, st + 8)) AS pos FROM twice) GROUP BY doc_id),
m AS (SELECT w.doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
             100 * n_symbols > {MAX_SYMBOLS_PER_100_WORDS} * n_words AS symbols_failed,
             n_lines >= {MIN_LINES} AND 100 * n_dup_lines > {MAX_DUP_LINES_PER_100_LINES} * n_lines AS dup_lines_failed FROM m),
h AS (SELECT host, count(*) AS n_docs, {_RATE_SQL} FROM f GROUP BY host),
g AS (SELECT {_MOMENT_SQL} FROM h),
r AS (SELECT host, {_SHRUNK_SQL} FROM h, g),
v AS (SELECT host, {_OK_SQL} AS host_ok, {_FLAG_SQL} AS host_flagged, {_RATES_SQL} FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND host_ok AND NOT (host_flagged AND (symbols_failed OR dup_lines_failed)) AS kept,
       host_flagged, base_rate, symbols_rate, dup_lines_rate
FROM f JOIN v ON f.host IS NOT DISTINCT FROM v.host
"""
