"""Personal data by weak-supervision aggregation. DataFrame and SQL functions only.

Base kinds (email, ip, card, phone) are matched and checked as fixed rules; their
spans always stay. Further candidates are base matches that fail their check, and
matches of ``EXTRA`` kinds. Five labelers vote -1, 0 or 1 on each candidate: shape
(regex), validity (checksums, counts), gazetteer, context cues and word boundary.
Votes are counted by pattern in one aggregation of at most len(KINDS) * 3**5 = 1,944
rows, whatever the corpus. From these counts expectation-maximisation estimates
each labeler's reliability, and a logistic span classifier over votes and kinds is
trained on the posteriors; it is applied as a column expression.

Patterns are anchored with ``\\G`` and use possessive repeats, so that long texts need
no deep stack; offsets are running sums in blocks (:mod:`tracequill.functions.folds`),
so n matches in a text cost about n ** (4/3). Offsets are code points, end exclusive.
Matches of one kind never overlap. Spans of different kinds may, or may be equal but
for their kind: ``spans`` lists each of them, by start, then kind, then end, and
:func:`masked` makes one mask of overlapping ones, named by the first.

Defined results: null text is empty; a text without spans has empty lists (the digest
of nothing); repeated rows give repeated results and count as often in the votes;
no candidates at all leave the classifier at a majority of votes; an empty table gives
an empty result; extra columns are ignored, and kept by :func:`masked`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequill.functions import folds
from tracequill.session import written

BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
EXTRA = {
    "secret": r"(?<=[\"'=: ])(?:[0-9a-f]{32,}+(?![A-Za-z0-9_-])|[A-Za-z0-9_-]{40,}+)",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,}+(?![A-Za-z0-9])",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Sr|Sra)\.? \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++)?+",
}
KINDS = (*BASE, *EXTRA)
LABELERS = ("shape", "valid", "gazetteer", "context", "boundary")
CONTEXT = 32
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
#: The check of an account number: its first four characters moved to the end, letters as 10 to 35, leave 1 on division by 97.
_MOD_97 = (
    "aggregate(split(concat(substring(x.m, 5), left(x.m, 4)), ''), 0, "
    "(a, d) -> IF(d = '', a, IF(d BETWEEN '0' AND '9', a * 10 + ascii(d) - 48, a * 100 + ascii(d) - 55) % 97)) = 1"
)

#: Gazetteers of our own, small on purpose; callers may replace them before the queries are built.
FIRST_NAMES = (
    "Ana Anna Antonio Barbara Carlos Carmen Catherine Charles Christian Claire Claudia Daniel David Elena Elizabeth Emma Eva Felix Francisco "
    "François George Hannah Hans Heinrich Helen Henri Isabel James Jan Jean Jennifer John Jonas José Juan Julia Julie Karl Klaus Laura Léa Lena "
    "Linda Louis Lucas Lucía Luis Manuel Marc Maria María Marie Mark Martin Mary Michael Michel Miguel Monika Nicolas Olivia Patricia Paul Pablo "
    "Peter Petra Philippe Pierre Richard Robert Sabine Sarah Sofía Sophie Stefan Susan Thomas Ursula William Wolfgang"
).split()
COUNTRIES = "AT BE CH CZ DE DK ES FI FR GB HU IE IT LU NL NO PL PT SE".split()


def _listed_words(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


#: SQL over x (s, e, m, c): the base checks.
CHECKS = {
    "email": "true",
    "ip": rf"x.m RLIKE '^{_OCTET}[.]{_OCTET}[.]{_OCTET}[.]{_OCTET}$'",
    "card": f"(length({_DIGITS}) BETWEEN 12 AND 19 AND luhn_check({_DIGITS}))",
    "phone": f"(length({_DIGITS}) BETWEEN 9 AND 15)",
}
#: Each labeler's evidence for and against a kind, as SQL over x.
_SHAPE = {
    "ip": (r"x.m RLIKE '^(?:[1-9][0-9]{0,2}[.]){3}[0-9]{1,3}$'", r"x.m RLIKE '(?:^|[.])0[0-9]|[0-9]{4}'"),
    "card": (r"x.m RLIKE '^(?:[0-9]{4}[ -]?){3}[0-9]{1,7}$'", r"length(x.m) < 12"),
    "phone": (r"x.m RLIKE '^[+][0-9]{1,3}[ .-]?[(]?[0-9]{2,4}[)]?[ .-][0-9]'", r"x.m RLIKE '[.]{2}|--|[(][^)]*$'"),
    "secret": (r"x.m RLIKE '^[0-9a-f]+$'", r"x.m RLIKE '^(?:[0-9]+|[A-Za-z]+)$'"),
    "national_id": ("true", "false"),
    "iban": (r"x.m RLIKE '^[A-Z]{2}[0-9]{12,32}$'", "length(x.m) < 15"),
    "name": (r"x.m RLIKE ' .+ '", "false"),
}
_VALID = {
    "ip": ("false", "true"),
    "card": (f"luhn_check({_DIGITS})", f"NOT luhn_check({_DIGITS}) OR length({_DIGITS}) < 12"),
    "phone": (f"length({_DIGITS}) BETWEEN 9 AND 15", f"length({_DIGITS}) NOT BETWEEN 9 AND 15"),
    "secret": (r"x.m RLIKE '[0-9]' AND x.m RLIKE '[A-Za-z]'", r"x.m NOT RLIKE '[0-9]'"),
    "national_id": (r"x.m NOT RLIKE '^(?:000|666|9..)|-00-|-0000$'", r"x.m RLIKE '^(?:000|666|9..)|-00-|-0000$'"),
    "iban": (f"length(x.m) <= 34 AND {_MOD_97}", f"length(x.m) > 34 OR NOT ({_MOD_97})"),
    "name": ("false", "false"),
}
_GAZETTEER = {
    "ip": ("false", r"x.m RLIKE '^0'"),
    "card": (r"x.m RLIKE '^(?:4|5[1-5]|3[47]|6011)'", r"x.m RLIKE '^[01789]'"),
    "phone": (r"x.m RLIKE '^[+](?:1|33|34|44|49|39|31|41|43|32|52|54|55|81|86|91)(?![0-9]{8}$)'", r"x.m RLIKE '^[+]0'"),
    "secret": (r"x.m RLIKE '^(?:sk|pk|gh[pousr]|xox|AKIA)'", "false"),
    "national_id": ("false", "false"),
    "iban": (f"left(x.m, 2) IN ({_listed_words(COUNTRIES)})", "false"),
    "name": (f"exists(split(x.m, ' '), w -> w IN ({_listed_words(FIRST_NAMES)}))", "false"),
}
_CONTEXT = {
    "ip": ("ip|host|server|addr|client", "version|ver|build|release|section"),
    "card": ("card|visa|master|amex|credit|pay", "order|invoice|isbn|item|serial|sku"),
    "phone": ("tel|phone|call|mobile|fax|contact", "score|goal|delta|change"),
    "secret": ("token|secret|key|passw|pwd|auth|bearer|credential", "sha|md5|hash|commit|digest|checksum|uuid"),
    "national_id": ("ssn|social|security|tax|id", "part|order|invoice|isbn"),
    "iban": ("iban|account|bank|transfer|konto|compte|cuenta", "part|serial|sku"),
    "name": ("contact|from|dear|by|author|name", "street|square|avenue"),
}


def _votes(kind: str) -> str:
    cue, against = _CONTEXT[kind]
    pairs = {
        "shape": _SHAPE[kind],
        "valid": _VALID[kind],
        "gazetteer": _GAZETTEER[kind],
        "context": (f"x.c RLIKE '(?:{cue})[^.!?]{{0,20}}$'", f"x.c RLIKE '(?:{against})[^.!?]{{0,20}}$'"),
        "boundary": (r"x.c = '' OR x.c RLIKE '[\\s\"=:,;(]$'", r"x.c RLIKE '[\\p{L}0-9]$'"),
    }
    return ", ".join(f"'{name}', CASE WHEN {yes} THEN 1 WHEN {no} THEN -1 ELSE 0 END" for name, (yes, no) in pairs.items())


def _quoted(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


_FOUND = "array<struct<s:int,e:int,m:string,c:string>>"


def _find(kind: str) -> str:
    """SQL: all leftmost non-overlapping matches of a kind, with offsets and the text before."""
    pattern = (BASE | EXTRA)[kind]
    plain, walked = _quoted(pattern.replace(r"(?:\G|(?<![A-Za-z0-9._%+-]))", "")), _quoted(rf"(?s)\G(.*?)({pattern})")
    guard = "contains(text, '@')" if kind == "email" else "contains(text, '+')" if kind == "phone" else f"text RLIKE '{plain}'"
    pairs = f"zip_with(regexp_extract_all(text, '{walked}', 1), regexp_extract_all(text, '{walked}', 2), (p, m) -> named_struct('p', p, 'm', m))"
    starts = folds.sums_before("transform(w, x -> cast(length(x.p) + length(x.m) AS bigint))")
    placed = (
        "named_struct('s', cast(at + length(x.p) AS int), 'e', cast(at + length(x.p) + length(x.m) AS int), "
        f"'m', x.m, 'c', lower(right(x.p, {CONTEXT})))"
    )
    found = folds.bound(pairs, "w", f"zip_with(w, {starts}, (x, at) -> {placed})")
    return f"CASE WHEN {guard} THEN cast({found} AS {_FOUND}) ELSE cast(array() AS {_FOUND}) END AS {kind}"


def matches(docs: DataFrame) -> DataFrame:
    """doc_id and, for each kind, its raw matches; no shuffle."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.selectExpr("doc_id", *(_find(k) for k in KINDS))


def candidates(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The key column, ``base`` (s, k, e), counts by base kind, and ``open``: candidates with their votes."""
    base = [f"transform(filter({k}, x -> {CHECKS[k]}), x -> named_struct('s', x.s, 'k', {i}, 'e', x.e))" for i, k in enumerate(BASE)]
    rest = []
    for i, k in enumerate(KINDS):
        if k == "email":
            continue
        kept = f"filter({k}, x -> NOT ({CHECKS[k]}))" if k in BASE else k
        rest.append(f"transform({kept}, x -> named_struct('s', x.s, 'k', {i}, 'e', x.e, {_votes(k)}))")
    return found.selectExpr(
        key,
        f"array_sort(concat({', '.join(base)})) AS base",
        *(f"cast(size(filter({k}, x -> {CHECKS[k]})) AS long) AS n_{k}" for k in BASE),
        f"concat({', '.join(rest)}) AS open",
    )


def vote_counts(found: DataFrame) -> list[tuple[tuple[int, ...], int]]:
    """((kind, votes...), count): the only thing that reaches the driver, at most len(KINDS) * 3**5 rows."""
    keys = ["k", *LABELERS]
    rows = found.select(F.explode("open").alias("x")).select(*(F.col(f"x.{k}").alias(k) for k in keys)).groupBy(*keys).count().collect()
    return sorted((tuple(r[k] for k in keys), r["count"]) for r in rows)


def reliabilities(counts: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[list[float], list[dict]]:
    """Expectation-maximisation over vote patterns.

    Posterior of each pattern, and for each labeler P(vote | class) for the classes 0 and 1.
    Starts from the share of positive votes; counts are smoothed by one.
    """
    post = [(1.0 + sum(v > 0 for v in key[1:])) / (2.0 + sum(v != 0 for v in key[1:])) for key, _ in counts]
    tables: list[dict] = []
    for _ in range(rounds):
        tables = []
        for j in range(len(LABELERS)):
            mass = {(v, y): 1.0 for v in (-1, 0, 1) for y in (0, 1)}
            for (key, n), p in zip(counts, post, strict=True):
                mass[key[1 + j], 1] += n * p
                mass[key[1 + j], 0] += n * (1 - p)
            total = {y: sum(mass[v, y] for v in (-1, 0, 1)) for y in (0, 1)}
            tables.append({k: m / total[k[1]] for k, m in mass.items()})
        prior: dict[int, list[float]] = {}
        for (key, n), p in zip(counts, post, strict=True):
            share = prior.setdefault(key[0], [1.0, 2.0])
            share[0] += n * p
            share[1] += n
        fresh = []
        for key, _ in counts:
            rate = prior[key[0]][0] / prior[key[0]][1]
            odds = math.log(rate / (1 - rate)) + sum(math.log(t[v, 1] / t[v, 0]) for t, v in zip(tables, key[1:], strict=True) if v)
            fresh.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        if max((abs(a - b) for a, b in zip(post, fresh, strict=True)), default=0.0) < 1e-9:
            break
        post = fresh
    return post, tables


def train(counts: list[tuple[tuple[int, ...], int]], steps: int = 400, rate: float = 0.5) -> list[float]:
    """Logistic weights over votes, then kinds, fitted to the posteriors of the patterns."""
    weights = [1.0] * len(LABELERS) + [-0.5] * len(KINDS)
    if not counts:
        return weights
    post, _ = reliabilities(counts)
    total = sum(math.log1p(n) for _, n in counts)
    for _ in range(steps):
        slope = [0.001 * w for w in weights]
        for (key, n), target in zip(counts, post, strict=True):
            z = sum(w * v for w, v in zip(weights, key[1:], strict=False)) + weights[len(LABELERS) + key[0]]
            miss = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - target) * math.log1p(n) / total
            for j, v in enumerate(key[1:]):
                slope[j] += miss * v
            slope[len(LABELERS) + key[0]] += miss
        weights = [w - rate * s for w, s in zip(weights, slope, strict=True)]
    return weights


def classified(found: DataFrame, weights: list[float], key: str = "doc_id") -> DataFrame:
    """Adds ``spans``: base spans and the candidates the classifier takes, by start, kind and end."""
    score = " + ".join(f"{w!r}D * x.{name}" for w, name in zip(weights, LABELERS, strict=False))
    kinds = ", ".join(f"{w!r}D" for w in weights[len(LABELERS) :])
    taken = f"transform(filter(open, x -> {score} + element_at(array({kinds}), x.k + 1) >= 0D), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))"
    return found.selectExpr(key, "base", *(f"n_{k}" for k in BASE), f"array_sort(concat(base, {taken})) AS spans")


def _listed(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.k + 1), ':', x.s, ':', x.e)), ',')"


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base, counts and spans (arrays of start, kind number, end) of every row."""
    spark = docs.sparkSession
    found = written(spark, candidates(written(spark, matches(docs), "pii-matches")), "pii")
    return classified(found, train(vote_counts(found)))


def op2_pii(spark, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet")).selectExpr(
        "doc_id", *(f"n_{k}" for k in BASE), f"sha2({_listed('base')}, 256) AS base_sha256", f"{_listed('spans')} AS spans"
    )


def masked(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans become one.

    The rows are written once with their matches; votes are counted on that table and the
    masks applied to it, so the texts are not shuffled.
    """
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    reached = folds.most_before("transform(spans, x -> cast(x.e AS bigint))")
    heads = f"filter(zip_with(spans, {reached}, (x, r) -> named_struct('r', cast(r AS int), 's', x.s, 'k', x.k)), y -> y.s >= y.r)"
    piece = f"concat(substring(t, y.r - b[0].r + 1, y.s - y.r), element_at(array({names}), y.k + 1))"
    block = folds.bound("substring(row.text, b[0].r + 1, element_at(b, -1).s - b[0].r)", "t", f"array_join(transform(b, y -> {piece}), '')")
    before = folds.bound(heads, "h", f"array_join(transform({folds.blocks('h')}, b -> {block}), '')")
    text = f"CASE WHEN size(spans) = 0 THEN row.text ELSE concat({before}, substring(row.text, array_max(transform(spans, x -> x.e)) + 1)) END AS text"
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    rows = written(docs.sparkSession, packed.selectExpr("row", *(_find(k) for k in KINDS)), "pii-rows")
    found = candidates(rows, "row")
    spans = classified(found, train(vote_counts(found)), "row")
    return spans.select("row", F.expr(text)).select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))
