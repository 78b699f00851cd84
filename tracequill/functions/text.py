"""Text functions as column expressions."""

from __future__ import annotations

import re
import unicodedata
from operator import add

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .canonical import let
from .nfkc import nfkc

#: White space of the web platform: ASCII, no-break and typographic spaces.
SPACE = r"[\s\u000B   -     　﻿]"
#: Found in texts that collapsing white space may change; a class of two ranges is searched faster than :data:`SPACE`.
_UNEVEN = r"[^\x20-\x7E\xA1-\x{167F}]|  "
#: Found in texts that hold white space other than plain spaces, and in some others.
_OTHER_SPACE = r"[^\x20-\x7E\xA1-\x{167F}]"
SENTENCE_END = "[。！？!?]$"


def normalize_text(text: Column) -> Column:
    """Without tags, four entities decoded in their fixed order, white space collapsed and trimmed."""
    def decoded(x: Column) -> Column:
        out = F.regexp_replace(x, "<[^>]+>", "")
        for entity, plain in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">")):
            out = F.regexp_replace(out, f"(?i)&{entity};", plain)
        return out

    # Most texts need no replacement, and finding that out costs a fraction of one.
    bare = let(text, lambda x: F.when(F.contains(x, F.lit("<")) | F.contains(x, F.lit("&")), decoded(x)).otherwise(x))
    return let(bare, lambda x: F.trim(F.when(x.rlike(_UNEVEN), F.regexp_replace(x, SPACE + "+", " ")).otherwise(x)))


def compact_characters(text: Column) -> Column:
    """Code points that are no white space; null counts as empty."""
    known = F.coalesce(text, F.lit(""))
    # Replacing plain spaces costs a fraction of a pattern's replacement at each word.
    return F.length(F.when(known.rlike(_OTHER_SPACE), F.regexp_replace(known, SPACE, "")).otherwise(F.replace(known, F.lit(" "), F.lit(""))))


_SPACES = re.compile(SPACE, re.A)
_SPACE_RUN = re.compile(SPACE + "+", re.A)
_TAG = re.compile("<[^>]+>")
_ENTITIES = [(re.compile(f"&{entity};", re.I | re.A), plain) for entity, plain in (("nbsp", " "), ("amp", "&"), ("lt", "<"), ("gt", ">"))]


def _ignored(c: str) -> bool:
    return unicodedata.category(c)[0] in "PS" or bool(_SPACES.match(c))


_IGNORED_BYTES = bytes(i for i in range(256) if _ignored(chr(i)))


def _decoded(text: str) -> str:
    if "<" in text or "&" in text:
        text = _TAG.sub("", text)
        for entity, plain in _ENTITIES:
            text = entity.sub(plain, text)
    return text


def normal_text(text: str) -> str:
    """:func:`normalize_text` of one text, inside Arrow functions."""
    text = _decoded(text)
    if not text.isascii() or not text.isprintable() or "  " in text:
        text = _SPACE_RUN.sub(" ", text)
    return text.strip(" ")


def _claim(text: str) -> str:
    text = _decoded(text)
    text = unicodedata.normalize("NFKC", text)
    try:
        return text.encode("latin-1").translate(None, _IGNORED_BYTES).decode("latin-1")
    except UnicodeEncodeError:
        for c in filter(_ignored, set(text)):
            text = text.replace(c, "")
        return text


def _claims(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else _claim(x) for x in texts.to_pylist()], pa.string())


def normalized_claim(text: Column) -> Column:
    """For comparisons: :func:`normalize_text` in Unicode's compatibility form, without punctuation, symbols and space, lower case.

    Made in Arrow batches by Python's Unicode data: one pass over bytes for most texts, where a pattern costs many times as much for each
    character. White space need not be collapsed, since all of it goes.
    """
    return F.lower(F.arrow_udf(_claims, "string")(text))


def normalize_review_text(text: Column) -> Column:
    """In Unicode's compatibility form, without white space; null counts as empty."""
    return F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), SPACE + "+", "")


def _pairs(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else list(dict.fromkeys(map(add, x, x[1:]))) if len(x) > 2 else [x] if x else [] for x in texts.to_pylist()], pa.list_(pa.string()))


def bigrams(text: Column) -> Column:
    """Distinct pairs of characters of the normalised text; two or fewer characters are one gram.

    Made in Arrow batches: a lambda costs several times as much for each character.
    """
    return grams(normalized_claim(text))


def grams(plain: Column) -> Column:
    """:func:`bigrams` of a text that is normalised already."""
    return F.arrow_udf(_pairs, "array<string>")(plain)


def jaccard(left: Column, right: Column) -> Column:
    """Similarity of two gram sets; an empty one gives 0."""
    shared = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), F.lit(0.0)).otherwise(shared / (F.size(left) + F.size(right) - shared))


def parse_timestamp(value: Column) -> Column:
    """Milliseconds of ``HH:MM:SS.mmm`` or ``MM:SS.mmm`` (comma allowed); null for other forms."""
    parts = F.split(F.replace(F.trim(value), F.lit(","), F.lit(".")), ":")
    seconds = [F.try_element_at(parts, F.lit(i)).try_cast("double") for i in (1, 2, 3)]
    three = seconds[0] * 3600 + seconds[1] * 60 + seconds[2]
    total = F.when(F.size(parts) == 3, three).when(F.size(parts) == 2, seconds[0] * 60 + seconds[1])
    return F.floor(total * 1000 + 0.5).cast("long")


def format_timestamp(ms: Column, millis: bool = True) -> Column:
    total = F.greatest(ms, F.lit(0))
    base = F.concat_ws(
        ":",
        F.when(total < 36_000_000, F.lpad((total / 3_600_000).cast("long").cast("string"), 2, "0")).otherwise((total / 3_600_000).cast("long").cast("string")),
        F.lpad((F.pmod(total, F.lit(3_600_000)) / 60_000).cast("long").cast("string"), 2, "0"),
        F.lpad((F.pmod(total, F.lit(60_000)) / 1000).cast("long").cast("string"), 2, "0"),
    )
    base = F.when(total.isNotNull(), base)
    return F.concat(base, F.lit("."), F.lpad(F.pmod(total, F.lit(1000)).cast("string"), 3, "0")) if millis else base


def rounded(value: Column, digits: int = 4) -> Column:
    """Half up, as floor(x * 10**digits + 0.5)."""
    return F.floor(value * 10**digits + 0.5) / 10**digits


def adaptive_targets(density: Column, characters: Column) -> dict[str, Column]:
    """Length targets from a density of 0 to 20 and the source's characters."""
    raw = F.lit(4000) + density * 500 + characters * 0.12
    bounded = F.least(F.lit(18_000), F.greatest(F.lit(12_000), raw))
    return {
        "reader_target": F.least(characters, (F.floor(bounded / 500 + 0.5) * 500).cast("long")),
        "reader_minimum": F.least(characters, F.lit(12_000)),
        "reader_maximum": F.least(characters, F.lit(18_000)),
        "brief_target": F.least(F.lit(8000), F.lit(3000) + density * 250),
    }


def reading_minutes(characters: Column, rate: int = 450) -> Column:
    return F.greatest(F.lit(1), F.ceil(characters / rate)).cast("long")


def end_sentence(text: Column, mark: str = ".") -> Column:
    """Trimmed, with a closing mark unless it has one."""
    plain = F.trim(text)
    return F.when(plain.rlike(r"[.。！？!?…]$") | (plain == ""), plain).otherwise(F.concat(plain, F.lit(mark)))


def plain_markdown(text: Column) -> Column:
    """Without emphasis, code and link marks; link labels stay."""
    out = F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")
    return F.trim(F.regexp_replace(out, r"[*_`#>]+", ""))


def escape_html(text: Column, apostrophe: str = "&#39;") -> Column:
    out = text
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", apostrophe)):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def markdown_cell(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"\r?\n", " "), F.lit("|"), F.lit("\\|"))


def href(path: Column) -> Column:
    """Percent-encoded, with slashes kept and spaces as %20."""
    return F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts as a JSON array of strings; null parts are ``null``."""
    return F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts)), {"ignoreNullFields": "false"}), 256)


def valid_date(value: Column, month_precision: bool = False) -> Column:
    """Whether a text is a real YYYY-MM-DD (or YYYY-MM) date."""
    full = value.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(value, "yyyy-MM-dd").isNotNull()
    month = value.rlike(r"^\d{4}-(?:0[1-9]|1[0-2])$")
    return F.coalesce(full | month if month_precision else full, F.lit(False))


def speaker_prefix(text: Column) -> Column:
    """A leading ``name:`` of at most 24 letters and digits; null without one."""
    found = F.regexp_extract(text, r"^\s*([\p{L}\p{N}·・]{1,24})\s*[：:]", 1)
    return F.when(found != "", found)


def term_hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms occur, case ignored; occurrences do not count twice."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(t.lower())).cast("int") for t in terms), F.lit(0))


def percentage(value: Column) -> Column:
    return F.concat(F.format_number(value * 100, 1), F.lit("%"))


def corrupted(text: Column) -> Column:
    """Replacement characters, or two question marks or more in a row."""
    return F.coalesce(F.contains(text, F.lit("�")) | text.rlike(r"\?{2,}"), F.lit(False))
