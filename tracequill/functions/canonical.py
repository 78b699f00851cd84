"""Canonical JSON: keys in order, no white space, numbers and escapes as the web platform writes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Escapes that are written with letters; other control characters have digits only or a short form.
_LETTERED = ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F")
_NUMBER = r"-?[0-9][0-9.eE+\-]*"
#: Marks for escaped backslashes and quotes: JSON text holds no raw control characters.
_SLASH, _QUOTE = "\x01", "\x02"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shape(d: Column, digits: Column, point: Column) -> Column:
    """0.digits times 10**point, as text."""
    k = F.length(digits)
    rest = F.when(k > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise("")
    text = (
        F.when((k <= point) & (point <= 21), F.concat(digits, F.repeat(F.lit("0"), point - k)))
        .when((point > 0) & (point <= 21), F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
        .when((point > -6) & (point <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
        .otherwise(F.concat(F.substr(digits, F.lit(1), F.lit(1)), rest, F.lit("e"), F.when(point > 0, "+").otherwise("-"), F.abs(point - 1).cast("string")))
    )
    return F.concat(F.when(d < 0, "-").otherwise(""), text)


def _shorter(d: Column, x: Column) -> Column:
    """``x`` (digits, point) with one digit less where a neighbour reads back as the same double: the JVM writes up to two too many at times."""
    digits, point = x["digits"], x["point"]
    near = [F.floor((digits.cast("decimal(20,0)") + n) * F.lit("0.1").cast("decimal(2,1)")).cast("string") for n in (5, 0, 10)]

    def of(tried: Column) -> Column:
        out = x
        for i in reversed(range(3)):
            up = tried[i]
            at = point + F.length(up) - F.length(digits) + 1
            same = (F.length(digits) > 1) & (F.concat(F.lit("0."), up, F.lit("E"), at.cast("string")).cast("double") == F.abs(d))
            out = F.when(same, F.struct(F.rtrim(up, F.lit("0")).alias("digits"), at.alias("point"))).otherwise(out)
        return out

    return let(F.array(*near), of)


def number(token: Column) -> Column:
    """The double that a numeral stands for, in the shortest form that reads back.

    Plain digits from 1e-6 to below 1e21, else an exponent with its sign; minus zero is 0. Of two forms with 17 digits
    that read back alike, JVMs before 19 may give the one that is not nearest (1 of 30,000 random doubles).
    """

    def of(d: Column) -> Column:
        parts = F.split(F.abs(d).cast("string"), "[.E]")
        whole, fraction = F.element_at(parts, 1), F.element_at(parts, 2)
        exponent = F.coalesce(F.try_element_at(parts, F.lit(3)).cast("int"), F.lit(0))
        digits = F.concat(whole, fraction)
        bare = F.ltrim(digits, F.lit("0"))
        split = F.struct(F.rtrim(bare, F.lit("0")).alias("digits"), (F.length(whole) + exponent - F.length(digits) + F.length(bare)).alias("point"))
        return F.when(d == 0, "0").otherwise(let(split, lambda x: let(_shorter(d, x), lambda y: let(_shorter(d, y), lambda z: _shape(d, z["digits"], z["point"])))))

    return let(token.cast("double"), of)


def _pieces(text: Column) -> Column:
    """``text`` cut at its quotes: every second piece is a string's inside."""
    marked = F.replace(F.replace(text, F.lit("\\\\"), F.lit(_SLASH)), F.lit('\\"'), F.lit(_QUOTE))
    return F.split(marked, '"')


def _overflows(text: Column) -> Column:
    outside = F.filter(_pieces(text), lambda x, i: i % 2 == 0)
    return F.exists(F.flatten(F.transform(outside, lambda x: F.regexp_extract_all(x, F.lit(_NUMBER), F.lit(0)))), lambda x: F.abs(x.cast("double")) == float("inf"))


def _outside(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(_NUMBER + r"|[^0-9\-]+"), F.lit(0))
    return F.array_join(F.transform(tokens, lambda x: F.when(x.rlike("^-?[0-9]"), number(x)).otherwise(x)), "")


def _inside(text: Column) -> Column:
    for code in _LETTERED:
        text = F.replace(text, F.lit(f"\\u00{code}"), F.lit(f"\\u00{code.lower()}"))
    return text


def canonical_json(text: Column) -> Column:
    """The canonical form of JSON ``text``; null stays null.

    Text that is no JSON, repeats a key in one object, or overflows a double is an error. Keys go by
    their UTF-16 code units; whole numbers as keys are no exception to that. Variants keep their
    keys in that order, so nothing is sorted here.
    """

    def of(plain: Column) -> Column:
        fixed = F.array_join(F.transform(_pieces(plain), lambda x, i: F.when(i % 2 == 0, _outside(x)).otherwise(_inside(x))), '"')
        return F.replace(F.replace(fixed, F.lit(_QUOTE), F.lit('\\"')), F.lit(_SLASH), F.lit("\\\\"))

    large = text.rlike(r"[eE][+]?[0-9]{3}|[0-9]{300}")
    checked = F.when(large & _overflows(text), F.raise_error(F.lit("numbers must be finite"))).otherwise(F.to_json(F.parse_json(text)))
    return let(checked, of)


def canonical_hash(text: Column) -> Column:
    """SHA-256 of the canonical form of JSON ``text``."""
    return F.sha2(canonical_json(text).cast("binary"), 256)
