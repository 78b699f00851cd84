"""Compatibility composition (NFKC) by Python's Unicode data.

Spark has no function for it, so texts go through Python in Arrow batches. ``_tables`` holds what the form changes, by rule.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hangul syllables are composed by arithmetic.
_S, _L, _V, _T, _NL, _NV, _NT = 0xAC00, 0x1100, 0x1161, 0x11A7, 19, 21, 28


def _characters() -> range:
    return range(sys.maxunicode + 1)


@functools.cache
def _tables() -> tuple[dict[int, str], dict[int, int], dict[tuple[str, str], str]]:
    """Full decompositions of single characters, combining classes other than 0, and pairs that compose."""
    apart, ranks, pairs = {}, {}, {}
    for i in _characters():
        if 0xD800 <= i < 0xE000 or _S <= i < _S + _NL * _NV * _NT:
            continue
        c = chr(i)
        if unicodedata.combining(c):
            ranks[i] = unicodedata.combining(c)
        if (whole := unicodedata.normalize("NFKD", c)) != c:
            apart[i] = whole
        two = unicodedata.decomposition(c).split()
        if len(two) == 2 and two[0][0] != "<":
            a, b = (chr(int(x, 16)) for x in two)
            if unicodedata.normalize("NFC", a + b) == c:
                pairs[a, b] = c
    return apart, ranks, pairs


def _composed(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in texts.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """``text`` in Unicode's form NFKC; null stays null. It names columns of the table, no variables of lambdas."""
    return F.arrow_udf(_composed, "string")(text)
