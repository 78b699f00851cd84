"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this many rows up, and only if it has more than one in MOST_HOT of all rows: so there are fewer than MOST_HOT hot keys.
MIN_HOT = 4096
MOST_HOT = 10_000


def joined(big: DataFrame, small: DataFrame, keys: list[str], n: str, how: str = "inner") -> DataFrame:
    """``big`` joined to ``small``, which has one row a key and in column ``n`` the key's rows in ``big``.

    Hot keys, fewer than MOST_HOT by their definition, are broadcast and so need no shuffle of
    their rows; all other keys are shuffled. ``small`` should be a written table.
    """
    total = small.agg(F.sum(n)).first()[0] or 0
    floor = max(MIN_HOT, int(total) // MOST_HOT)
    hot = small.filter(F.col(n) > floor)
    if total <= floor or hot.isEmpty():
        return big.join(small.drop(n), keys, how)
    few = big.join(F.broadcast(hot.drop(n)), keys, "inner" if how == "left" else how)
    rest = big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(small.filter(F.col(n) <= floor).drop(n), keys, how)
    return few.unionByName(rest)
