"""Running aggregates over the array of one row, as SQL text.

A fold that appends to its own output copies that output at every step. Here an
array of n elements is cut into blocks, those into smaller ones, each about the
cube root of n long in the end. Totals of the blocks give each its start, and
only the smallest are folded with their output, so the work is about n ** (4/3).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """``df`` with its columns computed once a row.

    The optimizer puts a column's expression wherever a later projection names it, inside lambdas too, where it
    would be computed for each element; it does not look through a generator, here one of a single row.
    """
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_row")).select("_row.*")


def bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def blocks(name: str, power: str = "0.5") -> str:
    """The array variable ``name`` (of one element or more) in blocks of about its size to the ``power``."""
    n = f"cast(greatest(16, ceil(power(size({name}), {power}))) AS int)"
    return bound(n, f"{name}_n", f"transform(sequence(0, cast((size({name}) - 1) div {name}_n AS int)), {name}_i -> slice({name}, cast({name}_i * {name}_n + 1 AS int), {name}_n))")


def before(values: str, start: str, step: Callable[[str, str], str], kind: str = "bigint", name: str = "v") -> str:
    """For each of ``values`` what ``step`` makes of ``start`` and all values before it; ``step`` is associative."""
    none = f"cast(array() AS array<{kind}>)"

    def scanned(own: str, at: str, powers: list[str]) -> str:
        a, b, x, t = (f"{own}_{c}" for c in "abxt")
        if not powers:
            return (
                f"aggregate({own}, named_struct('at', {at}, 'out', {none}), ({a}, {x}) -> "
                f"named_struct('at', cast({step(f'{a}.at', x)} AS {kind}), 'out', array_append({a}.out, {a}.at)), {a} -> {a}.out)"
            )
        total = f"aggregate({x}, {a}.at, ({own}_s, {own}_y) -> cast({step(f'{own}_s', f'{own}_y')} AS {kind}))"
        starts = (
            f"aggregate({b}, named_struct('at', {at}, 'out', {none}), ({a}, {x}) -> "
            f"named_struct('at', {total}, 'out', array_append({a}.out, {a}.at)), {a} -> {a}.out)"
        )
        return bound(blocks(own, powers[0]), b, f"flatten(zip_with({b}, {starts}, ({x}, {t}) -> {scanned(x, t, powers[1:])}))")

    body = scanned(name, f"cast({start} AS {kind})", ["2D / 3", "0.5"])
    return bound(values, name, f"CASE WHEN size({name}) = 0 THEN {none} ELSE {body} END")


def sums_before(values: str, name: str = "v") -> str:
    return before(values, "0", lambda a, b: f"{a} + {b}", name=name)


def most_before(values: str, name: str = "v") -> str:
    return before(values, "0", lambda a, b: f"greatest({a}, {b})", name=name)


def least_after(values: str, none: str, name: str = "v") -> str:
    """For each of ``values`` the least of all later ones, or ``none``."""
    return f"reverse({before(f'reverse({values})', none, lambda a, b: f'least({a}, {b})', name=name)})"


def first_at_least(ascending: str, target: str, name: str = "b") -> str:
    """Place (from 0) of the first of ``ascending`` values that is ``target`` or more; their number if none is."""
    s, mid = f"{name}_s", f"(({name}_s.lo + {name}_s.hi) div 2)"
    step = f"CASE WHEN {s}.lo >= {s}.hi THEN {s} WHEN {ascending}[{mid}] >= {target} THEN named_struct('lo', {s}.lo, 'hi', {mid}) ELSE named_struct('lo', {mid} + 1, 'hi', {s}.hi) END"
    return f"aggregate(sequence(1, length(bin(size({ascending})))), named_struct('lo', 0L, 'hi', cast(size({ascending}) AS bigint)), ({s}, {name}_k) -> {step}, {s} -> cast({s}.lo AS int))"


def orbit(after: str, name: str = "o") -> str:
    """Places that ``after`` leads to from 0, in order: it holds for each of n places a later one, up to n, and n for n itself.

    Pointer doubling: tables of 1, 2, 4, ... steps, then each place by the bits of its number.
    """
    t, n = f"{name}_t", f"(size({name}_t[0]) - 1)"
    tables = f"aggregate(sequence(1, length(bin(size({after})))), array({after}), ({name}_a, {name}_k) -> array_append({name}_a, transform(element_at({name}_a, -1), {name}_x -> element_at({name}_a, -1)[{name}_x])))"
    jump = f"{t}[{name}_l][{name}_s.p]"
    last = (
        f"aggregate(sequence(size({t}) - 1, 0, -1), named_struct('p', 0, 'k', 0), ({name}_s, {name}_l) -> CASE WHEN {jump} < {n} "
        f"THEN named_struct('p', {jump}, 'k', {name}_s.k + cast(shiftleft(1, {name}_l) AS int)) ELSE {name}_s END, {name}_s -> {name}_s.k)"
    )
    place = f"aggregate(sequence(0, size({t}) - 1), 0, ({name}_p, {name}_l) -> CASE WHEN shiftright({name}_i, {name}_l) & 1 = 1 THEN {t}[{name}_l][{name}_p] ELSE {name}_p END)"
    return bound(tables, t, f"CASE WHEN {n} = 0 THEN cast(array() AS array<int>) ELSE transform(sequence(0, {last}), {name}_i -> {place}) END")
