"""External induced suffix sorting for shards of text, with common-prefix values.

:class:`Sorter` sorts the suffixes of a string by induced copying. What its queue carries is a
tuple of suffix and common-prefix length with the one before it in its bucket. The queue
hands buckets out in order of priority (ascending for L, descending for S suffixes) and
first in, first out inside one, so it is a monotone priority queue; beyond
its memory share it spills bucket chunks to files of its own folder, as do the sorted
runs. Texts, types and results beyond that share are files mapped into memory.

The common prefix of two suffixes copied into one bucket is one more than the least
value scanned between them, for which the sorter keeps, by bucket, the least value since the
last copy. Where L and S suffixes of a bucket meet, it is the shorter run of the bucket's symbol.
LMS substrings are sorted by induction first and named, and their string is sorted by
recursion: the same induction while its names are beyond memory's share, else in memory.
A common prefix of names gives one of symbols, up to the LMS substring in which two suffixes differ.

Orders are exact to ``DEPTH`` symbols and values end there.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable

import numpy as np

DEPTH = 200
MEMORY = 16 << 20


class BucketQueue:
    """FIFO chunks of packed tuples (suffix, common prefix) by bucket; the largest are moved to disk beyond ``memory`` bytes."""

    def __init__(self, folder: str, memory: int):
        self.folder, self.memory, self.held = folder, memory, 0
        self.chunks: dict[int, list] = {}
        self.files = 0
        self.spilled = 0

    def push(self, bucket: int, suffixes: np.ndarray) -> None:
        self.chunks.setdefault(bucket, []).append(suffixes)
        self.held += suffixes.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        sizes = {b: sum(c.nbytes for c in cs if not isinstance(c, str)) for b, cs in self.chunks.items()}
        for bucket in sorted(sizes, key=sizes.get, reverse=True):
            if self.held <= self.memory // 2 or not sizes[bucket]:
                break
            out, run = [], []
            for c in [*self.chunks[bucket], ""]:
                if isinstance(c, str):
                    if run:
                        out.append(self._write(np.concatenate(run)))
                        run = []
                    if c:
                        out.append(c)
                else:
                    run.append(c)
            self.chunks[bucket] = out
            self.held -= sizes[bucket]

    def _write(self, suffixes: np.ndarray) -> str:
        self.files += 1
        self.spilled += suffixes.nbytes
        path = os.path.join(self.folder, f"{id(self)}-{self.files}")
        suffixes.tofile(path)
        return path

    def pop(self, bucket: int) -> np.ndarray | None:
        """All that was pushed to a bucket, in order; None if nothing."""
        chunks = self.chunks.pop(bucket, None)
        if not chunks:
            return None
        parts = []
        for c in chunks:
            if isinstance(c, str):
                parts.append(np.fromfile(c, np.int64))
                os.unlink(c)
            else:
                self.held -= c.nbytes
                parts.append(c)
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _range_least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo:hi] for each pair lo < hi."""
    span = hi - lo
    if not len(span):
        return values[:0]
    level = np.frexp(span)[1] - 1
    out = np.empty(len(span), values.dtype)
    table = values
    for k in range(int(level.max()) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k)])
        if len(table) > 1 << k:
            table = np.minimum(table[: -(1 << k)], table[1 << k :])
    return out


class Scan:
    """One direction of induction: by symbol, the least common prefix scanned since the last copy to its bucket."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queue: BucketQueue, symbols: int, carry: bool):
        self.text, self.wanted, self.queue, self.carry = text, wanted, queue, carry
        self.low = np.full(symbols, DEPTH, np.uint8)
        self.begun = np.zeros(symbols, bool)

    def copy(self, suffixes: np.ndarray, common: np.ndarray) -> None:
        """Push those predecessors of scanned ``suffixes`` that are wanted, keeping their order in each bucket."""
        at = np.flatnonzero(suffixes > 0)
        before = suffixes[at] - 1
        ok = self.wanted[before]
        at, before = at[ok], before[ok]
        if not len(before):
            if self.carry:
                np.minimum(self.low, common.min(), out=self.low)
            return
        first = self.text[before]
        order = np.argsort(first, kind="stable")
        first, before, at = first[order], before[order], at[order]
        heads = np.concatenate([[0], np.flatnonzero(first[1:] != first[:-1]) + 1])
        tails = np.concatenate([heads[1:], [len(first)]]) - 1
        if self.carry:
            since = np.concatenate([[0], at[:-1] + 1])
            since[heads] = 0
            least = _range_least(common, since, at + 1)
            bucket = first[heads]
            least[heads] = np.minimum(least[heads], self.low[bucket])
            value = np.minimum(least.astype(np.int64) + 1, DEPTH)
            value[heads[~self.begun[bucket]]] = 0
            self.begun[bucket] = True
            np.minimum(self.low, common.min(), out=self.low)
            after = np.append(np.minimum.accumulate(common[::-1])[::-1], np.uint8(DEPTH))
            self.low[bucket] = after[at[tails] + 1]
            before = before << 8 | value
        else:
            before = before << 8
        for c, lo, hi in zip(first[heads].tolist(), heads.tolist(), (tails + 1).tolist(), strict=True):
            self.queue.push(c, before[lo:hi])


class Sorter:
    """Induced sorting of one text over an alphabet of 16-bit symbols; the last symbol is the least."""

    def __init__(self, text: np.ndarray, memory: int = MEMORY):
        self.memory = memory
        self.folder = tempfile.mkdtemp(prefix="suffixes-")
        self.spilled = self.mapped = self.deeper = 0
        self.text = self._held(text)
        self.turns = np.flatnonzero(text[:-1] != text[1:])

    def __enter__(self) -> Sorter:
        return self

    def __exit__(self, *_: object) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)

    def _array(self, n: int, dtype) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if size <= self.memory:
            return np.empty(n, dtype)
        self.mapped += 1
        return np.memmap(os.path.join(self.folder, f"mapped-{self.mapped}"), dtype, "w+", shape=(n,))

    def _held(self, values: np.ndarray) -> np.ndarray:
        if values.nbytes <= self.memory:
            return values
        out = self._array(len(values), values.dtype)
        out[:] = values
        return out

    def _types(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether each suffix is of type S, and the LMS positions."""
        t, turns = self.text, self.turns
        n = len(t)
        rises = t[turns] < t[turns + 1]
        small = np.ones(n, bool)
        lengths = np.diff(np.concatenate([[-1], turns]))
        small[: len(lengths) and int(turns[-1]) + 1] = np.repeat(rises, lengths)
        lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int64) + 1
        return self._held(small), lms

    def _run(self, suffix: int) -> int:
        """How often the first symbol of a suffix stands there in a row."""
        k = int(np.searchsorted(self.turns, suffix))
        return (int(self.turns[k]) if k < len(self.turns) else len(self.text) - 1) - suffix + 1

    def _seam(self, one: int, other: int) -> int:
        return 0 if one < 0 else min(DEPTH, self._run(one), self._run(other))

    def induce(self, small: np.ndarray, lms: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes and their common prefixes with the one before, given those of LMS positions in order.

        Without ``common`` only the order of LMS substrings comes out, and no values.
        """
        text, n, carry = self.text, len(self.text), common is not None
        first = text[lms]
        if not carry:
            order = np.argsort(first, kind="stable")
            lms, first = lms[order], first[order]
            common = np.zeros(len(lms), np.uint8)
        symbols = np.unique(text).tolist()
        cuts = np.searchsorted(first, symbols).tolist(), np.searchsorted(first, symbols, side="right").tolist()
        queue, runs = BucketQueue(self.folder, self.memory), BucketQueue(self.folder, self.memory)
        up = Scan(text, ~small, queue, symbols[-1] + 1, carry)
        for c, lo, hi in zip(symbols, *cuts, strict=True):
            last = -1
            while (ready := queue.pop(c)) is not None:
                runs.push(c, ready)
                suffixes = ready >> 8
                up.copy(suffixes, (ready & 255).astype(np.uint8))
                last = int(suffixes[-1])
            if hi > lo:
                own = common[lo:hi].copy()
                own[0] = self._seam(last, int(lms[lo])) if carry else 0
                up.copy(lms[lo:hi], own)
        down = Scan(text, small, queue, symbols[-1] + 1, carry)
        found, values, at = self._array(n, np.int64), self._array(n, np.uint8), n

        def scanned(suffixes: np.ndarray, own: np.ndarray) -> int:
            nonlocal at
            down.copy(suffixes, own)
            found[at - len(suffixes) : at] = suffixes[::-1]
            values[at - len(suffixes) : at] = own[::-1]
            at -= len(suffixes)
            return int(suffixes[-1])

        for c in reversed(symbols):
            last = -1
            if c == symbols[0]:
                last = scanned(np.array([n - 1]), np.zeros(1, np.uint8))
            while (ready := queue.pop(c)) is not None:
                last = scanned(ready >> 8, (ready & 255).astype(np.uint8))
            ready = runs.pop(c)
            if ready is not None:
                suffixes, own = (ready >> 8)[::-1], (ready & 255).astype(np.uint8)
                seam = self._seam(last, int(suffixes[0])) if carry else 0
                scanned(suffixes, np.concatenate([np.array([seam], np.uint8), own[:0:-1]]))
        self.spilled += queue.spilled + runs.spilled
        values[1:] = values[:-1].copy()  # scanned downwards, a value belongs to the one above
        values[0] = 0
        return found, values

    def _names(self, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
        """Names of LMS substrings in text order; equal substrings have one name."""
        text = self.text
        at = np.full(len(text) + 1, -1, np.int32)
        at[lms] = np.arange(len(lms), dtype=np.int32)
        rank = at[ordered]
        ends = np.concatenate([lms[1:], [len(text) - 1]]).astype(np.int32)
        lengths = (ends - lms + 1)[rank]
        a, b = ordered[:-1], ordered[1:]
        same = lengths[:-1] == lengths[1:]
        open_ = np.flatnonzero(same)
        k = 0
        while len(open_):
            equal = text[a[open_] + k] == text[b[open_] + k]
            same[open_[~equal]] = False
            k += 1
            open_ = open_[equal]
            open_ = open_[lengths[open_] > k]
        named = np.concatenate([[0], np.cumsum(~same)])
        names = np.empty(len(lms), np.int64)
        names[rank] = named
        return names, int(named[-1]) + 1

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in order, and the common prefix of each with the one before."""
        small, lms = self._types()
        if not len(lms):
            return np.zeros(1, np.int64), np.zeros(1, np.uint8)  # the last symbol alone
        rough, _ = self.induce(small, lms)
        is_lms = np.zeros(len(self.text), bool)
        is_lms[lms] = True
        ordered = rough[is_lms[rough]]
        names, count = self._names(lms, ordered)
        by_name, alike = self._reduced(names, count)
        return self.induce(small, lms[by_name], self._in_symbols(lms, by_name, alike))

    def _reduced(self, names: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes of the string of names and their common prefixes in names; each name covers two symbols or more."""
        if count < len(names) and count < (1 << 16) - 1 and names.nbytes > self.memory:
            with Sorter(np.concatenate([names + 1, [0]]).astype(np.uint16), self.memory) as deeper:
                found, values = deeper.order()
                self.spilled, self.deeper = self.spilled + deeper.spilled, 1 + deeper.deeper
                return np.array(found[1:]), np.array(values[1:])
        order = _order_in_memory(names, count)
        padded = np.append(names, -1)
        alike = np.zeros(len(order), np.uint8)
        open_ = np.arange(1, len(order))
        for k in range(DEPTH // 2 + 1):
            open_ = open_[padded[order[open_ - 1] + k] == padded[order[open_] + k]]
            if not len(open_):
                break
            alike[open_] = k + 1
        return order, alike

    def _in_symbols(self, lms: np.ndarray, order: np.ndarray, alike: np.ndarray) -> np.ndarray:
        """Common prefixes of neighbouring LMS suffixes: the names they share, then the symbols of the first that differs."""
        out = np.zeros(len(order), np.uint8)
        if len(order) < 2:
            return out
        a, b, k = order[:-1], order[1:], alike[1:].astype(np.int64)
        known = lms[np.minimum(a + k, len(lms) - 1)] - lms[a]
        length = np.minimum(known, DEPTH)
        open_ = np.flatnonzero(known < DEPTH)
        x, y = lms[a] + known, lms[b] + known
        while len(open_):
            open_ = open_[self.text[x[open_]] == self.text[y[open_]]]
            length[open_] += 1
            x[open_] += 1
            y[open_] += 1
            open_ = open_[length[open_] < DEPTH]
        out[1:] = length
        return out


def _order_in_memory(names: np.ndarray, count: int) -> np.ndarray:
    """Order of the suffixes of ``names`` by ranks of growing prefixes, to a depth of DEPTH symbols."""
    n = len(names)
    if count == n:
        out = np.empty(n, np.int64)
        out[names] = np.arange(n)
        return out
    rank, reach = names, 1
    while True:
        bits = max(1, int(count).bit_length())
        ways = max(2, 63 // bits)
        key = np.zeros(n, np.int64)
        for j in range(ways):
            key <<= bits
            if j * reach < n:
                key[: n - j * reach] |= rank[j * reach :] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        count = int(rank[order[-1]]) + 1
        reach *= ways
        if count == n or 2 * reach > DEPTH:
            return order


def suffix_order(text: bytes, memory: int = MEMORY) -> np.ndarray:
    """Start positions of the suffixes of ``text``, in order to a depth of ``DEPTH`` bytes."""
    symbols = np.frombuffer(text, np.uint8).astype(np.uint16) + np.uint16(1)
    with Sorter(np.concatenate([symbols, np.zeros(1, np.uint16)]), memory) as own:
        return np.array(own.order()[0][1:])


def joined(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Segments with a separator below all bytes after each, then the end symbol; their starts."""
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    starts = np.cumsum(lengths + 1) - lengths - 1
    text = np.ones(int(lengths.sum()) + len(segments) + 1, np.uint16)
    body = np.frombuffer(b"\0".join(segments), np.uint8).astype(np.uint16) + np.uint16(2)
    text[: len(body)] = body
    text[starts + lengths] = 1
    text[-1] = 0
    return text, starts


def equal_windows(segments: list[bytes], width: int = DEPTH, memory: int = MEMORY, spilled: Callable[[int], None] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of every window of ``width`` bytes that occurs at two places of the segments or more.

    ``spilled`` is told how many bytes went to disk.
    """
    if width > DEPTH:
        raise ValueError(f"orders are exact to {DEPTH} bytes")
    text, starts = joined(segments)
    lengths = np.fromiter(map(len, segments), np.int64, len(segments))
    begins = np.zeros(len(text) + 1, np.int32)
    roomy = lengths >= width
    np.add.at(begins, starts[roomy], 1)
    np.add.at(begins, starts[roomy] + lengths[roomy] - width + 1, -1)
    fits = np.cumsum(begins[:-1]) > 0
    with Sorter(text, memory) as own:
        order, common = own.order()
        if spilled is not None:
            spilled(own.spilled)
        at = np.flatnonzero(fits[order])
        order = np.array(order[at])
        near = np.minimum.reduceat(common, at[:-1] + 1)[: len(at) - 1] >= width if len(at) > 1 else np.zeros(0, bool)
        if len(at) > 1 and at[-1] + 1 < len(common):
            near[-1] = common[at[-2] + 1 : at[-1] + 1].min() >= width
    twice = np.concatenate([near, [False]]) | np.concatenate([[False], near]) if len(order) else np.zeros(0, bool)
    at = np.sort(order[twice])
    which = np.searchsorted(starts, at, side="right") - 1
    return which, at - starts[which]
