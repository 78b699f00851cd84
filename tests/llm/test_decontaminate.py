import random
import re

import numpy as np
import pytest
from oracle import both

from tracequill.llm import decontaminate, fmindex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(texts, items, width=10):
    """(n_words, spans, items) of every text."""
    windows = {}
    for item, text in items:
        w = plain_words(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + width]), set()).add("" if item is None else str(item))
    out = []
    for text in texts:
        w, hit, found = plain_words(text), set(), set()
        for i in range(len(w)):
            for size in {len(x) for x in windows}:
                if i + size <= len(w) and (own := windows.get(tuple(w[i : i + size]))):
                    hit |= set(range(i, i + size))
                    found |= own
        spans = decontaminate.merged([(i, i + 1) for i in hit])
        out.append((len(w), spans, sorted(found)))
    return out


def made(seed):
    rng = random.Random(seed)
    some = [f"w{i}" for i in range(12)] + ["É", "naïve", "x" * 300, "1"]
    prose = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(some) for _ in range(n))
    items = [(i, prose(rng.choice([0, 1, 2, 3, 9, 10, 11, 40]))) for i in range(12)] + [(None, "W1 w2 w3"), (3, "w1 w2 w3"), (77, None), (78, "unseen words only")]
    texts = [prose(rng.randint(0, 60)) for _ in range(50)]
    texts += [prose(5) + " oov " + (rng.choice(items)[1] or "") + " " + prose(3) for _ in range(20)]
    texts += [items[7][1] or "", items[7][1] or "", None, "", " .,; ", "w1", "w1 w2 w3", "W1, W2! w3 w1 w2 w3", "w1 oov w2 w3", ("w1 w2 w3 " * 200).strip()]
    return texts, items


def test_suffix_order_and_search_equal_scan():
    rng = np.random.default_rng(2)
    for n in [1, 2, 3, 10, 200, 3000]:
        for v in (1, 3, 40):
            symbols = rng.integers(0, v + 1, n).astype(np.int32)
            symbols[-1] = 0
            if n > 100:
                symbols[50:90] = symbols[10:50]
            ends = np.flatnonzero(symbols == 0)
            key = lambda i: [(1, int(c)) if c else (0, i + k) for k, c in enumerate(symbols[i : ends[np.searchsorted(ends, i)] + 1])]  # noqa: B023, E731
            if n <= 200:
                assert fmindex.suffix_order(symbols).tolist() == sorted(range(n), key=key)
            own = fmindex.FMIndex(symbols, v + 1, rate=rng.choice([1, 2, 16]))
            patterns = rng.integers(1, v + 1, (60, 4)).astype(np.int32)
            patterns[:20, :2] = 0
            patterns[20:30, 0] = 0
            lo, hi = own.search(patterns)
            for p, a, b in zip(patterns.tolist(), lo, hi, strict=True):
                p = [c for c in p if c]
                want = [i for i in range(n - len(p) + 1) if symbols[i : i + len(p)].tolist() == p]
                assert sorted(own.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("shard", [12, 40, 1 << 20])
def test_texts_equal_brute_force(shard):
    for seed in range(5):
        texts, items = made(seed)
        rows = [("" if i is None else str(i), (t or "").encode()) for i, t in items]
        own = decontaminate.Windows(rows)
        assert decontaminate.search_texts([(t or "").encode() for t in texts], own, shard) == plain(texts, items)


@pytest.mark.parametrize("limit", [decontaminate.BLOCK_BYTES, 900])
def test_rows_blocks_and_other_columns(spark, limit, monkeypatch):
    """A benchmark of several blocks, long items in pieces, null and repeated rows, columns with clashing names."""
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    texts, items = made(9)
    docs = spark.createDataFrame([(i % 40 or None, t, i, "s") for i, t in enumerate(texts)], "doc_id long, text string, item_id long, n_words string")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted((r.item_id, r.doc_id, r.text, r.n_words, r._hits.n_words, [tuple(x) for x in r._hits.spans], list(r._hits["items"])) for r in decontaminate.marked(docs, bench, block_bytes=limit).collect())
    assert got == [(i, i % 40 or None, t, "s", *found) for i, (t, found) in enumerate(zip(texts, plain(texts, items), strict=True))]
    assert (decontaminate._blocks(bench, 10, limit)[1] > 1) == (limit == 900)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.marked(docs.limit(0), bench).count() == 0
    assert [tuple(r._hits) for r in decontaminate.marked(docs, bench.limit(0)).collect()] == [(3, [], [])]


def test_removed_texts(spark):
    docs = spark.createDataFrame([(1, "Say: One, two THREE. End"), (2, None), (3, "nothing")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert sorted((r.doc_id, r.text) for r in decontaminate.removed(docs, bench).collect()) == [(1, "Say: . End"), (2, None), (3, "nothing")]


def test_query_equals_sql(spark, sf_dir):
    got, want = both(spark, sf_dir, decontaminate.op11_decontaminate, decontaminate.OP11_SQL)
    assert got == want and any("True" in r for r in got)
