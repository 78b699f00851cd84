import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from oracle import both

from tracequill.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return Counter(re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or ""))


def plain(docs, items, k=10):
    own = [(i, plain_terms(t)) for i, t in docs]
    own = [(i, t, sum(t.values())) for i, t in own if t]
    n_docs, n_terms = len(own), sum(n for _, _, n in own)
    df = Counter(t for _, x, _ in own for t in x)
    out = []
    for item, text in items:
        scored = []
        for doc_id, tf, n in own:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 8 * m)) for t, c in plain_terms(text).items() if tf[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def made(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"t{i}" for i in range(40)] + ["É", "naïve", "x" * 200, "9"]
    prose = lambda n: rng.choice([" ", "--", "\n"]).join(rng.choice(vocabulary[: rng.choice([4, 20, 44])]) for _ in range(n))
    docs = [(i, prose(rng.choice([0, 1, 3, 30, 90]))) for i in range(n)]
    docs += [(7, docs[5][1]), (7, docs[5][1]), (None, docs[5][1]), (None, None), (500, ""), (501, "..."), (502, "T1 " * 4000), (503, docs[8][1].upper())]
    docs += [(600 + i, docs[9][1]) for i in range(30)]
    items = [(i, prose(rng.choice([1, 5, 30]))) for i in range(8)] + [(8, None), (9, ""), (None, "t1 T1 t2"), (3, "unknown"), (3, docs[9][1] or "t3")]
    return docs, items


@pytest.mark.parametrize(("shard", "block"), [(lexical.SHARD_WORDS, lexical.BLOCK_BYTES), (50, lexical.BLOCK_BYTES), (300, 200)])
def test_ranking_equals_brute_force(spark, shard, block):
    """Shards and query blocks of any size; ties, copies, null ids and texts, clashing names."""
    docs, items = made(3)
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, score int")
    own = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = sorted((tuple(r) for r in lexical.ranked(df, own, shard_words=shard, block_bytes=block).collect()), key=repr)
    assert got == plain(docs, items)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert lexical.ranked(docs.limit(0), items).count() == 0
    assert lexical.ranked(docs, items.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in lexical.ranked(docs, items).collect()] == [(1, 1, 1)]


def test_bounds_hold_and_spare_most_documents():
    """Impacts bound every part from both sides, and few documents need their exact score."""
    rng = np.random.default_rng(4)
    tf, m = rng.integers(1, 10**6, 10_000), rng.integers(25, 10**7, 10_000)
    tf[:5_000] = rng.integers(1, 5, 5_000)
    parts = lexical.part(tf, m)
    impact = -(-parts // lexical.UNIT)
    assert impact.max() <= 255 and (impact * lexical.UNIT >= parts).all() and ((impact - 1) * lexical.UNIT <= parts).all()
    import pyarrow.parquet as pq

    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    items = pq.read_table("/root/testdata/sf0.01/benchmark.parquet").to_pylist()
    n_docs = sum(bool(lexical.words((d["text"] or "").encode())) for d in docs)
    n_terms = sum(len(lexical.words((d["text"] or "").encode())) for d in docs)
    shard = lexical._Shard()
    for d in docs:
        shard.add(d["doc_id"], (d["text"] or "").encode())
    terms, *blobs = shard.row(n_docs, n_terms)
    names = terms.split(b" ")
    place = {t: i for i, t in enumerate(names)}
    starts = np.frombuffer(blobs[0], np.int32)
    queries = [[(place[t], lexical.weight(int(starts[place[t] + 1] - starts[place[t]]), n_docs) * c) for t, c in Counter(lexical.words(x["text"].encode())).items() if t in place] for x in items]
    ranking = lexical.Ranking(queries, 10)
    ranking.add({i: i for i in range(len(names))}, *(np.frombuffer(x, t) for x, t in zip(blobs, (np.int32, np.int32, np.uint8, np.int32, np.int64, np.uint8, np.int64), strict=True)))
    got = sorted(((x["item_id"], r, d, -s) for x, best in zip(items, ranking.best, strict=True) for r, (s, _, d) in enumerate(best, 1)), key=repr)
    assert got == plain([(d["doc_id"], d["text"]) for d in docs], [(x["item_id"], x["text"]) for x in items])
    assert ranking.scored < ranking.bounded / 10


def test_query_equals_sql(spark, sf_dir):
    got, want = both(spark, sf_dir, lexical.op12_lexical, lexical.OP12_SQL)
    assert got == want and len(got) > 100
