import numpy as np
import xxhash
from pyspark.sql import functions as F

from tracequill.llm import simhash


def plain_print(text):
    import re

    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: {doc_id: fp}; smallest doc_id reachable by links of at most 3 bits."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            if (prints[ids[x]] ^ prints[ids[y]]).bit_count() <= 3:
                a, b = sorted((find(ids[x]), find(ids[y])))
                root[b] = a
    return {i: find(i) for i in ids}


def test_whole_table_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: plain_print(t) for i, t in texts.items()}
    want = plain_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op4_simhash(spark, sf_dir).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in texts}


def test_edge_cases(spark):
    rows = [(5, None, "x"), (3, "", "y"), (9, " \t\n", "z"), (4, "One two THREE four", "a"), (2, "one Two three FOUR", "b"), (7, "one", "c"), (7, "one", "c"), (None, "one", "d"), (8, "word " * 70000, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.components(docs).collect())
    assert got == [(-1, 7), (2, 2), (3, 3), (4, 2), (5, 3), (7, 7), (7, 7), (8, 8), (9, 3)]
    assert simhash.components(docs.limit(0)).count() == 0


def test_hot_buckets_lose_no_link(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 3, dtype=np.uint64)
    fps = set()
    for b in base:
        for _ in range(400):
            x = int(b)
            for bit in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    want = plain_components(dict(enumerate(fps)))
    points = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    for size in (8, 64, 4096):
        member = {r.node: r.root for r in simhash.classes(simhash.links(points, size=size)).collect()}
        got = {}
        for i, x in enumerate(fps):
            got.setdefault(member.get(simhash._signed(x), simhash._signed(x)), []).append(i)
        groups = {}
        for i, r in want.items():
            groups.setdefault(r, []).append(i)
        assert sorted(got.values()) == sorted(groups.values()), size


def test_gray_forest_equals_scan():
    rng = np.random.default_rng(1)
    for sizes in ([1200], [1, 2, 3, 4, 5, 16, 17, 64, 65, 300], [2] * 500, [1, 1], []):
        groups = [np.unique(np.concatenate([rng.integers(0, 1 << 63, n // 2 + 1, dtype=np.uint64), rng.integers(0, 1 << 12, n, dtype=np.uint64)]))[:n] for n in sizes]
        fps = np.concatenate([rng.permutation(g) for g in groups]) if groups else np.zeros(0, np.uint64)
        ends = np.cumsum([len(g) for g in groups]).astype(np.int64)
        begins = ends - np.array([len(g) for g in groups], np.int64)
        forest = simhash.GrayForest(fps, begins, ends)
        want = {(k, *sorted((int(a), int(b)))) for k, g in enumerate(groups) for x, a in enumerate(g) for b in g[:x] if (int(a) ^ int(b)).bit_count() <= 3}
        got = []
        for lo in range(0, len(fps), 100):
            i, j = forest.near(lo, min(len(fps), lo + 100), 3)
            got += [(int(forest.group[x]), *sorted((int(forest.fps[x]), int(forest.fps[y])))) for x, y in zip(i, j, strict=True)]
        assert len(got) == len(set(got)) and set(got) == want
        if sizes == [1200]:
            assert forest.pruned > 10_000 and forest.compared < 1200 * 1199 // 4


def test_driver_links_all_come_from_the_forest(spark, monkeypatch):
    """Every bucket of the table goes through the index, and it gives all links."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prints = sorted({r.fp for r in simhash.fingerprints(docs).select("fp").distinct().collect()})
    dealt = simhash.buckets(spark.createDataFrame([(x,) for x in prints], "fp long")).orderBy("mask", "bits", "fp").collect()
    keys = np.array([(r.mask, r.bits) for r in dealt], np.int64)
    cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
    begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
    forest = simhash.GrayForest(np.array([r.fp for r in dealt], np.int64).view(np.uint64), begins, ends)
    i, j = forest.near(0, len(keys), 3)
    found = {tuple(sorted((int(forest.fps[a]), int(forest.fps[b])))) for a, b in zip(i, j, strict=True)}
    own = [x & (1 << 64) - 1 for x in prints]
    assert found == {tuple(sorted((a, b))) for k, a in enumerate(own) for b in own[:k] if (a ^ b).bit_count() <= 3}
    assert forest.tested >= len(keys) and forest.compared > 0


def test_hot_classes_and_hubs(spark, monkeypatch):
    monkeypatch.setattr(simhash.skew, "MIN_HOT", 5)
    monkeypatch.setattr(simhash.skew, "MOST_HOT", 50)
    text = [f"alpha beta gamma {'delta ' * (i % 3)}" for i in range(200)] + [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "doc_id long, text string")
    want = plain_components({i: plain_print(t) for i, t in enumerate(text)})
    assert {r.doc_id: r.component_id for r in simhash.components(docs).collect()} == want


def test_chain_contracts(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {(r.node, r.root) for r in simhash.classes(edges).collect()} == {(i, 0) for i in range(1, 201)}
