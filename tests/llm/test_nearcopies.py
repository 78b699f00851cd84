import os
import random
import sys
from collections import Counter, defaultdict

sys.path.insert(0, os.path.dirname(__file__))
from test_pipeline import plain_rejected  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from tracequill.llm import nearcopies  # noqa: E402

near_duplicates = dict(corpus_pipeline.STAGES)["simhash near-dedup"]


def plain_kept(texts):
    """texts: {doc_id: text}; smallest doc_ids of the classes of links with Jaccard >= 0.8."""
    shingles = {}
    for i, text in texts.items():
        words = (text or "").encode().lower().split()
        shingles[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    holders, shared = defaultdict(list), Counter()
    for i in sorted(texts):
        for s in shingles[i]:
            shared.update((j, i) for j in holders[s])
            holders[s].append(i)
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), both in shared.items():
        if 10 * both >= 8 * (len(shingles[a]) + len(shingles[b]) - both):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i for i in texts if find(i) == i}


def kept(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id for r in near_duplicates(spark, docs, None).collect()}


def test_test_tables_equal_brute_force(spark):
    for sf in ("sf0.001", "sf0.01"):
        rows = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()
        texts = {r.doc_id: r.text for r in rows if not plain_rejected(r.text)}
        assert kept(spark, texts) == plain_kept(texts)


def test_planted_copies_and_a_common_passage(spark):
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, base, texts = words(60), words(200), {}
    for i in range(60):
        texts[i] = " ".join(words(60) + passage)  # far below 0.8
    for i in range(100, 160):
        copy = list(base)
        for at in rng.sample(range(200), rng.randrange(8)):
            copy[at] = "other"
        texts[i] = " ".join(copy)
    for i in range(200, 240):
        own = words(rng.randrange(1, 90))
        texts[i], texts[i + 100] = " ".join(own), " ".join(own + words(rng.randrange(12)))
    assert kept(spark, texts) == plain_kept(texts)


def test_prefixes_of_near_sets_meet():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in range(1, 60):
        a = np.unique(rng.integers(-1000, 1000, n))
        b = a[rng.random(len(a)) < 0.93]
        if 5 * len(b) >= 4 * len(a):
            a, b = (x * np.int64(0x9E3779B97F4A7C1) for x in (a, b))
            a.sort(), b.sort()
            common = rng.integers(3, 6, nearcopies.COUNTERS)
            assert set(nearcopies.prefix(a, common)) & set(nearcopies.prefix(b, common))


def test_rows_of_one_doc_id_in_different_classes_stay(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(7, one), (7, two), (7, two + " end"), (8, one), (9, two), (None, "c " + one[::-1]), (None, "c " + one[::-1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.text[0]) for r in near_duplicates(spark, docs, None).collect())
    assert found == [(0, "c"), (7, "a"), (7, "b")]


def test_a_crowd_of_copies_below_the_similarity_is_no_product_of_its_members(spark):
    rng = random.Random(5)
    base, texts = [f"w{i}" for i in range(150)], {}
    for i in range(400):
        copy = list(base)
        for at in rng.sample(range(150), rng.choice((1, 2, 3, 5, 7))):
            copy[at] = f"own{i}-{at}"
        texts[i] = " ".join(copy)
    assert kept(spark, texts) == plain_kept(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = nearcopies.sets(docs.withColumn("_row", F.struct(F.lit("").alias("f"), F.col("doc_id").alias("i"))), nearcopies.common_hashes(docs))
    shared = nearcopies._shared(found).cache()
    tried = nearcopies._central(shared).distinct()
    assert tried.count() <= shared.count()
    links = nearcopies._checked(tried, nearcopies._arrays(docs))
    assert nearcopies._meeting(shared.withColumn("root", F.col("node"))).count() > 20 * len(texts)
    member = {r.node: r.root for r in nearcopies.simhash.classes(links).collect()}
    rooted = shared.join(spark.createDataFrame(list(member.items()), "node long, root long"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    assert nearcopies._meeting(rooted).count() < 5 * len(texts)


def test_every_link_meets_under_some_hash(spark):
    rng = random.Random(6)
    base, texts = [f"w{i}" for i in range(120)], {}
    for i in range(150):
        lo = rng.randrange(20)
        copy = base[lo : lo + rng.randrange(60, 101)]
        copy[rng.randrange(len(copy))] = f"own{i % 40}"
        texts[i] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = docs.withColumn("_row", F.struct(F.lit("").alias("f"), F.col("doc_id").alias("i")))
    found = nearcopies.sets(rows, nearcopies.common_hashes(docs)).dropDuplicates(["node"]).cache()
    met = {(r.a, r.b) for r in nearcopies._meeting(nearcopies._shared(found).withColumn("root", F.col("node"))).collect()}
    sets = {}
    for text in texts.values():
        own = nearcopies.hashes(text.encode())
        sets[nearcopies.node(own)] = set(own.tolist())
    nodes = sorted(sets)
    links = {(a, b) for k, a in enumerate(nodes) for b in nodes[k + 1 :] if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))}
    assert links and links <= met


def test_all_texts_count(spark):
    texts = ["a b c d e f", "a b c d e", "a b c d e g", None, "a b c d e f"]
    docs = spark.createDataFrame([(x,) for x in texts], "text string").repartition(4)
    want = Counter(k for x in texts for k in nearcopies._counter(nearcopies.hashes((x or "").encode())).tolist())
    found = nearcopies.common_hashes(docs)
    assert {int(k): int(found[k]) for k in found.nonzero()[0]} == want and max(want.values()) == 4
    assert not nearcopies.common_hashes(docs.limit(0)).any()


def test_a_template_below_the_similarity_makes_few_candidates(spark):
    rng = random.Random(8)
    template = [f"t{i}" for i in range(86)]
    texts = [" ".join(template + [f"o{rng.randrange(10**6)}" for _ in range(14)]) for _ in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = docs.withColumn("_row", F.struct(F.lit("").alias("f"), F.col("doc_id").alias("i")))
    shared = nearcopies._shared(nearcopies.sets(rows, nearcopies.common_hashes(docs))).cache()
    tried = nearcopies._central(shared).count() + nearcopies._meeting(shared.withColumn("root", F.col("node"))).count()
    assert tried < 10 * len(texts)


def test_kept_rows_are_not_shuffled(spark, tmp_path, monkeypatch):
    texts = {i: " ".join(f"w{i // 2 % 5000}-{k}" for k in range(6)) for i in range(9000)}
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2).write.parquet(path)
    docs = spark.read.parquet(path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = near_duplicates(spark, docs, None)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "text" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
        assert sorted(r.doc_id for r in found.collect()) == list(range(0, 9000, 2))
        monkeypatch.setattr(nearcopies, "MAX_BROADCAST_BLOCKS", 1)
        assert near_duplicates(spark, docs, None).count() == 4500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_prefixes_leave_room_for_every_link_and_not_for_most_other_pairs(spark):
    rng = random.Random(9)
    base, texts = [f"w{i}" for i in range(200)], {}
    for i in range(120):
        lo = rng.randrange(40)
        copy = base[lo : lo + rng.randrange(90, 161)]
        for at in rng.sample(range(len(copy)), rng.randrange(6)):
            copy[at] = f"own{i % 30}-{at}"
        texts[i] = " ".join(copy)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = docs.withColumn("_row", F.struct(F.lit("").alias("f"), F.col("doc_id").alias("i")))
    found = nearcopies.sets(rows, nearcopies.common_hashes(docs)).dropDuplicates(["node"]).cache()
    a, b = (found.select(F.col("node").alias(x)) for x in "ab")
    pairs = a.crossJoin(b).filter("a < b").cache()
    left = {tuple(r) for r in nearcopies._possible(pairs, found).collect()}
    links = {tuple(r) for r in nearcopies._checked(pairs, nearcopies._arrays(docs).dropDuplicates(["node"])).collect()}
    assert links and links <= left and 2 * len(left) < pairs.count()
