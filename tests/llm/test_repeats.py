import hashlib
import random

import pytest

from tracequill.llm import repeats, suffixsort


def plain(texts, width=200):
    """texts: {key: bytes} -> {key: (n_bytes, n_removed, n_spans, sha256)}."""
    where = {}
    for key, data in texts.items():
        for i in range(len(data) - width + 1):
            w = data[i : i + width]
            where[w] = where.get(w, 0) + 1
    out = {}
    for key, data in texts.items():
        gone = bytearray(len(data))
        for i in range(len(data) - width + 1):
            if where[data[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[key] = (len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()}


def test_whole_table_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.op9_repeats(spark, sf_dir).collect()}
    assert got == plain(docs)


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(80) for _ in range(4)]
    texts = [prose(rng.randint(0, 120)) + rng.choice(passages)[rng.randint(0, 90) :] + prose(rng.randint(0, 60)) for _ in range(60)]
    texts += [passages[0][:199], passages[0][:200], passages[0][1:201], "a" * 199, "a" * 200, "a" * 777, "St " * 300, "ab" * 99 + "c" + "ab" * 200, "", "x"]
    texts += [texts[3], texts[3], texts[5][:-1] + "Z", texts[5][: len(texts[5]) // 2] + "Q" + texts[5][len(texts[5]) // 2 :]]
    return {i: t for i, t in enumerate(texts)}


@pytest.mark.parametrize(("group", "memory"), [(2, 100), (repeats.GROUP, repeats.MEMORY), (repeats.GROUP, 2_000)])
def test_passages_edits_and_periods(spark, group, memory):
    """With little memory each shard is far larger than its queues."""
    texts = made(group)
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, gram string")
    spilled = spark.sparkContext.accumulator(0)
    assert result(repeats.kept_texts(df, group, memory, spilled)) == plain({i: t.encode() for i, t in texts.items()})
    assert (spilled.value > 0) == (memory < repeats.MEMORY)


def test_hot_runs(spark, monkeypatch):
    monkeypatch.setattr(repeats.skew, "MIN_HOT", 3)
    monkeypatch.setattr(repeats.skew, "MOST_HOT", 20)
    texts = made(7)
    texts |= {1000 + i: texts[0] + str(i) * (i % 5) for i in range(40)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert result(repeats.kept_texts(df)) == plain({i: t.encode() for i, t in texts.items()})


def test_chunks_of_a_long_text_meet(monkeypatch):
    rng = random.Random(8)
    raw = repeats.np.frombuffer(bytes(rng.choices(b"abcdefgh", k=5_000)), repeats.np.uint8)
    whole = repeats.anchor_runs(raw)
    monkeypatch.setattr(repeats, "_CHUNK", 700)
    parts = repeats.anchor_runs(raw)
    windows = lambda found: {w: (int(at), int(g)) for s, n, at, g in zip(*found, strict=True) for w in range(int(s), int(s + n))}
    assert windows(parts) == windows(whole) and len(windows(whole)) == 4_801


def test_nulls_repeated_rows_and_empty_tables(spark):
    long = "é" * 50 + "".join(random.Random(2).choices("abcdefgh", k=300))
    df = spark.createDataFrame([(1, None), (2, ""), (3, long), (3, long), (None, long + "y"), (4, "short"), (-1, "z")], "doc_id long, text string")
    got = sorted((r.doc_id or -9, r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in repeats.kept_texts(df).collect())
    assert got == [(-9, 401, 400, 1, b"y"), (-1, 1, 0, 0, b"z"), (1, 0, 0, 0, b""), (2, 0, 0, 0, b""), (3, 400, 400, 1, b""), (3, 400, 400, 1, b""), (4, 5, 0, 0, b"short")]
    assert repeats.kept_texts(df.limit(0)).count() == 0


def plain_order(text):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    common = [0]
    for i, j in zip(order, order[1:]):
        k = 0
        while i + k < len(text) and j + k < len(text) and text[i + k] == text[j + k] and k < suffixsort.DEPTH:
            k += 1
        common.append(k)
    return order, common


def test_suffixes_and_common_prefixes_equal_sorting():
    rng = random.Random(1)
    for n in range(400):
        text = bytes(rng.choices(rng.choice([b"ab", b"abc", bytes(range(1, 255)), b"a"]), k=rng.randint(0, 150))) + b"\0"
        if n % 9 == 0:
            text = text[:-1][:30] * 5 + b"\0"
        symbols = suffixsort.np.frombuffer(text, suffixsort.np.uint8).astype(suffixsort.np.uint16)
        with suffixsort.Sorter(symbols, rng.choice([8, 64, 1 << 20])) as own:
            order, common = own.order()
        assert (order.tolist(), common.tolist()) == plain_order(text)
        assert suffixsort.suffix_order(text, 64).tolist() == order.tolist()


def test_queues_spill_recursion_carries_values_and_files_go():
    rng = random.Random(4)
    passage = bytes(rng.choices(b"abcd", k=900))
    text = b"".join(bytes(rng.choices(b"abcd", k=rng.randint(1, 900))) + passage[rng.randint(0, 600) :] for _ in range(60)) + b"\0"
    symbols = suffixsort.np.frombuffer(text, suffixsort.np.uint8).astype(suffixsort.np.uint16)
    with suffixsort.Sorter(symbols, memory=20_000) as own:
        order, common = own.order()
        assert own.spilled > 100_000 and own.deeper > 0 and own.mapped > 0
        assert (order.tolist(), common.tolist()) == plain_order(text)
        folder = own.folder
    import os

    assert not os.path.exists(folder)


def test_equal_windows():
    rng = random.Random(3)
    for _ in range(60):
        segments = [bytes(rng.choices(b"ab", k=rng.randint(0, 40))) for _ in range(rng.randint(1, 8))]
        width = rng.choice([1, 3, 4, 6, 8, 11])
        seen = {}
        for i, s in enumerate(segments):
            for o in range(len(s) - width + 1):
                seen.setdefault(s[o : o + width], []).append((i, o))
        k, o = suffixsort.equal_windows(segments, width)
        assert list(zip(k.tolist(), o.tolist(), strict=True)) == sorted(x for v in seen.values() if len(v) > 1 for x in v)
