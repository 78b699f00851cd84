import math
from collections import Counter, defaultdict

import pytest

from tracequill.llm import mixing


def made(spark):
    rows = []
    for source, n in (("big", 600), ("mid", 90), ("small", 12)):
        rows += [(len(rows) + i, " ".join(["w"] * (3 + i % 5)), source, "x") for i in range(n)]
    rows += [(9000, None, "hollow", "x"), (9001, "", "hollow", "x"), (9002, "one two", None, "x"), (None, "a b", "mid", "x"), (5, "w w w", "big", "x"), (5, "w w w", "big", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, epoch string")


def plain_exponent(tokens, target, limit, cover):
    total = sum(tokens)
    shares = [t / total for t in tokens]

    def state(step):
        powers = [p ** (step / mixing.STEPS) for p in shares]
        z = sum(powers)
        entropy = -sum(w / z * math.log(w / z) for w in powers) / math.log(len(powers))
        repeats = [w / z / p for w, p in zip(powers, shares, strict=True)]
        return entropy, max(repeats) / min(repeats) if cover else max(repeats)

    by_entropy = max(s for s in range(0, mixing.STEPS + 1, 256) if s == 0 or state(s)[0] >= target)
    while by_entropy < mixing.STEPS and state(by_entropy + 1)[0] >= target:
        by_entropy += 1
    if state(by_entropy)[1] <= limit:
        return by_entropy
    step = by_entropy
    while step < mixing.STEPS and state(step)[1] > limit:
        step += 1
    return step


@pytest.mark.parametrize(("target", "limit", "budget"), [(0.8, 100.0, "total"), (0.9999, 9.0, "total"), (0.5, 50.0, "cover"), (0.95, 3.0, "cover")])
def test_plan_meets_its_targets(spark, target, limit, budget):
    tokens = mixing.token_rows(made(spark))
    totals = {r.source: r.t for r in tokens.groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "t").collect()}
    shares = spark.createDataFrame([(t / sum(totals.values()),) for t in totals.values() if t], "p double")
    step = mixing.exponent(shares, target, limit, budget == "cover")
    want = plain_exponent([t for t in totals.values() if t], target, limit, budget == "cover")
    assert abs(step - want) <= 1
    plan = {r.source: r for r in mixing.source_plan(tokens, target, limit, budget).collect()}
    taken = defaultdict(int)
    copies = Counter()
    order = defaultdict(list)
    for r in mixing.realised(tokens, mixing.source_plan(tokens, target, limit, budget)).collect():
        taken[r.source] += r.n_tokens
        copies[r.doc_id] += 1
        order[r.source].append((r.epoch, r.token_start, r.token_start + r.n_tokens))
    for source, p in plan.items():
        longest = 8
        assert taken[source] <= p.budget and taken[source] > p.budget - longest or not p.tokens, source
        spans = sorted(order[source], key=lambda x: (x[0], x[1], x[2]))
        for (e, _, stop), (f, start, _) in zip(spans, spans[1:], strict=False):
            assert start == stop or (f > e and start >= stop)  # runs are whole but for the last epoch's end
    assert copies[9000] == copies[9001] == 1
    if budget == "cover":
        assert all(copies[i] for i in copies) and set(copies) >= {r.doc_id for r in tokens.collect()}


def test_epochs_are_permutations(spark):
    tokens = mixing.token_rows(made(spark).filter("source = 'small'"))
    plan = mixing.source_plan(tokens).selectExpr("source", "n_docs", "tokens", "weight", "tokens * 3 AS budget", "3L AS epochs", "0L AS rest", "blocks")
    by_epoch = defaultdict(list)
    for r in sorted(mixing.realised(tokens, plan).collect(), key=lambda r: (r.epoch, r.token_start)):
        by_epoch[r.epoch].append(r.doc_id)
    assert sorted(by_epoch) == [0, 1, 2] and len({tuple(x) for x in by_epoch.values()}) == 3
    assert len({tuple(sorted(x)) for x in by_epoch.values()}) == 1


def test_rows_keep_their_columns(spark):
    docs = made(spark)
    got = mixing.mixed(docs, 0.9, 2.0)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == {r.doc_id for r in docs.collect()}
    assert mixing.mixed(docs.limit(0)).count() == 0 and mixing.mix_plan(docs.limit(0)).count() == 0


def test_rows_that_differ_in_any_column_stay(spark):
    rows = [(1, "a b c", "s", "en"), (1, "a b c", "s", "fr"), (1, "a b c", "s", "fr"), (None, None, None, None), (2, "x", "t", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = Counter(tuple(r) for r in mixing.mixed(docs, 0.0, 1.0).collect())
    assert got == Counter(rows)
    more = Counter(tuple(r) for r in mixing.mixed(docs, 1.0, 9.0).collect())
    assert set(more) == set(rows) and more[rows[4]] > 1 and more[rows[1]] >= 2
