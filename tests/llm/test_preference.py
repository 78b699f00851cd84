import time

import duckdb
from pyspark.sql import functions as F

from tracequill.llm import preference as P


def build(spark, turns):
    rows = [(*t, "x") for t in turns]
    return {r.pair_id: r for r in P.preference_pairs(spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string, prompt string")).collect()}


def test_prefix_masks_and_states(spark):
    shared = [(1, s, 0, "user", "hé") for s in ("chosen", "rejected")] + [(1, s, 1, "assistant", "yes") for s in ("chosen", "rejected")]
    turns = [
        *shared, (1, "chosen", 2, "user", "a"), (1, "chosen", 3, "assistant", "b<|end|>"), (1, "rejected", 2, "assistant", "😀"),
        (2, "chosen", 0, "user", "same"), (2, "rejected", 5, "user", "same"), (3, "chosen", 0, "user", None), (3, "chosen", 0, None, "t"), (3, "chosen", None, "assistant", "z"),
        (4, "chosen", 0, "user", "p"), (4, "rejected", 0, "user", "p"), (4, "rejected", 1, "user", "q"), (None, None, 0, "user", "lost"),
    ]
    got = build(spark, turns)
    r = got[1]
    assert r.n_prompt_turns == 2 and r.status == "ok" and r.prompt == "<|user|>\nhé<|end|>\n<|assistant|>\nyes<|end|>\n"
    spans = [tuple(map(int, x.split(":"))) for x in r.chosen_mask.split(",")]
    assert [r.chosen_completion[a:b] for a, b in spans] == ["b<\\|end|><|end|>"]
    a, b = map(int, r.rejected_mask.split(":"))
    assert r.rejected_completion[a:b] == "😀<|end|>"
    assert [got[k].status for k in (2, 3, 4, None)] == ["identical", "unpaired", "untrained", "unpaired"]
    assert got[3].chosen_completion == "<|user|>\n<|end|>\n<|user|>\nt<|end|>\n<|assistant|>\nz<|end|>\n"
    assert not build(spark, turns[:0])


def test_repeated_rows_and_long_turns(spark):
    long = "word " * 100_000
    got = build(spark, [(1, "chosen", 0, "user", "a"), (1, "chosen", 0, "user", "a"), (1, "rejected", 0, "user", "a"), (1, "chosen", 1, "assistant", long), (1, "rejected", 1, "assistant", "n")])
    assert got[1].n_prompt_turns == 1 and got[1].chosen_completion.count("<|user|>") == 1 and long in got[1].chosen_completion


def test_conversations_branch_at_their_last_reply(spark):
    turns = [
        (0, 0, "system", "s"), (0, 1, "user", "a"), (0, 2, "assistant", "A"), (0, 3, "user", "b"), (0, 4, "assistant", "B"), (0, 5, "user", "bye"),
        (1, 0, "user", "x"), (1, 1, "assistant", "X"), (2, 0, "user", "alone"), (2, 1, "assistant", "yes"), (4, 0, "user", "q"), (5, 0, "user", "w"), (5, 1, "assistant", "W"),
        (7, 0, "assistant", "R"), (6, 0, "assistant", "R"), (None, 0, "user", "d"), (None, 1, "assistant", "D"),
    ]
    rows = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, own string")
    got = {r.pair_id: r for r in P.formatted(P.branched(rows)).collect()}
    assert set(got) == {0, 1, 2, 4, 5, 6, 7, None}
    assert got[0].n_prompt_turns == 4 and "|>\nB<|end|>" in got[0].chosen_completion and "|>\nX<|end|>" in got[0].rejected_completion
    assert got[1].n_prompt_turns == 1 and "|>\nB<|end|>" in got[1].rejected_completion
    assert [got[k].status for k in (0, 1, 2, 4, 5, 6, 7, None)] == ["ok", "ok", "unpaired", "unpaired", "unpaired", "identical", "identical", "unpaired"]
    assert got[None].chosen_completion == "<|user|>\nd<|end|>\n<|assistant|>\nD<|end|>\n" and got[None].rejected_completion == ""
    db = duckdb.connect()
    db.register("conversations", rows.toPandas().astype({"conv_id": "Int64"}))
    sql = db.execute(P.OP3_SQL)
    at = [d[0] for d in sql.description]
    assert sorted(map(repr, sql.fetchall())) == sorted(repr(tuple(r[c] for c in at)) for r in got.values())
    assert P.formatted(P.branched(rows.limit(0))).count() == 0


def test_driver_pairs_share_prompts(spark, sf_dir):
    found = P.op3_preference(spark, sf_dir).groupBy("status").agg({"n_prompt_turns": "max"}).collect()
    assert {r[0]: r[1] for r in found}["ok"] > 1


def test_a_hundred_thousand_turns(spark):
    turns = spark.range(200_000).selectExpr("1L AS pair_id", "IF(id % 2 = 0, 'chosen', 'rejected') AS side", "id div 2 AS turn", "IF(id div 2 % 2 = 1, 'assistant', 'user') AS role", "IF(id = 199999, 'other', 't') AS text")
    began = time.perf_counter()
    (r,) = P.preference_pairs(turns).collect()
    assert r.n_prompt_turns == 99_999 and r.status == "ok" and time.perf_counter() - began < 60
    (r,) = P.preference_pairs(turns.withColumn("text", F.when(F.col("turn") == 0, F.col("side")).otherwise(F.col("text")))).collect()
    spans = r.chosen_mask.split(",")
    assert r.n_prompt_turns == 0 and len(spans) == 50_000
    a, b = map(int, spans[-1].split(":"))
    assert r.chosen_completion[a:b] == "t<|end|>" and time.perf_counter() - began < 60
