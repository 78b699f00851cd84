import random
import sys
import time
import unicodedata

import duckdb
from pyspark.sql import functions as F

from tracequill.functions import nfkc
from tracequill.functions import text as T
from tracequill.plans import fixtures as X


def test_form_equals_unicode_data(spark):
    """Every character that changes, alone, after a letter and before a mark; random sequences; Hangul; long runs."""
    rng = random.Random(3)
    apart, ranks, pairs = nfkc._tables()
    changing = [chr(i) for i in apart]
    pool = changing + [chr(i) for i in ranks] * 2 + [x for q in pairs for x in q] + list("abcdefg éèñ 1２Ａﬁ가각각") * 100
    texts = ["", "abc", "é", "́x", "q̣̇", "á" * 2_000, "１２３" * 1_000, "한" * 300, "plain " * 5_000 + "́"]
    texts += [c for i in range(0, len(changing), 3) for c in (changing[i], "e" + changing[i], changing[i] + "́")]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(3_000)]
    texts += [chr(i) + "́" for i in range(0x20, 0x600)] + [chr(i) for i in range(0xAC00, 0xD7A4, 97)] + [chr(i) for i in range(0x2000, sys.maxunicode, 211) if not 0xD800 <= i < 0xE000]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "i int, x string").repartition(8).select("i", nfkc.nfkc(F.col("x")).alias("n")).collect()
    assert {r.i: r.n for r in rows} == {i: unicodedata.normalize("NFKC", x) for i, x in enumerate(texts)} | {len(texts): None}


def test_comparison_forms(spark):
    rows = [("Ｔｈｅ  ﬁn, é!", "thefiné", "The fin, é!".replace(" ", "")), ("①　２", "12", "12"), (None, None, "")]
    df = spark.createDataFrame([(x,) for x, _, _ in rows], "x string").select("x", T.normalized_claim(F.col("x")).alias("a"), T.normalize_review_text(F.col("x")).alias("b"))
    assert {(r.x, r.a, r.b) for r in df.collect()} == set(rows)


def test_every_character_changes_at_the_same_rate(spark):
    """Texts of which nothing is in the form already; one by one in expressions, their 4 million characters took minutes."""
    text = "１é" * 7_000
    began = time.perf_counter()
    rows = spark.range(0, 200, 1, 8).select(nfkc.nfkc(F.concat(F.lit(text), F.col("id").cast("string"))).alias("n"), "id").collect()
    assert {r.n for r in rows} == {"1é" * 7_000 + str(r.id) for r in rows}
    assert time.perf_counter() - began < 30


def test_claims_are_compared_without_signs_as_in_the_sql(spark):
    # Signs that a JVM's older Unicode data does not know, letters of both byte lengths, entities in their fixed order.
    texts = ["a⹓b؝c⃀d", "Été, <b>¿Qué?</b> &AMP;lt; x", "«Ｆull» width ﬁ", "a&nbsp;b c　d﻿e", "<>", "", "x < y > z", "&nbſp;", "\x1c\x85\t"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, None])], "i int, x string")
    got = [r.k for r in rows.select("i", T.normalized_claim(rows.x).alias("k")).orderBy("i").collect()]
    assert got == ["abcd", "étéquéx", "fullwidthfi", "abcde", "", "", "xz", "nbsp", "\x1c\x85", None]
    assert duckdb.connect().execute(f"SELECT {X.plain('x')} FROM (VALUES ('{texts[0]}')) t(x)").fetchall() == [(got[0],)]
