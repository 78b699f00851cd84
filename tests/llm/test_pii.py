import time
import hashlib
import re

from tracequill.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


#: A character that every match holds; texts without it are not searched, as the plain patterns take quadratic time.
HOLDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def plain_base(text):
    found = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        if HOLDS[kind] not in (text or ""):
            continue
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def listed(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def check(docs, got):
    for doc_id, text in docs:
        want = plain_base(text)
        row = got[doc_id]
        assert [row[f"n_{k}"] for k in PLAIN] == [sum(x[1] == i for x in want) for i in range(4)], (doc_id, text)
        assert row.base_sha256 == hashlib.sha256(listed(want).encode()).hexdigest(), (doc_id, text)
        assert not want or set(listed(want).split(",")) <= set(row.spans.split(","))


def test_whole_table_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: r for r in pii.op2_pii(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    check(docs, got)


CASES = [
    None, "", "plain", "a@b.cc.dd@e.ff", "a@b-c.com_x@y.zz x..y@z.co.uk.", "@@ a@b a@b. a@.b %+@-.-", "x@1.2.3.4", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.0255",
    "999.1.1.1 1.1.1.1", "4111 1111 1111 1111 4111-1111-1111-1112", "41111111111111111111 4111111111111111", "+1 (786) 555-4469, +49.30.1234567 +12 +1 2",
    "+1 555 444 33 22 11 00 99 88 é 1.2.3.4", "日本 a@b.cc 😀 +33 1 23 45 67 89 token = \"2fc43797753588f13dc1659f3b1265a8c9a08e5a\"", "1-2-3-4 ++1234567890+123456789",
    "a" * 200_000, "a." * 50_000 + "@" + "b." * 50_000 + "c", "1" * 100_000, "+1" + " " * 50_000 + "9", "1 " * 60_000,
    "10.0.0.1 0.0.0.0 010.020.000.255 00000300.1.1.1 1.2.3.256 000.00.0.249",
]


def test_edge_cases_and_very_long_texts(spark):
    docs = list(enumerate(CASES))
    df = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, spans string")
    found = pii.detect(df).selectExpr("doc_id", *(f"n_{k}" for k in PLAIN), f"sha2({pii._listed('base')}, 256) AS base_sha256", f"{pii._listed('spans')} AS spans")
    got = {r.doc_id: r for r in found.collect()}
    check(docs, got)
    assert "secret:" in got[13].spans
    assert pii.detect(df.limit(0)).count() == 0


def test_masking_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "é a@b.cc, x 4111 1111 1111 1111.", "s"), (2, "clean 12", "s"), (3, None, None), (1, "é a@b.cc, x 4111 1111 1111 1111.", "s")], "doc_id long, text string, source string")
    got = sorted((r.doc_id, r.text or "") for r in pii.masked(df).collect())
    assert got == [(1, "é [EMAIL], x [CARD].")] * 2 + [(2, "clean 12"), (3, "")]


def test_reliable_labelers_win():
    counts = [((4, 1, 1, 0, 1, 1), 50), ((4, -1, -1, 0, -1, 1), 50), ((4, 1, 1, 0, -1, 1), 5), ((4, -1, -1, 0, 0, 1), 5)]
    post, tables = pii.reliabilities(counts)
    assert post[0] > 0.9 and post[1] < 0.1
    assert tables[1][1, 1] > tables[1][1, 0]
    assert pii.train([]) == [1.0] * 5 + [-0.5] * 8


def test_long_secrets_names_and_account_numbers(spark):
    secrets = ["a1B-" * 20 + "x", "Zz9_" * 1250, "0af3" * 30]
    iban = "DE89370400440532013000"
    texts = [f"the token: {x} is here" for x in secrets] + [f"account {iban} now", f"account {iban[:-1]}1 now", "contact Dr. Anna " + "X" + "a" * 60]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    assert [got[i] for i in range(3)] == ["the token: [SECRET] is here"] * 3
    assert got[3] == "account [IBAN] now"
    votes = {r.k: r.valid for r in pii.candidates(pii.matches(docs.filter("doc_id IN (3, 4)"))).selectExpr("doc_id AS k", "filter(open, x -> x.k = 6)[0].valid AS valid").collect()}
    assert votes == {3: 1, 4: -1}


def test_many_matches_in_one_text(spark):
    text = ", ".join(f"{i}@b{i % 97}.cd" for i in range(40_000))
    docs = spark.createDataFrame([(1, text), (2, "x@y.zz and 9@b.c")], "doc_id long, text string")
    began = time.perf_counter()
    got = {r.doc_id: r.text for r in pii.masked(docs).collect()}
    assert got == {1: ", ".join(["[EMAIL]"] * 40_000), 2: "[EMAIL] and [EMAIL]"}
    counts = {r.doc_id: r.n_email for r in pii.detect(docs).collect()}
    assert counts == {1: 40_000, 2: 2} and time.perf_counter() - began < 90


def test_overlapping_spans_make_one_mask(spark):
    text = "pay 4111 1111 1111 1111 or call +49 (30) 901820-44 11, mail a@b.cd."
    docs = spark.createDataFrame([(i, text * i, "x") for i in range(40)], "doc_id long, text string, row string")
    for r in pii.masked(docs).collect():
        spans, out, at = plain_base(text * r.doc_id), [], 0
        for s, k, e in spans:
            if s >= at:
                out += [(text * r.doc_id)[at:s], f"[{pii.KINDS[k].upper()}]"]
            at = max(at, e)
        assert r.text == "".join(out) + (text * r.doc_id)[at:]
