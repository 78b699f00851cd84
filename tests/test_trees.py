import hashlib
import json
import random
from decimal import Decimal

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tracequill.functions import canonical
from tracequill.operators import contracts, trees


def plain_characters(value, key=""):
    if isinstance(value, str):
        return len("".join(value.split())) if key in trees.TEXT_KEYS else 0
    if isinstance(value, list):
        return sum(plain_characters(x, key) for x in value)
    return sum(plain_characters(x, k) for k, x in value.items()) if isinstance(value, dict) else 0


def plain_references(value, evidence, blocks):
    if isinstance(value, list):
        for x in value:
            plain_references(x, evidence, blocks)
    if isinstance(value, dict):
        for keys, into in (({"evidenceRef", "evidenceRefs", "matchedEvidenceRefs"}, evidence), ({"readerBlockRef", "readerBlockRefs"}, blocks)):
            for k in keys & set(value):
                if isinstance(value[k], str) and not k.endswith("s"):
                    into.add(value[k])
                if isinstance(value[k], list) and k.endswith("s"):
                    into |= {x for x in value[k] if isinstance(x, str)}
        for x in value.values():
            plain_references(x, evidence, blocks)


def made(rng, depth):
    names = ["title", "text", "note", "evidenceRef", "evidenceRefs", "matchedEvidenceRefs", "readerBlockRef", "readerBlockRefs", "a/b~c", "é", ""]
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([None, True, 3, 2.5, "a b", "", "E1", "E2", "B1", " x\ty", [], {}])
    if rng.random() < 0.5:
        return [made(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return {k: made(rng, depth - 1) for k in rng.sample(names, rng.randint(0, 5))}


def test_visitors_equal_recursion(spark):
    rng = random.Random(5)
    values = [made(rng, rng.randint(0, 7)) for _ in range(150)]
    deep = {"text": "bottom up", "evidenceRefs": ["E9"]}
    for i in range(60):
        deep = [deep] if i % 3 else {"child": deep, "label": "l"}
    values += [deep, {"text": [[["in lists"]]]}, "top", {"evidenceRefs": [["no"], {"evidenceRef": "yes"}]}]
    docs = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=i % 2 == 0)) for i, v in enumerate(values)] + [(-1, None)], "case_id int, json string")
    found = trees.leaves(docs, ["case_id"])
    got = {r.case_id: r.characters for r in trees.block_characters(found, ["case_id"]).collect()}
    assert got == {-1: 0} | {i: plain_characters(v) for i, v in enumerate(values)}
    refs = {(r.case_id, r.target, r.ref) for r in trees.references(found, ["case_id"]).collect()}
    want = set()
    for i, v in enumerate(values):
        evidence, blocks = set(), set()
        plain_references(v, evidence, blocks)
        want |= {(i, "evidence", x) for x in evidence} | {(i, "block", x) for x in blocks}
    assert refs == want


def test_leaves(spark):
    docs = spark.createDataFrame([(1, '{"a/b":[1,{"c~":[null,[]]}],"t":"x","n":1.5,"f":false}')], "case_id int, json string")
    got = {(r.path, r.key, r.hops, r.kind, r.value) for r in trees.leaves(docs, ["case_id"]).collect()}
    assert got == {("/a~1b/0", "a/b", 1, "number", None), ("/a~1b/1/c~0/0", "c~", 1, "null", None), ("/a~1b/1/c~0/1", "c~", 1, "array", None), ("/t", "t", 0, "string", "x"), ("/n", "n", 0, "number", None), ("/f", "f", 0, "boolean", None)}


def test_canonical_json(spark):
    rng = random.Random(6)
    values = [made(rng, 5) for _ in range(80)]
    docs = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, json string")
    got = {r.i: r.c for r in docs.select("i", canonical.canonical_json(F.col("json")).alias("c")).collect()}
    assert got == {i: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for i, v in enumerate(values)}
    cases = {
        '{"b":1.0,"a":[1e3,-0,0.10,1e21,123e18,1e-7,0.000001,12345678901234567890,5e-324]}': '{"a":[1000,0,0.1,1e+21,123000000000000000000,1e-7,0.000001,12345678901234567000,5e-324],"b":1}',
        r'"\u001F\u0007\n\/ \"\\u001F\\\u001Bé"': '"\\u001f\\u0007\\n/ \\"\\\\u001F\\\\\\u001bé"',
        '{"1.0":"2.0e3 \\" 3.0"}': '{"1.0":"2.0e3 \\" 3.0"}',
        "null": "null",
        None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "json string").select("json", canonical.canonical_json(F.col("json")).alias("c")).collect()
    assert {r.json: r.c for r in rows} == cases
    for bad in ("1e400", '{"a":[-1e999]}', '{"a":1,"a":2}', "{"):
        with pytest.raises((PySparkException, Py4JJavaError)):
            spark.createDataFrame([(bad,)], "json string").select(canonical.canonical_json(F.col("json"))).collect()


def test_numbers_read_back_in_the_shortest_form(spark):
    rng = random.Random(7)
    values = [rng.random() * 10 ** rng.randint(-12, 25) for _ in range(3_000)] + [round(rng.random() * 100, rng.randint(0, 4)) for _ in range(500)]
    rows = spark.createDataFrame([(i, repr(v)) for i, v in enumerate(values)], "i int, x string").select("i", canonical.number(F.col("x")).alias("n")).collect()
    assert all(float(r.n) == values[r.i] and len(Decimal(r.n).normalize().as_tuple().digits) == len(Decimal(repr(values[r.i])).normalize().as_tuple().digits) for r in rows)


def test_snapshots(spark):
    """Order and quotes of spans do not matter to the support hash; how ids are grouped into spans does."""
    schema = "case_id int, id string, statement string, provenance string, importance string, claim_role string, speaker string, speaker_confidence double, theme_id string, uncertainty array<string>, support_spans array<struct<segmentId:string,sourceIds:array<string>,quote:string>>"
    claim = lambda i, spans, role=None: (1, i, "s", "p", "high", role, None, 1.0, "T", None, spans)
    rows = [
        claim("a", [("S", ["P2", "P1", "P1"], "q"), ("R", ["P3"], "")]), claim("b", [("R", ["P3"], "other"), ("S", ["P1", "P2"], "q")]), claim("c", [("S", ["P1"], "q"), ("S", ["P2"], "q"), ("R", ["P3"], "")]), claim("d", None, "why"), claim("e", []),
    ]
    got = {r.id: r for r in contracts.snapshots(spark.createDataFrame(rows, schema)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got["a"].support_hash == got["b"].support_hash != got["c"].support_hash
    assert got["d"].support_hash == got["e"].support_hash == sha("[]")
    assert got["e"].semantic_hash == got["a"].semantic_hash == sha('{"importance":"high","provenance":"p","speakerConfidence":1,"statement":"s","themeId":"T"}')
    assert got["d"].semantic_hash == sha('{"claimRole":"why","importance":"high","provenance":"p","speakerConfidence":1,"statement":"s","themeId":"T"}')
    assert len({r.full_hash for r in got.values()}) == 5
