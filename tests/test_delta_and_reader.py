import pytest

from tracequill.operators import deltaclaims as D
from tracequill.operators import readergate as R

ENTRY = "case_id int, ref string, change_type string, verdict string, issue_kinds array<string>, finding_hash string"


def test_scope_weights_and_downgrades(spark):
    entries = spark.createDataFrame([(1, "E1", "added", "hard_error", ["asr_ambiguity"], "h"), (1, "E2", "removed", "revise", None, "h"), (1, "E3", "modified", "revise", [], "h"), (1, "E3", "modified", "pass", [], "h"), (1, "E9", "added", "pass", [""], "h")], ENTRY)
    changes = spark.createDataFrame([(1, "E1", "added"), (1, "E2", "modified"), (1, "E3", "modified"), (1, "E4", "removed")], "case_id int, ref string, change_type string")
    assert {(r.ref, r.error) for r in D.scope_errors(changes, entries).collect()} == {("E2", "change_type"), ("E3", "entry_repeated"), ("E4", "not_reviewed"), ("E9", "outside_scope")}
    hard = spark.createDataFrame([(1, "E3", "wrong_speaker"), (1, None, "x")], "case_id int, ref string, code string")
    rows = D.weighed(entries, hard)
    assert sorted((r.ref, r.weight, tuple(r.issue_kinds)) for r in rows.collect()) == [("E1", "blocking", ("asr_ambiguity",)), ("E2", "advisory", ()), ("E3", "blocking", ("wrong_speaker",)), ("E3", "blocking", ("wrong_speaker",)), ("E9", "none", ())]
    claims = spark.createDataFrame([(1, "E1"), (1, "E3"), (2, "E1")], "case_id int, id string")
    sure = dict.fromkeys(D.SAFEGUARDS, True)
    schema = "case_id int, ref string, finding_hash string, decision string, basis string, constraint string, safeguards map<string,boolean>, rationale string"
    good = ("h", D.DECISION, D.BASIS, D.CONSTRAINT, sure, "heard badly")
    downs = spark.createDataFrame([(1, "E1", *good)], schema)
    none = D.downgrade_errors(downs, rows, claims)
    assert none.collect() == []
    assert {(r.ref, r.level) for r in D.outcomes(rows, downs, none).collect()} == {("E1", "warning"), ("E2", "advisory"), ("E3", "hard")}
    bad = spark.createDataFrame([(1, "E2", *good), (1, "E3", "old", "pass", None, "", {**sure, "noFabrication": False, "noContradiction": None}, " "), (1, "E1", *good), (1, "E1", *good)], schema)
    found = D.downgrade_errors(bad, rows, claims)
    assert {(r.ref, r.error) for r in found.collect()} == {("E2", "not_blocking"), ("E1", "entry_repeated")} | {("E3", e) for e in ("stale_finding", "decision", "basis", "constraint", "kind_not_downgradable", "kind_never_downgradable", "safeguard_noFabrication", "safeguard_noContradiction", "rationale")}
    assert {(r.ref, r.level) for r in D.outcomes(rows, bad, found).collect()} == {("E1", "hard"), ("E2", "advisory"), ("E3", "hard")}


POLICY = R.Policy({"a": 2, "b": 2, "c": 2, "d": 1, "e": 1, "f": 1}, ("a", "b", "c"))
REVIEW = "case_id int, verdict string, scores map<string,int>, severities array<string>"


def scores(text):
    return {d: int(s) for d, s in zip("abcdef", text) if s != "-"}


def test_reader_gate(spark):
    cases = {
        1: ("444444", "clean_pass", [], "clean_pass", []),
        2: ("443445", "borderline", [], "borderline", []),
        3: ("443344", "pass", ["warning"], "revise", ["low_average"]),
        4: ("444444", "revise", ["error"], "revise", ["error_issue"]),
        5: ("444441", "revise", [], "revise", ["score_1:f", "low_average"]),
        6: ("244555", "revise", [], "revise", ["core_score_2:a"]),
        7: ("55555-", "revise", None, "revise", ["invalid_scores:f"]),
        8: ("555552", "revise", [], "revise", ["below_borderline:f"]),
        9: ("555333", "revise", [], "revise", ["too_many_threes"]),
    }
    rows = spark.createDataFrame([(c, v, scores(s), i) for c, (s, v, i, _, _) in cases.items()] + [(10, None, None, None)], REVIEW)
    got = {r.case_id: r for r in R.evaluated(rows, POLICY).collect()}
    assert {c: (got[c].classification, got[c].reasons) for c in cases} == {c: (k, why) for c, (_, _, _, k, why) in cases.items()}
    assert (got[10].classification, got[10].average, got[10].reasons) == ("revise", 0.0, ["invalid_scores:a,b,c,d,e,f", "low_average"])
    assert [got[c].declared for c in (1, 2, 3, 10)] == [True, True, False, False]
    plain = {r.case_id: (r.passed, r.failing) for r in R.failures(rows.withColumn("verdict", rows.verdict), list("abcdef")).collect()}
    assert plain[3] == (False, ["c", "d"]) and plain[1] == (False, []) and plain[10] == (False, [])
    for weights, core in (({"a": 2, "b": 2, "c": 1}, "abc"), ({"a": 2, "b": 2, "c": 2, "d": 2}, "abc"), ({"a": 2}, "a")):
        with pytest.raises(ValueError):
            R.Policy(weights, tuple(core))


def test_reader_pairs(spark):
    first = spark.createDataFrame([(c, "", scores("444444" if c == 1 else "443445"), []) for c in range(1, 6)], REVIEW)
    second = spark.createDataFrame([(1, "", scores("444444"), []), (3, "", scores("443445"), []), (4, "", scores("444445"), []), (5, "", scores("443415"), [])], REVIEW)
    paired = R.pairs(first, second, POLICY)
    assert {r.case_id: (r.status, r.disputed) for r in paired.collect()} == {1: ("not_allowed", []), 2: ("needs_secondary", []), 3: ("pass", []), 4: ("needs_adjudication", ["c"]), 5: ("needs_adjudication", ["e"])}
    rulings = spark.createDataFrame([(4, "cy", True, "pass", ["c"], "r"), (5, "ann", False, "maybe", ["e", "e"], ""), (3, "cy", True, "revise", [], "r")], "case_id int, reviewer_id string, blind boolean, decision string, disputed array<string>, rationale string")
    assigned = spark.createDataFrame([(c, "cy", ["ann", "bo"]) for c in (3, 4, 5)], "case_id int, adjudicator string, readers array<string>")
    assert {(r.case_id, r.error) for r in R.ruling_errors(rulings, paired, assigned).collect()} == {(3, "not_needed")} | {(5, e) for e in ("not_blind", "not_assigned", "not_independent", "decision", "dimensions", "rationale")}
