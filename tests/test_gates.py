"""Gates, nested documents and releases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracequill.operators import contracts as C
from tracequill.operators import gates as G
from tracequill.operators import leaves as L
from tracequill.operators import releases as R

FIELDS = "case_id long, ref string, verdict string, atomicity string, support string, importance_verdict string, theme_verdict string, speaker string, n_issues int, importance_proposed string, theme_proposed string"


def entry(case, ref, **more):
    row = {"verdict": "pass", "atomicity": "pass", "support": "supported", "importance_verdict": "confirmed", "theme_verdict": "confirmed", "speaker": "confirmed", "n_issues": 0, "importance_proposed": None, "theme_proposed": None} | more
    return (case, ref, *row.values())


def test_claim_gate_states(spark):
    bad = {"verdict": "split", "atomicity": "fail"}
    first = [entry(1, "a"), *(entry(c, "a", **bad) for c in range(2, 9)), entry(9, "a", verdict=None)]
    second = [entry(3, "a", **bad), *(entry(c, "a") for c in (4, 5, 6, 7, 8)), entry(9, "a", verdict=None)]
    rulings = [(5, "a", "original", 0.9), (6, "a", "primary", 0.9), (7, "a", "unreviewable", 0.9), (8, "a", "secondary", 0.5)]
    got = G.claim_gate(spark.createDataFrame(first, FIELDS), spark.createDataFrame(second, FIELDS), spark.createDataFrame(rulings, "case_id long, ref string, selection string, confidence double"))
    assert {r.case_id: r.state for r in got.collect()} == {1: "pass", 2: "needs_secondary", 3: "repair_required", 4: "needs_adjudication", 5: "pass", 6: "repair_required", 7: "human_required", 8: "human_required", 9: "pass"}


def test_omissions_need_two_roles(spark):
    rows = [(1, "scout", "core-omission", "k", "hard"), (1, "fidelity", "Core Omission", "k ", "hard"), (2, "scout", "core_omission", "k", "hard"), (3, "scout", "core_omission", None, "hard"), (3, "fidelity", "nonsense", None, "hard"), (4, "advocate", "fabrication", "x", "hard"), (5, "fidelity", "style", "x", "hard")]
    found = G.lite_findings(spark.createDataFrame(rows, "case_id long, role string, code string, key string, severity string"))
    assert {(r.case_id, r.role): (r.code, r.severity) for r in found.collect()} == {
        (1, "scout"): ("core_omission", "hard"), (1, "fidelity"): ("core_omission", "hard"), (2, "scout"): ("core_omission", "warning"), (3, "scout"): ("core_omission", "warning"),
        (3, "fidelity"): ("unknown_hard_error", "hard"), (4, "advocate"): ("fabrication", "warning"), (5, "fidelity"): ("style", "diagnostic"),
    }
    assert {r.case_id: r.status for r in G.lite_status(found).collect()} == {1: "blocked", 2: "pass_with_warnings", 3: "blocked", 4: "pass_with_warnings", 5: "pass"}


def test_leaves_inherit_and_last_definition_stays(spark):
    node = lambda i, text, prov=None, refs=None: (i, text, prov, refs, None)
    block = ("b", "quote", "source_fact", ["E1"], None, [node("x", "one"), node("y", "two", "system", ["E2"]), node("x", "three")])
    docs = spark.createDataFrame([(1, [("themes", [("m", [block])])])], f"case_id long, sections {L.DOCUMENT}")
    got = {r.id: r for r in L.flatten(docs).collect()}
    assert (got["x"].text, got["x"].repeated, got["x"].evidence_refs, got["x"].provenance) == ("three", True, ["E1"], "source_fact")
    assert (got["y"].evidence_refs, got["y"].citation_refs, got["y"].repeated) == (["E2"], [], False)
    assert [r.id for r in L.eligible(L.flatten(docs)).collect()] == ["x"] and L.fidelity_leaves(L.flatten(docs)).count() == 2


def test_release_round_trip(spark, tmp_path):
    root, df = str(tmp_path / "out"), spark.range(100).withColumn("t", F.concat(F.lit("é"), "id"))
    assert R.current(spark, root) is None
    first = R.publish(spark, {"units": df, "claims": df.limit(0)}, root, {"schema": "1"})
    with pytest.raises(FileExistsError):
        R.publish(spark, {"units": df.repartition(7), "claims": df.limit(0)}, root, {"schema": "1"})
    second = R.publish(spark, {"units": df.filter("id > 3")}, root, {"schema": "1"})
    now = R.current(spark, root)
    assert (now["generation"], now["supersedes"]) == (second, first) and R.published(spark, root)["units"].count() == 96
    spark.range(3).withColumn("t", F.lit("x")).write.mode("append").parquet(f"{root}/generation={second}/units")
    with pytest.raises(ValueError, match="changed"):
        R.published(spark, root)
    for bad in ("../x", "/x", "a//b", "a\\b", "", "c:x"):
        assert not R.safe_relative(bad)
    assert R.safe_relative("a/b.json") and R.optional_table(spark, f"{root}/none", "a long").count() == 0


def test_mechanical_cleanup_only_deletes(spark):
    from tracequill.operators import contracts as C

    rows = [(1, "um so we we went, well, home", "so we went home", True), (2, "so we went home", "so we ran home", False), (3, "so we went all home", "so we went home", False), (4, "um", "", False), (5, "a b", "a b c", False)]
    got = C.deletion_only(spark.createDataFrame(rows, "k long, source string, text string, want boolean"), ["um", "well"]).collect()
    assert [r.k for r in got if r.deleted_only != r.want] == []


def test_roles_find_words_beside_letters_of_other_scripts(spark):
    rules = [("cause", r"(?i)\b(?:porque|weil)\b"), ("escaped", r"\\b")]
    texts = {"la porqueñque": "cause", "Weil": "cause", "ñweil": "cause", "porquex": "fact", "x_weil": "fact", "a\\b": "escaped"}
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", G.keyword_role(F.col("x"), rules).alias("r"))
    assert {r.x: r.r for r in df.collect()} == texts


def test_deletions_equal_a_walk_by_characters(spark):
    """Random edits of few letters; no lambda goes over the characters, and a block's forms are made once."""

    def mechanical(gone, before, after):
        again = before and (before.endswith(gone) or gone.endswith(before[-6:])) or after and (after.startswith(gone) or gone.startswith(after[:6]))
        return bool(not gone or re.fullmatch("(?:um|well)+", gone) or again)

    def walk(s, t):
        p = at = 0
        for k, c in enumerate(s):
            if p < len(t) and c == t[p]:
                if not mechanical(s[at:k], t[:p], s[k:]):
                    return False
                p, at = p + 1, k + 1
        return bool(s and t) and p == len(t) and mechanical(s[at:], t, "")

    rng = random.Random(4)
    rows = []
    for i in range(4000):
        text = "".join(rng.choice("abum") for _ in range(rng.choice((0, 3, 9, 70, 140))))
        cut = sorted(rng.randrange(len(text) + 1) for _ in range(2))
        source = text[: cut[0]] + rng.choice(("", "um", "well", text[max(0, cut[0] - 3) : cut[0]], "b")) + text[cut[0] : cut[1]] + rng.choice(("", "well", text[cut[1] : cut[1] + 4], text[-7:])) + text[cut[1] :]
        rows.append((i, source, text))
    found = C.deletion_only(spark.createDataFrame(rows, "k int, source string, text string"), ["um", "well"])
    got = {r.k: r.deleted_only for r in found.collect()}
    assert got == {k: walk(s, t) for k, s, t in rows} and len(set(got.values())) == 2
    assert "lambdafunction" not in found._jdf.queryExecution().toString()


def test_quotes_are_normalised_once(spark):
    blocks = spark.createDataFrame([(1, "E1", "verbatim", "Ann", "abc defg", "00:01", None, ["E1", "E2", "E3"])], "case_id long, id string, mode string, attribution string, text string, source_locator string, source_text string, evidence_refs array<string>")
    spans = spark.createDataFrame([(1, f"E{i}", "00:01", "x abc, defg") for i in (1, 2)], "case_id long, ref string, locator string, quote string")
    found = C.controlled_quotes(blocks, spans, ["um"])
    assert found.collect() == []
    assert found._jdf.queryExecution().executedPlan().toString().count("_claims(") <= 2
