import hashlib
import random

from pyspark.sql import functions as F

from tracequill.operators import evidence as E
from tracequill.operators import rereview as R

SNAP = "case_id int, id string, semantic_hash string, support_hash string, full_hash string, importance string, theme_id string, segment_refs array<string>, block_refs array<string>"


def snap(i, semantic="s", support="p", full="f", level="low", theme="T1", segment="S1", blocks=()):
    return (1, i, semantic, support, full, level, theme, [segment], list(blocks))


def scope(spark, old, new, hashes=(("source", "h", "h"),), recorded=()):
    frame = lambda rows: spark.createDataFrame(rows, SNAP)
    artefacts = spark.createDataFrame([(1, *h) for h in hashes], "case_id int, artefact string, was string, now string")
    return R.change_scope(frame(old), frame(new), artefacts, spark.createDataFrame([(1, r) for r in recorded], "case_id int, ref string")).first()


def test_change_scopes(spark):
    same = scope(spark, [snap("a")], [snap("a")])
    assert (same.mode, same.reasons, same.claim_audit, same.fidelity) == ("mechanical", ["no_evidence_changes"], False, False)
    noted = scope(spark, [snap("a")], [snap("a", full="g")], [("deepRead", "x", "y")])
    assert (noted.mode, noted.reasons, noted.mechanical, noted.reader_advocate, noted.segment_refs) == ("mechanical", ["only_nonsemantic_claim_fields_changed"], 1, True, [])
    edited = scope(spark, [snap("a", level="high", segment="S1", blocks=["B2"])], [snap("a", semantic="t", full="g", segment="S9", theme="T2", blocks=["B1"])])
    assert (edited.mode, edited.segment_refs, edited.theme_refs, edited.block_refs) == ("semantic_delta", ["S1", "S9"], ["T1", "T2"], ["B1", "B2"])
    assert (edited.claim_audit, edited.full_claim_audit, edited.fidelity, edited.source_scout) == (True, False, True, False)
    lost = scope(spark, [snap("a"), snap("b", level="high")], [snap("a")])
    assert (lost.mode, lost.reasons, lost.fidelity, lost.source_scout) == ("structural_full", ["removed_claim_lineage_missing"], False, False)
    moved = scope(spark, [snap("a"), snap("b", level="high")], [snap("a")], recorded=["b"])
    assert (moved.mode, moved.removed, moved.source_scout) == ("semantic_delta", 1, True)
    cut = scope(spark, [snap("a")], [snap("a")], [("segments", "x", "y"), ("source", None, None), ("speakerMap", None, "z")])
    assert (cut.mode, cut.reasons, cut.full_claim_audit) == ("structural_full", ["segments_changed", "speaker_map_changed"], True)


LEAF = "case_id int, id string, text string, evidence_refs array<string>, citation_refs array<string>, provenance string, section_id string, module_id string, block_id string, type string"


def leaf(i, text="t", evidence=("E1",), cited=(), provenance="source_fact", block="B"):
    return (1, i, text, None if evidence is None else list(evidence), None if cited is None else list(cited), provenance, "S", "M", block, "p")


def test_leaves_reports_and_plans(spark):
    old = spark.createDataFrame([leaf("a"), leaf("b", evidence=("E1", "E2")), leaf("c"), leaf("d", evidence=None, cited=None, provenance=R.UNAVAILABLE), leaf("e", evidence=None, cited=None, provenance=R.UNAVAILABLE), leaf("gone")], LEAF)
    new = spark.createDataFrame([leaf("a", text="u", block="C"), leaf("b", evidence=("E2", "E1")), leaf("c", cited=("R1",), provenance="system"), leaf("d"), leaf("e", evidence=(), provenance="system"), leaf("new")], LEAF)
    changes = R.leaf_changes(old, new)
    assert {r.id: r.kinds for r in changes.collect()} == {"a": ["text", "structure"], "c": ["citation_refs", "provenance"], "d": ["evidence_refs", "provenance"], "gone": ["structure"], "new": ["structure"]}
    hashes = {(r.role): r.hash for r in R.role_hashes(new).collect()}
    reports = spark.createDataFrame([(1, "reader_advocate", 1, "other"), (1, "reader_advocate", 2, hashes["reader_advocate"]), (1, "reader_advocate", 3, hashes["reader_advocate"]), (1, "fidelity", 1, "old")], "case_id int, role string, round int, hash string")
    reuse = R.reused_reports(reports, R.role_hashes(new))
    assert {r.role: r.round for r in reuse.collect()} == {"fidelity": None, "reader_advocate": 3, "source_scout": None}
    plan = {r.role: (r.action, r.round, r.leaves) for r in R.targeted_plan(changes, reuse).collect()}
    assert plan == {"fidelity": ("rerun", None, ["a", "c", "d"]), "reader_advocate": ("inherit", 3, []), "source_scout": ("inherit", 1, [])}


def test_role_hashes_hold_what_a_role_sees(spark):
    base = [leaf("a"), leaf("b")]
    of = lambda rows: {r.role: r.hash for r in R.role_hashes(spark.createDataFrame(rows, LEAF)).collect()}
    first = of(base)
    assert of(base[::-1]) == first
    sourced, worded = of([leaf("a", evidence=("E2",)), leaf("b")]), of([leaf("a", text="u"), leaf("b")])
    differ = lambda x: {r for r in R.ROLES if x[r] != first[r]}
    assert differ(sourced) == {"fidelity", "source_scout"} and differ(worded) == {"fidelity", "reader_advocate"}


def test_leaders_equal_the_greedy_order(spark):
    """Dense, sparse and chained similarity: each row waits for those before it."""
    rng = random.Random(8)
    edges = {(1, i, i + 1) for i in range(30)} | {(2, *sorted(rng.sample(range(40), 2))) for _ in range(60)} | {(3, 0, i) for i in range(1, 50)}
    want = {}
    for case in (1, 2, 3):
        kept = []
        for v in range(60):
            near = [k for k in kept if (case, k, v) in edges]
            if near:
                want[case, v] = near[0]
            else:
                kept.append(v)
    pairs = spark.createDataFrame(sorted(edges), "case_id int, p int, pos int")
    assert {(r.case_id, r.pos): r.lead for r in E.leaders(pairs).collect()} == want
    assert E.leaders(pairs.limit(0)).count() == 0


def test_greedy_merge_equals_the_loop(spark):
    rng = random.Random(2)
    texts = []
    for _ in range(220):
        text = rng.choice(texts) if texts and rng.random() < 0.6 else " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(12))
        if rng.random() < 0.7:
            at = rng.randrange(len(text) or 1)
            text = text[:at] + rng.choice("xyz!") + text[at:]
        texts.append(rng.choice([text, text, text, ""]))
    plain = ["".join(c for c in t if c.isalnum()) for t in texts]
    grams = [{p[i : i + 2] for i in range(len(p) - 1)} if len(p) > 2 else {p} - {""} for p in plain]
    like = lambda a, b: bool(grams[a] and grams[b]) and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.93
    kept, want = [], {}
    for i in range(len(texts)):
        led = next((k for k in kept if plain[k] == plain[i]), None)
        led = led if led is not None else next((k for k in kept if like(k, i)), None)
        want[f"E{i:04d}"] = f"E{i if led is None else led:04d}"
        if led is None:
            kept.append(i)
    df = spark.createDataFrame([(1, i, f"E{i:04d}", t) for i, t in enumerate(texts)], "case_id long, pos long, id string, statement string")
    got = {r.id: r.kept_id for r in E.greedy_merge(df).collect()}
    assert got == want and len(kept) < 200
    near = {f"E{i:04d}" for i in range(len(texts)) if any(grams[i] and len(grams[i] & grams[k]) / len(grams[i] | grams[k]) >= 0.9 for k in range(i))}
    assert {r.id for r in E.near_duplicates(df).collect()} == near


def test_deletions_by_characters(spark):
    from tracequill.operators import contracts as C

    rows = [
        ("Um, II think research is um the oxygen.", "I think research is the oxygen!", True), ("abc def", "abc def ghi", False), ("abc def", "def abc", False), ("the plan the plan works", "the plan works", True),
        ("the whole plan works", "the plan works", False), ("plan", "", False), ("", "plan", False), (None, "plan", False), ("umwell go well", "go", True), ("word " * 3000 + "um", "word " * 3000, True),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "k int, source string, text string, want boolean")
    assert [r.deleted_only for r in C.deletion_only(df, ["um", "well"]).orderBy("k").collect()] == [r[2] for r in rows]
    match = spark.createDataFrame([("06:19:54–06:22:04", "06:19:54.250–06:22:04.9", True), ("06:19:54–06:22:04", "06:19:54–06:22:05", False), (" p  4 ", "p 4", True), (None, "", True), ("01:02", "x", False)], "a string, b string, want boolean")
    assert all(r.m == r.want for r in match.select("want", C.locators_match(F.col("a"), F.col("b")).alias("m")).collect())


def test_merging_normalises_each_claim_once(spark):
    """Claims and prefixes are stored: no later join normalises texts or orders grams again, and no lambda goes over grams."""
    claims = spark.createDataFrame([(1, 1, "E1", "The same words here!"), (1, 2, "E2", "the same words, here"), (1, 3, "E3", "something else")], "case_id long, pos long, id string, statement string")
    plan = E.greedy_merge(claims)._jdf.queryExecution().toString()
    assert "_claims(" not in plan and "lambdafunction" not in plan and "nfkc" not in plan
    rows = spark.createDataFrame([(1, 1, ["ab", "bc"]), (1, 2, ["bc", "ab"]), (1, 3, [])], "case_id long, pos long, g array<string>")
    pairs = E.similar_pairs(rows, 0.9)
    assert [tuple(r) for r in pairs.collect()] == [(1, 1, 2)]
    plan = pairs._jdf.queryExecution().toString()
    assert "prefixes-" in plan and "lambdafunction" not in plan


def test_role_hashes_gather_leaves_once_and_stay_what_they_were(spark):
    """Reports of earlier rounds hold their hashes, so these must not change; equal ids are ordered by what the role sees of them."""
    rows = spark.createDataFrame([leaf("b", "é \"x\"", evidence=("E2", "E1")), leaf("a"), leaf("b", "t", cited=None)], LEAF)
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    seen = {
        "fidelity": [("a", '["a","t","E1","","source_fact"]'), ("b", '["b","é \\"x\\"","E1,E2","","source_fact"]'), ("b", '["b","t","E1","","source_fact"]')],
        "reader_advocate": [("a", '["a","t"]'), ("b", '["b","é \\"x\\""]'), ("b", '["b","t"]')],
        "source_scout": [("a", '["a","E1"]'), ("b", '["b","E1,E2"]'), ("b", '["b","E1"]')],
    }
    found = R.role_hashes(rows)
    assert {r.role: r.hash for r in found.collect()} == {role: sha("".join(h for _, h in sorted((i, sha(x)) for i, x in shown))) for role, shown in seen.items()}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("collect_list(") == 1
