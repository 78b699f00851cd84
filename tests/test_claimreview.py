from tracequill.operators import claimreview as C

ENTRY = "case_id int, ref string, verdict string, atomicity string, support string, importance_verdict string, importance_proposed string, theme_verdict string, theme_proposed string, speaker string, issues array<string>, rationale string, merge_refs array<string>, replacements array<string>, codes array<string>"


def entry(ref="E0001", case=1, **changes):
    row = dict(case_id=case, ref=ref, verdict="pass", atomicity="pass", support="supported", importance_verdict="confirmed", importance_proposed=None, theme_verdict="confirmed", theme_proposed=None, speaker="confirmed", issues=[], rationale="because", merge_refs=[], replacements=[], codes=[])
    return tuple((row | changes).values())


def gap(ref, case=1, **changes):
    return entry(ref, case, **({"verdict": "revise", "support": "partial", "codes": ["support_gap"]} | changes))


def frames(spark, *rows):
    return spark.createDataFrame(list(rows), ENTRY)


def claims(spark, *ids, case=1):
    return spark.createDataFrame([(case, i) for i in ids], "case_id int, id string")


def test_entry_rules(spark):
    cases = [
        (entry(), []),
        (entry("e1"), ["evidence_ref"]),
        (entry(None), ["evidence_ref"]),
        (entry(verdict="maybe"), ["verdict", "nonpass_without_codes"]),
        (entry(importance_verdict="change"), ["importance_change_without_value", "pass_contradicts_axes"]),
        (entry(importance_proposed="low"), ["importance_confirmed_with_value", "pass_contradicts_axes"]),
        (entry(importance_proposed="huge"), ["importance_decision", "pass_contradicts_axes"]),
        (gap("E0001", theme_verdict="change", theme_proposed="T1"), ["theme_decision"]),
        (gap("E0001", issues=["a", "a", ""]), ["issues_empty_text", "issues_repeated"]),
        (gap("E0001", issues=None, rationale=" \n"), ["issues_missing", "rationale"]),
        (gap("E0001", verdict="merge", merge_refs=["E0001"]), ["merge_into_itself"]),
        (gap("E0001", verdict="merge", merge_refs=["E0009"]), ["merge_into_unknown"]),
        (gap("E0001", verdict="merge", merge_refs=None), ["merge_target_count"]),
        (gap("E0001", merge_refs=["E0002"]), ["targets_without_merge"]),
        (gap("E0001", verdict="split", replacements=["x"]), ["split_needs_two"]),
        (gap("E0001", verdict="split", replacements=["x", " "]), ["replacement_blank"]),
        (entry(replacements=["x"]), ["pass_with_replacement"]),
        (gap("E0001", codes=["odd"]), ["codes_unsupported"]),
        (gap("E0001", codes=None), ["codes_missing", "nonpass_without_codes"]),
        (entry(codes=["support_gap"]), ["pass_with_codes"]),
    ]
    rows = [(i, *row[1:]) for i, (row, _) in enumerate(cases)]
    known = spark.createDataFrame([(i, e) for i in range(len(cases)) for e in ("E0001", "E0002")], "case_id int, id string")
    got = {r.case_id: r.errors for r in C.entry_errors(frames(spark, *rows), known).collect()}
    assert got == {i: e for i, (_, e) in enumerate(cases)}


def test_scope_decisions_and_conflicts(spark):
    one = frames(spark, entry("E0001"), entry("E0001"), entry("E0003"))
    found = C.review_errors(one, claims(spark, "E0001", "E0002"), claims(spark, "E0001", "E0002").withColumnRenamed("id", "ref"))
    assert {(r.ref, r.error) for r in found.collect()} == {("E0001", "entry_repeated"), ("E0003", "outside_scope"), ("E0002", "not_reviewed")}
    mine = frames(spark, gap("E0001"), gap("E0002", codes=["missing_support_quote", "support_gap"]), entry("E0003", verdict="revise", codes=["missing_support_quote"], issues=["quote"]), gap("E0004", verdict="split", replacements=["x", "y"]))
    rows = {r.ref: r for r in C.decisions(mine).collect()}
    assert [(rows[e].semantic, rows[e].mechanical) for e in ("E0001", "E0002", "E0003")] == [(["support_gap"], False), (["support_gap"], True), ([], True)]
    other = frames(spark, entry("E0001"), gap("E0002"), gap("E0004", verdict="split", replacements=["p", "q", "r"]))
    got = {r.ref: r.triggers for r in C.conflicts(C.decisions(mine), C.decisions(other)).collect()}
    assert got == {"E0001": ["verdict_conflict", "finding_conflict"], "E0002": [], "E0004": ["remedy_conflict"]}


def test_quote_repairs(spark):
    spans = "case_id int, id string, span int, rest string, quote string"
    before = spark.createDataFrame([(1, "E0001", 0, "a", None), (1, "E0001", 1, "b", "said"), (1, "E0002", 0, "c", " "), (2, "E0001", 0, "a", None), (3, "E0001", 0, "a", "x")], spans)
    after = spark.createDataFrame([(1, "E0001", 0, "a", "new"), (1, "E0001", 1, "b", "said"), (1, "E0002", 0, "c", None), (2, "E0001", 0, "z", "new"), (3, "E0001", 0, "a", "y")], spans)
    assert {(r.case_id, r.id, r.span, r.outcome) for r in C.quote_additions(before, after).collect()} == {(1, "E0001", 0, "added"), (1, "E0002", 0, "quote_not_added"), (2, None, None, "semantics_changed"), (3, "E0001", 0, "quote_changed")}
    fix = "case_id int, ref string, code string, status string, spans array<int>"
    good = ("missing_support_quote", "mechanically_resolved")
    fixes = spark.createDataFrame([(1, "E0001", *good, [0]), (1, "E0002", "support_gap", "open", [0, 0])], fix)
    assert {(r.ref, r.error) for r in C.fix_errors(before, after, fixes).collect()} == {("E0002", e) for e in ("quote_not_added", "code", "status", "quote_left_missing", "spans", "nothing_added")}
    other = spark.createDataFrame([(2, "E0001", *good, [0])], fix)
    assert {(r.ref, r.error) for r in C.fix_errors(before, after, other).collect()} == {(None, "semantics_changed"), ("E0001", "spans_not_those_added"), ("E0001", "nothing_added")}
    late = spark.createDataFrame([(1, "E0003", *good, [0])], fix)
    assert ("E0001", "not_covered") in {(r.ref, r.error) for r in C.fix_errors(before, after, late).collect()}


def test_bindings(spark):
    h = "0" * 64
    schema = "case_id int, artefact string, hash string"
    got = C.binding_errors(spark.createDataFrame([(1, "a", h), (1, "b", "F" * 64), (1, "c", "1" * 64), (1, "x", h)], schema), spark.createDataFrame([(1, k, h) for k in "abcd"], schema))
    assert {(r.artefact, r.error) for r in got.collect()} == {("b", "malformed"), ("c", "stale"), ("d", "missing"), ("x", "not_an_input")}


def test_states(spark):
    ruled = "case_id int, ref string, triggers array<string>, selection string, confidence double, rationale string"
    both = ["verdict_conflict", "finding_conflict"]
    first = {1: [entry()], 2: [entry(), entry()], 3: [gap("E0001")], 4: [gap("E0001")], 5: [gap("E0001")], 6: [gap("E0001")], 7: [gap("E0001")], 8: [gap("E0001")], 9: [entry("E0001", verdict="revise", codes=["missing_support_quote"], issues=["q"])], 10: [gap("E0001", codes=["missing_support_quote", "support_gap"])], 11: [entry()], 12: [gap("E0001")], 13: [gap("E0001")]}
    second = {4: gap("E0001"), 5: entry(), 6: entry(), 7: entry(), 8: entry(), 10: entry(), 11: entry(), 12: gap("E0001"), 13: entry("E0002")}
    rulings = [(6, "E0001", both, "original", 0.9, "r"), (7, "E0001", both, "primary", 0.5, "r"), (8, "E0001", both[:1], "primary", 0.9, "r"), (10, "E0001", both, "primary", 0.9, "r")]
    move = lambda case, row: (case, *row[1:])
    known = spark.createDataFrame([(c, "E0001") for c in first], "case_id int, id string")
    fixed = spark.createDataFrame([(10, "E0001")], "case_id int, ref string")
    people = spark.createDataFrame([(c, "ann", "ann" if c == 12 else "bo", "cy") for c in first], "case_id int, primary string, secondary string, adjudicator string")
    got = C.claim_states(known, frames(spark, *(move(c, r) for c, rows in first.items() for r in rows)), fixed, frames(spark, *(move(c, r) for c, r in second.items())), spark.createDataFrame(rulings, ruled), people)
    assert {r.case_id: r.state for r in got.collect()} == {
        1: "pass", 2: "invalid", 3: "needs_secondary", 4: "repair_required", 5: "needs_adjudication", 6: "pass", 7: "human_required", 8: "invalid",
        9: "needs_mechanical_fix", 10: "repair_required", 11: "invalid", 12: "invalid", 13: "invalid",
    }


def test_unknown_targets_belong_to_their_own_entry(spark):
    """Three entries of one ref: only that with the unknown target breaks the rule."""
    rows = frames(spark, gap("E0001", verdict="merge", merge_refs=["E0002"]), gap("E0001", verdict="merge", merge_refs=["E0009"]), gap("E0001"))
    got = sorted((r.verdict, r.merge_refs, r.errors) for r in C.entry_errors(rows, claims(spark, "E0001", "E0002")).collect())
    assert got == [("merge", ["E0002"], []), ("merge", ["E0009"], ["merge_into_unknown"]), ("revise", [], [])]
