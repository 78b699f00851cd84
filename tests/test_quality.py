from tracequill.operators import quality as Q


def test_unlabelled_additions(spark):
    rows = [
        (1, "deep", "prose", "external", [], None, None), (1, "deep", "prose", "external", None, [["R"]], None), (1, "deep", "participant_guide", "external", None, None, None),
        (2, "brief", "prose", "external", None, [["R"]], None), (2, "brief", "participant_guide", "external", None, None, [[]]), (2, "brief", "prose", "external", None, None, [[], ["R"]]),
        (3, "deep", "editor_note", "editorial", None, None, None), (3, "brief", None, "editorial", ["R"], None, None), (4, None, None, None, None, None, None),
    ]
    blocks = spark.createDataFrame(rows, "case_id int, document string, type string, provenance string, citation_refs array<string>, paragraph_refs array<array<string>>, item_refs array<array<string>>")
    assert {r.case_id: r.additions for r in Q.unlabelled_additions(blocks).collect()} == {1: 1, 2: 2, 3: 1, 4: 0}
    assert Q.unlabelled_additions(blocks.limit(0)).collect() == []


def test_human_reviews(spark):
    cases = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True), (5, None)], "case_id int, required boolean")
    reviews = [(1, "1", "human", "Ann", "now", "pass", {"a": 5.0, "b": 1.0}), (3, "0", "agent", None, None, None, None), (4, None, "agent", "AI", " ", "no", {"a": 5.5, "b": 0.0})]
    found = spark.createDataFrame(reviews, "case_id int, version string, reviewer_type string, reviewer string, reviewed_at string, decision string, scores map<string,double>")
    got = {r.case_id: (r.status, r.errors) for r in Q.human_reviews(cases, found, ["a", "b"], "1").collect()}
    assert got == {1: ("pass", []), 2: ("pending", []), 3: ("not_required", []), 4: ("fail", ["version", "reviewer_type", "unsigned", "automatic_reviewer", "decision", "score_a", "score_b"]), 5: ("not_required", [])}
