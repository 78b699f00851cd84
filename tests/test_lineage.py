from tracequill.operators import lineage as L

ENTRY = "case_id int, entry_id string, kind string, old_refs array<string>, new_refs array<string>"
CLAIM = "case_id int, ref string, source_ids array<string>"


def test_migration_contract(spark):
    entries = [
        (1, "m1", "preserved", ["a"], ["A"]), (1, "m2", "merged", ["b", "c"], ["B"]), (1, "m3", "split", ["d"], ["D"]), (1, "m4", "retired", ["a"], []), (1, "m5", "rewritten", ["zz"], ["ZZ"]), (2, "m1", "new", [], ["N"]), (2, "m2", "other", ["o"], ["O"]),
    ]
    old = [(1, "a", ["1"]), (1, "b", ["2"]), (1, "c", ["9"]), (1, "d", []), (1, "lost", ["3"]), (2, "o", ["1"])]
    new = [(1, "A", ["1"]), (1, "B", ["2"]), (1, "D", ["4"]), (1, "fresh", ["5"]), (2, "N", []), (2, "O", [])]
    got = {tuple(r) for r in L.migration_errors(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(old, CLAIM), spark.createDataFrame(new, CLAIM)).collect()}
    assert got == {
        (1, "repeated_old", "a"), (1, "unknown_old", "zz"), (1, "unknown_new", "ZZ"), (1, "missing_old", "lost"), (1, "missing_new", "fresh"), (1, "cardinality", "m3"), (1, "no_overlap", "m2:c"), (2, "cardinality", "m2"),
    }


def test_origins_over_many_rounds(spark):
    """A chain of 20 rounds, a merge, a split, and a claim that came in on the way."""
    edges = [(1, r, "x", "x") for r in range(1, 21)] + [(1, 20, "y", "x"), (1, 13, "n", "n"), (1, 14, "x", "n"), (2, 2, "m", "a"), (2, 2, "m", "b"), (2, 1, "a", "p"), (2, 1, "b", "p"), (2, 1, "b", "q")]
    claims = [(1, 20, "x"), (1, 20, "y"), (1, 20, "new"), (2, 2, "m")]
    got = {tuple(r) for r in L.origins(spark.createDataFrame(edges, "case_id int, round int, ref string, old_ref string"), spark.createDataFrame(claims, "case_id int, round int, ref string")).collect()}
    want = {(1, 20, c, r, o) for c in "xy" for r, o in ((0, "x"), (12, "n"))} | {(1, 20, "new", 20, "new"), (2, 2, "m", 0, "p"), (2, 2, "m", 0, "q")}
    assert got == want
