import os

from tracequill import session
from tracequill.functions import folds


def test_running_aggregates_equal_a_loop(spark):
    arrays = [[3, 1, 2], [], [5], list(range(1000)), [7] * 17]
    df = spark.createDataFrame([(a,) for a in arrays], "x array<long>")
    got = df.selectExpr("x", f"{folds.sums_before('x')} AS sums", f"{folds.most_before('transform(x, q -> q + 1)', 'w')} AS most").collect()
    for r in got:
        assert r.sums == [sum(r.x[:i]) for i in range(len(r.x))]
        assert r.most == [max([0, *(v + 1 for v in r.x[:i])]) for i in range(len(r.x))]


def test_rows_are_told_apart(spark, sf_dir):
    same = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "x int, y string")
    stored = session.written(spark, same, "same")
    for df in (same, stored, stored.filter("x < 3"), same.limit(0), spark.read.parquet(f"{sf_dir}/nation.parquet")):
        found = session.identified(df)
        assert found.columns == [*df.columns, "_row"]
        rows = found.collect()
        assert len({tuple(r["_row"]) for r in rows}) == len(rows) == df.count()
        assert found.select("_row").distinct().join(found, "_row").count() == len(rows)


def test_scopes_drop_their_tables(spark):
    with session.scope(spark):
        inside = session.scratch_path(spark, "inside")
        spark.range(3).write.parquet(inside)
        assert os.path.isdir(inside)
    assert not os.path.exists(inside)
