import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tracequill.operators import intake
from tracequill.plans import case_queries
from tracequill.sources import cases


def files(spark, rows):
    return spark.createDataFrame(rows, "name string, content binary")


def test_intake_reads_back_and_refuses(spark, tmp_path):
    root = str(tmp_path / "archive")
    assert intake.listing(spark, root).count() == 0
    first = files(spark, [("b.txt", b"beta"), ("a.md", b"alpha"), ("README.md", b"x"), ("c.pdf", b"y"), (".hidden.txt", b"z"), ("copy.txt", b"beta"), ("d.srt", None)])
    got = {r.name: (r.status, r.case_id) for r in intake.archive(first, root).collect()}
    assert got == {
        "a.md": ("accepted", "case-0001-a"), "b.txt": ("accepted", "case-0002-b"), "d.srt": ("accepted", "case-0003-d"), "README.md": ("reserved", None), "c.pdf": ("unsupported", None),
        ".hidden.txt": ("unsafe", None), "copy.txt": ("repeated", None),
    }
    second = files(spark, [("e.txt", b"alpha"), ("B.md", b"new"), ("f.vtt", b"other"), ("F.txt", b"third")])
    got = {r.name: (r.status, r.case_id) for r in intake.archive(second, root).collect()}
    assert got == {"e.txt": ("archived", None), "B.md": ("taken", None), "F.txt": ("accepted", "case-0004-f"), "f.vtt": ("taken", None)}
    rows = {(r.case_id, r.name, r.format, bytes(r.content), r.n_bytes, r.sha256) for r in intake.archived(spark, root).collect()}
    want = [("case-0001-a", "a.md", "md", b"alpha"), ("case-0002-b", "b.txt", "txt", b"beta"), ("case-0003-d", "d.srt", "srt", b""), ("case-0004-f", "F.txt", "txt", b"third")]
    assert rows == {(*x, len(x[3]), hashlib.sha256(x[3]).hexdigest()) for x in want}
    assert {r.content for r in intake.listing(spark, root).collect()} == {None}


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    root = str(tmp_path / "archive")
    spark.dataSource.register(cases.CaseSource)
    good = [(f"case-{i}", f"f{i}.txt", "txt", None, 1, b"x") for i in range(20)]
    for bad in (("case-x", "../out.txt", "txt", None, 1, b"x"), ("case-x", "f.txt", "txt", "0" * 64, 1, b"x")):
        df = spark.createDataFrame([*good, bad], cases.SCHEMA).repartition(4)
        with pytest.raises(Exception, match="unsafe|hashed"):
            df.write.format("cases").option("path", root).mode("append").save()
        assert not os.path.exists(root) or os.listdir(root) == []
    assert intake.listing(spark, root).count() == 0
    with pytest.raises(Exception, match="append"):
        spark.createDataFrame(good, cases.SCHEMA).write.format("cases").option("path", root).mode("overwrite").save()


def test_partitions_follow_bytes_and_changes_are_seen(spark, tmp_path):
    root = str(tmp_path / "archive")
    spark.dataSource.register(cases.CaseSource)
    rows = [(f"case-{i}", f"f{i}.txt", "txt", None, 1, bytes([65 + i % 26]) * (i * 7 % 50)) for i in range(100)]
    spark.createDataFrame(rows, cases.SCHEMA).coalesce(2).write.format("cases").option("path", root).mode("append").save()
    os.makedirs(f"{root}/.staging-lost")
    df = spark.read.format("cases").option("path", root).option("split", "300").load()
    assert df.rdd.getNumPartitions() > 6
    assert {(r.name, bytes(r.content)) for r in df.collect()} == {(r[1], r[5]) for r in rows} and df.count() == 100
    (batch,) = [x for x in os.listdir(root) if x[0] != "."]
    part = next(x for x in sorted(os.listdir(f"{root}/{batch}")) if x.endswith(".bin"))
    with open(f"{root}/{batch}/{part}", "r+b") as own:
        own.seek(40)
        own.write(b"#")
    with pytest.raises(Exception, match="has changed"):
        intake.archived(spark, root).collect()


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(f"n{i * 37 % 1000:04d}",) for i in range(1000)], "name string").repartition(7)
    got = sorted((r.name, r.number) for r in intake.numbered(rows, "name", 5).collect())
    assert got == [(f"n{i:04d}", i + 5) for i in range(1000)]
    assert intake.numbered(rows.limit(0), "name").count() == 0


def test_numbers_are_shown_as_the_sql_pads_them(spark):
    """The archive keeps numbers of five digits and more whole; the queries show them as DuckDB's ``lpad`` does."""
    numbers = [1, 42, 9_999, 10_000, 123_456]
    want = [duckdb.execute("SELECT 'case-' || lpad(?::VARCHAR, 4, '0') || '-doc-7-b'", [n]).fetchone()[0] for n in numbers]
    df = spark.createDataFrame([(i, f"case-{n:04d}-doc-7-b") for i, n in enumerate(numbers)], "i int, c string").orderBy("i")
    assert [r.c for r in df.select(case_queries._shown(F.col("c")).alias("c")).collect()] == want
