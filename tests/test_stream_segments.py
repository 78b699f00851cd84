import random
import tempfile

from pyspark.sql import functions as F

from tracequill.operators import segments as S
from tracequill.streaming.segments import streamed_segments

SCHEMA = "case_id long, at timestamp, pos int, text string, heading string, start_ms long, end_ms long"


def run(spark, batches, **options):
    """Placed rows of all batches, each one file and one run over the same checkpoint."""
    base = tempfile.mkdtemp(prefix="spark-")
    for rows in batches:
        frame = spark.createDataFrame(rows, "case_id long, at_ms long, pos int, text string, heading string, start_ms long, end_ms long")
        frame.withColumn("at", F.timestamp_millis(F.col("at_ms") + 86400000)).select("case_id", "at", "pos", "text", "heading", "start_ms", "end_ms").coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = streamed_segments(spark.readStream.schema(SCHEMA).parquet(f"{base}/in"), "10 seconds", **options)
        stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/progress").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.case_id, r.pos, r.segment) for r in spark.read.schema("case_id long, pos int, segment int").parquet(f"{base}/out").collect())


END = (-1, 10**9, 0, "", "", 0, 0)


def test_equals_batch_whatever_the_order_within_the_watermark(spark):
    random.seed(5)
    rows = []
    for case in (1, 2):
        at = 0
        for pos in range(1, 121):
            at += random.choice((0, 200, 400, 9000))
            text = "w" * random.randrange(0, 60) + random.choice((".", ",", ""))
            rows.append((case, at, pos, text, random.choice(("A", "A", "A", "B", "", None)), at if pos % 17 else None, at + 100))
    rows.append((None, 50, 1, "alone", None, None, None))
    apart = sorted(rows, key=lambda r: r[1] + random.randrange(0, 8000))
    parts = [apart[i * len(apart) // 3 : (i + 1) * len(apart) // 3] for i in range(3)]
    got = run(spark, [[r for r in part if r[0] is not None] for part in parts] + [[END]], maximum=300, preferred=120, most_units=9)
    known = spark.createDataFrame([(r[0], *r[2:]) for r in rows if r[0] is not None], "case_id long, pos int, text string, heading string, start_ms long, end_ms long")
    want = S.segmented(known, maximum=300, preferred=120, most_units=9)
    assert got == sorted((r.case_id, r.pos, r.segment) for r in want.collect())


def test_late_units_are_dropped_and_idle_cases_forgotten(spark):
    unit = lambda case, at, pos: (case, at, pos, "word.", "", at, at)
    batches = [[unit(1, 0, 1), unit(1, 20000, 2)], [unit(2, 60000, 1)], [unit(1, 30000, 3), unit(1, 55000, 4)], [END]]
    assert run(spark, batches) == [(1, 1, 1), (1, 2, 2), (1, 4, 3), (2, 1, 1)]
    idle = [[unit(1, 0, 1), unit(1, 20000, 2)], [unit(2, 60000, 1)], [unit(2, 500000, 2)], [unit(1, 600000, 3)], [END]]
    assert [r for r in run(spark, idle, idle_ms=60000) if r[0] == 1] == [(1, 1, 1), (1, 2, 2), (1, 3, 1)]


def test_cases_without_ready_units_give_no_frames(spark):
    """A case costs no operations on a frame: before, each made several on its units and one for no rows at all. Nulls stay nulls."""
    import inspect

    from tracequill.streaming import segments

    assert not [x for x in (".astype(", ".where(", ".rename(") if x in inspect.getsource(segments.streamed_segments)]
    rows = [(case, 1, 1, "word.", None, None, 5) for case in range(40)] + [(case, 9000, 2, None, "", 7100, None) for case in range(40)]
    assert run(spark, [rows, [END]]) == [(case, pos, 1) for case in range(40) for pos in (1, 2)]


def test_cases_share_a_call_of_python(spark):
    """Before, each case was a call with a state of its own. In one bucket, one idle case is forgotten while others go on; a null case and large ids stay apart."""
    unit = lambda case, at, pos: (case, at, pos, "word.", "", at, at)
    big = 2**60 + 1
    batches = [[unit(1, 0, 1), unit(1, 20000, 2), unit(big, 20000, 1), unit(0, 20000, 1)], [unit(2, 60000, 1)], [unit(2, 500000, 2)], [unit(1, 600000, 3)], [END]]
    got = run(spark, batches, idle_ms=60000, buckets=1)
    assert {(1, 1, 1), (1, 2, 2), (1, 3, 1), (2, 1, 1), (big, 1, 1), (0, 1, 1)} <= set(got)
    assert run(spark, [[unit(None, 0, 1), unit(None, 20000, 2)], [unit(None, 90000, 3)]], buckets=1) == [(None, 1, 1), (None, 2, 2)]
