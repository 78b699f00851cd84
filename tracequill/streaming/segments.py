"""Segmentation of units as they arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracequill.functions import text as T

_UNIT = pa.schema([("case", pa.int64()), ("none", pa.bool_()), ("at", pa.int64()), ("pos", pa.int32()), ("n", pa.int64()), ("ends", pa.bool_()), ("heading", pa.string()), ("start_ms", pa.int64()), ("end_ms", pa.int64())])
#: The open segment of each case (number, characters, units), the last unit's heading and end, and when it is forgotten.
_CASE = pa.schema([("case", pa.int64()), ("none", pa.bool_()), ("segment", pa.int32()), ("characters", pa.int64()), ("units", pa.int32()), ("heading", pa.string()), ("end_ms", pa.int64()), ("until", pa.int64())])


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all()


def _rows(table: pa.Table) -> list[tuple]:
    return list(zip(*(c.to_pylist() for c in table.columns), strict=True))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def streamed_segments(
    units: DataFrame, watermark: str, maximum: int = 1200, preferred: int = 650, most_units: int = 48, max_gap_ms: int = 8000, idle_ms: int | None = None, buckets: int = 1024
) -> DataFrame:
    """case_id, pos and segment of a stream of units, equal to ``operators.segments.segmented`` of the same units.

    Columns: case_id (long), at (timestamp, not falling with pos in a case), pos, text, heading, start_ms, end_ms. A unit is placed when the
    watermark has reached it, so units may come in any order within ``watermark``; later ones are dropped. State is the open segment's sums
    of each case and the units that wait, never their texts, in ``buckets`` rows by the hash of the case: a call of Python with its state costs as
    much as thousands of units, so there is not one for each case. With ``idle_ms`` a case without units for so long is forgotten; units
    after that begin a new count. A checkpoint goes with its number of buckets.
    Rows with a null case_id are one case. Units without a time are left out, and so are those at the epoch or before, where watermarks begin.
    """
    rows = units.filter("at IS NOT NULL").select(
        F.pmod(F.xxhash64("case_id"), F.lit(buckets)).cast("int").alias("bucket"), "at", F.coalesce("case_id", F.lit(0)).cast("long").alias("case"), F.col("case_id").isNull().alias("none"),
        F.unix_millis("at").alias("_at"), F.col("pos").cast("int"), T.compact_characters(F.col("text")).cast("long").alias("n"),
        F.coalesce(F.col("text").rlike(T.SENTENCE_END), F.lit(False)).alias("ends"), "heading", F.col("start_ms").cast("long"), F.col("end_ms").cast("long"),
    )

    def placed(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cases, waiting = map(_unpacked, state.get) if state.exists else (_CASE.empty_table(), _UNIT.empty_table())
        now, touched = state.getCurrentWatermarkMs(), set()
        if not state.hasTimedOut:
            for batch in batches:
                came = pa.table([pa.Array.from_pandas(batch["_at" if f.name == "at" else f.name], type=f.type, safe=False) for f in _UNIT], schema=_UNIT)
                touched |= set(zip(came["case"].to_pylist(), came["none"].to_pylist(), strict=True))
                waiting = pa.concat_tables([waiting, came])
        due = pa.compute.less_equal(waiting["at"], now)
        ready = sorted(_rows(waiting.filter(due)), key=lambda u: (u[0], u[1], u[2], u[3]))
        waiting = waiting.filter(pa.compute.invert(due)).combine_chunks()
        pending = set(zip(waiting["case"].to_pylist(), waiting["none"].to_pylist(), strict=True)) if idle_ms is not None else set()
        # A case whose time is over is forgotten, unless units of it came.
        known = {(c[0], c[1]): list(c[2:]) for c in _rows(cases) if c[7] is None or c[7] >= now or (c[0], c[1]) in touched or (c[0], c[1]) in pending}
        out, moved = [], set()
        for case, none, _, pos, n, ends, head, start, stop in ready:
            own = known.setdefault((case, none), [1, 0, 0, None, None, None])
            segment, characters, count, heading, end, _ = own
            apart = bool(head and heading and head != heading) or (start is not None and end is not None and start - end > max_gap_ms)
            if count and (apart or characters >= maximum or count >= most_units):
                segment, characters, count = segment + 1, 0, 0
            characters, count = characters + int(n or 0), count + 1
            out.append((None if none else case, pos, segment))
            if characters >= maximum or count >= most_units or (characters >= preferred and ends):
                segment, characters, count = segment + 1, 0, 0
            own[:5] = segment, characters, count, head, stop
            moved.add((case, none))
        if idle_ms is not None:
            for case in touched | moved:
                known.setdefault(case, [1, 0, 0, None, None, None])[5] = max(now, 0) + idle_ms
            for case in pending & known.keys():
                known[case][5] = None
        if known or waiting.num_rows:
            state.update((_packed(_table([(*case, *own) for case, own in known.items()], _CASE)), _packed(waiting)))
            times = [own[5] for own in known.values() if own[5] is not None]
            if waiting.num_rows:
                times.append(pa.compute.min(waiting["at"]).as_py())
            if times:
                state.setTimeoutTimestamp(int(min(times)))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({"case_id": pd.array([x[0] for x in out], dtype="Int64"), "pos": [x[1] for x in out], "segment": [x[2] for x in out]})

    return rows.withWatermark("at", watermark).groupBy("bucket").applyInPandasWithState(placed, "case_id long, pos int, segment int", "cases binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout)
