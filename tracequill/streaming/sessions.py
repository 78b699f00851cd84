"""Sessions by a gap rule, for batch and for streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessionized(events: DataFrame, gap: str = "8 seconds", watermark: str | None = None, key: str = "user_id", at: str = "ts") -> DataFrame:
    """key, start, stop (of the last event's gap) and events of each session; more than ``gap`` between events breaks.

    A batch is read as instantaneous events. For streams ``watermark`` bounds the
    state; sessions are emitted when it has passed them.

    Session windows are half open, so a gap of exactly ``gap`` would break; one
    microsecond more keeps it together.
    """
    rows = events.withWatermark(at, watermark) if watermark else events
    window = F.session_window(F.col(at), F.concat(F.lit(gap), F.lit(" 1 microsecond")))
    return rows.groupBy(key, window).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), "events")
