"""Sightings of a stream: session windows with a watermark, the streaming form of gap sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_sightings(events: DataFrame, gap: str = "1 day", late: str = "1 day", ts: str = "ts", keys: tuple[str, ...] = ("user_id", "event_type")) -> DataFrame:
    """(keys, start, end, n): sessions of events at most `gap` apart, the gap included; events later than `late` are dropped.

    start and end are the first and the last event of the session, as in the batch form; runs on a stream or on a table.
    """
    s = events.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap))
    return s.agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count("*").alias("n")).select(*keys, "start", "end", "n")
