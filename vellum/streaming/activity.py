"""Streaming forms of the activity operators. Extensions: there is nothing to match here but the batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def debounce_stream(events: DataFrame, user: str, ts: str, value: str, gap: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """The last value of each burst, given out once the watermark has passed its end."""
    bursts = events.withWatermark(ts, late).groupBy(user, F.session_window(ts, gap).alias("burst"))
    return bursts.agg(F.max(ts).alias(ts), F.max_by(value, ts).alias(value)).select(user, ts, value)


def last_visits_stream(events: DataFrame, user: str, item: str, ts: str) -> DataFrame:
    """The newest visit of each item by each user, for update mode; the top five are taken from the sink's table."""
    return events.groupBy(user, item).agg(F.max(ts).alias(ts))
