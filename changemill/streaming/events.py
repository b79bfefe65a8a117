"""Streaming operators on event time: de-duplicated events and windowed counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once_per_event(events: DataFrame, id_column: str = "event_id", time_column: str = "event_time", within: str = "1 hour") -> DataFrame:
    """Each event id once; ids are remembered for the watermark delay, not for ever."""
    return events.withWatermark(time_column, within).dropDuplicatesWithinWatermark([id_column])


def events_per_window(
    feed: DataFrame, by: Sequence[str], time_column: str = "ts", width: str = "1 hour", delay: str | None = None
) -> DataFrame:
    """Events per tumbling window and group; with a delay a window is emitted once it is final."""
    source = feed.withWatermark(time_column, delay) if delay else feed
    counted = source.groupBy(F.window(time_column, width), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), *by, "n")
