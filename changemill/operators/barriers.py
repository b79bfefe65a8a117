"""Feeds of several partitions: where each partition is, and which truncates the whole feed has passed.

A keyed topic deals its keys over partitions, so offsets order a key but not a table. Across partitions changes
compare by their source position (the place in the source's log that every change carries). A truncate speaks for
the whole table but lies in one partition: it is a barrier that waits until every partition has come to its
position, and only then wipes what came before it. Until then it is pending, and the position that may be
committed for its partition stays in front of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changemill.operators.fold import LIVE_OPS, fold_changes


def position_vector(rows: DataFrame, table: str = "topic", part: str = "part", order: str = "pos") -> DataFrame:
    """Last position of each partition of each table: (table, part, order), combined before the shuffle."""
    return rows.groupBy(table, part).agg(F.max(order).alias(order))


def barrier_floor(vector: DataFrame, table: str = "topic", order: str = "pos", partitions: int | None = None) -> DataFrame:
    """Position that every partition of a table has reached: (table, ``_floor``).

    ``partitions`` is how many a topic has; while fewer have been seen nothing is passed. Without it the partitions
    seen so far count as all.
    """
    seen = vector.groupBy(table).agg(F.min(order).alias("_low"), F.count("*").alias("_seen"))
    complete = F.lit(True) if partitions is None else F.col("_seen") >= partitions
    return seen.select(table, F.when(complete, F.col("_low")).alias("_floor"))


def with_release(truncates: DataFrame, floor: DataFrame, table: str = "topic", order: str = "pos") -> DataFrame:
    """Truncates with ``released``: every partition has come to their position."""
    passed: Column = F.coalesce(F.col(order) <= F.col("_floor"), F.lit(False))
    return truncates.join(floor, table, "left").select(*truncates.columns, passed.alias("released"))


def last_released(truncates: DataFrame, floor: DataFrame, table: str = "topic", order: str = "pos") -> DataFrame:
    """Position of the last released truncate of each table: (table, ``_t_off``)."""
    return with_release(truncates, floor, table, order).where("released").groupBy(table).agg(F.max(order).alias("_t_off"))


def partitioned_state(
    feed: DataFrame, keys: list[str], table: str = "topic", part: str = "part", order: str = "pos", op: str = "op", partitions: int | None = None
) -> DataFrame:
    """Current rows of a feed of several partitions; pending truncates have not taken effect."""
    floor = barrier_floor(position_vector(feed, table, part, order), table, order, partitions)
    wiped = last_released(feed.where(F.col(op) == "t").select(table, order), floor, table, order)
    rows = fold_changes(feed, keys, order, op)
    kept = rows.join(wiped, table, "left").where(F.col("_t_off").isNull() | (F.col(order) > F.col("_t_off")))
    return kept.where(F.col(op).isin(*LIVE_OPS)).select(*rows.columns)


def pending_truncates(
    feed: DataFrame, table: str = "topic", part: str = "part", order: str = "pos", op: str = "op", partitions: int | None = None
) -> DataFrame:
    """Truncates that some partition has not come to yet, with the columns of the feed."""
    floor = barrier_floor(position_vector(feed, table, part, order), table, order, partitions)
    return with_release(feed.where(F.col(op) == "t"), floor, table, order).where("NOT released").drop("released")
