"""Truncates that wait: for the sink's position, or for a paused pipeline to run again.

Inside one ordered feed the fold handles truncates itself. These operators serve feeds whose
data and truncates are read apart, as small tables of (topic, part, off).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AT = ["topic", "part"]


def with_due(pending: DataFrame, committed: DataFrame, on_unknown: str = "defer") -> DataFrame:
    """Add ``is_due``: the sink's committed position (the next offset it reads) is past the truncate.

    A negative or missing position is not past anything. ``on_unknown="apply"`` treats a
    position that is absent from the table as due, for callers that would rather act.
    """
    positions = committed.select(*AT, "committed", F.lit(True).alias("_known"))
    unknown = F.lit(on_unknown == "apply")
    due = F.when(F.col("_known").isNull(), unknown).otherwise(
        F.coalesce((F.col("committed") >= 0) & (F.col("committed") > F.col("off")), F.lit(False))
    )
    return pending.join(positions, AT, "left").select(*pending.columns, "committed", due.alias("is_due"))


def truncates_due(pending: DataFrame, committed: DataFrame, on_unknown: str = "defer") -> DataFrame:
    return with_due(pending, committed, on_unknown).where("is_due").drop("is_due")


def settle(pending: DataFrame, committed: DataFrame, resynced: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(applied, still pending) after a poll; ``resynced`` says per topic whether its resync worked.

    A truncate that is not due, or whose resync failed, stays pending.
    """
    marked = with_due(pending, committed).join(resynced.select("topic", "resync_ok"), "topic", "left")
    done = F.col("is_due") & F.coalesce("resync_ok", F.lit(True))
    return marked.where(done).select(*pending.columns), marked.where(~done).select(*pending.columns)


def commit_positions(positions: DataFrame, pending: DataFrame) -> DataFrame:
    """Position to commit per partition: never past the earliest truncate still pending."""
    earliest = pending.groupBy(*AT).agg(F.min("off").alias("_first"))
    held = F.least("position", F.coalesce("_first", "position"))
    return positions.join(earliest, AT, "left").select(*AT, held.alias("commit_position")).where("commit_position >= 0")


def enqueue(queue: DataFrame, new: DataFrame) -> DataFrame:
    """Truncates of a paused pipeline, each table at most once with its latest position."""
    both = queue.unionByName(new)
    rest = [c for c in both.columns if c not in ("pipeline", "tbl", "off")]
    return both.groupBy("pipeline", "tbl", *rest).agg(F.max("off").alias("off")).select(*queue.columns)


def drainable(queue: DataFrame, control: DataFrame) -> DataFrame:
    """Queued truncates of pipelines whose source and sink both run."""
    running = control.where((F.col("source_state") == "RUNNING") & (F.col("sink_state") == "RUNNING")).select("pipeline")
    return queue.join(running, "pipeline", "left_semi")


def after_drain(queue: DataFrame, applied: DataFrame) -> DataFrame:
    """What stays queued: everything that was not applied successfully."""
    return queue.join(applied.select("pipeline", "tbl"), ["pipeline", "tbl"], "left_anti")
