"""Signal source: requests for ad-hoc snapshots, joined to the tables they name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Signal types.
SIGNAL_TYPES = ("execute-snapshot", "pause-snapshot", "resume-snapshot", "stop-snapshot", "log")
SIGNAL = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField(
            "data",
            T.StructType(
                [
                    T.StructField("type", T.StringType()),
                    T.StructField("data-collections", T.ArrayType(T.StringType())),
                    T.StructField("message", T.StringType()),
                ]
            ),
        ),
    ]
)


def read_signals(feed: DataFrame) -> DataFrame:
    """Signals of a feed; the message key is the prefix of the source they are meant for."""
    rows = feed.select(F.col("key").alias("prefix"), "off", F.from_json("value", SIGNAL).alias("_s"))
    return rows.where(F.col("_s.type").isin(*SIGNAL_TYPES)).select(
        "prefix", "off", F.col("_s.id").alias("signal_id"), F.col("_s.type").alias("signal_type"),
        F.coalesce("_s.data.type", F.lit("incremental")).alias("snapshot_type"),
        F.col("_s.data.`data-collections`").alias("collections"),
    )


def requested_tables(signals: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row per table a snapshot signal asks for and an enabled mapping knows."""
    wanted = signals.where(F.col("signal_type") == "execute-snapshot").select(
        "prefix", "off", "signal_id", "snapshot_type", F.explode("collections").alias("collection")
    )
    known = mapping.where("is_enabled").select(
        F.concat_ws(".", "source_schema", "source_table").alias("collection"), "target_table"
    )
    return wanted.join(known, "collection")


def active_snapshots(signals: DataFrame) -> DataFrame:
    """State of each source's snapshot after its last signal: running, paused or stopped."""
    state = (
        F.when(F.col("signal_type").isin("execute-snapshot", "resume-snapshot"), "running")
        .when(F.col("signal_type") == "pause-snapshot", "paused")
        .when(F.col("signal_type") == "stop-snapshot", "stopped")
    )
    steps = signals.withColumn("state", state).where(F.col("state").isNotNull())
    return steps.groupBy("prefix").agg(F.max_by("state", "off").alias("state"), F.max("off").alias("off"))
