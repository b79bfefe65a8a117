"""Snapshots: whole tables, key-ordered chunks that race the log, resync, hand-over."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changemill.functions.names import seconds_between
from changemill.operators.fold import latest_per_key
from changemill.operators.ordering import global_rank
from changemill.session import measured

# Snapshot modes and default sizes.
SNAPSHOT_MODES = ("initial", "when_needed", "never", "always", "schema_only", "recovery")
FETCH_SIZE = 10_000
CHUNK_ROWS = 1024


def needs_data(mode: str, has_state: bool, offset_usable: bool = True) -> bool:
    """Whether a source in this mode reads table rows before it follows the log."""
    if mode not in SNAPSHOT_MODES:
        raise ValueError(f"unknown snapshot mode {mode!r}")
    if mode == "always":
        return True
    if mode == "initial":
        return not has_state
    if mode == "when_needed":
        return not has_state or not offset_usable
    return False


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str],
    key: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    fetch_size: int = FETCH_SIZE,
) -> DataFrame:
    """A relational table, read in parallel key ranges when a numeric key and its bounds are given."""
    reader = spark.read.format("jdbc").options(**properties).option("url", url).option("dbtable", table)
    reader = reader.option("fetchsize", fetch_size)
    if key and bounds:
        reader = (
            reader.option("partitionColumn", key)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    return reader.load()


def as_snapshot(table: DataFrame, topic: str, position: int) -> DataFrame:
    """Rows of a table as read events at one feed position."""
    return table.select(F.lit(topic).alias("topic"), F.lit(position).cast("bigint").alias("off"), F.lit("r").alias("op"), *table.columns)


def resync(feed: DataFrame, table: DataFrame, topic: str, position: int) -> DataFrame:
    """Feed after a resync of one table: a reset marker, then every row of the table as a read.

    The marker is a truncate just below the reads, so the fold forgets older rows, and changes
    after the position win over the reads. The change at the position itself is in the reads
    already and would tie with them, so it is left out.
    """
    reads = as_snapshot(table, topic, position)
    marker = reads.sparkSession.range(1).select(
        F.lit(topic).alias("topic"), F.lit(position - 1).cast("bigint").alias("off"), F.lit("t").alias("op")
    )
    rest = feed.where((F.col("topic") != topic) | (F.col("off") != position))
    return rest.unionByName(reads, allowMissingColumns=True).unionByName(marker, allowMissingColumns=True)


def chunk_snapshot(table: DataFrame, keys: Sequence[str], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``chunk``: the table in key order, cut every ``chunk_rows`` rows.

    Only the keys are ranked, so what is sorted and checkpointed is narrow; the rows meet their
    chunk in one join on the key.
    """
    ranked = global_rank(table.select(*keys), keys, "_rank")
    chunks = ranked.select(*keys, F.floor(F.col("_rank") / F.lit(chunk_rows)).cast("bigint").alias("chunk"))
    return table.join(chunks, list(keys))


def window_of(offset: Column, width: int) -> Column:
    """Chunk whose watermark window holds a log offset: window n runs from n * width up to the next."""
    return F.floor(offset / F.lit(width)).cast("bigint")


def surviving_reads(chunks: DataFrame, log: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Chunk rows as reads just below their high watermark, without the keys that the log
    changed inside the chunk's window (the log row is newer than the read).

    The log is reduced to its distinct (key, window) pairs before it moves, so a key that is
    changed all the time is a few rows, and the anti join is a plain equi join.
    """
    changed = log.select(*keys, window_of(F.col("off"), width).alias("chunk")).distinct()
    reads = chunks.join(changed, [*keys, "chunk"], "left_anti")
    high = (F.col("chunk") + 1) * F.lit(width)
    return reads.withColumn("off", high - 1).withColumn("op", F.lit("r")).drop("chunk")


def merge_snapshot(reads: DataFrame, log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State after snapshot and log: the latest of reads and log changes per key, no deletes."""
    both = reads.unionByName(log, allowMissingColumns=True)
    return latest_per_key(both, keys).where(F.col("op") != "d")


def progress(completions: DataFrame, tables: DataFrame) -> DataFrame:
    """Snapshot progress per pipeline.

    ``completions`` has one row per finished chunk (pipeline, kind, tbl, rows, started_at,
    finished_at, is_last); ``tables`` one per table to read (pipeline, tbl). An incremental
    snapshot is preferred to an initial one. Chunks are summed per table first, so the report
    works on one row per table.
    """
    per_table = completions.groupBy("pipeline", "kind", "tbl").agg(
        F.sum("rows").alias("rows"),
        F.min("started_at").alias("started_at"),
        F.max("finished_at").alias("finished_at"),
        F.bool_or("is_last").alias("is_done"),
    )
    per_kind = per_table.groupBy("pipeline", "kind").agg(
        F.count_if("is_done").alias("done"),
        F.sum("rows").alias("rows_scanned"),
        F.min("started_at").alias("started_at"),
        F.max("finished_at").alias("finished_at"),
        F.max_by("tbl", F.struct("finished_at", "tbl")).alias("current_table"),
    )
    preferred = latest_per_key(
        per_kind.withColumn("_pref", F.when(F.col("kind") == "incremental", 1).otherwise(0)), ["pipeline"], "_pref"
    )
    total = tables.groupBy("pipeline").agg(F.count("*").alias("total_tables"))
    remaining = F.greatest(F.col("total_tables") - F.coalesce("done", F.lit(0)), F.lit(0))
    return total.join(preferred, "pipeline", "left").select(
        "pipeline", "kind", "total_tables",
        remaining.alias("remaining_tables"),
        F.greatest(F.col("total_tables") - remaining, F.lit(0)).alias("completed_tables"),
        F.coalesce("rows_scanned", F.lit(0)).alias("rows_scanned"),
        F.coalesce(seconds_between(F.col("started_at"), F.col("finished_at")), F.lit(0)).alias("duration_seconds"),
        F.when(remaining > 0, F.col("current_table")).alias("current_table"),
        (remaining == 0).alias("is_completed"),
    )


def completed_by_streaming(report: DataFrame, streaming: DataFrame) -> DataFrame:
    """A pipeline that is already streaming has completed its snapshot, whatever was sampled."""
    seen = measured(streaming.select("pipeline", F.lit(True).alias("_streams")).distinct())
    done = F.col("is_completed") | (F.col("kind").isNull() & F.coalesce("_streams", F.lit(False)))
    return report.join(seen, "pipeline", "left").withColumn("is_completed", done).drop("_streams")


def handover(table: DataFrame, log: DataFrame, topic: str, position: int) -> DataFrame:
    """Snapshot rows at the recorded position, then the log from there on."""
    reads = as_snapshot(table, topic, position)
    return reads.unionByName(log.where(F.col("off") > position), allowMissingColumns=True)
