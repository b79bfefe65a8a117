"""Change-feed source: many change topics read as one feed of (topic, part, off, ts, key, value)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changemill.functions import names
from changemill.functions.decode import zone_free
from changemill.session import measured

FEED_SCHEMA = T.StructType(
    [
        T.StructField("topic", T.StringType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("off", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)
# Capture and signal tables that a source adds to its include list.
CAPTURE_TABLES = {
    "postgresql": "ddl_capture.ddl_events",
    "mssql": "dbo.debezium_signal",
    "oracle": "DEBEZIUM_SIGNAL",
}


def read_files(
    spark: SparkSession,
    path: str,
    streaming: bool = False,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """A feed stored as parquet files with the feed columns."""
    if not streaming:
        return spark.read.schema(FEED_SCHEMA).parquet(path)
    reader = spark.readStream.schema(FEED_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def read_kafka(
    spark: SparkSession,
    servers: str,
    client_id: int,
    db_id: int | None = None,
    streaming: bool = True,
    starting_offsets: str = "earliest",
    max_offsets_per_trigger: int | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """A feed in Kafka; new tables join by the topic pattern without a restart."""
    reader = (spark.readStream if streaming else spark.read).format("kafka")
    reader = (
        reader.option("kafka.bootstrap.servers", servers)
        .option("subscribePattern", names.topic_pattern(client_id, db_id))
        .option("startingOffsets", starting_offsets)
    )
    if max_offsets_per_trigger and streaming:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return reader.options(**(options or {})).load().select(
        "topic",
        F.col("partition").alias("part"),
        F.col("offset").alias("off"),
        zone_free(F.col("timestamp")).alias("ts"),
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
    )


def subscribed(feed: DataFrame, client_id: int, db_id: int | None = None) -> DataFrame:
    """Data topics of a source: three or four segments, no DDL capture and no signal table."""
    return feed.where(names.is_data_topic(F.col("topic"), client_id, db_id))


def with_topic_parts(feed: DataFrame) -> DataFrame:
    topic = F.col("topic")
    return feed.withColumns(
        {
            "db_id": names.topic_db_id(topic),
            "source_schema": names.topic_schema(topic),
            "source_table": names.topic_table(topic),
        }
    )


def enabled(mapping: DataFrame) -> DataFrame:
    return mapping.where("is_enabled")


def include_tables(feed: DataFrame, mapping: DataFrame) -> DataFrame:
    """Rows of tables that an enabled mapping lists.

    The mapping is metadata (one row per captured table); pass it measured or as a lookup,
    and Spark broadcasts it on its known size.
    """
    listed = enabled(mapping).select("db_id", "source_schema", "source_table")
    return with_topic_parts(feed).join(listed, ["db_id", "source_schema", "source_table"], "left_semi").select(*feed.columns)


def include_list(mapping: DataFrame, system: str, user_schema: str | None = None) -> DataFrame:
    """Names a source captures: its enabled tables and its own capture or signal table."""
    rows = enabled(mapping).select(
        names.include_list_name(
            F.lit(system), F.col("database"), F.col("source_schema"), F.col("source_table"), F.lit(user_schema)
        ).alias("name")
    )
    extra = CAPTURE_TABLES.get(system)
    if extra is None:
        return rows
    if system == "oracle":
        extra = f"{(user_schema or '').upper()}.{extra}"
    return rows.unionByName(rows.sparkSession.range(1).select(F.lit(extra).alias("name"))).distinct()


def skip_operations(feed: DataFrame, skipped: Sequence[str] = ("t",)) -> DataFrame:
    """Drop operations a source is told to skip; an empty list keeps truncates too."""
    return feed.where(~F.col("op").isin(*skipped)) if skipped else feed


def without_system_schemas(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(~names.is_system_schema(F.col(column)))


def union_feeds(feeds: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)


def table_changes(watched: DataFrame, desired: DataFrame, key: str = "topic") -> DataFrame:
    """Tables to add to and to remove from a subscription.

    Nothing is returned when no table is desired: a subscription never becomes empty.
    """
    watched, desired = measured(watched.select(key).distinct()), measured(desired.select(key).distinct())
    added = desired.exceptAll(watched).withColumn("change", F.lit("added"))
    removed = watched.exceptAll(desired).withColumn("change", F.lit("removed"))
    return added.unionByName(removed).where(desired.exists())
