"""Rows that cannot be applied: refuse the batch, or keep them with where they came from and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "topic string, part int, off bigint, stage string, error_class string, message string, payload string, batch_id bigint"
)


class BadRows(RuntimeError):
    """Raised under tolerance ``none``: the batch stops and is replayed after a restart."""


def as_dead_letters(rows: DataFrame, stage: str, error: Column, message: Column | None = None, batch_id: int = 0) -> DataFrame:
    """Rejected rows in the dead-letter form, the whole row kept as JSON."""
    text = F.to_json(F.struct(*rows.columns))
    return rows.select(
        "topic", "part", "off", F.lit(stage).alias("stage"), error.alias("error_class"),
        (message if message is not None else error).alias("message"), text.alias("payload"),
        F.lit(batch_id).cast("bigint").alias("batch_id"),
    )


def topic_name(client_id: int, db_id: int | None = None) -> str:
    return f"client_{client_id}.dlq" if db_id is None else f"client_{client_id}_db_{db_id}.dlq"


def settle_rejects(rejects: DataFrame, tolerance: str, path: str) -> None:
    """Tolerance ``none``: any reject fails the batch. ``all``: rejects are kept, one partition
    per batch, so a replay overwrites its own."""
    if tolerance == "none":
        first = rejects.select("stage", "error_class", "message").take(1)
        if first:
            raise BadRows(f"{first[0].stage}: {first[0].error_class}: {first[0].message}")
        return
    (
        rejects.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id").parquet(path)
    )


def read_dead_letters(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)
