"""Profile of many tables at once: columns, keys, exact rows and bytes on disk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changemill.functions.envelope import field_catalog
from changemill.functions.names import SYSTEM_SCHEMAS
from changemill.operators.reconcile import row_counts

# A pipeline's own tables, never offered for capture.
INTERNAL_TABLES = ("debezium_signal", "ddl_events")


def is_user_table(name: str) -> bool:
    """False for tables of system schemas and for a pipeline's own tables."""
    parts = name.lower().split(".")
    return parts[-1] not in INTERNAL_TABLES and not (set(parts[:-1]) & set(SYSTEM_SCHEMAS))


def column_catalog(spark: SparkSession, tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One row per column of every table; schemas are metadata, no rows are read."""
    return field_catalog(spark, {n: df.schema for n, df in tables.items()}, dict(keys or {}))


def table_profile(
    spark: SparkSession, tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Columns, key columns and exact row count of every user table, sorted by name."""
    wanted = {n: df for n, df in tables.items() if is_user_table(n)}
    shape = column_catalog(spark, wanted, keys).groupBy("tbl").agg(
        F.count("*").cast("int").alias("columns"), F.count_if("is_key").cast("int").alias("key_columns")
    )
    return shape.join(row_counts(wanted), "tbl").orderBy("tbl")


def table_bytes(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Size of the files behind file-based tables, each file counted once."""
    sizes = [
        df.select(F.lit(name).alias("tbl"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
        .distinct()
        .groupBy("tbl")
        .agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
        for name, df in tables.items()
    ]
    total = sizes[0]
    for part in sizes[1:]:
        total = total.unionByName(part)
    return total
