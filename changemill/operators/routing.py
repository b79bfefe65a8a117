"""Routing of feed rows to target tables: custom names first, the default name otherwise."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changemill.functions import names
from changemill.sources.feed import enabled, with_topic_parts


def route(feed: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add ``target_table``.

    A mapping matches the topics of its database id, schema and table under any version of
    the source; topics no mapping matches take ``{schema or database}_{table}``.
    """
    custom = enabled(mapping).select("db_id", "source_schema", "source_table", F.col("target_table").alias("_custom"))
    routed = with_topic_parts(feed).join(custom, ["db_id", "source_schema", "source_table"], "left")
    target = F.coalesce("_custom", names.default_target(F.col("topic"))).alias("target_table")
    return routed.select(*feed.columns, target)


def target_name(tables: DataFrame, mapping: DataFrame, prefix: str = "database") -> DataFrame:
    """Add ``target_table`` to rows of (prefix, source_table): mapped name, else prefix_table."""
    custom = enabled(mapping).select("source_table", F.col("target_table").alias("_custom"))
    default = F.concat_ws("_", F.col(prefix), F.col("source_table"))
    return tables.join(custom, "source_table", "left").select(
        *tables.columns, F.coalesce("_custom", default).alias("target_table")
    )
