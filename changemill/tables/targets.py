"""Target tables of the catalog: create, refresh, truncate, drop, join and leave a pipeline."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changemill.operators.evolve import empty_table
from changemill.sources.feed import with_topic_parts
from changemill.spec import PipelineSpec, TableSpec


def create_target(spark: SparkSession, name: str, schema: T.StructType, source: str | None = None) -> bool:
    """Create an empty target from a source schema; an existing table is left as it is."""
    if source is not None and source == name:
        raise ValueError("the target must differ from the source")
    if not schema.fields:
        raise ValueError("the source has no columns; the table is not created")
    if spark.catalog.tableExists(name):
        return False
    empty_table(spark, schema).write.format("parquet").saveAsTable(name)
    return True


def full_refresh(spark: SparkSession, name: str, rows: DataFrame, drop_before_sync: bool = True) -> bool:
    """Load a table anew. The rows go to a new version, then the view ``name`` moves to it, so
    readers see the old rows or the new ones. Without ``drop_before_sync`` an existing table stays."""
    exists = spark.catalog.tableExists(name)
    if exists and not drop_before_sync:
        return False
    old = sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(f"{name.lower()}_load_"))
    number = int(old[-1].rsplit("_", 1)[1]) + 1 if old else 1
    version = f"{name}_load_{number:06d}"
    rows.write.format("parquet").mode("overwrite").saveAsTable(version)
    if exists and not old:
        spark.sql(f"DROP TABLE {name}")
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {version}")
    for stale in old:
        spark.sql(f"DROP TABLE IF EXISTS {stale}")
    return True


def truncate_targets(spark: SparkSession, names: Sequence[str]) -> tuple[int, int]:
    """Remove all rows, keep the schema: (truncated, failed). A missing table is no failure."""
    done = failed = 0
    for name in names:
        if not spark.catalog.tableExists(name):
            continue
        try:
            spark.sql(f"TRUNCATE TABLE {name}")
            done += 1
        except AnalysisException:
            failed += 1
    return done, failed


def drop_targets(spark: SparkSession, names: Sequence[str], allowed: bool = False) -> int:
    """Drop tables, only when the caller says it may."""
    if not allowed:
        raise PermissionError("dropping target tables needs drop_before_sync or an explicit action")
    dropped = [name for name in names if spark.catalog.tableExists(name)]
    for name in dropped:
        spark.sql(f"DROP TABLE {name}")
    return len(dropped)


def rename_target(spark: SparkSession, old: str, new: str | None) -> str:
    """Rename a target: applied, old_missing, new_exists or failed (no new name, nothing run)."""
    if not new:
        return "failed"
    if not spark.catalog.tableExists(old):
        return "old_missing"
    if spark.catalog.tableExists(new):
        return "new_exists"
    spark.sql(f"ALTER TABLE {old} RENAME TO {new}")
    return "applied"


def remove_tables(
    spark: SparkSession,
    spec: PipelineSpec,
    tables: Sequence[str],
    offsets: DataFrame,
    action: str = "keep",
    allow_empty: bool = False,
) -> tuple[PipelineSpec, DataFrame]:
    """Take tables out of a pipeline: mapping disabled, targets kept, truncated or dropped, and
    their feed positions forgotten, so that adding them again starts afresh."""
    changed = spec.without_tables(set(tables), allow_empty)
    going = spec.named(set(tables))
    targets = [t.target for t in going]
    if action == "truncate":
        truncate_targets(spark, targets)
    elif action == "drop":
        drop_targets(spark, targets, allowed=True)
    parts = with_topic_parts(offsets)
    gone = F.lit(False)
    for t in going:
        gone = gone | ((F.col("source_schema") == t.source_schema) & (F.col("source_table") == t.source_table))
    return changed, parts.where(~gone).select(*offsets.columns)


def add_tables(spec: PipelineSpec, tables: Sequence[TableSpec]) -> tuple[PipelineSpec, list[str]]:
    """Add or re-enable tables; returns the tables that now need an incremental snapshot."""
    for table in tables:
        spec = spec.with_table(table)
    return spec, [f"{t.source_schema}.{t.source_table}" for t in tables]
