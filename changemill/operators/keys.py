"""Keys, indexes and foreign keys: where they point, whether they hold, whether they exist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changemill.functions.names import IDENTIFIER_LIMIT
from changemill.session import join_spread


def foreign_key_targets(fks: DataFrame, mapping: DataFrame) -> DataFrame:
    """Target table each foreign key refers to.

    ``fks``: fk_id, system, db, referred_table, referred_schema. ``mapping``: source_table,
    target_table, both of one source. Lookups in order: the name itself; for Oracle its upper
    case, SCHEMA.TABLE in upper case, then any mapped name whose last part matches; elsewhere
    schema.table; else ``{db}_{table}``. Each lookup is an equi join and the lowest one wins.
    """
    named = mapping.select(F.col("source_table").alias("lookup"), F.col("target_table").alias("_found"))
    suffix = named.select(
        F.upper(F.element_at(F.split("lookup", r"\."), -1)).alias("lookup"), "_found"
    ).groupBy("lookup").agg(F.min("_found").alias("_found"))
    is_oracle = F.col("system") == "oracle"
    table, schema = F.col("referred_table"), F.col("referred_schema")
    candidates = F.array(
        F.struct(F.lit(1).alias("step"), table.alias("lookup")),
        F.struct(F.lit(2).alias("step"), F.when(is_oracle, F.upper(table)).alias("lookup")),
        F.struct(
            F.lit(3).alias("step"),
            F.when(schema.isNotNull(), F.when(is_oracle, F.concat_ws(".", F.upper(schema), F.upper(table))).otherwise(F.concat_ws(".", schema, table))).alias("lookup"),
        ),
    )
    tried = fks.select("fk_id", F.explode(candidates).alias("_c")).select("fk_id", "_c.step", "_c.lookup").where("lookup IS NOT NULL")
    exact = tried.join(named, "lookup").select("fk_id", "step", "_found")
    by_suffix = (
        fks.where(is_oracle).select("fk_id", F.upper(table).alias("lookup")).join(suffix, "lookup").select("fk_id", F.lit(4).alias("step"), "_found")
    )
    best = exact.unionByName(by_suffix).groupBy("fk_id").agg(F.min_by("_found", "step").alias("_found"))
    fallback = F.concat_ws("_", F.col("db"), F.col("referred_table"))
    return fks.join(best, "fk_id", "left").select(*fks.columns, F.coalesce("_found", fallback).alias("target_table"))


def foreign_key_name(table, column):
    return F.left(F.concat_ws("_", F.lit("fk"), table, column), F.lit(IDENTIFIER_LIMIT["constraint"]))


def index_name(table, column):
    return F.left(F.concat_ws("_", F.lit("idx"), table, column), F.lit(IDENTIFIER_LIMIT["constraint"]))


def copyable_indexes(indexes: DataFrame) -> DataFrame:
    """Indexes worth copying: with columns, not the primary key under any name.

    ``indexes``: tbl, name, columns (array), pk (array), is_unique.
    """
    is_pk = (F.size("pk") > 0) & (F.array_sort(F.array_distinct("columns")) == F.array_sort(F.array_distinct("pk")))
    return indexes.where((F.size("columns") > 0) & (F.col("name") != "PRIMARY") & ~is_pk)


def constraint_preview(wanted: DataFrame, existing: DataFrame, tables: DataFrame) -> DataFrame:
    """Status of each wanted constraint: table_not_ready, already_exists, cannot_create, will_create.

    ``wanted``: tbl, constraint_name, referred_tbl (null for indexes); ``existing``: tbl,
    constraint_name; ``tables``: tbl of the tables that exist.
    """
    ready = tables.select("tbl").distinct()
    rows = wanted.join(ready.withColumn("_ready", F.lit(True)), "tbl", "left")
    rows = rows.join(existing.select("tbl", "constraint_name").distinct().withColumn("_exists", F.lit(True)), ["tbl", "constraint_name"], "left")
    rows = rows.join(ready.select(F.col("tbl").alias("referred_tbl"), F.lit(True).alias("_parent")), "referred_tbl", "left")
    status = (
        F.when(F.col("_ready").isNull(), "table_not_ready")
        .when(F.col("_exists").isNotNull(), "already_exists")
        .when(F.col("referred_tbl").isNotNull() & F.col("_parent").isNull(), "cannot_create")
        .otherwise("will_create")
    )
    return rows.select(*wanted.columns, status.alias("status"))


def preview_summary(previewed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of each status, per group or overall, in one aggregate."""
    counts = [
        F.count_if(F.col("status") == s).alias(s) for s in ("will_create", "already_exists", "cannot_create", "table_not_ready")
    ]
    return previewed.groupBy(*by).agg(*counts) if by else previewed.agg(*counts)


def duplicate_keys(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with how often; rows with a blank key are exempt.

    Counts combine before the shuffle, so a value held by a third of the rows is one row per task.
    """
    present = table
    for key in keys:
        present = present.where(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))
    return present.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def value_taken(table: DataFrame, column: str, value: object, self_column: str, self_value: object) -> DataFrame:
    """Rows other than the one being edited that hold a value that ought to be unique."""
    return table.where((F.col(column) == F.lit(value)) & (F.col(self_column) != F.lit(self_value)))


def orphans(child: DataFrame, parent: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Child rows whose reference has no parent row; rows with a null reference are exempt.

    ``columns`` maps child columns to parent columns. Child keys are checked once each: the
    distinct references are anti-joined, and only the missing ones go back to the rows, so a
    reference shared by a third of the rows crosses the parent join as one row; the join back
    spreads the rows of a key.
    """
    keys = list(columns)
    present = child
    for key in keys:
        present = present.where(F.col(key).isNotNull())
    refs = parent.select(*[F.col(p).alias(c) for c, p in columns.items()])
    missing = present.select(*keys).distinct().join(refs, keys, "left_anti")
    return join_spread(present, missing, keys, "left_semi")


def orphan_counts(child: DataFrame, parent: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Missing references with the number of child rows that hold them: one pre-aggregated join."""
    keys = list(columns)
    present = child
    for key in keys:
        present = present.where(F.col(key).isNotNull())
    refs = parent.select(*[F.col(p).alias(c) for c, p in columns.items()])
    counted = present.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.join(refs, keys, "left_anti")
