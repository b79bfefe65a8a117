"""Proof that a source and its copy agree: counts, sync status, row differences, tables left out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changemill.functions.names import younger_than


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Exact rows of every table in one job; tables without rows count zero.

    Each branch counts before the union, so nothing but one row per task is shuffled, and a
    plain parquet table is counted from its metadata columns only.
    """
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("tbl"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counted)


def non_empty_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Tables with at least one row; one row is read of each."""
    first = [df.limit(1).select(F.lit(name).alias("tbl")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, first)


def unassigned_tables(
    listing: DataFrame, mapping: DataFrame, emptiness: DataFrame | None = None
) -> DataFrame:
    """Listed tables (``tbl``, bare or schema.table) that no enabled mapping holds, sorted.

    An assignment counts under both of its names. With ``emptiness`` (tbl, is_empty),
    tables known to be empty are left out; unknown (null) counts as non-empty.
    """
    assigned = mapping.where("is_enabled").select(
        F.explode(F.array("source_table", F.concat_ws(".", "source_schema", "source_table"))).alias("tbl")
    )
    free = listing.join(assigned, "tbl", "left_anti")
    if emptiness is not None:
        empty = emptiness.where("is_empty").select("tbl")
        free = free.join(empty, "tbl", "left_anti")
    return free.orderBy("tbl")


def compare_counts(mapping: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Counts of both sides per enabled mapping, with a reason where a count is missing.

    ``source`` and ``target``: tbl, n, error (null when counted). A table that was not counted
    at all is ``table_not_found``; an unreachable side carries its own error in every row.
    """
    src = source.select(F.col("tbl").alias("source_table"), F.col("n").alias("source_rows"), F.col("error").alias("_se"), F.lit(True).alias("_s"))
    tgt = target.select(F.col("tbl").alias("target_table"), F.col("n").alias("target_rows"), F.col("error").alias("_te"), F.lit(True).alias("_t"))
    rows = mapping.where("is_enabled").join(src, "source_table", "left").join(tgt, "target_table", "left")

    def reason(seen: str, error: str):
        return F.when(F.col(seen).isNull(), "table_not_found").otherwise(F.col(error))

    return rows.select(
        "pipeline", "source_table", "target_table", "source_rows", "target_rows",
        reason("_s", "_se").alias("source_error"), reason("_t", "_te").alias("target_error"),
        F.coalesce(F.col("source_rows") == F.col("target_rows"), F.lit(False)).alias("in_sync"),
    )


# Errors that make a whole side unusable.
SIDE_ERRORS = ("db_unreachable", "no_target_db")


def sync_status(pipelines: DataFrame, compared: DataFrame) -> DataFrame:
    """Status per pipeline: rows_in_sync, not_synced, unable_to_check or snapshot_in_progress.

    ``pipelines``: pipeline, created_at, checked_at, snapshot_running, last_success_at. A table
    that could not be counted is not in sync; a side that cannot be reached, or no table at
    all, means unable to check; a running snapshot of a pipeline younger than 24 hours is
    reported instead of a comparison that cannot hold yet.
    """
    side_down = F.col("source_error").isin(*SIDE_ERRORS) | F.col("target_error").isin(*SIDE_ERRORS)
    totals = compared.groupBy("pipeline").agg(
        F.count("*").alias("total_count"),
        F.count_if("in_sync").alias("in_sync_count"),
        F.bool_or(F.coalesce(side_down, F.lit(False))).alias("_down"),
    )
    young = younger_than(F.col("created_at"), F.col("checked_at"))
    total, same = F.coalesce("total_count", F.lit(0)), F.coalesce("in_sync_count", F.lit(0))
    status = (
        F.when(young & F.col("snapshot_running"), "snapshot_in_progress")
        .when((total == 0) | F.col("_down"), "unable_to_check")
        .when(total == same, "rows_in_sync")
        .otherwise("not_synced")
    )
    rows = pipelines.join(totals, "pipeline", "left").withColumn("status", status)
    synced_at = F.when(F.col("status") == "rows_in_sync", F.col("checked_at")).otherwise(F.col("last_success_at"))
    return rows.select(
        "pipeline", "status", total.alias("total_count"), same.alias("in_sync_count"),
        (total - same).alias("not_synced_count"), synced_at.alias("last_fully_synced"),
    )


def _digest(columns: Sequence[str]):
    """128 bits over the columns, nulls told apart from every value."""
    marked = [F.struct(F.col(c).isNull(), F.col(c)) for c in columns]
    return F.struct(F.xxhash64(*marked), F.xxhash64(F.lit("second"), *marked))


def row_diff(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Each key's class: missing (in the target), extra, different or same, with the columns
    that differ.

    One full outer join on the key, shuffled by key, columns compared null-safely. Keys are
    unique on both sides, so no key can gather rows.
    """
    compared = list(columns or [c for c in source.columns if c not in keys])
    left = source.select(*keys, F.struct(*compared).alias("_s"))
    right = target.select(*keys, F.struct(*compared).alias("_t"))
    differs = [F.when(~F.col(f"_s.`{c}`").eqNullSafe(F.col(f"_t.`{c}`")), F.lit(c)) for c in compared]
    kind = (
        F.when(F.col("_t").isNull(), "missing")
        .when(F.col("_s").isNull(), "extra")
        .when(F.col("_s").eqNullSafe(F.col("_t")), "same")
        .otherwise("different")
    )
    both = F.col("_s").isNotNull() & F.col("_t").isNotNull()
    changed = F.when(both, F.nullif(F.array_join(F.array(*differs), ","), F.lit("")))
    return left.join(right, list(keys), "full_outer").select(*keys, kind.alias("diff"), changed.alias("changed_columns"))


def row_diff_summary(source: DataFrame, target: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows per class, comparing a 128-bit digest per row instead of the columns themselves.

    The digests make the shuffled rows narrow. Use ``row_diff`` where a comparison by digest
    will not do.
    """
    compared = list(columns or [c for c in source.columns if c not in keys])
    left = source.select(*keys, _digest(compared).alias("_s"))
    right = target.select(*keys, _digest(compared).alias("_t"))
    kind = (
        F.when(F.col("_t").isNull(), "missing")
        .when(F.col("_s").isNull(), "extra")
        .when(F.col("_s") == F.col("_t"), "same")
        .otherwise("different")
    )
    return left.join(right, list(keys), "full_outer").groupBy(kind.alias("diff")).agg(F.count("*").alias("n"))
