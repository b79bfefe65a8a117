"""Differences between two column catalogs of (tbl, name, pos, type_name, length, scale).

Catalogs hold one row per column of every table, so all tables are compared in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changemill.functions.types import similar_group, types_differ

RESULT = "tbl stage pos operation column_name new_name type_name is_destructive".split()


def _operation(stage: int, operation: str, column: str, new: str | None, type_name: str | None, destructive: bool = False) -> Column:
    """One operation as a struct of the result columns behind the table."""
    text = lambda name: F.col(name) if name else F.lit(None).cast("string")
    return F.struct(
        F.lit(stage).alias("stage"), F.col("pos"), F.lit(operation).alias("operation"), F.col(column).alias("column_name"),
        text(new).alias("new_name"), text(type_name).alias("type_name"), F.lit(destructive).alias("is_destructive"),
    )


def rename_aware_diff(source: DataFrame, target: DataFrame, renames: DataFrame) -> DataFrame:
    """Operations that bring each target table to its source columns without losing renames.

    In this order: renames the DDL text names (``renames``: tbl, old_name, new_name), columns
    of the same name, columns at the same position with a similar type whose old name is gone
    (renames), then added and dropped columns. Types of same-named columns are not compared.
    """
    old = target.select("tbl", F.col("name").alias("old_name"))
    explicit = renames.join(old, ["tbl", "old_name"], "left_semi").join(
        source.select("tbl", F.col("name").alias("new_name"), "pos", "type_name"), ["tbl", "new_name"]
    )

    # Each side once, marked with what its name already matches.
    source_marked = (
        source.join(target.select("tbl", "name", F.lit(True).alias("_same")), ["tbl", "name"], "left")
        .join(explicit.select("tbl", F.col("new_name").alias("name"), F.lit(True).alias("_renamed")), ["tbl", "name"], "left")
    )
    target_marked = (
        target.join(source.select("tbl", "name", F.lit(True).alias("_same")), ["tbl", "name"], "left")
        .join(explicit.select("tbl", F.col("old_name").alias("name"), F.lit(True).alias("_renamed")), ["tbl", "name"], "left")
    )
    open_source = source_marked.where("_same IS NULL AND _renamed IS NULL").drop("_same", "_renamed")
    open_target = target_marked.where("_same IS NULL AND _renamed IS NULL").select(
        "tbl", "pos", F.col("name").alias("old_name"), F.col("type_name").alias("old_type")
    )
    paired = open_source.join(open_target, ["tbl", "pos"], "full_outer")
    similar = F.coalesce(similar_group(F.col("type_name")) == similar_group(F.col("old_type")), F.lit(False))
    paired = paired.withColumn("_rename", F.col("name").isNotNull() & F.col("old_name").isNotNull() & similar)

    # A pair of positions gives a rename, or an added and a dropped column, or one of them.
    added, dropped = F.col("name").isNotNull() & ~F.col("_rename"), F.col("old_name").isNotNull() & ~F.col("_rename")
    operations = F.array(
        F.when(F.col("_rename"), _operation(3, "RENAME_COLUMN", "old_name", "name", "type_name")),
        F.when(added, _operation(4, "ADD_COLUMN", "name", None, "type_name")),
        F.when(dropped, _operation(5, "DROP_COLUMN", "old_name", None, None, True)),
    )
    by_position = paired.select("tbl", F.inline(F.array_compact(operations)))
    by_text = explicit.select("tbl", F.inline(F.array(_operation(1, "RENAME_COLUMN", "old_name", "new_name", "type_name"))))
    return by_text.unionByName(by_position).select(*RESULT)


def typed_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """Added, dropped and modified columns by name; a table the target lacks is created.

    Tables only the target has are left alone. One full outer join on (table, name).
    """
    src = source.select("tbl", "name", "pos", F.col("type_name").alias("_st"), F.col("length").alias("_sl"), F.lit(True).alias("_s"))
    tgt = target.select("tbl", "name", F.col("pos").alias("_tpos"), F.col("type_name").alias("_tt"), F.col("length").alias("_tl"), F.lit(True).alias("_t"))
    both = src.join(tgt, ["tbl", "name"], "full_outer")
    has_source = source.select("tbl").distinct().withColumn("_src_tbl", F.lit(True))
    has_target = target.select("tbl").distinct().withColumn("_tgt_tbl", F.lit(True))
    both = both.join(has_source, "tbl", "left").join(has_target, "tbl", "left")
    operation = (
        F.when(F.col("_src_tbl").isNull(), F.lit(None))
        .when(F.col("_tgt_tbl").isNull(), "CREATE_TABLE")
        .when(F.col("_t").isNull(), "ADD_COLUMN")
        .when(F.col("_s").isNull(), "DROP_COLUMN")
        .when(types_differ(F.col("_st"), F.col("_sl"), F.col("_tt"), F.col("_tl")), "MODIFY_COLUMN")
    )
    rows = both.withColumn("operation", operation).where(F.col("operation").isNotNull())
    return rows.select(
        "tbl", "operation", F.col("name").alias("column_name"), F.coalesce("pos", "_tpos").alias("pos"),
        F.col("_st").alias("type_name"),
        F.when(F.col("operation") == "MODIFY_COLUMN", F.col("_tt")).alias("old_type"),
        (F.col("operation") == "DROP_COLUMN").alias("is_destructive"),
    )


def positions(columns: DataFrame, array: str) -> DataFrame:
    """Ordinal of each column of a table whose columns are an array."""
    return columns.select(*[c for c in columns.columns if c != array], F.posexplode(array).alias("pos", "name"))
