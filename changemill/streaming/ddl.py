"""DDL in the stream: captured statements become operations that rows are evolved by.

State rows keep the offset and the columns they were written with; operations are kept with
their own offset. Whoever reads a target evolves each live row by exactly the operations of its
table that came after it, so DDL and data need not arrive in the same micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changemill.operators import ddl

OPERATIONS = (
    "tbl string, off bigint, clause_no int, operation string, column_name string, new_name string, "
    "type_name string, default_value string, status string, ddl string, batch_id bigint"
)
DETAILS = ["tbl", "off", "clause_no", "operation", "column_name", "new_name", "type_name", "default_value"]


def statements_to_operations(statements: DataFrame, existing: DataFrame, allow_destructive: bool = False) -> DataFrame:
    """Statements (ddl_id, off, system, tbl, ddl) to recorded operations.

    Status ``apply`` for what evolves rows, ``pending_approval`` and ``blocked`` for what waits
    behind the destructive gate, ``dead_letter`` for statements that cannot be split safely
    (kept whole, never half-applied) and for clauses that nothing here understands. Renames of
    tables are operations on the old name; index statements are ``recorded``, and statements of
    systems that send metadata wait as ``diff_metadata``. No relevant statement leaves without a row.
    """
    routed = ddl.dispatch(statements)
    gated = ddl.gate(ddl.classify_clauses(ddl.alter_clauses(routed.where("route = 'parse_alter'"))), existing, allow_destructive)
    through = gated.where("status IN ('apply', 'pending_approval', 'blocked')")
    status = through.select("tbl", "off", "clause_no", "status", "ddl")
    typed = ddl.evolution_operations(through.drop("status")).join(status, ["tbl", "off", "clause_no"])
    no_text = F.lit(None).cast("string")

    def rows(found: DataFrame, status: str | Column, clause_no: Column, operation: Column, tbl: Column, new: Column = no_text, text: str = "ddl") -> DataFrame:
        state = F.lit(status) if isinstance(status, str) else status
        return found.select(
            tbl.alias("tbl"), "off", clause_no.cast("int").alias("clause_no"), operation.alias("operation"), no_text.alias("column_name"),
            new.alias("new_name"), no_text.alias("type_name"), no_text.alias("default_value"), state.alias("status"), F.col(text).alias("ddl"),
        )

    whole, unknown = F.lit(0), F.lit("UNKNOWN")
    off_of = statements.select("ddl_id", "off", "ddl")
    renames = ddl.table_renames(routed.where("route IN ('rename_table', 'parse_alter')"), existing).join(off_of, "ddl_id")
    indexes = ddl.index_statements(routed.where("route = 'parse_index'")).join(off_of, "ddl_id")
    others = [
        rows(routed.where("route = 'dead_letter'"), "dead_letter", whole, unknown, F.col("tbl")),
        rows(gated.where("operation = 'UNKNOWN' AND status <> 'skipped'"), "dead_letter", F.col("clause_no"), unknown, F.col("tbl"), text="clause"),
        rows(renames, F.col("status"), F.col("clause_no"), F.lit("RENAME_TABLE"), F.col("old_table"), F.col("new_table")),
        rows(indexes, "recorded", F.col("clause_no"), F.col("operation"), F.col("tbl"), F.col("index_name")),
        rows(routed.where("route = 'diff_metadata'"), "diff_metadata", whole, unknown, F.col("tbl")),
    ]
    return reduce(DataFrame.unionByName, [typed.select(*DETAILS, "status", "ddl"), *others])


def record_into(path: str, existing: Callable[[], DataFrame], allow_destructive: bool = False) -> Callable[[DataFrame, int], None]:
    """Batch function that keeps the operations of each batch in a partition of its own; a
    replay overwrites it."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        rows = statements_to_operations(batch, existing(), allow_destructive).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)

    return on_batch


def read_operations(spark: SparkSession, path: str, statuses: Sequence[str] = ("apply",)) -> DataFrame:
    """Recorded operations of some statuses; after an approval, pass the waiting ones too."""
    return spark.read.schema(OPERATIONS).parquet(path).where(F.col("status").isin(*statuses))
