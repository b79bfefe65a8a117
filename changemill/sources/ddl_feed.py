"""DDL sources: schema-history messages and the DDL capture table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changemill.functions import names

COLUMN = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("typeName", T.StringType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("scale", T.IntegerType()),
        T.StructField("optional", T.BooleanType()),
        T.StructField("autoIncremented", T.BooleanType()),
        T.StructField("defaultValue", T.StringType()),
        T.StructField("enumValues", T.ArrayType(T.StringType())),
    ]
)
TABLE_CHANGE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField(
            "table",
            T.StructType(
                [
                    T.StructField("columns", T.ArrayType(COLUMN)),
                    T.StructField("primaryKeyColumnNames", T.ArrayType(T.StringType())),
                ]
            ),
        ),
    ]
)
HISTORY = T.StructType(
    [
        T.StructField("databaseName", T.StringType()),
        T.StructField("ddl", T.StringType()),
        T.StructField("tableChanges", T.ArrayType(TABLE_CHANGE)),
        T.StructField("_corrupt", T.StringType()),
    ]
)
CAPTURE_ROW = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_time", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("object_type", T.StringType()),
        T.StructField("schema_name", T.StringType()),
        T.StructField("object_name", T.StringType()),
        T.StructField("ddl_command", T.StringType()),
        T.StructField("processed", T.BooleanType()),
    ]
)


def read_history(feed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Schema-history messages: (usable DDL events, messages that are not JSON).

    Null values, messages with neither text nor table changes, and system databases are
    skipped; text that does not parse goes to the dead letters, never past them.
    """
    parsed = feed.where(F.col("value").isNotNull()).withColumn(
        "_h", F.from_json("value", HISTORY, {"columnNameOfCorruptRecord": "_corrupt"})
    )
    broken = F.col("_h._corrupt").isNotNull()
    changes = F.coalesce(F.col("_h.tableChanges"), F.array().cast(T.ArrayType(TABLE_CHANGE)))
    ddl = F.nullif(F.trim(F.col("_h.ddl")), F.lit(""))
    events = (
        parsed.where(~broken)
        .where(ddl.isNotNull() | (F.size(changes) > 0))
        .where(~names.is_system_schema(F.col("_h.databaseName")))
        .select("topic", "part", "off", F.col("_h.databaseName").alias("db"), ddl.alias("ddl"), changes.alias("table_changes"))
    )
    dead = parsed.where(broken).select("topic", "part", "off", "value", F.lit("malformed_json").alias("error"))
    return events, dead


def read_capture(feed: DataFrame) -> DataFrame:
    """DDL capture rows: the row after the change, once per event, without processed events
    and system schemas. Deletes have no row after the change and drop out."""
    envelope = T.StructType([T.StructField("after", CAPTURE_ROW)])
    rows = feed.select("off", F.from_json("value", envelope).alias("_v")).select("off", "_v.after.*")
    usable = rows.where(F.col("event_id").isNotNull()).where(~F.coalesce("processed", F.lit(False)))
    usable = usable.withColumn("schema_name", F.coalesce("schema_name", F.lit("public")))
    usable = usable.where(~names.is_system_schema(F.col("schema_name")))
    first = usable.groupBy("event_id").agg(F.min_by(F.struct(*[c for c in usable.columns if c != "event_id"]), "off").alias("_r"))
    table = names.bare_name(F.col("object_name"), F.col("object_type"))
    return first.select("event_id", "_r.*").withColumn("tbl", table)


# Table that a statement names, without quotes and qualifiers.
STATEMENT_TABLE = r"(?i)^\s*(?:ALTER|TRUNCATE)\s+TABLE\s+(?:IF\s+EXISTS\s+)?(?:ONLY\s+)?((?:[`\"]?\w+[`\"]?\.)*[`\"]?\w+[`\"]?)"


def history_statements(events: DataFrame, prefix: str, system: str = "mysql") -> DataFrame:
    """Schema-history text as statements of the topic that carries the table's rows."""
    named = names.bare_name(F.regexp_extract("ddl", STATEMENT_TABLE, 1))
    changed = names.bare_name(F.try_element_at(F.filter("table_changes", lambda c: F.upper(c["type"]) == "ALTER"), F.lit(1))["id"])
    topic = F.concat_ws(".", F.lit(prefix), F.col("db"), F.coalesce(changed, named))
    return events.where(F.col("ddl").isNotNull()).select(
        F.col("off").alias("ddl_id"), "off", F.lit(system).alias("system"), topic.alias("tbl"), "ddl"
    )


def capture_statements(rows: DataFrame, prefix: str, database: str) -> DataFrame:
    """Captured DDL commands as statements of the topic that carries the table's rows."""
    topic = F.concat_ws(".", F.lit(prefix), F.lit(database), F.col("tbl"))
    return rows.where(F.col("ddl_command").isNotNull()).select(
        F.col("event_id").alias("ddl_id"), "off", F.lit("postgresql").alias("system"), topic.alias("tbl"), F.col("ddl_command").alias("ddl")
    )


def column_catalog(events: DataFrame, kinds: tuple[str, ...] = ("ALTER",)) -> DataFrame:
    """Columns of the tables in ``table_changes``, with their position in the table."""
    change = events.select("off", F.explode("table_changes").alias("_c")).where(F.upper("_c.type").isin(*kinds))
    named = change.select(
        "off", names.bare_name(F.col("_c.id")).alias("tbl"), F.upper("_c.type").alias("kind"),
        F.col("_c.table.primaryKeyColumnNames").alias("_pk"),
        F.posexplode("_c.table.columns").alias("pos", "_col"),
    )
    return named.select(
        "off", "tbl", "kind", "pos", F.col("_col.name").alias("name"), F.upper("_col.typeName").alias("type_name"),
        F.col("_col.length").alias("length"), F.col("_col.scale").alias("scale"),
        F.coalesce("_col.optional", F.lit(True)).alias("optional"),
        F.coalesce("_col.autoIncremented", F.lit(False)).alias("auto_incremented"),
        F.col("_col.defaultValue").alias("default_value"),
        F.coalesce(F.array_contains("_pk", F.col("_col.name")), F.lit(False)).alias("is_key"),
    )
