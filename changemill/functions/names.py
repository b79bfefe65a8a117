"""Topic names, table names and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# System codes, default schemas, identifier limits and topic patterns.
MYSQL, POSTGRESQL, SQLSERVER, ORACLE = "mysql", "postgresql", "mssql", "oracle"
DEFAULT_SCHEMA = {"postgresql": "public", "mssql": "dbo"}
IDENTIFIER_LIMIT = {"slot": 63, "constraint": 64, "pipeline": 80}
SYSTEM_SCHEMAS = (
    "mysql", "information_schema", "performance_schema", "sys",
    "pg_catalog", "pg_toast", "ddl_capture",
)
DATA_TOPICS = r"client_{client}_db_{db}_v_\d+\.[^.]+\.(?:[^.]+\.)?(?!ddl_events$|debezium_signal$)[^.]+"


def topic_pattern(client_id: int, db_id: int | None = None) -> str:
    """Subscription pattern for the data topics of one source, or of all sources of a client."""
    return DATA_TOPICS.format(client=client_id, db=r"\d+" if db_id is None else db_id)


def is_data_topic(topic: Column, client_id: int, db_id: int | None = None) -> Column:
    return topic.rlike(f"^{topic_pattern(client_id, db_id)}$")


def segments(name: Column) -> Column:
    return F.split(name, r"\.")


def topic_table(topic: Column) -> Column:
    """The table is always the last segment."""
    return F.substring_index(topic, ".", -1)


def topic_schema(topic: Column) -> Column:
    """Schema (or database) segment in front of the table."""
    return F.when(topic.contains("."), F.substring_index(F.substring_index(topic, ".", -2), ".", 1))


def topic_prefix(topic: Column) -> Column:
    return F.substring_index(topic, ".", 1)


def topic_db_id(topic: Column) -> Column:
    """Database id in the topic prefix, null for a foreign prefix."""
    return F.regexp_extract(topic_prefix(topic), r"^client_\d+_db_(\d+)_v_\d+$", 1).try_cast("int")


def default_target(topic: Column) -> Column:
    """Default routing: the last two of at least three segments joined by an underscore."""
    last_two = F.substring_index(topic, ".", -2)
    return F.when(last_two != topic, F.replace(last_two, F.lit("."), F.lit("_"))).otherwise(topic)


def reroute_schema(topic: Column, database: Column) -> Column:
    """``prefix.schema.table`` to ``prefix.database.table``."""
    parts = segments(topic)
    return F.when(
        F.size(parts) >= 3,
        F.concat_ws(".", parts[0], database, F.array_join(F.slice(parts, 3, F.size(parts) - 2), ".")),
    ).otherwise(topic)


def build_topic(
    system: Column, prefix: Column, database: Column, schema: Column, table: Column, user: Column
) -> Column:
    """Topic of a table in each source system."""
    sql_server_schema = F.coalesce(schema, F.lit(DEFAULT_SCHEMA[SQLSERVER]))
    oracle_schema = F.coalesce(schema, F.upper(user))
    return (
        F.when(system == SQLSERVER, F.concat_ws(".", prefix, database, sql_server_schema, table))
        .when(system == ORACLE, F.concat_ws(".", prefix, oracle_schema, table))
        .otherwise(F.concat_ws(".", prefix, database, table))
    )


def include_list_name(
    system: Column, database: Column, schema: Column, table: Column, user: Column
) -> Column:
    """Two-part name under which a source lists a captured table.

    A schema written in the table name wins over the schema column.
    """
    own_schema = F.when(table.contains("."), F.regexp_replace(table, r"\.[^.]*$", ""))
    bare = topic_table(table)
    fallback = (
        F.when(system == SQLSERVER, F.coalesce(schema, F.lit(DEFAULT_SCHEMA[SQLSERVER])))
        .when(system == POSTGRESQL, F.coalesce(schema, F.lit(DEFAULT_SCHEMA[POSTGRESQL])))
        .otherwise(F.coalesce(schema, F.upper(user)))
    )
    return (
        F.when(system == MYSQL, F.concat_ws(".", database, bare))
        .when(
            system.isin(SQLSERVER, POSTGRESQL, ORACLE),
            F.concat_ws(".", F.coalesce(own_schema, fallback), bare),
        )
        .otherwise(F.concat_ws(".", database, table))
    )


def snapshot_name(system: Column, database: Column, schema: Column, table: Column) -> Column:
    """Name under which a snapshot request lists a table: two parts, or three parts with the
    database in front for SQL Server and Oracle; Oracle in upper case."""
    dots = F.size(segments(table))
    three_part = lambda default: (
        F.when(dots == 3, table)
        .when(dots == 2, F.concat_ws(".", database, table))
        .otherwise(F.concat_ws(".", database, F.coalesce(schema, default), table))
    )
    return (
        F.when(system == MYSQL, F.when(dots > 1, table).otherwise(F.concat_ws(".", database, table)))
        .when(
            system == POSTGRESQL,
            F.when(dots > 1, table).otherwise(
                F.concat_ws(".", F.coalesce(schema, F.lit(DEFAULT_SCHEMA[POSTGRESQL])), table)
            ),
        )
        .when(system == SQLSERVER, three_part(F.lit(DEFAULT_SCHEMA[SQLSERVER])))
        .when(system == ORACLE, F.upper(three_part(F.upper(database))))
        .otherwise(F.concat_ws(".", database, table))
    )


def bare_name(identifier: Column, object_type: Column | None = None) -> Column:
    """Table part of a quoted, qualified identifier.

    For column and constraint events the identity ends in the column, so the table is the
    part before it.
    """
    parts = segments(F.regexp_replace(identifier, "[\"'`]", ""))
    last = F.element_at(parts, -1)
    if object_type is None:
        return last
    inner = object_type.isin("table column", "table constraint") & (F.size(parts) >= 2)
    return F.when(inner, F.element_at(parts, F.when(inner, F.lit(-2)).otherwise(F.lit(-1)))).otherwise(last)


def slug(name: Column, limit: int | None = None) -> Column:
    """Lower case, separators to underscores, everything else non-alphanumeric removed."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(name), "[ -]", "_"), "[^a-z0-9_]", "")
    return clean if limit is None else F.left(clean, F.lit(limit))


def is_system_schema(schema: Column) -> Column:
    return F.lower(F.coalesce(schema, F.lit(""))).isin(*SYSTEM_SCHEMAS)


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def younger_than(start: Column, now: Column, hours: int = 24) -> Column:
    return seconds_between(start, now) < F.lit(hours * 3600)
