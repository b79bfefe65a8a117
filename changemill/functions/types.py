"""Column types across source systems: canonical types, translations, similarity, conformance.

A catalog of columns is a DataFrame with ``system, type_name, length, scale``; the fixed
tables below become small lookup DataFrames of known size and are joined to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changemill.functions.decode import timestamp_from_text
from changemill.session import lookup

# ---- Fixed values -------------------------------------------------------------------------
# Canonical type of each source type name, per source system.
CANONICAL_NAMES = {
    "mysql": {
        "tinyint": "SmallInteger", "smallint": "SmallInteger",
        "mediumint": "Integer", "int": "Integer", "integer": "Integer", "year": "Integer", "bit": "Integer",
        "bigint": "BigInteger",
        "float": "Float", "double": "Float", "real": "Float",
        "decimal": "Numeric", "numeric": "Numeric", "dec": "Numeric",
        "varchar": "String", "char": "String", "enum": "String",
        "tinytext": "Text", "text": "Text", "mediumtext": "Text", "longtext": "Text", "set": "Text",
        "binary": "LargeBinary", "varbinary": "LargeBinary", "tinyblob": "LargeBinary", "blob": "LargeBinary",
        "mediumblob": "LargeBinary", "longblob": "LargeBinary",
        "date": "Date",
        "datetime": "DateTime", "timestamp": "DateTime",
        "time": "Time",
        "json": "JSON",
        "bool": "Boolean", "boolean": "Boolean",
    },
    "mssql": {
        "smallint": "SmallInteger", "tinyint": "SmallInteger",
        "int": "Integer",
        "bigint": "BigInteger",
        "bit": "Boolean",
        "decimal": "Numeric", "numeric": "Numeric", "money": "Numeric", "smallmoney": "Numeric",
        "float": "Float", "real": "Float",
        "datetime": "DateTime", "datetime2": "DateTime", "smalldatetime": "DateTime",
        "datetimeoffset": "DateTime",
        "date": "Date",
        "time": "Time",
        "char": "String", "varchar": "String", "nchar": "String", "nvarchar": "String",
        "uniqueidentifier": "String",
        "text": "Text", "ntext": "Text", "xml": "Text", "sql_variant": "Text",
        "binary": "LargeBinary", "varbinary": "LargeBinary", "image": "LargeBinary",
    },
    "postgresql": {
        "smallint": "SmallInteger", "int2": "SmallInteger", "smallserial": "SmallInteger",
        "integer": "Integer", "int": "Integer", "int4": "Integer", "serial": "Integer", "bit": "Integer",
        "oid": "Integer",
        "bigint": "BigInteger", "int8": "BigInteger", "bigserial": "BigInteger",
        "numeric": "Numeric", "decimal": "Numeric", "money": "Numeric",
        "real": "Float", "float4": "Float", "double precision": "Float", "float8": "Float",
        "boolean": "Boolean", "bool": "Boolean",
        "character varying": "String", "varchar": "String", "character": "String", "char": "String",
        "name": "String", "interval": "String", "uuid": "String", "inet": "String", "cidr": "String",
        "macaddr": "String", "point": "String", "line": "String", "lseg": "String", "box": "String",
        "path": "String", "polygon": "String", "circle": "String", "bit varying": "String",
        "text": "Text", "tsvector": "Text", "tsquery": "Text", "xml": "Text",
        "bytea": "LargeBinary",
        "timestamp": "DateTime", "timestamp without time zone": "DateTime",
        "timestamp with time zone": "DateTime", "timestamptz": "DateTime",
        "date": "Date",
        "time": "Time", "time without time zone": "Time", "time with time zone": "Time", "timetz": "Time",
        "json": "JSON", "jsonb": "JSON",
    },
}

# Target type name of each source type name, per (source, target). What is not listed takes the
# default of the pair; None keeps the source name in upper case.
TRANSLATIONS = {
    ("mysql", "postgresql"): {
        "tinyint": "SMALLINT", "year": "SMALLINT",
        "mediumint": "INTEGER", "int": "INTEGER", "integer": "INTEGER",
        "bigint": "BIGINT",
        "float": "REAL",
        "double": "DOUBLE PRECISION",
        "decimal": "NUMERIC", "numeric": "NUMERIC",
        "datetime": "TIMESTAMP", "timestamp": "TIMESTAMP",
        "tinytext": "TEXT", "mediumtext": "TEXT", "longtext": "TEXT", "set": "TEXT",
        "blob": "BYTEA", "tinyblob": "BYTEA", "mediumblob": "BYTEA", "longblob": "BYTEA", "binary": "BYTEA",
        "varbinary": "BYTEA",
        "bit": "BIT",
        "bool": "BOOLEAN", "boolean": "BOOLEAN",
        "json": "JSONB",
        "enum": "VARCHAR",
    },
    ("postgresql", "mysql"): {
        "smallint": "SMALLINT", "int2": "SMALLINT",
        "integer": "INT", "int": "INT", "int4": "INT",
        "bigint": "BIGINT", "int8": "BIGINT",
        "serial": "INT AUTO_INCREMENT",
        "bigserial": "BIGINT AUTO_INCREMENT",
        "real": "FLOAT", "float4": "FLOAT",
        "double precision": "DOUBLE", "float8": "DOUBLE",
        "numeric": "DECIMAL", "decimal": "DECIMAL",
        "boolean": "TINYINT(1)", "bool": "TINYINT(1)",
        "timestamp": "DATETIME", "timestamp without time zone": "DATETIME",
        "timestamp with time zone": "DATETIME", "timestamptz": "DATETIME",
        "bytea": "LONGBLOB",
        "json": "JSON", "jsonb": "JSON",
        "uuid": "VARCHAR(36)",
        "text": "LONGTEXT",
        "character varying": "VARCHAR", "varchar": "VARCHAR",
        "character": "CHAR", "char": "CHAR",
        "interval": "VARCHAR(50)", "cidr": "VARCHAR(50)",
        "inet": "VARCHAR(45)",
        "macaddr": "VARCHAR(17)",
        "money": "DECIMAL(19,4)",
    },
    ("mssql", "postgresql"): {
        "int": "INTEGER",
        "bigint": "BIGINT",
        "smallint": "SMALLINT", "tinyint": "SMALLINT",
        "bit": "BOOLEAN",
        "decimal": "NUMERIC", "numeric": "NUMERIC",
        "money": "NUMERIC(19,4)",
        "smallmoney": "NUMERIC(10,4)",
        "float": "DOUBLE PRECISION",
        "real": "REAL",
        "datetime": "TIMESTAMP", "datetime2": "TIMESTAMP", "smalldatetime": "TIMESTAMP",
        "datetimeoffset": "TIMESTAMP WITH TIME ZONE",
        "date": "DATE",
        "time": "TIME",
        "char": "CHAR", "nchar": "CHAR",
        "varchar": "VARCHAR", "nvarchar": "VARCHAR",
        "text": "TEXT", "ntext": "TEXT",
        "binary": "BYTEA", "varbinary": "BYTEA", "image": "BYTEA",
        "uniqueidentifier": "UUID",
        "xml": "XML",
    },
    ("mssql", "mysql"): {
        "int": "INT",
        "bigint": "BIGINT",
        "smallint": "SMALLINT",
        "tinyint": "TINYINT",
        "bit": "TINYINT(1)",
        "decimal": "DECIMAL", "numeric": "DECIMAL",
        "money": "DECIMAL(19,4)",
        "smallmoney": "DECIMAL(10,4)",
        "float": "DOUBLE",
        "real": "FLOAT",
        "datetime": "DATETIME", "smalldatetime": "DATETIME", "datetimeoffset": "DATETIME",
        "datetime2": "DATETIME(6)",
        "date": "DATE",
        "time": "TIME",
        "char": "CHAR", "nchar": "CHAR",
        "varchar": "VARCHAR", "nvarchar": "VARCHAR",
        "text": "LONGTEXT", "ntext": "LONGTEXT", "xml": "LONGTEXT",
        "binary": "BINARY",
        "varbinary": "VARBINARY",
        "image": "LONGBLOB",
        "uniqueidentifier": "VARCHAR(36)",
    },
}
TRANSLATION_DEFAULTS = {
    ("mysql", "postgresql"): None,
    ("postgresql", "mysql"): "VARCHAR",
    ("mssql", "postgresql"): "TEXT",
    ("mssql", "mysql"): "VARCHAR(255)",
}
# Target names that take a length, and what a SQL Server length of -1 (MAX) turns them into.
SIZED_NAMES = {
    ("mysql", "postgresql"): ("VARCHAR", "CHAR", "CHARACTER VARYING"),
    ("postgresql", "mysql"): ("VARCHAR", "CHAR"),
    ("mssql", "postgresql"): ("VARCHAR", "CHAR"),
    ("mssql", "mysql"): ("VARCHAR", "CHAR", "BINARY", "VARBINARY"),
}
MAX_LENGTH_NAMES = {
    ("mssql", "postgresql"): {"VARCHAR": "TEXT", "CHAR": "TEXT"},
    ("mssql", "mysql"): {"VARCHAR": "LONGTEXT", "CHAR": "LONGTEXT", "VARBINARY": "LONGBLOB", "BINARY": "LONGBLOB"},
}
# Similar types: a rename by position needs two names of one group.
SIMILAR_GROUPS = (
    ("INT", "INTEGER", "INT4"),
    ("BIGINT", "INT8"),
    ("SMALLINT", "INT2"),
    ("VARCHAR", "CHARACTER VARYING", "TEXT"),
    ("TIMESTAMP", "DATETIME"),
    ("BOOL", "BOOLEAN", "TINYINT"),
    ("FLOAT", "REAL", "FLOAT4"),
    ("DOUBLE", "DOUBLE PRECISION", "FLOAT8"),
    ("NUMERIC", "DECIMAL"),
)
# Equal types of the typed difference, by canonical name; the last two compare lengths.
EQUAL_GROUPS = {
    "INTEGER": ("INT", "INT4", "INTEGER"),
    "BIGINT": ("INT8", "BIGINT"),
    "SMALLINT": ("INT2", "SMALLINT"),
    "TEXT": ("TEXT", "VARCHAR"),
    "TIMESTAMP WITHOUT TIME ZONE": ("TIMESTAMP", "TIMESTAMP WITHOUT TIME ZONE"),
    "TIMESTAMP WITH TIME ZONE": ("TIMESTAMPTZ", "TIMESTAMP WITH TIME ZONE"),
    "DOUBLE PRECISION": ("FLOAT8", "DOUBLE PRECISION", "DOUBLE"),
    "REAL": ("FLOAT4", "REAL", "FLOAT"),
    "BOOLEAN": ("BOOL", "BOOLEAN"),
    "CHARACTER VARYING": ("VARCHAR", "CHARACTER VARYING"),
    "NUMERIC": ("DECIMAL", "NUMERIC"),
}
LENGTH_GROUPS = ("CHARACTER VARYING", "NUMERIC")
# Type changes that need an explicit conversion, in either direction.
LOSSY_TEXT = ("VARCHAR", "TEXT")
LOSSY_VALUE = ("INTEGER", "NUMERIC", "BIGINT", "SMALLINT", "BOOLEAN", "DATE")
LOSSY_TIME = ("TIMESTAMP", "DATE")
# Spark type of each canonical type; Numeric takes its own precision and scale.
SPARK_TYPES = {
    "SmallInteger": "smallint", "Integer": "int", "BigInteger": "bigint", "Float": "double",
    "Numeric": "decimal(38,18)", "String": "string", "Text": "string", "Boolean": "boolean",
    "DateTime": "timestamp_ntz", "Date": "date", "Time": "bigint", "LargeBinary": "binary",
    "JSON": "string",
}
# -------------------------------------------------------------------------------------------


def canonical_lookup(spark: SparkSession) -> DataFrame:
    rows = [(s, n, c) for s, names in CANONICAL_NAMES.items() for n, c in names.items()]
    return lookup(spark, rows, "system string,base_type string,canonical string")


def translation_lookup(spark: SparkSession, target: str) -> DataFrame:
    rows = [(s, n, r) for (s, t), names in TRANSLATIONS.items() if t == target for n, r in names.items()]
    return lookup(spark, rows, f"system string,base_type string,{target}_name string")


def base_type(type_name: Column) -> Column:
    """Type name without parameters, in lower case, whatever stands behind the parameters.

    ``timestamp(6) with time zone`` keeps its suffix, so the longest name is looked up.
    """
    bare = F.regexp_replace(F.lower(F.trim(type_name)), r"\s*\([^)]*\)", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def type_parameter(type_name: Column, position: int) -> Column:
    """First (1) or second (2) number in the parentheses of a type name, else null."""
    pattern = r"\(\s*(\d+)" if position == 1 else r"\(\s*\d+\s*,\s*(\d+)"
    return F.regexp_extract(type_name, pattern, 1).try_cast("int")


def similar_group(type_name: Column) -> Column:
    """Group of mutually similar types; a type outside the groups is its own group."""
    name = F.upper(base_type(type_name))
    branch = F
    for group in SIMILAR_GROUPS:
        branch = branch.when(name.isin(*group), F.lit(group[0]))
    return branch.otherwise(name)


def types_differ(source: Column, source_len: Column, target: Column, target_len: Column) -> Column:
    """Typed comparison: equal names or one equal group; two groups also compare lengths, and of
    the character types only an unbounded one equals TEXT."""
    a, b = F.upper(base_type(source)), F.upper(base_type(target))
    a_chars, b_chars = a.isin("VARCHAR", "CHARACTER VARYING"), b.isin("VARCHAR", "CHARACTER VARYING")
    bounded = lambda length: F.coalesce(length > 0, F.lit(False))
    branch = (
        F.when(a_chars & b_chars, ~source_len.eqNullSafe(target_len))
        .when(a_chars & (b == "TEXT"), bounded(source_len))
        .when((a == "TEXT") & b_chars, bounded(target_len))
    )
    for canonical, members in EQUAL_GROUPS.items():
        lengths = ~source_len.eqNullSafe(target_len) if canonical in LENGTH_GROUPS else F.lit(False)
        branch = branch.when(a.isin(*members) & b.isin(*members), lengths)
    return branch.otherwise(a != b)


def is_lossy_cast(source: Column, target: Column) -> Column:
    """True when changing between the two types needs an explicit conversion."""
    names = {"INT": "INTEGER", "DECIMAL": "NUMERIC", "DATETIME": "TIMESTAMP", "CHARACTER VARYING": "VARCHAR", "BOOL": "BOOLEAN"}

    def plain(col: Column) -> Column:
        name = F.upper(base_type(col))
        branch = F
        for alias, canonical in names.items():
            branch = branch.when(name == alias, F.lit(canonical))
        return branch.otherwise(name)

    a, b = plain(source), plain(target)
    text_to_value = a.isin(*LOSSY_TEXT) & b.isin(*LOSSY_VALUE)
    value_to_text = a.isin(*LOSSY_VALUE) & b.isin(*LOSSY_TEXT)
    return text_to_value | value_to_text | (a.isin(*LOSSY_TIME) & b.isin(*LOSSY_TIME) & (a != b))


def with_canonical_types(columns: DataFrame) -> DataFrame:
    """Add ``canonical``, its parameters and the Spark type to a column catalog.

    Needs ``system, type_name, length, scale``; explicit lengths win over the parameters in
    the type name. Unknown names become String, and String without a length becomes Text.
    """
    typed = columns.withColumns(
        {
            "base_type": base_type(F.col("type_name")),
            "length": F.coalesce("length", type_parameter(F.col("type_name"), 1)),
            "scale": F.coalesce("scale", type_parameter(F.col("type_name"), 2)),
        }
    )
    typed = typed.join(canonical_lookup(columns.sparkSession), ["system", "base_type"], "left")
    named = F.coalesce("canonical", F.lit("String"))
    sized = F.coalesce(F.col("length") > 0, F.lit(False))
    canonical = F.when((named == "String") & ~sized, "Text").otherwise(named)
    typed = typed.withColumn("canonical", canonical)
    spark_type = F
    for name, spark_name in SPARK_TYPES.items():
        spark_type = spark_type.when(F.col("canonical") == name, F.lit(spark_name))
    exact = F.format_string("decimal(%d,%d)", F.col("length"), F.coalesce("scale", F.lit(0)))
    return typed.withColumn(
        "spark_type", F.when((F.col("canonical") == "Numeric") & sized, exact).otherwise(spark_type)
    )


def translated_type(columns: DataFrame, target: str) -> DataFrame:
    """Add ``<target>_type``: the type text each column gets in the target system.

    Expects the output of ``with_canonical_types``. Columns that are already in the target
    system keep their own text in upper case.
    """
    out, found = f"{target}_type", F.col(f"{target}_name")
    joined = columns.join(translation_lookup(columns.sparkSession, target), ["system", "base_type"], "left")
    length, scale = F.col("length"), F.col("scale")
    exact = "NUMERIC" if target == "postgresql" else "DECIMAL"
    branch = F
    for source, default in TRANSLATION_DEFAULTS.items():
        if source[1] != target:
            continue
        name = F.coalesce(found, F.lit(default) if default else F.upper("base_type"))
        text = F.when(name.isin(*SIZED_NAMES[source]) & (length > 0), F.concat(name, F.lit("("), length, F.lit(")")))
        for plain, unbounded in MAX_LENGTH_NAMES.get(source, {}).items():
            text = text.when((name == plain) & (length == -1), F.lit(unbounded))
        text = text.when(
            (name == exact) & (length > 0) & (scale > 0), F.concat(name, F.lit("("), length, F.lit(","), scale, F.lit(")"))
        ).when((name == exact) & (length > 0), F.concat(name, F.lit("("), length, F.lit(")")))
        if source == ("postgresql", "mysql"):
            text = text.when(name == "VARCHAR", F.lit("VARCHAR(255)"))
        branch = branch.when(F.col("system") == source[0], text.otherwise(name))
    return joined.withColumn(out, branch.otherwise(F.upper("type_name"))).drop(f"{target}_name")


def conform(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """Cast text columns to Spark types; ``_rejects`` lists columns whose value was lost.

    A value is lost when it was not null and its cast is null. Zero dates are the exception:
    lenient sources write them for "no date", so they become null without a reject.
    """
    def cast(name: str) -> Column:
        if types[name] == "timestamp_ntz":
            return timestamp_from_text(F.col(name))
        return F.col(name).try_cast(types[name])

    def lost(name: str) -> Column:
        gone = F.col(name).isNotNull() & cast(name).isNull()
        if types[name] in ("timestamp_ntz", "date"):
            gone = gone & ~F.col(name).startswith("0000-00-00")
        return F.when(gone, F.lit(name))

    rejects = F.array_join(F.array(*[lost(name) for name in types]), ",")
    return rows.select(
        *[cast(c).alias(c) if c in types else F.col(c) for c in rows.columns],
        F.nullif(rejects, F.lit("")).alias("_rejects"),
    )
