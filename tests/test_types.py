import pytest
from pyspark.sql import functions as F

from changemill.functions import types


def typed(spark, *columns):
    df = spark.createDataFrame(list(columns), "system string, type_name string, length int, scale int")
    both = types.translated_type(types.translated_type(types.with_canonical_types(df), "postgresql"), "mysql")
    return both.collect()


def one(spark, *column):
    return typed(spark, column)[0]


@pytest.mark.parametrize(
    "system,name,length,scale,canonical,spark_type",
    [
        ("mysql", "VARCHAR(255)", None, None, "String", "string"),
        ("mysql", "DECIMAL(10,2)", None, None, "Numeric", "decimal(10,2)"),
        ("mysql", "DECIMAL(10,0)", None, None, "Numeric", "decimal(10,0)"),
        ("mysql", "DECIMAL", None, None, "Numeric", "decimal(38,18)"),
        ("mysql", "DECIMAL(10,2)", 12, 4, "Numeric", "decimal(12,4)"),
        ("mysql", "VARCHAR", None, None, "Text", "string"),
        ("mysql", "geometry", None, None, "Text", "string"),
        ("mssql", "int", None, None, "Integer", "int"),
        ("mssql", "bit", None, None, "Boolean", "boolean"),
        ("mssql", "nvarchar", -1, None, "Text", "string"),
        ("postgresql", "timestamp with time zone", None, None, "DateTime", "timestamp_ntz"),
        ("postgresql", "timestamp(6) without time zone", None, None, "DateTime", "timestamp_ntz"),
        ("postgresql", "time with time zone", None, None, "Time", "bigint"),
        ("postgresql", "interval", None, None, "Text", "string"),
        ("postgresql", "point", None, None, "Text", "string"),
        ("postgresql", "double precision", None, None, "Float", "double"),
        ("postgresql", "Character Varying(30)", None, None, "String", "string"),
        ("postgresql", "jsonb", None, None, "JSON", "string"),
    ],
)
def test_canonical_types(spark, system, name, length, scale, canonical, spark_type):
    row = one(spark, system, name, length, scale)
    assert (row.canonical, row.spark_type) == (canonical, spark_type)


@pytest.mark.parametrize(
    "system,name,length,scale,postgresql,mysql",
    [
        ("mysql", "TINYINT", None, None, "SMALLINT", "TINYINT"),
        ("mysql", "VARCHAR", 40, None, "VARCHAR(40)", "VARCHAR"),
        ("mysql", "DECIMAL", 10, 2, "NUMERIC(10,2)", "DECIMAL"),
        ("mysql", "YEAR", None, None, "SMALLINT", "YEAR"),
        ("mysql", "DATE", None, None, "DATE", "DATE"),
        ("postgresql", "uuid", None, None, "UUID", "VARCHAR(36)"),
        ("postgresql", "boolean", None, None, "BOOLEAN", "TINYINT(1)"),
        ("postgresql", "varchar", None, None, "VARCHAR", "VARCHAR(255)"),
        ("postgresql", "timestamp with time zone", None, None, "TIMESTAMP WITH TIME ZONE", "DATETIME"),
        ("postgresql", "numeric", 12, None, "NUMERIC", "DECIMAL(12)"),
        ("mssql", "nvarchar", -1, None, "TEXT", "LONGTEXT"),
        ("mssql", "varbinary", -1, None, "BYTEA", "LONGBLOB"),
        ("mssql", "varbinary", 16, None, "BYTEA", "VARBINARY(16)"),
        ("mssql", "money", None, None, "NUMERIC(19,4)", "DECIMAL(19,4)"),
        ("mssql", "datetime2", None, None, "TIMESTAMP", "DATETIME(6)"),
        ("mssql", "hierarchyid", None, None, "TEXT", "VARCHAR(255)"),
    ],
)
def test_translations(spark, system, name, length, scale, postgresql, mysql):
    row = one(spark, system, name, length, scale)
    assert (row.postgresql_type, row.mysql_type) == (postgresql, mysql)


def test_every_listed_name_has_its_type(spark):
    listed = [(s, n, c) for s, names in types.CANONICAL_NAMES.items() for n, c in names.items()]
    got = {(r.system, r.type_name): r.canonical for r in typed(spark, *[(s, n, 9, None) for s, n, _ in listed])}
    assert got == {(s, n): c for s, n, c in listed}


def test_similar_and_equal_types(spark):
    pairs = [("INT", "int4"), ("VARCHAR(20)", "TEXT"), ("DATETIME", "TIMESTAMP"), ("DECIMAL(9,2)", "numeric"), ("INT", "BIGINT"), ("UUID", "uuid")]
    df = spark.createDataFrame(pairs, "a string, b string")
    same = [r[0] for r in df.select(types.similar_group(F.col("a")) == types.similar_group(F.col("b"))).collect()]
    assert same == [True, True, True, True, False, True]
    rows = [("VARCHAR", 20, "CHARACTER VARYING", 30), ("NUMERIC", 10, "DECIMAL", 10), ("NUMERIC", 10, "DECIMAL", 12), ("VARCHAR", 5, "TEXT", None), ("VARCHAR", None, "TEXT", None), ("VARCHAR", 50, "VARCHAR", 10), ("INT", None, "DATE", None)]
    df = spark.createDataFrame(rows, "a string, al int, b string, bl int")
    differ = [r[0] for r in df.select(types.types_differ(F.col("a"), F.col("al"), F.col("b"), F.col("bl"))).collect()]
    assert differ == [True, False, True, True, False, True, True]


def test_lossy_casts_in_both_directions(spark):
    pairs = [("VARCHAR(9)", "INTEGER"), ("integer", "text"), ("TIMESTAMP", "DATE"), ("INTEGER", "BIGINT"), ("VARCHAR", "TEXT"), ("DATE", "DATE")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(types.is_lossy_cast(F.col("a"), F.col("b"))).collect()] == [True, True, True, False, False, False]


def test_conformance(spark):
    df = spark.createDataFrame(
        [("1", "2.50", "2024-01-02 03:04:05", "ok"), ("x", "2", "0000-00-00 00:00:00", None), (None, "abc", "2024-13-01", "y")],
        "a string, b string, c string, d string",
    )
    out = types.conform(df, {"a": "int", "b": "decimal(10,2)", "c": "timestamp_ntz"}).collect()
    assert [r._rejects for r in out] == [None, "a", "b,c"]
    assert (out[0].a, str(out[0].b), out[0].d) == (1, "2.50", "ok")
    assert out[1].c is None
