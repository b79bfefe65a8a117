import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from changemill.operators import ddl, evolve, schema_diff

STATEMENT = "ddl_id bigint, system string, tbl string, ddl string"


def statements(spark, *texts, system="mysql", tbl="t"):
    return spark.createDataFrame([(i, system, tbl, t) for i, t in enumerate(texts)], STATEMENT)


def parsed(spark, text, system="mysql"):
    return ddl.classify_clauses(ddl.alter_clauses(statements(spark, text, system=system))).orderBy("clause_no").collect()


def test_split_keeps_commas_inside_parentheses(spark):
    rows = ddl.alter_clauses(statements(spark, "ALTER TABLE `t` ADD COLUMN a INT, DROP COLUMN b, MODIFY c DECIMAL(10,2);")).orderBy("clause_no").collect()
    assert [r.clause for r in rows] == ["ADD COLUMN a INT", "DROP COLUMN b", "MODIFY c DECIMAL(10,2)"]


@pytest.mark.parametrize(
    "text,operation,column,new,type_name",
    [
        ("ALTER TABLE t MODIFY c INT NOT NULL", "MODIFY_COLUMN", "c", None, "INT"),
        ("ALTER TABLE t CHANGE COLUMN x y VARCHAR(20)", "RENAME_COLUMN", "x", "y", "VARCHAR"),
        ("ALTER TABLE t CHANGE x x BIGINT", "MODIFY_COLUMN", "x", None, "BIGINT"),
        ("ALTER TABLE t RENAME COLUMN `x` TO `y`", "RENAME_COLUMN", "x", "y", None),
        ("ALTER TABLE t ADD PRIMARY KEY (a)", "ADD_PRIMARY_KEY", None, None, None),
        ("ALTER TABLE t ADD CONSTRAINT k FOREIGN KEY (a) REFERENCES o (b)", "ADD_CONSTRAINT", None, None, None),
        ("ALTER TABLE t ADD UNIQUE INDEX i (a, b)", "ADD_INDEX", None, None, None),
        ("ALTER TABLE t DROP KEY i", "DROP_INDEX", None, None, None),
        ("ALTER TABLE t DROP PRIMARY KEY", "DROP_PRIMARY_KEY", None, None, None),
        ("ALTER TABLE t DROP b", "DROP_COLUMN", "b", None, None),
        ("ALTER TABLE t ADD e ENUM('a','b') NOT NULL", "ADD_COLUMN", "e", None, "ENUM"),
        ("ALTER TABLE t ENGINE=InnoDB", "UNKNOWN", None, None, None),
    ],
)
def test_mysql_clauses(spark, text, operation, column, new, type_name):
    row = parsed(spark, text)[0]
    assert (row.operation, row.column_name, row.new_name, row.type_name) == (operation, column, new, type_name)


@pytest.mark.parametrize(
    "text,operation,column,type_name",
    [
        ("ALTER TABLE t ALTER COLUMN c SET DATA TYPE TEXT", "MODIFY_COLUMN", "c", "TEXT"),
        ("ALTER TABLE t ALTER c TYPE numeric(10,2)", "MODIFY_COLUMN", "c", "NUMERIC"),
        ('ALTER TABLE ONLY "s"."t" ALTER COLUMN c DROP NOT NULL', "NO_OP", "c", None),
        ("ALTER TABLE t ALTER COLUMN c SET DEFAULT 5", "NO_OP", "c", None),
        ("ALTER TABLE t DROP COLUMN IF EXISTS c", "DROP_COLUMN", "c", None),
        ("ALTER TABLE t ADD COLUMN c timestamp with time zone", "ADD_COLUMN", "c", "TIMESTAMP WITH TIME ZONE"),
    ],
)
def test_postgresql_clauses(spark, text, operation, column, type_name):
    row = parsed(spark, text, "postgresql")[0]
    assert (row.operation, row.column_name, row.type_name) == (operation, column, type_name)


def test_details(spark):
    add = parsed(spark, "ALTER TABLE t ADD d DECIMAL(10,2) NOT NULL DEFAULT 7")[0]
    assert (add.length, add.scale, add.is_optional, add.default_value, add.is_destructive) == (10, 2, False, "7", False)
    index = parsed(spark, "ALTER TABLE t ADD UNIQUE INDEX i (`a`, b)")[0]
    assert (index.index_name, index.index_columns, index.is_unique) == ("i", "a,b", True)
    assert parsed(spark, "ALTER TABLE t DROP COLUMN c")[0].is_destructive


@pytest.mark.parametrize("prefix", ddl.SKIPPED_PREFIXES)
def test_irrelevant_statements_are_skipped(spark, prefix):
    text = prefix.strip().lower() + " something"
    assert ddl.dispatch(statements(spark, text)).first().route == "skipped"


def test_dispatch(spark):
    nested = "ALTER TABLE t ADD CHECK ((a > 0))"
    assert ddl.dispatch(statements(spark, nested)).first().route == "dead_letter"
    assert ddl.alter_clauses(statements(spark, nested)).count() == 0
    assert ddl.dispatch(statements(spark, "TRUNCATE TABLE t")).first().route == "ignored"
    assert ddl.dispatch(statements(spark, "ALTER TABLE t ADD a INT", system="oracle")).first().route == "ignored"
    assert ddl.dispatch(statements(spark, "ALTER TABLE t ADD a INT", system="mssql")).first().route == "diff_metadata"
    assert ddl.dispatch(statements(spark, "CREATE UNIQUE INDEX i ON s.t (a)", system="postgresql")).first().route == "parse_index"


def test_index_statements(spark, rows):
    df = statements(spark, 'CREATE UNIQUE INDEX IF NOT EXISTS "i" ON s.t ("a", b)', "DROP INDEX s.j", system="postgresql")
    assert rows(ddl.index_statements(df), "operation", "tbl", "index_name", "index_columns", "is_unique") == [
        ("ADD_INDEX", "t", "i", "a,b", True), ("DROP_INDEX", "t", "j", None, None)
    ]


def test_gate_blocks_what_follows_a_waiting_operation(spark, rows):
    clauses = ddl.classify_clauses(ddl.alter_clauses(statements(spark, "ALTER TABLE t ADD a INT, DROP b, ADD c INT")))
    have = spark.createDataFrame([("t",)], "tbl string")
    assert [s for _, s in rows(ddl.gate(clauses, have), "clause_no", "status")] == ["apply", "pending_approval", "blocked"]
    assert {s for _, s in rows(ddl.gate(clauses, have, True), "clause_no", "status")} == {"apply"}
    assert {s for _, s in rows(ddl.gate(clauses, have.limit(0)), "clause_no", "status")} == {"skipped"}


def test_table_renames(spark, rows):
    df = statements(spark, "RENAME TABLE a TO b, `s`.c TO d, x TO y")
    have = spark.createDataFrame([("a",), ("c",), ("d",)], "tbl string")
    assert rows(ddl.table_renames(df, have), "clause_no", "old_table", "new_table", "status") == [
        (0, "a", "b", "apply"), (1, "c", "d", "new_exists"), (2, "x", "y", "old_missing")
    ]


CATALOG = "tbl string, name string, pos int, type_name string, length int, scale int"


def catalog(spark, *columns):
    return spark.createDataFrame([("t", n, i, ty, None, None) for i, (n, ty) in enumerate(columns)], CATALOG)


@pytest.mark.parametrize(
    "source,target,renames,expected",
    [
        ([("id", "INT"), ("y", "VARCHAR")], [("id", "INT"), ("x", "TEXT")], [("x", "y")], [(1, "RENAME_COLUMN", "x", "y")]),
        ([("id", "INT"), ("y", "VARCHAR")], [("id", "INT"), ("x", "TEXT")], [], [(3, "RENAME_COLUMN", "x", "y")]),
        ([("id", "INT"), ("y", "DATE")], [("id", "INT"), ("x", "TEXT")], [], [(4, "ADD_COLUMN", "y", None), (5, "DROP_COLUMN", "x", None)]),
        ([("id", "INT"), ("n", "INT")], [("id", "INT")], [], [(4, "ADD_COLUMN", "n", None)]),
        ([("id", "INT"), ("z", "INT")], [("id", "INT"), ("m", "DATE"), ("z", "INT")], [], [(5, "DROP_COLUMN", "m", None)]),
        ([("id", "BIGINT")], [("id", "INT")], [], []),
        (
            [("id", "INT"), ("b2", "INT"), ("c2", "VARCHAR"), ("e", "DATE")],
            [("id", "INT"), ("b1", "INT4"), ("c1", "TEXT"), ("d", "BLOB")],
            [("c1", "c2")],
            [(1, "RENAME_COLUMN", "c1", "c2"), (3, "RENAME_COLUMN", "b1", "b2"), (4, "ADD_COLUMN", "e", None), (5, "DROP_COLUMN", "d", None)],
        ),
    ],
)
def test_rename_aware_diff(spark, rows, source, target, renames, expected):
    explicit = spark.createDataFrame([("t", a, b) for a, b in renames], "tbl string, old_name string, new_name string")
    diff = schema_diff.rename_aware_diff(catalog(spark, *source), catalog(spark, *target), explicit)
    assert rows(diff, "stage", "operation", "column_name", "new_name") == expected


def test_typed_diff(spark, rows):
    source, target = catalog(spark, ("a", "INT"), ("b", "DATE"), ("c", "INT")), catalog(spark, ("a", "INTEGER"), ("b", "TEXT"), ("d", "INT"))
    assert rows(schema_diff.typed_diff(source, target), "operation", "column_name", "old_type") == [
        ("ADD_COLUMN", "c", None), ("DROP_COLUMN", "d", None), ("MODIFY_COLUMN", "b", "TEXT")
    ]
    assert {r.operation for r in schema_diff.typed_diff(source, target.limit(0)).collect()} == {"CREATE_TABLE"}
    assert schema_diff.typed_diff(source.limit(0), target).count() == 0


def op(kind, column, new=None, type_name=None, default=None, off=10, tbl="t"):
    return Row(tbl=tbl, off=off, operation=kind, column_name=column, new_name=new, type_name=type_name, default_value=default)


def test_apply_operations_leaves_an_audit(spark):
    df = spark.createDataFrame([(1, "5"), (2, "x")], "id int, v string")
    operations = [
        op("ADD_COLUMN", "n", type_name="int", default="3"), op("ADD_COLUMN", "id", type_name="int"), op("RENAME_COLUMN", "v", "w"),
        op("RENAME_COLUMN", "gone", "w2"), op("RENAME_COLUMN", "w"), op("MODIFY_COLUMN", "w", type_name="int"), op("DROP_COLUMN", "gone"),
        op("ADD_INDEX", "w"),
    ]
    out, audit = evolve.apply_operations(df, operations)
    assert sorted(map(tuple, out.select("id", "w", "n").collect())) == [(1, 5, 3), (2, None, 3)]
    assert [a[2] for a in audit] == ["success", "exists", "success", "absent", "failed", "success", "absent", "recorded"]


def test_rows_evolve_by_the_operations_after_them(spark, rows):
    df = spark.createDataFrame(
        [("t", 1, "a", None, None), ("t", 20, None, "b", "own"), ("u", 1, "c", None, None)], "topic string, off int, old string, new string, extra string"
    )
    operations = [op("RENAME_COLUMN", "old", "new", off=10), op("ADD_COLUMN", "extra", type_name="string", default="dft", off=15)]
    out = evolve.evolve_rows(df, operations, {"old": "string", "new": "string", "extra": "string"})
    assert rows(out, "topic", "off", "old", "new", "extra") == [
        ("t", 1, None, "a", "dft"), ("t", 20, None, "b", "own"), ("u", 1, "c", None, None)
    ]
    chained = evolve.evolve_rows(
        df, [op("RENAME_COLUMN", "old", "mid", off=5), op("RENAME_COLUMN", "mid", "new", off=6), op("DROP_COLUMN", "new", off=7)],
        {"old": "string", "new": "string", "extra": "string"},
    )
    assert rows(chained, "topic", "off", "old", "mid", "new") == [
        ("t", 1, None, None, None), ("t", 20, None, None, "b"), ("u", 1, "c", None, None)
    ]


def test_too_many_operations_are_refused_not_cut(spark):
    many = spark.range(5).select(F.col("id").alias("off"))
    assert len(evolve.bounded_operations(many, 5)) == 5
    with pytest.raises(ValueError):
        evolve.bounded_operations(many, 4)


def test_defaults_and_target_schema(spark):
    df = spark.createDataFrame([("string", "x", False), ("boolean", "true", False), ("int", "5", False), ("int", "5", True)], "k string, v string, a boolean")
    assert [r[0] for r in df.select(evolve.default_literal(F.col("k"), F.col("v"), F.col("a"))).collect()] == ["'x'", "1", "5", None]
    columns = [
        Row(name="b", pos=1, spark_type="decimal(10,2)", optional=True, is_key=False, type_name="DECIMAL"),
        Row(name="a", pos=0, spark_type="int", optional=True, is_key=True, type_name="INT"),
    ]
    schema = evolve.target_schema(columns)
    assert [(f.name, f.dataType.simpleString(), f.nullable) for f in schema] == [("a", "int", False), ("b", "decimal(10,2)", True)]
    with pytest.raises(ValueError):
        evolve.target_schema([])
    assert evolve.union_schema(schema, schema.add("c", "string")).names == ["a", "b", "c"]


def test_positions(spark, rows):
    df = spark.createDataFrame([("t", ["a", "b"])], "tbl string, cols array<string>")
    assert rows(schema_diff.positions(df, "cols")) == [("t", 0, "a"), ("t", 1, "b")]


def test_widen_and_not_null(spark):
    old, new = spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2, "x")], "a int, b string")
    assert [tuple(r) for r in evolve.widen(old, new).collect()] == [(1, None)]
    df = spark.createDataFrame([(True, True), (False, True), (False, False)], "k boolean, o boolean")
    assert [r[0] for r in df.select(evolve.not_null(F.col("k"), F.col("o"))).collect()] == [True, False, True]


def test_modify_keeps_other_tables_values(spark):
    df = spark.createDataFrame([("a", 1, "12"), ("a", 9, "x"), ("b", 1, "abc")], "topic string, off bigint, w string")
    change = [Row(tbl="a", off=5, operation="MODIFY_COLUMN", column_name="w", new_name=None, type_name="int", default_value=None)]
    shared = {(r.topic, r.off): r.w for r in evolve.evolve_rows(df, change, {"w": "string"}).collect()}
    assert shared == {("a", 1): "12", ("a", 9): "x", ("b", 1): "abc"}
    one = evolve.evolve_rows(df.where("topic = 'a'"), change, {"w": "string"}, one_table=True)
    assert one.schema["w"].dataType.simpleString() == "int" and [r.w for r in one.orderBy("off").collect()] == [12, None]


@pytest.mark.parametrize(
    "text,operation,column,index",
    [
        ("ALTER TABLE t ADD FULLTEXT INDEX ft (a, b)", "ADD_INDEX", None, "ft"),
        ("ALTER TABLE t ADD UNIQUE uq (a)", "ADD_INDEX", None, "uq"),
        ("ALTER TABLE t ADD FOREIGN KEY fk (a) REFERENCES o (b)", "ADD_CONSTRAINT", None, "fk"),
        ("ALTER TABLE t DROP PARTITION p0", "UNKNOWN", None, None),
        ("ALTER TABLE t DROP CHECK c1", "DROP_CONSTRAINT", None, "c1"),
        ("ALTER  TABLE t ADD c INT COMMENT 'x, DROP COLUMN y'", "ADD_COLUMN", "c", None),
        ("ALTER TABLE t RENAME TO u", "RENAME_TABLE", None, None),
    ],
)
def test_clauses_that_look_like_columns(spark, text, operation, column, index):
    found = parsed(spark, text)
    assert [(r.operation, r.column_name, r.index_name) for r in found] == [(operation, column, index)]


def test_quoted_defaults_column_lists_and_table_renames(spark, rows):
    assert parsed(spark, "ALTER TABLE t ADD c VARCHAR(9) DEFAULT 'a,b' NOT NULL")[0].default_value == "a,b"
    assert [r.column_name for r in parsed(spark, "ALTER TABLE t ADD COLUMN (a INT, b INT)")] == ["a", "b"]
    have = spark.createDataFrame([("a",)], "tbl string")
    assert rows(ddl.table_renames(statements(spark, "ALTER TABLE s.a RENAME TO s.b"), have), "old_table", "new_table", "status") == [("a", "b", "apply")]


def test_every_relevant_statement_leaves_a_row_in_the_stream(spark):
    from changemill.streaming.ddl import statements_to_operations

    texts = [
        ("mysql", "ALTER TABLE t ADD a INT, FORCE"), ("mysql", "RENAME TABLE t TO u"), ("mssql", "ALTER TABLE t ADD a INT"),
        ("postgresql", "CREATE INDEX i ON t (a)"), ("mysql", "ALTER TABLE t RENAME TO v"), ("mysql", "ALTER TABLE t ADD CHECK ((a > 0))"),
    ]
    rows = [(i, i, system, "t", text) for i, (system, text) in enumerate(texts)]
    df = spark.createDataFrame(rows, "ddl_id bigint, off bigint, system string, tbl string, ddl string")
    found = statements_to_operations(df, spark.createDataFrame([("t",)], "tbl string")).collect()
    assert sorted((r.off, r.operation, r.new_name, r.status) for r in found) == [
        (0, "ADD_COLUMN", None, "apply"), (0, "UNKNOWN", None, "dead_letter"), (1, "RENAME_TABLE", "u", "apply"),
        (2, "UNKNOWN", None, "diff_metadata"), (3, "ADD_INDEX", "i", "recorded"), (4, "RENAME_TABLE", "v", "apply"), (5, "UNKNOWN", None, "dead_letter"),
    ]


@pytest.mark.parametrize("text", [
    "ALTER TABLE t ADD COLUMN a INT COMMENT '{x}', DROP COLUMN b", "ALTER TABLE t ADD COLUMN a INT DEFAULT '{q}', DROP COLUMN b",
    "ALTER TABLE t ADD COLUMN a INT /*{blank}*/, DROP COLUMN b", "ALTER TABLE t ADD COLUMN a ENUM('{x}', 'y'){blank};, DROP COLUMN b",
])
def test_long_texts_take_neither_stack_nor_hours(spark, text):
    n = 1_000_000
    statement = text.replace("{x}", "x" * n).replace("{q}", "''\\\\" * (n // 4)).replace("{blank}", " " * n)
    found = [(r.operation, r.column_name) for r in parsed(spark, statement)]
    assert found == [("ADD_COLUMN", "a"), ("DROP_COLUMN", "b")]


def test_an_open_quote_keeps_the_statement_whole(spark):
    assert not statements(spark, "ALTER TABLE t ADD COLUMN a INT COMMENT 'it''").select(ddl.is_splittable(F.col("ddl")).alias("s")).first().s
