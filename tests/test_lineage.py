"""Columns traced back through operations, and schema epochs of a state."""

import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changemill.functions.envelope import encode_envelope
from changemill.operators import evolve
from changemill.session import run_dir
from changemill.sources.feed import read_files
from changemill.spec import PipelineSpec, TableSpec
from changemill.streaming.apply import Pipeline

TOPIC = "client_1_db_2_v_1.shop.a"
COLUMNS = {"a": "string", "b": "string"}


def operation(off, kind, column, new=None, kind_of=None, default=None):
    return Row(tbl=TOPIC, off=off, clause_no=0, operation=kind, column_name=column, new_name=new, type_name=kind_of, default_value=default)


def as_int(x):
    return str(int(x)) if x is not None and x.lstrip("-").isdigit() else None


def plain(row, operations):
    """A row's values after every operation behind its offset, one after the other."""
    values, known = dict(row), set(COLUMNS)
    for op in operations:
        if op.operation == "ADD_COLUMN":
            known.add(op.column_name)
        elif op.column_name not in known:
            continue
        if op.operation == "RENAME_COLUMN":
            known.add(op.new_name)
        if op.off <= row["off"]:
            continue
        old = values.get(op.column_name)
        if op.operation == "ADD_COLUMN":
            values[op.column_name] = op.default_value
        elif op.operation == "DROP_COLUMN":
            values[op.column_name] = None
        elif op.operation == "RENAME_COLUMN":
            values[op.column_name], values[op.new_name] = None, old
        elif op.operation == "MODIFY_COLUMN" and op.type_name == "int":
            values[op.column_name] = as_int(old)
    return {c: values.get(c) for c in known}


def some_operations(rnd, n):
    names, out = ["a", "b", "c", "d"], []
    for i in range(n):
        kind = rnd.choice(["ADD_COLUMN", "DROP_COLUMN", "RENAME_COLUMN", "MODIFY_COLUMN"])
        one, other = rnd.sample(names, 2)
        made = {"RENAME_COLUMN": {"new": other}, "ADD_COLUMN": {"kind_of": "string", "default": f"{i}"}, "MODIFY_COLUMN": {"kind_of": rnd.choice(["int", "string"])}}
        out.append(operation(10 * i + 5, kind, one, **made.get(kind, {})))
    # the last types are text again, so that values compare as they are
    return [*out, *[operation(10 * n + 5 + i, "MODIFY_COLUMN", c, kind_of="string") for i, c in enumerate(names)]]


@pytest.mark.parametrize("seed", range(8))
def test_lineage_equals_operations_one_by_one(spark, seed):
    rnd = random.Random(seed)
    operations = some_operations(rnd, 14)
    # rows are written under the schema of their time: no words once a column has been a number
    words = min([op.off for op in operations if op.type_name == "int"], default=1000)
    pick = lambda off, word: rnd.choice([word if off < words else "3", "12", None])
    rows = [(i, off, pick(off, "x"), pick(off, "y")) for i, off in enumerate(range(0, 160, 5))]
    df = spark.createDataFrame(rows, "id long, off long, a string, b string")
    once = evolve.evolve_by_lineage(df, operations, COLUMNS).collect()
    table = spark.createDataFrame(operations, "tbl string, off long, clause_no int, operation string, column_name string, new_name string, type_name string, default_value string")
    chunked = evolve.evolve_in_chunks(df, table, ["id", "off"], size=4).collect()
    for found in (once, chunked):
        for r in found:
            raw = {"off": r.off, "a": rows[r.id][2], "b": rows[r.id][3]}
            expected = plain(raw, operations)
            assert {c: r[c] for c in expected} == expected


def test_chunks_hold_every_operation_once(spark):
    df = spark.range(2500).select((F.col("id") / 3).cast("long").alias("off"), (F.col("id") % 3).cast("int").alias("clause_no"), F.lit("x").alias("operation"))
    chunks = list(evolve.operation_chunks(df, 700))
    assert [len(c) for c in chunks] == [700, 700, 700, 400]
    assert [(r.off, r.clause_no) for c in chunks for r in c] == [(i // 3, i % 3) for i in range(2500)]
    assert list(evolve.operation_chunks(df.limit(0))) == []


ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("a", T.StringType())])


def changes(spark, folder, events):
    df = spark.createDataFrame(events, "topic string, part int, off long, op string, id long, a string")
    messages = encode_envelope(df, ["id", "a"], ["id"]).selectExpr("topic", "part", "off", "CAST(NULL AS TIMESTAMP_NTZ) AS ts", "key", "value")
    messages.write.mode("append").parquet(f"{folder}/feed")


def test_fifty_thousand_operations(spark):
    """A long history is folded in as the data comes by; the driver sees a chunk, and reads look at what is new."""
    folder = run_dir(spark, "epochs")
    spec = PipelineSpec(1, 2, "mysql", "shop", (TableSpec("shop", "a", ROW, ("id",)),), frequency="manual")
    pipeline = Pipeline(spark, spec, folder, "epochs", buckets=2)
    table = spec.tables[0]
    # every operation swaps two names; 50,000 of them leave the value where it was
    operations = spark.range(50_000).select(
        F.lit(TOPIC).alias("tbl"), (F.col("id") * 2 + 101).alias("off"), F.lit(0).alias("clause_no"), F.lit("RENAME_COLUMN").alias("operation"),
        F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("column_name"), F.when(F.col("id") % 2 == 0, "b").otherwise("a").alias("new_name"),
        F.lit(None).cast("string").alias("type_name"), F.lit(None).cast("string").alias("default_value"),
    )
    changes(spark, folder, [(TOPIC, 0, 10, "c", 1, "old"), (TOPIC, 0, 60_000, "c", 2, "mid")])
    pipeline.run(read_files(spark, f"{folder}/feed", True), f"{folder}/ck").awaitTermination()
    began = time.time()
    assert pipeline.fold_schema(table, operations) == 59_999
    assert pipeline.fold_schema(table, operations) == 59_999  # nothing is due twice
    later = pipeline._operations_of(table, operations).where(F.col("off") > pipeline.state(table).epoch())
    assert later.count() == 50_000 - 29_950
    changes(spark, folder, [(TOPIC, 0, 100_200, "c", 3, "new")])
    pipeline.run(read_files(spark, f"{folder}/feed", True), f"{folder}/ck").awaitTermination()
    pipeline.fold_schema(table, operations)
    found = {r.id: r.a for r in pipeline.target_rows(table, operations).collect()}
    assert found == {1: "old", 2: "mid", 3: "new"}
    assert time.time() - began < 240


def test_types_change_with_the_epoch(spark, rows):
    folder = run_dir(spark, "retype")
    spec = PipelineSpec(1, 2, "mysql", "shop", (TableSpec("shop", "a", ROW, ("id",)),), frequency="manual")
    pipeline = Pipeline(spark, spec, folder, "retype", buckets=2)
    table = spec.tables[0]
    changes(spark, folder, [(TOPIC, 0, 1, "c", 1, "12"), (TOPIC, 0, 2, "c", 2, "no"), (TOPIC, 0, 9, "c", 3, "5")])
    pipeline.run(read_files(spark, f"{folder}/feed", True), f"{folder}/ck").awaitTermination()
    known = "tbl string, off long, clause_no int, operation string, column_name string, new_name string, type_name string, default_value string"
    operations = spark.createDataFrame([operation(5, "MODIFY_COLUMN", "a", kind_of="int"), operation(6, "ADD_COLUMN", "z", kind_of="int", default="4"), operation(50, "DROP_COLUMN", "z")], known)
    assert pipeline.fold_schema(table, operations) == 6  # the last one is beyond the data
    changes(spark, folder, [(TOPIC, 0, 11, "u", 1, "13"), (TOPIC, 0, 12, "c", 4, "6")])
    pipeline.run(read_files(spark, f"{folder}/feed", True), f"{folder}/ck").awaitTermination()
    assert rows(pipeline.state(table).current(), "id", "a", "z") == [(1, 13, None), (2, None, 4), (3, 5, None), (4, 6, None)]
    assert rows(pipeline.target_rows(table, operations), "id", "a", "z") == [(1, 13, None), (2, None, None), (3, 5, None), (4, 6, None)]
