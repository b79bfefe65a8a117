import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changemill.functions.envelope import encode_envelope
from changemill.session import lookup, measured, run_dir
from changemill.sources.feed import FEED_SCHEMA, read_files
from changemill.spec import PipelineSpec, TableSpec
from changemill.streaming.apply import MetadataUnavailable, Pipeline, fold_into, may_run, start, trigger_options
from changemill.streaming.ddl import read_operations, record_into
from changemill.streaming.progress import ProgressLog
from changemill.tables import jdbc, targets
from changemill.tables.dead_letters import BadRows, as_dead_letters, read_dead_letters, settle_rejects, topic_name
from changemill.tables.state_table import StateTable

ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])


def spec(**kw):
    tables = kw.pop("tables", (TableSpec("shop", "a", ROW, ("id",)), TableSpec("shop", "b", ROW, ("id",), target_table="bees")))
    return PipelineSpec(1, 2, "mysql", "shop", tables, **{"frequency": "manual", **kw})


def test_spec_problems():
    assert spec().problems() == []
    assert spec(key_mode="none").problems() == ["upsert needs a key, key mode is none", "hard deletes need the key mode record_key"]
    assert spec(tables=()).problems() == ["no enabled table"]
    assert "without a primary key: shop.k" in spec(tables=(TableSpec("shop", "k", ROW),)).problems()[0]
    assert spec(insert_mode="other").problems() == ["unknown insert mode 'other'"]
    twice = (TableSpec("shop", "a", ROW, ("id",), "x"), TableSpec("shop", "b", ROW, ("id",), "x"))
    assert spec(tables=twice).problems() == ["target x is used twice"]
    with pytest.raises(ValueError):
        Pipeline(None, spec(tables=()), "x").run(None, "y")


def test_tables_join_and_leave_a_pipeline(spark, rows):
    offsets = spark.createDataFrame([("p.shop.a", 5), ("p.shop.b", 6)], "topic string, off bigint")
    less, kept = targets.remove_tables(spark, spec(), ["a"], offsets)
    assert [t.target for t in less.enabled_tables] == ["bees"] and rows(kept, "topic") == [("p.shop.b",)]
    with pytest.raises(ValueError):
        less.without_tables({"b"})
    assert less.without_tables({"b"}, allow_empty=True).enabled_tables == ()
    more, to_read = targets.add_tables(less, [TableSpec("shop", "a", ROW, ("id",)), TableSpec("shop", "c", ROW, ("id",), "sea")])
    assert sorted(t.target for t in more.enabled_tables) == ["bees", "sea", "shop_a"] and to_read == ["shop.a", "shop.c"]
    assert rows(more.mapping(spark), "source_table", "target_table", "is_enabled") == [("a", "shop_a", True), ("b", "bees", True), ("c", "sea", True)]


def test_targets(spark):
    assert targets.create_target(spark, "made", ROW) and not targets.create_target(spark, "made", ROW)
    assert spark.table("made").schema.names == ["id", "v"]
    for bad in (lambda: targets.create_target(spark, "x", ROW, source="x"), lambda: targets.create_target(spark, "x", T.StructType())):
        with pytest.raises(ValueError):
            bad()
    spark.createDataFrame([(1, "a")], ROW).write.insertInto("made")
    assert targets.truncate_targets(spark, ["made", "missing"]) == (1, 0)
    assert spark.table("made").count() == 0 and spark.table("made").schema.names == ["id", "v"]
    assert targets.rename_target(spark, "made", None) == "failed"
    assert targets.rename_target(spark, "gone", "x") == "old_missing"
    assert targets.rename_target(spark, "made", "moved") == "applied"
    assert targets.create_target(spark, "made", ROW) and targets.rename_target(spark, "moved", "made") == "new_exists"
    with pytest.raises(PermissionError):
        targets.drop_targets(spark, ["made"])
    assert targets.drop_targets(spark, ["made", "moved", "missing"], allowed=True) == 2


def test_full_refresh_swaps_versions(spark):
    assert targets.full_refresh(spark, "fresh", spark.range(3))
    assert spark.table("fresh").count() == 3
    assert not targets.full_refresh(spark, "fresh", spark.range(9), drop_before_sync=False)
    # a refresh may read the table it replaces
    assert targets.full_refresh(spark, "fresh", spark.table("fresh").where("id > 0"))
    assert sorted(r.id for r in spark.table("fresh").collect()) == [1, 2]
    assert len([t for t in spark.catalog.listTables() if t.name.startswith("fresh_load_")]) == 1


def test_dead_letters(spark, rows, tmp_path):
    bad = spark.createDataFrame([("t", 0, 5, "boom")], "topic string, part int, off bigint, why string")
    letters = as_dead_letters(bad, "decode", F.col("why"), batch_id=3)
    with pytest.raises(BadRows, match="decode: boom"):
        settle_rejects(letters, "none", str(tmp_path / "x"))
    settle_rejects(letters.limit(0), "none", str(tmp_path / "x"))
    for _ in range(2):  # a replay overwrites its own partition
        settle_rejects(letters, "all", str(tmp_path / "dlq"))
    settle_rejects(as_dead_letters(bad, "decode", F.col("why"), batch_id=4), "all", str(tmp_path / "dlq"))
    kept = read_dead_letters(spark, str(tmp_path / "dlq"))
    assert rows(kept, "batch_id", "off", "error_class") == [(3, 5, "boom"), (4, 5, "boom")]
    assert json.loads(kept.first().payload)["why"] == "boom"
    assert topic_name(1) == "client_1.dlq" and topic_name(1, 2) == "client_1_db_2.dlq"


def test_jdbc_options():
    options = jdbc.writer_options("jdbc:x", "t", {"user": "u"}, connections=4)
    assert options == {"user": "u", "url": "jdbc:x", "dbtable": "t", "batchsize": "3000", "truncate": "true", "numPartitions": "4"}


@pytest.mark.parametrize("frequency,options", [("realtime", {"processingTime": "0 seconds"}), ("15min", {"processingTime": "15 minutes"}), ("hourly", {"processingTime": "60 minutes"}), ("manual", {"availableNow": True})])
def test_triggers(frequency, options):
    assert trigger_options(frequency) == options


def feed_files(spark, events, folder, files=3):
    df = spark.createDataFrame(events, "topic string, part int, off bigint, op string, id bigint, v string")
    messages = encode_envelope(df, ["id", "v"], ["id"]).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    messages.select(*FEED_SCHEMA.names).repartitionByRange(files, "off").write.mode("append").parquet(f"{folder}/feed")
    return f"{folder}/feed"


def test_pipeline_applies_all_tables_and_recovers(spark, rows):
    folder = run_dir(spark, "pipe")
    a, b, other = "client_1_db_2_v_1.shop.a", "client_1_db_2_v_1.shop.b", "client_1_db_9_v_1.shop.a"
    path = feed_files(spark, [(a, 0, 1, "c", 1, "x"), (b, 0, 1, "c", 1, "y"), (other, 0, 1, "c", 8, "no"), (a, 0, 2, "u", 1, "z"), (a, 0, 3, "c", 2, "w")], folder)
    pipeline = Pipeline(spark, spec(), folder, "pipe")
    pipeline.run(read_files(spark, path, True, 1), f"{folder}/ck").awaitTermination()
    assert rows(pipeline.state(pipeline.spec.tables[0]).current(), "id", "v") == [(1, "z"), (2, "w")]
    # more data, same checkpoint: only the new file is applied
    feed_files(spark, [(a, 0, 4, "d", 2, None), (b, 0, 2, "t", None, None)], folder, 1)
    pipeline.run(read_files(spark, path, True, 1), f"{folder}/ck").awaitTermination()
    assert rows(pipeline.state(pipeline.spec.tables[0]).current(), "id", "v") == [(1, "z")]
    assert pipeline.state(pipeline.spec.tables[1]).current().count() == 0
    # position lost: a new checkpoint on the kept state gives the same rows
    again = Pipeline(spark, spec(), folder, "pipe")
    again.recover(read_files(spark, path, True, 2), f"{folder}/ck2").awaitTermination()
    assert rows(again.state(again.spec.tables[0]).current(), "id", "v") == [(1, "z")]
    # a restart of the recovered stream, in a process that knows nothing of it, goes on counting
    feed_files(spark, [(a, 0, 5, "u", 1, "new"), (a, 0, 6, "c", 7, "n")], folder, 1)
    Pipeline(spark, spec(), folder, "pipe").run(read_files(spark, path, True, 2), f"{folder}/ck2").awaitTermination()
    assert rows(again.state(again.spec.tables[0]).current(), "id", "v") == [(1, "new"), (7, "n")]
    # a checkpoint that the state does not know is refused, not skipped
    with pytest.raises(ValueError, match="recover"):
        Pipeline(spark, spec(), folder, "pipe").run(read_files(spark, path, True, 2), f"{folder}/ck3")


def test_tolerance_none_stops_the_stream_and_loses_nothing(spark, rows):
    folder = run_dir(spark, "strict")
    topic = "client_1_db_2_v_1.shop.a"
    path = feed_files(spark, [(topic, 0, 1, "c", 1, "x")], folder, 1)
    bad = spark.createDataFrame([(topic, 0, 2, None, None, "{broken")], FEED_SCHEMA)
    bad.write.mode("append").parquet(path)
    pipeline = Pipeline(spark, spec(), folder, "strict")
    with pytest.raises(Exception, match="malformed_json"):
        pipeline.run(read_files(spark, path, True), f"{folder}/ck").awaitTermination()
    lenient = Pipeline(spark, spec(tolerance="all"), folder, "strict")
    lenient.run(read_files(spark, path, True), f"{folder}/ck").awaitTermination()
    assert rows(lenient.state(lenient.spec.tables[0]).current(), "id", "v") == [(1, "x")]
    assert rows(read_dead_letters(spark, f"{folder}/dead_letters/shop_a"), "off", "error_class") == [(2, "malformed_json")]


def test_a_failed_batch_comes_again(spark, rows):
    folder = run_dir(spark, "outage")
    path = feed_files(spark, [("t", 0, 1, "c", 1, "x"), ("t", 0, 2, "c", 2, "y")], folder, 1)
    state = StateTable(spark, "outage", ["topic", "id"], folder, buckets=2)
    apply = fold_into(state, lambda b: b.select("topic", "off", F.get_json_object("value", "$.op").alias("op"), F.get_json_object("key", "$.id").cast("long").alias("id")))

    def down(batch, batch_id):
        raise MetadataUnavailable("schema registry does not answer")

    with pytest.raises(Exception, match="does not answer"):
        start(read_files(spark, path, True), down, f"{folder}/ck").awaitTermination()
    start(read_files(spark, path, True), apply, f"{folder}/ck").awaitTermination()
    assert rows(state.current(), "id") == [(1,), (2,)]


def test_tables_are_read_again_in_every_batch(spark, rows):
    folder = run_dir(spark, "dynamic")
    a, b = "client_1_db_2_v_1.shop.a", "client_1_db_2_v_1.shop.b"
    path = feed_files(spark, [(a, 0, 1, "c", 1, "x"), (b, 0, 1, "c", 1, "y")], folder, 1)
    full = spec()
    only_a, none = full.without_tables({"b"}), full.without_tables({"a", "b"}, allow_empty=True)
    answers = iter([only_a, none, full])
    pipeline = Pipeline(spark, only_a, folder, "dynamic", lambda: next(answers))
    for number in (1, 2, 3):
        if number > 1:
            feed_files(spark, [(a, 0, number, "c", number, "x"), (b, 0, number, "c", number, "y")], folder, 1)
        pipeline.run(read_files(spark, path, True), f"{folder}/ck").awaitTermination()
    assert rows(pipeline.state(full.tables[0]).current(), "id") == [(1,), (2,), (3,)]
    assert rows(pipeline.state(full.tables[1]).current(), "id") == [(3,)]


def test_a_paused_pipeline_stops_before_the_batch_and_resumes(spark, rows):
    folder = run_dir(spark, "paused")
    path = feed_files(spark, [("client_1_db_2_v_1.shop.a", 0, 1, "c", 1, "x")], folder, 1)
    state = {"sink": "PAUSED"}
    control = lambda: spark.createDataFrame([("paused", "RUNNING", state["sink"])], "pipeline string, source_state string, sink_state string")
    pipeline = Pipeline(spark, spec(), folder, "paused", control=control)
    with pytest.raises(Exception, match="is paused"):
        pipeline.run(read_files(spark, path, True), f"{folder}/ck").awaitTermination()
    state["sink"] = "RUNNING"
    pipeline.run(read_files(spark, path, True), f"{folder}/ck").awaitTermination()
    assert rows(pipeline.state(pipeline.spec.tables[0]).current(), "id") == [(1,)]


def test_base_is_bucketed_by_key_and_joins_without_a_shuffle(spark):
    folder = run_dir(spark, "bucketed")
    state = StateTable(spark, "bucketed", ["topic", "id"], folder, buckets=4)
    state.apply(spark.range(1000).select(F.lit("t").alias("topic"), "id", F.col("id").alias("off"), F.lit("c").alias("op")), 0)
    state.compact()
    base = spark.table("bucketed_base_1")
    assert base.select("_metadata.file_path").distinct().count() <= 4
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = base.join(base.select("topic", "id", "off"), ["topic", "id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_may_run(spark):
    control = spark.createDataFrame([("p", "RUNNING", "PAUSED"), ("q", "RUNNING", "RUNNING")], "pipeline string, source_state string, sink_state string")
    assert [may_run(control, p) for p in ("p", "q", "r")] == [False, True, False]


def test_casts_reject_what_does_not_fit(spark, rows):
    folder = run_dir(spark, "casts")
    topic = "client_1_db_2_v_1.shop.a"
    path = feed_files(spark, [(topic, 0, 1, "c", 1, "12"), (topic, 0, 2, "c", 2, "abc")], folder, 1)
    tables = (TableSpec("shop", "a", ROW, ("id",), casts={"v": "int"}),)
    pipeline = Pipeline(spark, spec(tables=tables, tolerance="all"), folder, "casts")
    pipeline.run(read_files(spark, path, True), f"{folder}/ck").awaitTermination()
    assert rows(pipeline.state(tables[0]).current(), "id", "v") == [(1, 12)]
    assert rows(read_dead_letters(spark, f"{folder}/dead_letters/shop_a"), "off", "error_class") == [(2, "cast:v")]


def test_ddl_stream_records_what_applies_waits_and_cannot_be_parsed(spark, rows):
    folder = run_dir(spark, "ddl")
    texts = ["ALTER TABLE t ADD a INT, DROP COLUMN b, ADD c VARCHAR(5)", "ALTER TABLE t ADD CHECK ((a > 0))", "ALTER TABLE gone ADD x INT", "GRANT ALL ON t TO u"]
    df = spark.createDataFrame([(i, i, "mysql", "gone" if "gone" in t else "t", t) for i, t in enumerate(texts)], "ddl_id bigint, off bigint, system string, tbl string, ddl string")
    df.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
    have = spark.createDataFrame([("t",)], "tbl string")
    start(stream, record_into(f"{folder}/out", lambda: have), f"{folder}/ck").awaitTermination()
    got = rows(read_operations(spark, f"{folder}/out", ("apply", "pending_approval", "blocked", "dead_letter")), "off", "clause_no", "operation", "column_name", "type_name", "status")
    assert got == [
        (0, 0, "ADD_COLUMN", "a", "int", "apply"), (0, 1, "DROP_COLUMN", "b", None, "pending_approval"),
        (0, 2, "ADD_COLUMN", "c", "string", "blocked"), (1, 0, "UNKNOWN", None, None, "dead_letter"),
    ]
    assert rows(read_operations(spark, f"{folder}/out"), "column_name") == [("a",)]


def test_progress_rows(spark):
    log = ProgressLog(keep=2)
    log.rows = [("q", 0, 5, "2024-01-01T00:00:00Z")]
    assert tuple(log.as_rows(spark).first()) == ("q", 0, 5, "2024-01-01T00:00:00Z")


def test_lookups_and_measured_sides_have_a_known_size(spark):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(plan(lookup(spark, [("a", 1)], "k string,n int")))) < 1000
    assert int(str(plan(measured(spark.range(100).groupBy((F.col("id") % 3).alias("k")).count())))) < 1000


@pytest.mark.parametrize(
    "mode,first,second,refused",
    [
        ("insert", [(1, "x"), (2, "y")], [(1, "x"), (2, "y"), (3, "n")], [(3, "key_exists")]),
        ("update", [], [], []),
    ],
)
def test_insert_modes_in_the_stream_decide_alike_on_replay(spark, rows, mode, first, second, refused):
    folder = run_dir(spark, mode)
    topic = "client_1_db_2_v_1.shop.a"
    pipeline = Pipeline(spark, spec(insert_mode=mode, tolerance="all"), folder, f"mode_{mode}")
    table = pipeline.spec.tables[0]
    path = feed_files(spark, [(topic, 0, 1, "c", 1, "x"), (topic, 0, 2, "c", 2, "y")], folder, 1)
    for checkpoint in ("ck", "ck_again"):  # the second checkpoint replays batch 0 under the same number
        if checkpoint == "ck_again":
            pipeline._remember(f"{folder}/ck_again", 0)
        pipeline.run(read_files(spark, path, True), f"{folder}/{checkpoint}").awaitTermination()
        assert rows(pipeline.target_rows(table), "id", "v") == first
    feed_files(spark, [(topic, 0, 3, "c", 1, "again"), (topic, 0, 4, "c", 3, "n")], folder, 1)
    pipeline.run(read_files(spark, path, True), f"{folder}/ck").awaitTermination()
    assert rows(pipeline.target_rows(table), "id", "v") == second
    letters = read_dead_letters(spark, f"{folder}/dead_letters/shop_a").collect()
    assert sorted((r.off, r.error_class) for r in letters) == refused


def test_compaction_inside_the_stream_and_replays_after_it(spark, rows):
    folder = run_dir(spark, "compacting")
    topic = "client_1_db_2_v_1.shop.a"
    pipeline = Pipeline(spark, spec(insert_mode="insert", tolerance="all"), folder, "compacting", buckets=2, compact_every=2)
    path, table = None, pipeline.spec.tables[0]
    for number in range(4):
        path = feed_files(spark, [(topic, 0, number, "c", number, "x")], folder, 1)
        pipeline.run(read_files(spark, path, True), f"{folder}/ck").awaitTermination()
    assert pipeline.state(table)._version() == 2 and pipeline.state(table)._batches() == []
    # batch 0 of another checkpoint is one that the base covers: no row changes, none is refused
    pipeline._remember(f"{folder}/ck_again", 0)
    pipeline.run(read_files(spark, path, True), f"{folder}/ck_again").awaitTermination()
    assert rows(pipeline.target_rows(table), "id") == [(0,), (1,), (2,), (3,)]
    assert read_dead_letters(spark, f"{folder}/dead_letters/shop_a").count() == 0


def test_rows_of_a_second_partition_are_applied(spark, rows):
    folder = run_dir(spark, "partitions")
    topic = "client_1_db_2_v_1.shop.a"
    path = feed_files(spark, [(topic, 0, 1, "c", 1, "x"), (topic, 1, 1, "t", None, None)], folder, 1)
    pipeline = Pipeline(spark, spec(tolerance="all"), folder, "partitions")
    pipeline.run(read_files(spark, path, True), f"{folder}/ck").awaitTermination()
    assert rows(pipeline.target_rows(pipeline.spec.tables[0]), "id") == [(1,)]
    # a truncate empties its own partition: offsets do not compare with those of others
    assert rows(read_dead_letters(spark, f"{folder}/dead_letters/shop_a"), "part", "error_class") == []


def test_delete_modes(spark, rows):
    topic = "client_1_db_2_v_1.shop.a"
    for mode, expected in (("hard", [(2, None)]), ("soft", [(1, True), (2, False)]), ("ignore", [(1, None), (2, None)])):
        folder = run_dir(spark, mode)
        pipeline = Pipeline(spark, spec(delete_mode=mode), folder, f"deletes_{mode}")
        path = feed_files(spark, [(topic, 0, 1, "c", 1, "x"), (topic, 0, 2, "c", 2, "y"), (topic, 0, 3, "d", 1, "x")], folder, 1)
        pipeline.run(read_files(spark, path, True), f"{folder}/ck").awaitTermination()
        out = pipeline.target_rows(pipeline.spec.tables[0])
        flag = "__deleted" if mode == "soft" else F.lit(None).alias("__deleted")
        assert rows(out.select("id", flag)) == expected


def test_declared_constraints_are_validated(spark, rows):
    folder = run_dir(spark, "constraints")
    a, b = "client_1_db_2_v_1.shop.a", "client_1_db_2_v_1.shop.b"
    tables = (
        TableSpec("shop", "a", ROW, ("id",), unique=(("v",),), foreign_keys=(("id", "shop_b", "id"),)),
        TableSpec("shop", "b", ROW, ("id",), unique=(("v",),)),
    )
    pipeline = Pipeline(spark, spec(tables=tables), folder, "constraints")
    path = feed_files(spark, [(a, 0, 1, "c", 1, "x"), (a, 0, 2, "c", 2, "x"), (b, 0, 1, "c", 1, "p"), (b, 0, 2, "c", 9, "q")], folder, 1)
    pipeline.run(read_files(spark, path, True), f"{folder}/ck").awaitTermination()
    assert rows(pipeline.constraint_violations()) == [("shop_a", "reference", "id", 1), ("shop_a", "unique", "v", 1)]


def test_missing_row_schema_holds_the_stream(spark):
    folder = run_dir(spark, "noschema")
    path = feed_files(spark, [("client_1_db_2_v_1.shop.a", 0, 1, "c", 1, "x")], folder, 1)
    pipeline = Pipeline(spark, spec(tables=(TableSpec("shop", "a", T.StructType(), ("id",)),)), folder, "noschema")
    with pytest.raises(Exception, match="no row schema"):
        pipeline.run(read_files(spark, path, True), f"{folder}/ck").awaitTermination()


def test_soft_deletes_keep_the_last_image_over_batches_and_compaction(spark):
    schema = "topic string, id int, off bigint, op string, v string, w int"
    state = StateTable(spark, "soft_images", ["topic", "id"], run_dir(spark, "soft"), buckets=2, keep_images=True)
    batch = lambda *rows: spark.createDataFrame([("t", *r) for r in rows], schema)
    state.apply(batch((1, 1, "c", "x", 1), (2, 2, "c", "y", 2), (3, 3, "c", "z", None)), 0)
    state.compact()
    state.apply(batch((1, 4, "d", None, None), (3, 5, "u", "zz", 3), (3, 6, "d", None, None)), 1)
    state.apply(batch((1, 7, "d", None, None)), 2)  # the tombstone behind the delete
    expected = [(1, "x", 1, True), (2, "y", 2, False), (3, "zz", 3, True)]
    found = lambda: sorted((r.id, r.v, r.w, r["__deleted"]) for r in state.soft_deleted().collect())
    assert found() == expected
    state.compact()
    assert found() == expected
    assert sorted(r.id for r in state.current().collect()) == [2]
