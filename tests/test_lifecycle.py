"""Tables that leave and join a pipeline, resyncs, the queue of a paused pipeline, files of dropped tables."""

import os

import pytest
from pyspark.sql import types as T

from changemill.session import run_dir
from changemill.spec import PipelineSpec, TableSpec
from changemill.streaming.apply import Pipeline
from changemill.streaming.queue import TruncateQueue
from changemill.tables import targets
from changemill.tables.state_table import StateTable

ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
CHANGES = "topic string, part int, off long, op string, id long, v string"


def changes(spark, *events):
    return spark.createDataFrame(list(events), CHANGES)


def test_names_of_several_schemas(spark, rows):
    tables = (TableSpec("sales", "users", ROW, ("id",)), TableSpec("hr", "users", ROW, ("id",)), TableSpec("hr", "jobs", ROW, ("id",)))
    spec = PipelineSpec(1, 2, "mysql", "shop", tables)
    assert [t.target for t in spec.without_tables({"sales.users"}).enabled_tables] == ["hr_users", "hr_jobs"]
    assert [t.target for t in spec.without_tables({"jobs"}).enabled_tables] == ["sales_users", "hr_users"]
    with pytest.raises(ValueError, match="several schemas"):
        spec.without_tables({"users"})
    offsets = spark.createDataFrame([("client_1_db_2_v_1.sales.users", 5), ("client_1_db_2_v_1.hr.users", 6)], "topic string, off bigint")
    _, kept = targets.remove_tables(spark, spec, ["sales.users"], offsets)
    assert rows(kept, "topic") == [("client_1_db_2_v_1.hr.users",)]


def test_resync_twice_gives_the_same_and_nothing_older_comes_back(spark, rows):
    state = StateTable(spark, "resynced", ["topic", "id"], run_dir(spark, "resync"), buckets=2)
    state.apply(changes(spark, ("t", 0, 1, "c", 1, "a"), ("t", 0, 2, "c", 2, "b"), ("t", 0, 9, "c", 3, "new"), ("t", 0, 10, "u", 1, "newer")), 0)
    reads = spark.createDataFrame([(1, "read"), (4, "read")], ROW)
    for _ in range(2):
        state.resync(reads, "t", 5)
        assert rows(state.current(), "id", "v", "off") == [(1, "newer", 10), (3, "new", 9), (4, "read", 5)]
    # a replay under new batch numbers brings nothing older back
    state.apply(changes(spark, ("t", 0, 2, "c", 2, "b"), ("t", 0, 3, "c", 4, "old"), ("t", 0, 11, "d", 3, None)), state.next_batch())
    assert rows(state.current(), "id", "v", "off") == [(1, "newer", 10), (4, "read", 5)]
    assert rows(state.commit_positions(), "part", "commit_position") == [(0, 12)]


def test_resync_of_a_state_without_rows(spark, rows):
    state = StateTable(spark, "unborn", ["topic", "id"], run_dir(spark, "unborn"), buckets=2)
    state.resync(None, "t", 5)
    state.resync(spark.createDataFrame([(1, "read")], ROW), "t", 5)
    state.apply(changes(spark, ("t", 0, 4, "c", 1, "old"), ("t", 0, 5, "t", None, None), ("t", 0, 6, "c", 2, "new")), state.next_batch())
    assert rows(state.current(), "id", "v") == [(2, "new")]


def test_files_of_dropped_parts_are_gone(spark):
    folder = run_dir(spark, "disk")
    state = StateTable(spark, "disk", ["topic", "id"], folder, buckets=2)
    for n in range(5):
        state.apply(changes(spark, *[("t", 0, n * 10 + i, "u", i, str(n)) for i in range(10)]), n)
        state.compact()
    names = sorted(d for d in os.listdir(folder) if d.startswith("disk_"))
    assert names == ["disk_base_4", "disk_base_5", "disk_changes", "disk_versions"]
    assert [d for d in os.listdir(f"{folder}/disk_changes") if d.startswith("batch_id")] == []
    assert state.current().count() == 10
    state.drop()
    assert [d for d in os.listdir(folder) if d.startswith("disk_")] == []


def test_queue_holds_a_table_once_and_keeps_what_fails(spark, rows):
    queue = TruncateQueue(spark, "queued", run_dir(spark, "queue"))
    assert queue.pending().count() == 0 and queue.drain(lambda topic, off: True) == []
    batch = spark.createDataFrame([("a", 5), ("a", 9), ("b", 7)], "topic string, off bigint")
    for _ in range(2):
        queue.enqueue(batch, 0)
    queue.enqueue(batch.limit(0), 1)
    assert rows(queue.pending(), "topic", "off") == [("a", 9), ("b", 7)]
    tried = []

    def carry_out(topic, off):
        tried.append(topic)
        if topic == "b" and len(tried) < 3:
            raise ConnectionError("down")
        return True

    assert queue.drain(carry_out) == [("a", 9, "applied"), ("b", 7, "failed")]
    assert queue.drain(carry_out) == [("b", 7, "applied")] and queue.drain(carry_out) == []
    queue.enqueue(spark.createDataFrame([("a", 9), ("b", 12)], "topic string, off bigint"), 2)  # read again, and a new one
    assert rows(queue.pending(), "topic", "off") == [("b", 12)]


def test_actions_on_tables_that_leave(spark, rows):
    folder = run_dir(spark, "leave")
    tables = tuple(TableSpec("shop", n, ROW, ("id",)) for n in "abc")
    pipeline = Pipeline(spark, PipelineSpec(1, 2, "mysql", "shop", tables, frequency="manual"), folder, "leave", buckets=2)
    for t in tables[:2]:
        pipeline.state(t).apply(changes(spark, (f"client_1_db_2_v_1.shop.{t.source_table}", 0, 3, "c", 1, "x")), 0)
    pipeline.remove_tables({"shop.a"}, "truncate")
    assert rows(pipeline.state(tables[0]).current()) == [] and [t.source_table for t in pipeline.spec.enabled_tables] == ["b", "c"]
    pipeline.remove_tables({"b"}, "keep")
    assert rows(pipeline.state(tables[1]).current(), "id") == [(1,)]
    with pytest.raises(ValueError, match="empty"):
        pipeline.remove_tables({"c"})
    pipeline.remove_tables({"c"}, "drop", allow_empty=True)  # it never had a state
    with pytest.raises(ValueError, match="unknown action"):
        pipeline.remove_tables({"a"}, "burn")


def test_incidents_do_not_depend_on_cuts(spark, rows):
    """Batches of any size, replayed ones too, give the incidents of all samples at once."""
    import random

    from changemill.operators import monitor
    from changemill.streaming.incidents import IncidentLog

    rnd = random.Random(4)
    states = ["RUNNING", "RUNNING", "FAILED", "PAUSED", "NOT_FOUND"]
    samples = [(f"p{rnd.randint(0, 2)}", i, i * 700, rnd.choice(states), rnd.random() < 0.2, rnd.choice(states), rnd.random() < 0.1) for i in range(160)]
    schema = "pipeline string, check_id long, at long, source_state string, source_task_failed boolean, sink_state string, sink_task_failed boolean"
    df = spark.createDataFrame(samples, schema).selectExpr("* EXCEPT (at)", "timestamp_seconds(at) AS ts")
    log, at, number = IncidentLog(spark, "cuts", run_dir(spark, "cuts")), 0, 0
    with pytest.raises(ValueError, match="no batch"):
        log.incidents()
    while at < len(samples):
        upto = at + rnd.choice([0, 1, 9, 40])
        batch = df.where(f"check_id >= {at} AND check_id < {upto}")
        log.on_batch(batch, number)
        if rnd.random() < 0.4:
            log.on_batch(batch, number)
        at, number = upto, number + 1
    found = rows(log.incidents())
    assert found == rows(monitor.incidents(df)) and len(found) > 10


def test_progress_beyond_what_the_driver_holds(spark, tmp_path):
    from types import SimpleNamespace

    from changemill.streaming.progress import ProgressLog

    log = ProgressLog(spark, str(tmp_path / "progress"), keep=3)
    for i in range(10):
        log.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(name="q", id=1, batchId=i, numInputRows=i, timestamp="t")))
    assert len(log.rows) == 1
    assert sorted(r.batch_id for r in log.as_rows(spark).collect()) == list(range(10))
