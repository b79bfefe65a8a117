import random

import pytest
from pyspark.sql import functions as F

from changemill import session
from changemill.operators import keys, monitor, ordering, reconcile
from changemill.spec import missing_key_message, missing_key_report


def test_global_rank_is_the_row_number_of_the_whole(spark, rows):
    values = random.Random(5).sample(range(10**6), 500)
    df = spark.createDataFrame([(v % 7, v) for v in values], "a bigint, b bigint")
    ranked = ordering.global_rank(df.repartition(5), ["a", "b"])
    expected = sorted((v % 7, v) for v in values)
    assert rows(ranked.orderBy("rank"), "rank", "a", "b") == sorted(((i, *e) for i, e in enumerate(expected)), key=repr)


@pytest.mark.parametrize("following", [False, True])
def test_nearest_in_group_across_slices(spark, following):
    rng = random.Random(3)
    data = sorted({(rng.choice("xy"), rng.randrange(200)) for _ in range(120)})
    df = spark.createDataFrame([(g, t, None if t % 3 else t * 2) for g, t in data], "g string, t bigint, v bigint")
    values = {"p": F.col("v"), "q": F.when(F.col("t") % 2 == 0, F.col("t"))}
    out = ordering.nearest_in_group(df, ["g"], ["t"], values, F.floor(F.col("t") / 10), following)
    for r in out.collect():
        near = [t for g, t in data if g == r.g and (t > r.t if following else t < r.t)]
        pick = min if following else max
        threes, evens = [t for t in near if t % 3 == 0], [t for t in near if t % 2 == 0]
        assert (r.p, r.q) == (pick(threes) * 2 if threes else None, pick(evens) if evens else None)


def test_last_rows(spark, rows):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 4)], "g string, id int")
    assert rows(ordering.last_rows(df, ["id"], 3), "id") == [(6,), (7,), (8,)]
    assert rows(ordering.last_rows(df, ["id"], 2, ["g"])) == [("a", 7), ("a", 8), ("b", 4)]


def test_foreign_key_targets_fall_back_in_order(spark, rows):
    mapping = spark.createDataFrame([("orders", "t1"), ("ORDERS", "t2"), ("APP.ITEMS", "t3"), ("app.parts", "t4")], "source_table string, target_table string")
    fks = spark.createDataFrame(
        [(1, "mysql", "db", "orders", None), (2, "oracle", "db", "Orders", None), (3, "oracle", "db", "items", "app"), (4, "oracle", "db", "items", None),
         (5, "mssql", "db", "parts", "app"), (6, "mssql", "db", "parts", None), (7, "mysql", "db", "ITEMS", None)],
        "fk_id int, system string, db string, referred_table string, referred_schema string",
    )
    assert rows(keys.foreign_key_targets(fks, mapping), "fk_id", "target_table") == [
        (1, "t1"), (2, "t2"), (3, "t3"), (4, "t3"), (5, "t4"), (6, "db_parts"), (7, "db_ITEMS")
    ]


def test_constraint_names_are_cut(spark):
    df = spark.createDataFrame([("t" * 70, "c")], "t string, c string")
    row = df.select(keys.foreign_key_name(F.col("t"), F.col("c")), keys.index_name(F.col("t"), F.col("c"))).first()
    assert row == (("fk_" + "t" * 70)[:64], ("idx_" + "t" * 70)[:64])


def test_duplicates_exempt_blanks_and_orphans_exempt_nulls(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), (" ", 2), (" ", 2), (None, 3), (None, 3)], "k string, n int")
    assert rows(keys.duplicate_keys(df, ["k"])) == [("a", 2)]
    parent = spark.createDataFrame([("a",)], "id string")
    assert rows(keys.orphans(df, parent, {"k": "id"})) == [(" ", 2), (" ", 2), ("b", 1)]
    assert rows(keys.orphan_counts(df, parent, {"k": "id"})) == [(" ", 2), ("b", 1)]
    people = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "id int, mail string")
    assert rows(keys.value_taken(people, "mail", "x", "id", 1)) == [(2, "x")]


def test_row_diff_is_null_safe(spark, rows):
    a = spark.createDataFrame([(1, "x", None), (2, "y", 2), (3, None, 3), (4, "s", 4)], "k int, v string, n int")
    b = spark.createDataFrame([(1, "x", None), (2, "y", None), (3, "z", 4), (5, "s", 4)], "k int, v string, n int")
    assert rows(reconcile.row_diff(a, b, ["k"])) == [(1, "same", None), (2, "different", "n"), (3, "different", "v,n"), (4, "missing", None), (5, "extra", None)]
    assert rows(reconcile.row_diff_summary(a, b, ["k"])) == [("different", 2), ("extra", 1), ("missing", 1), ("same", 1)]
    empty = spark.createDataFrame([(1, None, "")], "k int, v string, w string")
    swapped = spark.createDataFrame([(1, "", None)], "k int, v string, w string")
    assert rows(reconcile.row_diff_summary(empty, swapped, ["k"])) == [("different", 1)]


def test_counts_and_emptiness(spark, rows):
    tables = {"a": spark.range(5), "b": spark.range(0)}
    assert rows(reconcile.row_counts(tables)) == [("a", 5), ("b", 0)]
    assert rows(reconcile.non_empty_tables(tables)) == [("a",)]


def test_sync_status_cases(spark):
    import datetime as dt

    now, old = dt.datetime(2024, 1, 2, 12), dt.datetime(2023, 1, 1)
    pipelines = spark.createDataFrame(
        [("same", old, now, False, old), ("differs", old, now, True, old), ("down", old, now, False, None), ("fresh", now, now, True, None), ("empty", old, now, False, None)],
        "pipeline string, created_at timestamp_ntz, checked_at timestamp_ntz, snapshot_running boolean, last_success_at timestamp_ntz",
    )
    compared = spark.createDataFrame(
        [("same", None, None, True), ("differs", None, None, True), ("differs", None, "table_not_found", False), ("down", "db_unreachable", None, False), ("fresh", None, None, False)],
        "pipeline string, source_error string, target_error string, in_sync boolean",
    )
    got = {r.pipeline: (r.status, r.last_fully_synced) for r in reconcile.sync_status(pipelines, compared).collect()}
    assert got == {
        "same": ("rows_in_sync", now), "differs": ("not_synced", old), "down": ("unable_to_check", None),
        "fresh": ("snapshot_in_progress", None), "empty": ("unable_to_check", None),
    }


def test_health_and_incidents(spark, rows):
    import datetime as dt

    states = [
        ("RUNNING", False, "RUNNING", False), ("RUNNING", True, "RUNNING", False), ("FAILED", False, "RUNNING", False), ("PAUSED", False, "RUNNING", False),
        ("NOT_FOUND", False, "RUNNING", False), ("RUNNING", False, "NOT_CONFIGURED", False), ("RUNNING", False, "RUNNING", False), ("FAILED", False, "FAILED", False),
    ]
    samples = spark.createDataFrame(
        [("p", i, dt.datetime(2024, 1, 1, i, 59), *s) for i, s in enumerate(states)],
        "pipeline string, check_id bigint, ts timestamp_ntz, source_state string, source_task_failed boolean, sink_state string, sink_task_failed boolean",
    )
    health = [h for _, h in rows(samples.select("check_id", monitor.overall_health().alias("h")))]
    assert health == ["healthy", "degraded", "degraded", "healthy", "unhealthy", "unhealthy", "healthy", "degraded"]
    found = rows(monitor.incidents(samples).select("event_type", "opened_by", F.hour("resolved_at")))
    assert found == [("connector_missing", 4, 6), ("sink_failed", 7, None), ("source_failed", 1, 3), ("source_failed", 7, None)]
    assert rows(monitor.health_rollup(samples)) == [("p", 8, 3, 3, 2)]


def test_failed_tasks(spark):
    df = spark.createDataFrame([([("RUNNING",), ("FAILED",)],), ([("RUNNING",)],), (None,)], "tasks array<struct<state:string>>")
    assert [r[0] for r in df.select(monitor.has_failed_task(F.col("tasks"))).collect()] == [True, False, False]


def test_badges_and_connection_health(spark, rows):
    sinks = spark.createDataFrame([(1, "RUNNING"), (1, "FAILED"), (2, "RUNNING"), (2, "PAUSED"), (3, "RUNNING"), (4, "RUNNING"), (4, "NOT_CREATED")], "client int, state string")
    assert rows(monitor.sink_badges(sinks, "client")) == [(1, "FAILED"), (2, "PAUSED"), (3, "RUNNING"), (4, "UNKNOWN")]
    connections = spark.createDataFrame([(1,), (2,), (3,), (5,)], "connection int")
    health = monitor.connection_health(sinks.withColumnRenamed("client", "connection"), connections)
    assert rows(health, "connection", "health") == [(1, "degraded"), (2, "partial"), (3, "healthy"), (5, "no_connectors")]


def test_lag_histogram_dead_letters_heartbeats(spark, rows):
    high = spark.createDataFrame([("t", 0, 10), ("t", 1, 10), ("t", 2, 10)], "topic string, part int, high bigint")
    done = spark.createDataFrame([("t", 0, 4), ("t", 1, -1)], "topic string, part int, committed bigint")
    assert rows(monitor.consumer_lag(high, done), "part", "lag") == [(0, 6), (1, 10), (2, 10)]
    offsets = spark.createDataFrame([("d", 5, 9), ("d", 9, 3), ("e", 1, 1)], "topic string, low bigint, high bigint")
    assert rows(monitor.dead_letter_counts(offsets)) == [("d", 4), ("e", 0)]
    seconds = spark.createDataFrame([("g", 0.005), ("g", 0.1), ("g", 7.0), ("g", 99.0)], "g string, s double")
    counts = dict((le, n) for _, le, n in rows(monitor.latency_histogram(seconds, F.col("s"), ["g"])))
    assert counts == {"0.01": 1, "0.05": 1, "0.1": 2, "0.5": 2, "1.0": 2, "5.0": 2, "10.0": 3, "+Inf": 4}
    for bounds in (monitor.CONNECTION_BUCKETS, monitor.DISCOVERY_BUCKETS, monitor.CREATION_BUCKETS):
        assert monitor.latency_histogram(seconds, F.col("s"), ["g"], bounds).count() == len(bounds) + 1
    topics = spark.createDataFrame([("__source-heartbeat.p",), ("p.s.heartbeat",)], "topic string")
    assert rows(monitor.without_heartbeats(topics)) == [("p.s.heartbeat",)]


def test_missing_key_reports(spark):
    assert missing_key_message(["a"]) == "tables without a primary key: a"
    assert missing_key_message([str(i) for i in range(12)]).endswith("and 2 more")
    catalog = spark.createDataFrame([(f"t{i:02d}", "c", i < 2) for i in range(14)], "tbl string, name string, is_key boolean")
    row = missing_key_report(catalog).first()
    assert row.n == 12 and row.message.startswith("t02, t03") and row.message.endswith("t11 and 2 more")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_only_verdicts_of_hot_keys_are_multiplied(spark, rows, monkeypatch, how):
    monkeypatch.setattr(session, "HOT", 20)
    keys = [1] * 100 + [2] * 20 + [3, None, None, 9]
    left = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k bigint, i int").repartition(4)
    verdicts = spark.createDataFrame([(k, f"v{k}") for k in range(1, 9)], "k bigint, v string")
    salted, everywhere = session.spread(left, verdicts, ["k"])
    assert everywhere.count() == 8 + session.SALTS - 1
    assert salted.where("k = 1").select("_salt").distinct().count() == 4
    assert salted.where("k IN (2, 3, 9)").select("_salt").distinct().count() == 1
    for large in (False, True):
        found = session.join_spread(left, verdicts, ["k"], how, large=large)
        assert rows(found) == rows(left.join(verdicts, "k", how))
