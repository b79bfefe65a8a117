"""Truncate ordering: due checks, retries, watermarks, subscriptions, queues."""

import pytest

from changemill.operators import truncates
from changemill.sources.feed import table_changes

PENDING = "tbl string, topic string, part int, off bigint"


def pending(spark, *offsets, topic="t"):
    return spark.createDataFrame([("orders", topic, 0, o) for o in offsets], PENDING)


def committed(spark, *values, topic="t"):
    return spark.createDataFrame([(topic, 0, v) for v in values], "topic string, part int, committed bigint")


@pytest.mark.parametrize("offset,due", [(3, True), (4, True), (5, False), (9, False)])
def test_due_only_past_the_committed_position(spark, offset, due):
    row = truncates.with_due(pending(spark, offset), committed(spark, 5)).first()
    assert row.is_due is due


def test_no_commit_is_not_due_and_unknown_follows_the_option(spark):
    assert truncates.with_due(pending(spark, 0), committed(spark, -1001)).first().is_due is False
    nothing = committed(spark, 5).limit(0)
    assert truncates.with_due(pending(spark, 0), nothing).first().is_due is False
    assert truncates.with_due(pending(spark, 0), nothing, on_unknown="apply").first().is_due is True


@pytest.mark.parametrize("position,ok,applied,left", [(2, True, 0, 1), (99, True, 1, 0), (99, False, 0, 1)])
def test_retry_outcomes(spark, position, ok, applied, left):
    topic = "pfx.db.orders"
    outcome = spark.createDataFrame([(topic, ok)], "topic string, resync_ok boolean")
    done, rest = truncates.settle(pending(spark, 7, topic=topic), committed(spark, position, topic=topic), outcome)
    assert (done.count(), rest.count()) == (applied, left)


@pytest.mark.parametrize("waiting,expected", [([7], 7), ([], 50), ([9, 7], 7)])
def test_commit_stops_at_the_first_pending_truncate(spark, waiting, expected):
    position = spark.createDataFrame([("pfx.db.orders", 0, 50)], "topic string, part int, position bigint")
    rows = truncates.commit_positions(position, pending(spark, *waiting, topic="pfx.db.orders")).collect()
    assert [r.commit_position for r in rows] == [expected]


def test_subscription_changes(spark, rows):
    def topics(*names):
        return spark.createDataFrame([(n,) for n in names], "topic string")

    one, two = topics("pfx.db.orders"), topics("pfx.db.orders", "pfx.db.customers")
    assert rows(table_changes(one, two)) == [("pfx.db.customers", "added")]
    assert rows(table_changes(two, one)) == [("pfx.db.customers", "removed")]
    assert rows(table_changes(one, one)) == []
    assert rows(table_changes(two, two.limit(0))) == []


def test_paused_pipelines_queue_each_table_once(spark, rows):
    queue = spark.createDataFrame([("p", "orders", 3)], "pipeline string, tbl string, off bigint")
    new = spark.createDataFrame([("p", "orders", 9), ("p", "items", 4), ("q", "orders", 1)], queue.schema)
    queued = truncates.enqueue(queue, new)
    assert rows(queued) == [("p", "items", 4), ("p", "orders", 9), ("q", "orders", 1)]
    control = spark.createDataFrame(
        [("p", "RUNNING", "PAUSED"), ("q", "RUNNING", "RUNNING")], "pipeline string, source_state string, sink_state string"
    )
    ready = truncates.drainable(queued, control)
    assert rows(ready) == [("q", "orders", 1)]
    assert rows(truncates.after_drain(queued, ready)) == [("p", "items", 4), ("p", "orders", 9)]
    assert rows(truncates.after_drain(queued, ready.limit(0))) == rows(queued)
