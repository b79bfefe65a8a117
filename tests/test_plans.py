"""Plans: no Python row functions, filters at the scan, pruned columns, partial aggregates, no
products of tables, small sides broadcast on their measured size."""

import re

import pytest

import __spark_entry__ as registry
from changemill.operators import fold

SF_DIR = "/root/testdata/sf0.001"
QUERIES = registry.QUERIES  # the library's own
BATCH = sorted(n for n in QUERIES if not n.startswith("stream_"))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_python_no_products(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


def test_fold_combines_before_the_shuffle_and_prunes(spark):
    text = plan(QUERIES["truncate_aware_state"](spark, SF_DIR))
    assert "partial_max_by" in text
    assert "props" not in re.findall(r"ReadSchema: (\S+)", text)[0]


def test_truncate_fold_runs_nothing_before_it_is_asked(spark):
    context, group = spark.sparkContext, "plan-time"
    context.setJobGroup(group, "no job may run while the plan is built")
    feed = spark.read.parquet(f"{SF_DIR}/events.parquet").selectExpr(
        "concat('t', user_id % 4) AS topic", "user_id", "event_id AS off", "CASE WHEN event_id % 100 = 49 THEN 't' ELSE 'u' END AS op", "value"
    )
    before = len(context.statusTracker().getJobIdsForGroup(group))
    df = fold.truncate_aware_state(feed, ["topic", "user_id"])
    assert len(context.statusTracker().getJobIdsForGroup(group)) == before
    assert df.count() > 0


def test_merge_leaves_the_state_unshuffled(spark):
    text = plan(QUERIES["merge_customer"](spark, SF_DIR))
    assert "LeftAnti" in text and "SortMergeJoin" not in text


def test_previews_keep_n_rows_per_task(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["preview_last3"](spark, SF_DIR))
    assert "WindowGroupLimit" in plan(QUERIES["preview_last3_per_table"](spark, SF_DIR))


def test_large_sides_are_joined_by_shuffle(spark):
    """With a broadcast threshold the sides exceed, the same queries shuffle and stay right."""
    name, old = "truncate_aware_state", spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.catalog.clearCache()
    expected = sorted(map(tuple, QUERIES[name](spark, SF_DIR).collect()))
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        df = QUERIES[name](spark, SF_DIR)
        assert "SortMergeJoin" in plan(df) and "BroadcastHashJoin" not in plan(df)
        assert sorted(map(tuple, df.collect())) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", ["insert_mode_rejects", "insert_mode_state"])
def test_an_insert_sink_does_not_broadcast_its_state(spark, name):
    """Compressed files make the keys of a table look small; the driver would have to hold them all."""
    assert re.search(r"SortMergeJoin \[c_custkey#\d+L, _salt#\d+\]", plan(QUERIES[name](spark, SF_DIR)))


@pytest.mark.parametrize("name", ["multi_table_state", "routed_feed"])
def test_a_measured_mapping_is_found_again_and_broadcast(spark, name):
    """Joined by shuffle, all rows of a table would meet its one mapping row in one task."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.catalog.clearCache()
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")  # below the tables, above the mapping
        text = plan(QUERIES[name](spark, SF_DIR))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "InMemoryTableScan" in text and "BroadcastHashJoin [db_id" in text
    assert "SortMergeJoin [db_id" not in text
