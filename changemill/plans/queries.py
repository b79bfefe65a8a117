"""Registered queries: each takes (spark, folder of the given tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changemill.functions import decode, envelope, names, types
from changemill.operators import (
    barriers,
    ddl,
    evolve,
    fold,
    keys,
    monitor,
    ordering,
    reconcile,
    routing,
    schema_diff,
    truncates,
)
from changemill.plans.fixtures import TABLES, table, view
from changemill.session import lookup, measured, run_dir
from changemill.sources import ddl_feed, feed as feeds, profile, signals, snapshot
from changemill.tables import targets
from changemill.spec import tables_without_keys as keyless
from changemill.streaming.events import events_per_window
from changemill.tables.dead_letters import as_dead_letters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

USER_KEYS = ["topic", "user_id"]
STATE_COLUMNS = ["topic", "user_id", "event_type", "value", "off"]
CHUNK_WIDTH = 100


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _known(df: DataFrame, columns: list[str]) -> DataFrame:
    """Report form of columns that may be unknown: -1 instead of null."""
    return df.na.fill(-1, columns)


def user_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "feed").select("topic", "user_id", "op", "off", "event_type", "value")


# ---- Folds and sink modes ------------------------------------------------------------------


@query
def current_state(spark, sf_dir):
    return fold.current_state(user_feed(spark, sf_dir), USER_KEYS).select(*STATE_COLUMNS)


@query
def truncate_aware_state(spark, sf_dir):
    return fold.truncate_aware_state(user_feed(spark, sf_dir), USER_KEYS).select(*STATE_COLUMNS)


@query
def partitioned_state(spark, sf_dir):
    """Truncate-aware state of keyed topics of six partitions, compared by source position."""
    rows = barriers.partitioned_state(view(spark, sf_dir, "partitioned_feed"), USER_KEYS, partitions=6)
    return rows.select("topic", "part", "user_id", "event_type", "value", "off", "pos")


@query
def pending_truncates(spark, sf_dir):
    """Truncates that a partition has not come to yet."""
    return barriers.pending_truncates(view(spark, sf_dir, "lagging_feed"), partitions=6).select("topic", "part", "off", "pos")


@query
def latest_change(spark, sf_dir):
    """Last change of every key whatever its operation, deletes included."""
    return fold.fold_changes(user_feed(spark, sf_dir), USER_KEYS).select(*STATE_COLUMNS, "op")


@query
def soft_delete_state(spark, sf_dir):
    return fold.soft_delete_state(user_feed(spark, sf_dir), USER_KEYS, ["event_type", "value"])


@query
def insert_mode_state(spark, sf_dir):
    customer, inserts = table(spark, sf_dir, "customer"), view(spark, sf_dir, "customer_inserts")
    columns = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
    return fold.insert_mode_state(customer.select(*columns), inserts, ["c_custkey"])


@query
def insert_mode_rejects(spark, sf_dir):
    customer, inserts = table(spark, sf_dir, "customer"), view(spark, sf_dir, "customer_inserts")
    _, rejected = fold.split_insert_mode(customer.select("c_custkey"), inserts, ["c_custkey"])
    return rejected.select("c_custkey", "off", "reason")


@query
def update_mode_state(spark, sf_dir):
    customer, inserts = table(spark, sf_dir, "customer"), view(spark, sf_dir, "customer_inserts")
    return fold.update_mode_state(customer, inserts, ["c_custkey"])


@query
def merge_customer(spark, sf_dir):
    customer, changes = table(spark, sf_dir, "customer"), view(spark, sf_dir, "customer_changes")
    return fold.merge_changes(customer, changes, ["c_custkey"])


@query
def key_mode_rows(spark, sf_dir):
    """Rows of the feed keyed by their feed coordinates, the key mode of keyless tables."""
    coordinates = fold.key_columns("kafka")
    rows = view(spark, sf_dir, "feed")
    return rows.select(*[c.alias(n) for n, c in coordinates.items()], "op", "user_id")


# ---- Feed, routing, filters ----------------------------------------------------------------


@query
def routed_feed(spark, sf_dir):
    rows = feeds.subscribed(view(spark, sf_dir, "multi_feed"), 1)
    routed = routing.route(rows, measured(view(spark, sf_dir, "mapping")))
    return routed.select("topic", "off", "op", "row_key", "target_table")


@query
def multi_table_state(spark, sf_dir):
    mapping = measured(view(spark, sf_dir, "mapping"))
    rows = feeds.include_tables(feeds.subscribed(view(spark, sf_dir, "multi_feed"), 1), mapping)
    state = fold.truncate_aware_state(rows, ["topic", "row_key"])
    return routing.route(state, mapping).select("target_table", "row_key", "label", "off")


@query
def without_truncates(spark, sf_dir):
    """Feed of a source that skips truncates."""
    return feeds.skip_operations(view(spark, sf_dir, "feed")).select("topic", "off", "op", "user_id")


@query
def topic_names(spark, sf_dir):
    """Parts of every topic, and the topic under another database."""
    topic = F.col("topic")
    topics = view(spark, sf_dir, "multi_feed").groupBy("topic").agg(F.count("*").alias("n"))
    return topics.select(
        "topic", "n", names.topic_prefix(topic).alias("prefix"), names.topic_db_id(topic).alias("db_id"),
        names.topic_schema(topic).alias("source_schema"), names.topic_table(topic).alias("source_table"),
        names.default_target(topic).alias("default_target"), names.reroute_schema(topic, F.lit("warehouse")).alias("rerouted"),
    )


@query
def qualified_names(spark, sf_dir):
    """Topic, include-list name and snapshot name of one table per customer in each system."""
    key = F.col("c_custkey")
    system = F.element_at(F.array(*[F.lit(s) for s in ("mysql", "postgresql", "mssql", "oracle")]), (key % 4 + 1).cast("int"))
    bare = F.concat(F.lit("t"), key)
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", system.alias("system"),
        F.when(key % 3 == 0, F.lit("app")).alias("schema"),
        F.when(key % 5 == 0, F.concat(F.lit("own."), bare)).otherwise(bare).alias("tbl"),
    )
    db, user, system = F.lit("shop"), F.lit("cdc"), F.col("system")
    schema, tbl = F.col("schema"), F.col("tbl")
    return rows.select(
        "c_custkey",
        names.build_topic(system, F.lit("p"), db, schema, names.topic_table(tbl), user).alias("topic"),
        names.include_list_name(system, db, schema, tbl, user).alias("include_name"),
        names.snapshot_name(system, db, schema, tbl).alias("snapshot_name"),
        names.slug(F.concat(F.lit("My Source-"), tbl), 63).alias("slug"),
    )


@query
def subscription_changes(spark, sf_dir):
    """Topics to add and remove when the watched set is the audited half of the feed."""
    rows = view(spark, sf_dir, "multi_feed").select("topic")
    desired = feeds.subscribed(rows, 1)
    watched = rows.where(~F.col("topic").like("%users_1") & ~F.col("topic").like("%orders"))
    return feeds.table_changes(watched, desired)


@query
def capture_events(spark, sf_dir):
    rows = view(spark, sf_dir, "capture_rows")
    after = F.struct("event_id", "schema_name", "object_name", "object_type", "processed")
    messages = rows.select("off", F.to_json(F.struct(after.alias("after"))).alias("value"))
    return ddl_feed.read_capture(messages).select("event_id", "off", "schema_name", "tbl")


# ---- Conformance and dead letters ----------------------------------------------------------

ORDER_TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "decimal(15,2)", "o_orderdate": "timestamp_ntz"}


@query
def conformed_rows(spark, sf_dir):
    rows = types.conform(view(spark, sf_dir, "orders_text"), ORDER_TYPES).where("_rejects IS NULL")
    return rows.select("off", "o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), "o_orderdate")


@query
def conform_rejects(spark, sf_dir):
    rows = types.conform(view(spark, sf_dir, "orders_text"), ORDER_TYPES)
    return rows.where("_rejects IS NOT NULL").select("off", F.col("_rejects").alias("rejects"))


@query
def batch_results(spark, sf_dir):
    rows = types.conform(view(spark, sf_dir, "orders_text"), ORDER_TYPES)
    return monitor.batch_results(rows, F.col("_rejects").isNotNull())


def damaged_messages(spark, sf_dir):
    """The users feed as envelopes: every third wrapped in a payload, damage as planted."""
    rows = view(spark, sf_dir, "damaged_feed")
    image = F.struct("user_id", "event_type", "value")
    no_key = F.struct(F.lit(None).cast("bigint").alias("user_id"), "event_type", "value")
    after = F.when(F.col("op").isin("c", "u"), F.when(F.col("damage") == "missing_key", no_key).otherwise(image))
    body = F.struct(
        F.when(F.col("op") == "d", image).alias("before"),
        F.when(F.coalesce("damage", F.lit("")) != "missing_after", after).alias("after"),
        F.when(F.coalesce("damage", F.lit("")) == "unknown_op", "x").otherwise(F.col("op")).alias("op"),
    )
    text = F.when(F.col("off") % 3 == 0, F.to_json(F.struct(body.alias("payload")))).otherwise(F.to_json(body))
    value = F.when(F.col("damage") == "malformed_json", F.concat(F.lit("{"), F.col("event_type"))).otherwise(text)
    tombstone = (F.col("op") == "d") & F.col("damage").isNull() & (F.col("off") % 2 == 0)
    return rows.select(
        "topic", "part", "off", F.lit(None).cast("timestamp_ntz").alias("ts"),
        F.when(F.col("op") != "t", F.to_json(F.struct("user_id"))).alias("key"),
        F.when(~tombstone, value).alias("value"),
    )


USER_ROW = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)


@query
def decoded_changes(spark, sf_dir):
    """Envelopes, payload-wrapped envelopes and tombstones as typed changes."""
    decoded = envelope.decode_envelope(damaged_messages(spark, sf_dir), USER_ROW, ["user_id"])
    rows = envelope.good_rows(decoded).where("op <> 't'")
    return rows.select("topic", "off", "op", "user_id", F.when(F.col("op") != "d", F.col("value")).alias("value"))


@query
def envelope_dead_letters(spark, sf_dir):
    decoded = envelope.decode_envelope(damaged_messages(spark, sf_dir), USER_ROW, ["user_id"])
    return as_dead_letters(envelope.dead_rows(decoded), "decode", F.col("_error")).select("topic", "part", "off", "stage", "error_class")


@query
def decimal_values(spark, sf_dir):
    """Exact decimals sent as base64 of their two's complement bytes."""
    unscaled = (F.col("o_orderkey") - F.lit(7000)) * F.lit(13)
    sent = F.base64(F.unhex(F.lpad(F.hex(unscaled), 16, "0")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", sent.alias("sent"))
    return rows.select("o_orderkey", decode.decimal_from_base64(F.col("sent"), 20, 2).cast("double").alias("amount"))


@query
def wire_times(spark, sf_dir):
    """Event times sent as microseconds and days, decoded again."""
    ts = F.col("ts")
    micros = F.timestamp_diff("MICROSECOND", decode.epoch(), ts)
    rows = table(spark, sf_dir, "events").select("event_id", micros.alias("us"), F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).alias("days"))
    return rows.select(
        "event_id", decode.timestamp_from_micros(F.col("us")).alias("ts"), decode.date_from_days(F.col("days")).cast("string").alias("day"),
        decode.time_text(F.pmod("us", F.lit(86400000000))).alias("time_of_day"),
    )


# ---- Signals and schema history ------------------------------------------------------------


def _signals(spark, sf_dir):
    rows = view(spark, sf_dir, "signal_rows")
    data = F.struct(F.lit("incremental").alias("type"), F.array("collection").alias("data-collections"))
    body = F.struct(F.concat(F.lit("s"), "off").alias("id"), F.col("signal_type").alias("type"), data.alias("data"))
    return signals.read_signals(rows.select(F.col("prefix").alias("key"), "off", F.to_json(body).alias("value")))


@query
def snapshot_requests(spark, sf_dir):
    mapping = measured(view(spark, sf_dir, "mapping"))
    return signals.requested_tables(_signals(spark, sf_dir), mapping).select("prefix", "off", "signal_id", "target_table")


@query
def snapshot_states(spark, sf_dir):
    return signals.active_snapshots(_signals(spark, sf_dir))


@query
def history_events(spark, sf_dir):
    """Usable schema-history messages."""
    rows = view(spark, sf_dir, "history_rows")
    text = F.to_json(F.struct(F.col("db").alias("databaseName"), "ddl"))
    value = F.when(F.col("broken"), F.lit("{not json")).when(~F.col("is_null"), text)
    feed = rows.select(F.lit("history").alias("topic"), F.lit(0).alias("part"), "off", value.alias("value"))
    events, dead = ddl_feed.read_history(feed)
    return events.select("off", "db", "ddl", F.lit("event").alias("outcome")).unionByName(
        dead.select("off", F.lit(None).cast("string").alias("db"), F.lit(None).cast("string").alias("ddl"), F.col("error").alias("outcome"))
    )


@query
def metadata_differences(spark, sf_dir):
    """Table metadata of ALTER messages, diffed against the target's columns."""
    columns = view(spark, sf_dir, "source_columns")
    column = F.struct("pos", F.col("name"), F.col("type_name").alias("typeName"), "length", "scale")
    tables = columns.groupBy("tbl").agg(F.array_sort(F.collect_list(column)).alias("columns"))
    change = F.struct(
        F.lit("ALTER").alias("type"), F.concat(F.lit('"shop"."dbo"."'), "tbl", F.lit('"')).alias("id"), F.struct("columns").alias("table")
    )
    messages = tables.select(
        F.lit("history").alias("topic"), F.lit(0).alias("part"), F.lit(1).cast("bigint").alias("off"),
        F.to_json(F.struct(F.lit("shop").alias("databaseName"), F.array(change).alias("tableChanges"))).alias("value"),
    )
    events, _ = ddl_feed.read_history(messages)
    catalog = ddl_feed.column_catalog(events).select("tbl", "name", "pos", "type_name", "length", "scale")
    target = view(spark, sf_dir, "target_columns")
    no_renames = view(spark, sf_dir, "explicit_renames").where("false")
    diff = schema_diff.rename_aware_diff(catalog, target, no_renames)
    return diff.groupBy("tbl", "operation").agg(F.count("*").alias("n"))


# ---- Truncates and positions ---------------------------------------------------------------


@query
def truncates_due(spark, sf_dir):
    pending, committed = view(spark, sf_dir, "truncates_pending"), measured(view(spark, sf_dir, "sink_committed"))
    return truncates.truncates_due(pending, committed).select("topic", "part", "off", "committed")


@query
def commit_positions(spark, sf_dir):
    pending, committed = view(spark, sf_dir, "truncates_pending"), measured(view(spark, sf_dir, "sink_committed"))
    waiting = truncates.with_due(pending, committed).where("NOT is_due")
    return truncates.commit_positions(view(spark, sf_dir, "watch_positions"), waiting)


@query
def queued_truncates(spark, sf_dir):
    """Truncates of paused pipelines, once per table; the customers' connectors say who runs."""
    rows = view(spark, sf_dir, "feed").where("op = 't'")
    queue = rows.select(F.concat(F.lit("cfg_"), "user_id").alias("pipeline"), names.topic_table(F.col("topic")).alias("tbl"), "off")
    return truncates.enqueue(queue.limit(0), queue)


@query
def drainable_truncates(spark, sf_dir):
    queue = queued_truncates(spark, sf_dir)
    control = monitor.enrich_status(view(spark, sf_dir, "configs"), view(spark, sf_dir, "statuses"), view(spark, sf_dir, "target_dbs"))
    return truncates.drainable(queue, control)


# ---- Snapshots -----------------------------------------------------------------------------


@query
def chunk_snapshot_merge(spark, sf_dir):
    orders, log = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), view(spark, sf_dir, "orders_log")
    chunks = snapshot.chunk_snapshot(orders, ["o_orderkey"])
    reads = snapshot.surviving_reads(chunks, log, ["o_orderkey"], CHUNK_WIDTH)
    return snapshot.merge_snapshot(reads, log, ["o_orderkey"]).select("o_orderkey", "o_totalprice", "off", "op")


@query
def chunk_sizes(spark, sf_dir):
    """Rows and key range of every snapshot chunk."""
    chunks = snapshot.chunk_snapshot(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])
    return chunks.groupBy("chunk").agg(
        F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key")
    )


@query
def snapshot_progress(spark, sf_dir):
    report = snapshot.progress(view(spark, sf_dir, "chunk_completions"), view(spark, sf_dir, "snapshot_tables"))
    return snapshot.completed_by_streaming(report, view(spark, sf_dir, "streaming_pipelines"))


@query
def resynced_state(spark, sf_dir):
    """State of the orders table after a truncate and a resync in the middle of its log."""
    topic = "orders"
    log = view(spark, sf_dir, "orders_log").select(F.lit(topic).alias("topic"), "off", "op", "o_orderkey", "o_totalprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    feed = snapshot.resync(log, orders, topic, 500)
    # The marker has no key; one topic means one truncate row to join.
    return fold.truncate_aware_state(feed, ["topic", "o_orderkey"]).select("o_orderkey", "o_totalprice", "off", "op")


@query
def handover_state(spark, sf_dir):
    """Snapshot of orders at log position 300, then the log from there."""
    log = view(spark, sf_dir, "orders_log").select(F.lit("orders").alias("topic"), "off", "op", "o_orderkey", "o_totalprice")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return fold.current_state(snapshot.handover(orders, log, "orders", 300), ["topic", "o_orderkey"]).select("o_orderkey", "o_totalprice", "off")


# ---- Reconciliation and keys ---------------------------------------------------------------


@query
def row_counts(spark, sf_dir):
    plain = {t: table(spark, sf_dir, t) for t in TABLES}
    return reconcile.row_counts({**plain, "orders_copy": view(spark, sf_dir, "orders_copy")})


def _compared(spark, sf_dir):
    return reconcile.compare_counts(
        view(spark, sf_dir, "sync_mapping"), view(spark, sf_dir, "sync_source"), view(spark, sf_dir, "sync_target")
    )


@query
def compared_counts(spark, sf_dir):
    return _known(_compared(spark, sf_dir), ["source_rows", "target_rows"])


@query
def sync_status(spark, sf_dir):
    return reconcile.sync_status(view(spark, sf_dir, "sync_pipelines"), _compared(spark, sf_dir))


@query
def table_profile(spark, sf_dir):
    """Columns and exact rows of every given table."""
    tables = {t: table(spark, sf_dir, t) for t in TABLES}
    return profile.table_profile(spark, tables).select("tbl", "columns", "n")


@query
def null_counts(spark, sf_dir):
    """Nulls in required columns of the evolving users feed."""
    return evolve.null_violations(view(spark, sf_dir, "evolving_feed"), ["user_id", "event_type", "value", "origin"])


@query
def default_backfill(spark, sf_dir):
    rows = view(spark, sf_dir, "evolving_feed").select("topic", "off", "event_type", "origin")
    return evolve.backfill_defaults(rows, {"origin": "unknown", "event_type": "none"})


@query
def row_diff(spark, sf_dir):
    diff = reconcile.row_diff(table(spark, sf_dir, "orders"), view(spark, sf_dir, "orders_copy"), ["o_orderkey"])
    return diff.where("diff <> 'same'")


@query
def row_diff_summary(spark, sf_dir):
    return reconcile.row_diff_summary(table(spark, sf_dir, "orders"), view(spark, sf_dir, "orders_copy"), ["o_orderkey"])


@query
def preview_last3(spark, sf_dir):
    return ordering.last_rows(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"])


@query
def preview_last3_per_table(spark, sf_dir):
    rows = view(spark, sf_dir, "multi_feed").select("topic", "off", "op", "row_key")
    return ordering.last_rows(rows, ["off", "row_key", "op"], 3, ["topic"])


@query
def duplicate_keys(spark, sf_dir):
    return keys.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query
def fk_orphans(spark, sf_dir):
    child, parent = table(spark, sf_dir, "lineitem"), view(spark, sf_dir, "orders_gaps")
    return keys.orphan_counts(child, parent, {"l_orderkey": "o_orderkey"})


@query
def fk_orphan_rows(spark, sf_dir):
    child, parent = table(spark, sf_dir, "lineitem"), view(spark, sf_dir, "orders_gaps")
    found = keys.orphans(child.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), parent, {"l_orderkey": "o_orderkey"})
    return found


@query
def fk_targets(spark, sf_dir):
    found = keys.foreign_key_targets(view(spark, sf_dir, "fks"), view(spark, sf_dir, "fk_mapping"))
    return found.select("fk_id", "target_table")


@query
def constraint_preview(spark, sf_dir):
    return keys.constraint_preview(
        view(spark, sf_dir, "wanted_constraints"), view(spark, sf_dir, "existing_constraints"), view(spark, sf_dir, "existing_tables")
    )


@query
def constraint_summary(spark, sf_dir):
    return keys.preview_summary(constraint_preview(spark, sf_dir), ["pipeline"])


@query
def copied_indexes(spark, sf_dir):
    """Indexes worth copying with the names they get."""
    rows = view(spark, sf_dir, "index_catalog").withColumns(
        {"columns": F.split("column_list", ","), "pk": F.split("key_list", ",")}
    )
    return keys.copyable_indexes(rows).select(
        "tbl", "name", keys.index_name(F.col("tbl"), F.col("columns")[0]).alias("new_name"),
        keys.foreign_key_name(F.col("tbl"), F.col("columns")[0]).alias("fk_name"), "is_unique",
    )


@query
def unassigned_tables(spark, sf_dir):
    return reconcile.unassigned_tables(view(spark, sf_dir, "listing"), view(spark, sf_dir, "assigned"), view(spark, sf_dir, "emptiness"))


@query
def included_names(spark, sf_dir):
    """Names that a source of each system lists: enabled tables, and its capture or signal table."""
    mapping = view(spark, sf_dir, "mapping").withColumn("database", F.lit("shop"))
    systems = ("mysql", "postgresql", "mssql", "oracle")
    return feeds.union_feeds([feeds.include_list(mapping, s, "app").select(F.lit(s).alias("system"), "name") for s in systems])


@query
def tables_with_rows(spark, sf_dir):
    """Tables that have a row, one without any beside them."""
    tables = {name: table(spark, sf_dir, name) for name in TABLES}
    return reconcile.non_empty_tables({**tables, "no_orders": tables["orders"].where("o_orderkey < 0")})


@query
def created_target(spark, sf_dir):
    """A target made from its source's schema and loaded; a second creation leaves it as it is."""
    orders = table(spark, sf_dir, "orders")
    name = "created_" + run_dir(spark, "x").rsplit("-", 1)[1]
    targets.create_target(spark, name, orders.schema)
    orders.write.insertInto(name)
    targets.create_target(spark, name, orders.select("o_orderkey").schema)
    return spark.table(name)


@query
def refreshed_target(spark, sf_dir):
    """A target loaded anew twice, the second time from itself; in between a refresh that may not drop is skipped."""
    orders = table(spark, sf_dir, "orders")
    name = "refreshed_" + run_dir(spark, "x").rsplit("-", 1)[1]
    targets.full_refresh(spark, name, orders.where("o_orderkey % 2 = 0"))
    targets.full_refresh(spark, name, orders, drop_before_sync=False)
    targets.full_refresh(spark, name, spark.table(name).unionByName(orders.where("o_orderkey % 2 = 1 AND o_orderkey % 3 = 0")))
    return spark.table(name)


@query
def wrapped_key_changes(spark, sf_dir):
    """Changes whose keys come wrapped with their schema; deletes are tombstones, so the key alone names the row."""
    feed = view(spark, sf_dir, "feed").where("op <> 't'")
    key = F.to_json(F.struct(F.struct(F.lit("struct").alias("type")).alias("schema"), F.struct("user_id").alias("payload")))
    messages = envelope.encode_envelope(feed, ["user_id", "event_type", "value"], ["user_id"]).drop("key")
    messages = messages.join(feed.select("topic", "off", "op", key.alias("key")), ["topic", "off"])
    messages = messages.withColumn("value", F.when(F.col("op") != "d", F.col("value"))).drop("op")
    return envelope.good_rows(envelope.decode_envelope(messages, USER_ROW, ["user_id"])).select("topic", "off", "op", "user_id")


# ---- Types, schema differences, DDL --------------------------------------------------------


@query
def column_types(spark, sf_dir):
    """Canonical, Spark and translated types of a catalog of columns."""
    typed = types.with_canonical_types(view(spark, sf_dir, "type_catalog"))
    both = types.translated_type(types.translated_type(typed, "postgresql"), "mysql")
    return both.select("col_id", "system", "canonical", "spark_type", "postgresql_type", "mysql_type")


@query
def lossy_casts(spark, sf_dir):
    """Columns whose types differ between source and target, and whether casting may lose values."""
    source, target = view(spark, sf_dir, "source_columns"), view(spark, sf_dir, "target_columns")
    pairs = source.select("tbl", "name", F.col("type_name").alias("old_type")).join(
        target.select("tbl", F.col("name"), F.col("type_name").alias("new_type")), ["tbl", "name"]
    )
    return evolve.audit_modify(pairs).groupBy("old_type", "new_type", "is_lossy").agg(F.count("*").alias("n"))


@query
def schema_differences(spark, sf_dir):
    diff = schema_diff.rename_aware_diff(
        view(spark, sf_dir, "source_columns"), view(spark, sf_dir, "target_columns"), view(spark, sf_dir, "explicit_renames")
    )
    return diff.select("tbl", "stage", "operation", "column_name", "new_name", "is_destructive")


@query
def schema_differences_typed(spark, sf_dir):
    diff = schema_diff.typed_diff(view(spark, sf_dir, "source_columns"), view(spark, sf_dir, "target_columns"))
    return diff.select("tbl", "operation", "column_name", "type_name", "old_type", "is_destructive")


@query
def tables_without_keys(spark, sf_dir):
    catalog = view(spark, sf_dir, "source_columns").withColumn("is_key", F.expr("pos = 0 AND type_name <> 'INT'"))
    return keyless(catalog)


@query
def statement_routes(spark, sf_dir):
    routed = ddl.dispatch(view(spark, sf_dir, "ddl_text"))
    return routed.groupBy("system", "route").agg(F.count("*").alias("n"))


@query
def alter_clauses(spark, sf_dir):
    clauses = ddl.classify_clauses(ddl.alter_clauses(view(spark, sf_dir, "ddl_text")))
    return _known(clauses, ["length", "scale"]).select(
        "ddl_id", "clause_no", "operation", "column_name", "new_name", "type_name", "length", "scale",
        F.col("is_optional").cast("string").alias("is_optional"), "default_value", "index_name", "index_columns",
        F.col("is_unique").cast("string").alias("is_unique"), "is_destructive",
    )


@query
def ddl_operations(spark, sf_dir):
    """Operations with their status behind the destructive gate."""
    clauses = ddl.classify_clauses(ddl.alter_clauses(view(spark, sf_dir, "ddl_text")))
    gated = ddl.gate(clauses, view(spark, sf_dir, "ddl_targets"))
    return gated.select("ddl_id", "clause_no", "tbl", "operation", "status")


@query
def ddl_counts(spark, sf_dir):
    return ddl.operation_counts(ddl_operations(spark, sf_dir))


@query
def column_renames(spark, sf_dir):
    return ddl.explicit_renames(view(spark, sf_dir, "ddl_text"))


@query
def index_operations(spark, sf_dir):
    """Statements that make and drop indexes, as operations."""
    found = ddl.index_statements(view(spark, sf_dir, "index_text"))
    return found.select("ddl_id", "operation", "tbl", "index_name", "index_columns", F.col("is_unique").cast("string").alias("is_unique"))


@query
def default_literals(spark, sf_dir):
    """Defaults as literals of a new column, and whether it must not be null."""
    text = evolve.default_literal(F.col("kind"), F.col("value"), F.col("auto_increment"))
    return view(spark, sf_dir, "column_defaults").select("col_id", text.alias("default_text"), evolve.not_null(F.col("is_key"), F.col("optional")).alias("not_null"))


@query
def table_renames(spark, sf_dir):
    return ddl.table_renames(view(spark, sf_dir, "rename_text"), view(spark, sf_dir, "ddl_targets"))


@query
def evolved_state(spark, sf_dir):
    """State of the users tables with DDL between their changes: users_2 renames and adds a
    column, users_3 drops one, then modifies another."""
    operations = evolve.bounded_operations(view(spark, sf_dir, "ddl_between"))
    state = fold.truncate_aware_state(view(spark, sf_dir, "evolving_feed"), USER_KEYS)
    columns = {"event_type": "string", "value": "double", "amount": "double", "origin": "string"}
    return evolve.evolve_rows(state, operations, columns).select("topic", "user_id", "off", *columns)


@query
def evolved_by_lineage(spark, sf_dir):
    """The same state with each column traced back through its table's operations, chunk by chunk."""
    operations = view(spark, sf_dir, "ddl_between")
    state = fold.truncate_aware_state(view(spark, sf_dir, "evolving_feed"), USER_KEYS).drop("op")
    columns = ["event_type", "value", "amount", "origin"]
    parts = []
    for i in range(4):
        topic = f"client_1_db_2_v_1.shop.users_{i}"
        mine = evolve.evolve_in_chunks(state.where(F.col("topic") == topic), operations.where(F.col("tbl") == topic), [*USER_KEYS, "off"], size=1)
        parts.append(mine.select("topic", "user_id", "off", *columns))
    return feeds.union_feeds(parts)


@query
def applied_operations(spark, sf_dir):
    """Operations of the orders table, applied to it in their order: what became of each, and the columns left."""
    audit, table_now = [], table(spark, sf_dir, "orders")
    for chunk in evolve.operation_chunks(view(spark, sf_dir, "orders_operations")):
        table_now, outcomes = evolve.apply_operations(table_now, chunk)
        audit += [(op.off, *outcome, outcome[1] in table_now.columns) for op, outcome in zip(chunk, outcomes, strict=True)]
    return lookup(spark, audit, "off bigint,operation string,column_name string,outcome string,is_column boolean")


@query
def modify_losses(spark, sf_dir):
    """Values that planned type changes of the text orders would lose."""
    return evolve.modify_losses(view(spark, sf_dir, "orders_text"), {"o_totalprice": "decimal(15,2)", "o_custkey": "int", "o_orderstatus": "int"})


# ---- Monitoring ----------------------------------------------------------------------------


@query
def events_per_op_window(spark, sf_dir):
    return events_per_window(view(spark, sf_dir, "feed"), ["topic", "op"])


@query
def event_counts(spark, sf_dir):
    rows = view(spark, sf_dir, "multi_feed")
    return monitor.event_counts(rows, ["topic"])


@query
def latency_histogram(spark, sf_dir):
    rows = view(spark, sf_dir, "applied")
    return monitor.latency_histogram(rows, F.col("delay_us") / F.lit(1000000), ["topic"])


@query
def consumer_lag(spark, sf_dir):
    high = view(spark, sf_dir, "watch_positions").withColumnRenamed("position", "high")
    return _known(monitor.consumer_lag(high, view(spark, sf_dir, "sink_committed")), ["committed"])


@query
def seconds_behind(spark, sf_dir):
    """Lag of each table when everything past the sink's committed position still waits."""
    committed = measured(view(spark, sf_dir, "sink_committed"))
    rows = view(spark, sf_dir, "feed").join(committed, ["topic", "part"], "left")
    applied = rows.select("topic", "ts", F.when(F.col("off") < F.col("committed"), F.col("ts")).alias("applied_at"))
    return _known(monitor.seconds_behind(applied, ["topic"]), ["lag_seconds"]).na.fill(True, ["is_late"])


@query
def incidents(spark, sf_dir):
    return monitor.incidents(view(spark, sf_dir, "health_samples"))


@query
def health_rollup(spark, sf_dir):
    return monitor.health_rollup(view(spark, sf_dir, "health_samples"))


@query
def latest_samples(spark, sf_dir):
    newest = monitor.latest_samples(view(spark, sf_dir, "health_samples"), "check_id")
    return newest.select("pipeline", "check_id", "source_state", "sink_state", "severity")


@query
def state_counts(spark, sf_dir):
    states = {"running": "RUNNING", "paused": "PAUSED", "failed": "FAILED"}
    return monitor.state_counts(view(spark, sf_dir, "statuses"), "state", states)


@query
def status_enrichment(spark, sf_dir):
    return monitor.enrich_status(view(spark, sf_dir, "configs"), view(spark, sf_dir, "statuses"), view(spark, sf_dir, "target_dbs"))


@query
def connection_health(spark, sf_dir):
    configs = view(spark, sf_dir, "configs")
    sources = configs.join(view(spark, sf_dir, "statuses"), configs.source_name == F.col("name"))
    return monitor.connection_health(
        sources.select(F.col("client").alias("connection"), "state"),
        table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("connection")),
    )


@query
def sink_badges(spark, sf_dir):
    configs, statuses = view(spark, sf_dir, "configs").where("sink_name IS NOT NULL"), view(spark, sf_dir, "statuses")
    sinks = configs.join(statuses, configs.sink_name == statuses.name, "left")
    return monitor.sink_badges(sinks.select("client", F.coalesce("state", F.lit("NOT_CREATED")).alias("state")), "client")


@query
def dead_letter_counts(spark, sf_dir):
    return monitor.dead_letter_counts(view(spark, sf_dir, "dlq_offsets"))
