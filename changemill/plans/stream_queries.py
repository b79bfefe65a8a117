"""Streaming twins: the same feeds split into files and applied in micro-batches.

Each query writes its feed into a fresh part of the session's shared folder, streams it with
``availableNow`` and returns the resulting table, so its answer is that of the batch query.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changemill.functions import envelope
from changemill.functions.decode import utc_instant, zone_free
from changemill.operators import evolve
from changemill.plans.fixtures import table, view
from changemill.plans.queries import STATE_COLUMNS, USER_KEYS, USER_ROW, damaged_messages, query
from changemill.session import lookup, run_dir
from changemill.sources import snapshot
from changemill.sources.feed import FEED_SCHEMA, read_files, union_feeds
from changemill.spec import PipelineSpec, TableSpec
from changemill.streaming.apply import Pipeline, fold_into, start
from changemill.streaming.ddl import read_operations, record_into
from changemill.streaming.incidents import IncidentLog
from changemill.streaming.events import events_per_window, once_per_event
from changemill.tables.dead_letters import read_dead_letters
from changemill.tables.state_table import StateTable

FILES, FILES_PER_BATCH = 20, 7


def write_feed(messages: DataFrame, folder: str) -> str:
    """A feed as files of neighbouring offsets."""
    path = f"{folder}/feed"
    shaped = messages.withColumn("ts", F.lit(None).cast("timestamp_ntz")) if "ts" not in messages.columns else messages
    shaped.select(*FEED_SCHEMA.names).repartitionByRange(FILES, "off").write.parquet(path)
    return path


def write_in_order(rows: DataFrame, order: str, folder: str, slices: int = 4) -> str:
    """Rows as files whose age follows their order, for operators with a watermark."""
    path = f"{folder}/ordered"
    bounds = rows.agg(F.min(order), F.max(order)).first()
    width = (bounds[1] - bounds[0]) // slices + 1
    for i in range(slices):
        low = bounds[0] + i * width
        rows.where((F.col(order) >= low) & (F.col(order) < low + width)).write.mode("append").parquet(path)
    return path


def user_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.encode_envelope(view(spark, sf_dir, "feed"), ["user_id", "event_type", "value"], ["user_id"])


def users_of(batch: DataFrame) -> DataFrame:
    return envelope.good_rows(envelope.decode_envelope(batch, USER_ROW, ["user_id"]))


def state_table(spark: SparkSession, folder: str, name: str, keys: list[str]) -> StateTable:
    unique = f"{name}_{folder.rsplit('-', 1)[1][:12]}"
    return StateTable(spark, unique, keys, folder, buckets=8)


def drain(spark, path, folder, on_batch, checkpoint="checkpoint", files=FILES_PER_BATCH):
    start(read_files(spark, path, True, files), on_batch, f"{folder}/{checkpoint}").awaitTermination()


@query
def stream_truncate_aware_state(spark, sf_dir):
    folder = run_dir(spark, "fold")
    path, state = write_feed(user_messages(spark, sf_dir), folder), state_table(spark, folder, "users", USER_KEYS)
    drain(spark, path, folder, fold_into(state, users_of))
    return state.current().select(*STATE_COLUMNS)


@query
def stream_recovered_state(spark, sf_dir):
    """The stream's position is lost after a compaction: a new checkpoint replays the whole feed
    onto the kept state."""
    folder = run_dir(spark, "recover")
    path, state = write_feed(user_messages(spark, sf_dir), folder), state_table(spark, folder, "users", USER_KEYS)
    drain(spark, path, folder, fold_into(state, users_of), files=FILES)
    state.compact()
    drain(spark, path, folder, fold_into(state, users_of, state.next_batch()), "second_checkpoint", FILES)
    return state.current().select(*STATE_COLUMNS)


@query
def stream_handover_state(spark, sf_dir):
    """Snapshot of orders as the first batch, then the log from the snapshot's position."""
    folder = run_dir(spark, "handover")
    state = state_table(spark, folder, "orders", ["topic", "o_orderkey"])
    row = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType())])
    log = view(spark, sf_dir, "orders_log").select(F.lit("orders").alias("topic"), F.lit(0).alias("part"), "off", "op", "o_orderkey", "o_totalprice")
    messages = envelope.encode_envelope(log.where("off > 300"), row.names, ["o_orderkey"])
    path = write_feed(messages, folder)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    state.apply(snapshot.as_snapshot(orders, "orders", 300).withColumn("part", F.lit(0)), 0)

    def decode(batch: DataFrame) -> DataFrame:
        return envelope.good_rows(envelope.decode_envelope(batch, row, ["o_orderkey"]))

    drain(spark, path, folder, fold_into(state, decode, 1))
    return state.current().select("o_orderkey", "o_totalprice", "off")


@query
def stream_multi_table_state(spark, sf_dir):
    """One stream over all topics of a source, each enabled table into its own target, damaged
    envelopes into dead letters."""
    return _all_tables(spark, sf_dir)[0]


@query
def stream_dead_letters(spark, sf_dir):
    return _all_tables(spark, sf_dir)[1]


def _all_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    folder = run_dir(spark, "pipeline")
    path = write_feed(damaged_messages(spark, sf_dir), folder)
    tables = tuple(
        TableSpec("shop", f"users_{i}", USER_ROW, ("user_id",), is_enabled=i != 1, target_table="people" if i == 3 else None)
        for i in range(4)
    )
    spec = PipelineSpec(1, 2, "mysql", "shop", tables, frequency="manual", tolerance="all")
    pipeline = Pipeline(spark, spec, folder, f"p_{folder.rsplit('-', 1)[1][:12]}")
    pipeline.run(read_files(spark, path, True, FILES_PER_BATCH + 3), f"{folder}/checkpoint").awaitTermination()
    rows, rejects = None, None
    for spec_table in spec.enabled_tables:
        live = pipeline.state(spec_table).current().select(F.lit(spec_table.target).alias("target_table"), "user_id", "event_type", "value", "off")
        dead = read_dead_letters(spark, f"{folder}/dead_letters/{spec_table.target}").select("topic", "off", "error_class")
        rows = live if rows is None else rows.unionByName(live)
        rejects = dead if rejects is None else rejects.unionByName(dead)
    return rows, rejects


def _partitioned(spark: SparkSession, sf_dir: str, feed: str, heartbeats: bool = False) -> Pipeline:
    """A pipeline over topics of six partitions, which come one after the other: truncates arrive early in the
    first ones, and each waits for the partitions that are behind it."""
    folder = run_dir(spark, "partitions")
    messages = envelope.encode_envelope(view(spark, sf_dir, feed), ["user_id", "event_type", "value"], ["user_id"])
    shaped = messages.withColumn("ts", F.lit(None).cast("timestamp_ntz")).select(*FEED_SCHEMA.names)
    shaped.repartitionByRange(FILES, "part", "off").write.parquet(f"{folder}/feed")
    if heartbeats:  # the source goes on, though one partition has nothing to say
        beat = F.concat(F.lit('{"source": {"lsn": '), F.col("pos").cast("string"), F.lit("}}"))
        last = view(spark, sf_dir, feed).agg(F.max("pos").alias("pos")).select(
            F.lit("__debezium-heartbeat.client_1_db_2_v_1").alias("topic"), F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("off"),
            F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit("{}").alias("key"), beat.alias("value"),
        )
        last.write.mode("append").parquet(f"{folder}/feed")
    tables = tuple(TableSpec("shop", f"users_{i}", USER_ROW, ("user_id",)) for i in range(4))
    spec = PipelineSpec(1, 2, "mysql", "shop", tables, frequency="manual", ordering="position", partitions=6, heartbeats_advance=heartbeats)
    pipeline = Pipeline(spark, spec, folder, f"q_{folder.rsplit('-', 1)[1][:12]}", buckets=8, compact_every=2)
    pipeline.run(read_files(spark, f"{folder}/feed", True, None if heartbeats else FILES_PER_BATCH), f"{folder}/checkpoint").awaitTermination()
    return pipeline


@query
def stream_partitioned_state(spark, sf_dir):
    """Keyed topics of six partitions: rows compare by source position, truncates wait for all partitions."""
    pipeline = _partitioned(spark, sf_dir, "partitioned_feed")
    return union_feeds([pipeline.state(t).current().select("topic", "part", "user_id", "event_type", "value", "off", "pos") for t in pipeline.spec.tables])


@query
def stream_lagging_partition_state(spark, sf_dir):
    """The same while one partition is behind: truncates that it has not come to have no effect yet."""
    pipeline = _partitioned(spark, sf_dir, "lagging_feed")
    return union_feeds([pipeline.state(t).current().select("topic", "part", "user_id", "event_type", "value", "off", "pos") for t in pipeline.spec.tables])


@query
def stream_heartbeat_state(spark, sf_dir):
    """One partition falls idle; a heartbeat of the source shows that nothing is missing, and no truncate waits for it."""
    pipeline = _partitioned(spark, sf_dir, "lagging_feed", heartbeats=True)
    return union_feeds([pipeline.state(t).current().select("topic", "part", "user_id", "event_type", "value", "off", "pos") for t in pipeline.spec.tables])


@query
def stream_pending_truncates(spark, sf_dir):
    """Truncates that wait for the partition that is behind."""
    return _partitioned(spark, sf_dir, "lagging_feed").pending_truncates().select("topic", "part", "off", "pos")


@query
def stream_commit_positions(spark, sf_dir):
    """What may be committed meanwhile: never past a pending truncate."""
    return _partitioned(spark, sf_dir, "lagging_feed").commit_positions()


def _users_pipeline(spark: SparkSession, folder: str, control=None) -> Pipeline:
    tables = tuple(TableSpec("shop", f"users_{i}", USER_ROW, ("user_id",)) for i in range(4))
    spec = PipelineSpec(1, 2, "mysql", "shop", tables, frequency="manual")
    return Pipeline(spark, spec, folder, f"u_{folder.rsplit('-', 1)[1][:12]}", control=control, buckets=8)


def _users_now(spark: SparkSession, sf_dir: str, t: TableSpec) -> tuple[DataFrame, str, int]:
    """Rows of a users table at its source, its topic, and the position of the read."""
    topic = f"client_1_db_2_v_1.{t.source_schema}.{t.source_table}"
    rows = view(spark, sf_dir, "users_now").where(F.col("topic") == topic)
    return rows.select("user_id", "event_type", "value"), topic, rows.agg(F.max("position")).first()[0]


@query
def stream_registry_hold(spark, sf_dir):
    """The schema of one table cannot be had at first: the batch stops and is not committed; once it is there the stream
    goes on from the same checkpoint, and nothing is lost or applied twice."""
    folder = run_dir(spark, "hold")
    path, pipeline = write_feed(user_messages(spark, sf_dir), folder), _users_pipeline(spark, folder)
    known, unknown = pipeline.spec, TableSpec("shop", "users_3", T.StructType(), ("user_id",))
    specs = [replace(known, tables=(*known.tables[:3], unknown))]
    pipeline = Pipeline(spark, specs[0], folder, pipeline.name, current_spec=lambda: specs[0], buckets=8)
    held = pipeline.run(read_files(spark, path, True, FILES_PER_BATCH + 3), f"{folder}/checkpoint")
    try:
        held.awaitTermination()
    except StreamingQueryException as stop:
        if "no row schema" not in str(stop):
            raise
    specs[0] = known
    pipeline.run(read_files(spark, path, True, FILES_PER_BATCH + 3), f"{folder}/checkpoint").awaitTermination()
    return union_feeds([pipeline.state(t).current().select(*STATE_COLUMNS) for t in known.tables])


def _paused(spark: SparkSession, sf_dir: str) -> tuple[Pipeline, list]:
    """A pipeline is paused while its feed brings truncates; they are queued, also when batches are replayed. On
    resume one table cannot be read and stays queued; resuming again changes nothing for the other."""
    folder = run_dir(spark, "paused")
    running = [False]

    def control() -> DataFrame:
        sink = "RUNNING" if running[0] else "PAUSED"
        return spark.range(1).select(F.lit(pipeline.name).alias("pipeline"), F.lit("RUNNING").alias("source_state"), F.lit(sink).alias("sink_state"))

    def read_table(t: TableSpec) -> tuple[DataFrame, int]:
        if t.source_table == "users_1":
            raise ConnectionError("the source does not answer")
        rows, _, position = _users_now(spark, sf_dir, t)
        return rows, position

    pipeline = _users_pipeline(spark, folder, control)
    path = write_feed(user_messages(spark, sf_dir), folder)
    for checkpoint in ("watch", "watch_again"):
        pipeline.watch_truncates(read_files(spark, path, True, FILES_PER_BATCH + 3), f"{folder}/{checkpoint}").awaitTermination()
    assert pipeline.resume(read_table) == []
    running[0] = True
    pipeline.run(read_files(spark, path, True, FILES_PER_BATCH + 3), f"{folder}/checkpoint").awaitTermination()
    outcomes = pipeline.resume(read_table)
    return pipeline, [*outcomes, *pipeline.resume(read_table)]


@query
def stream_paused_truncates(spark, sf_dir):
    """What became of the truncates of a paused pipeline, try by try."""
    return lookup(spark, _paused(spark, sf_dir)[1], "topic string,off bigint,outcome string")


@query
def stream_resumed_state(spark, sf_dir):
    """The tables after that: one read anew, the others as the feed leaves them."""
    pipeline, _ = _paused(spark, sf_dir)
    return union_feeds([pipeline.state(t).current().select("topic", "user_id", "event_type", "value", "off") for t in pipeline.spec.tables])


@query
def stream_table_lifecycle(spark, sf_dir):
    """Tables leave a running pipeline and one joins again: emptied and dropped rows do not come back when the whole
    feed is replayed, and the table that joined has its rows as read, and what came behind them."""
    folder = run_dir(spark, "lifecycle")
    path, pipeline = write_feed(user_messages(spark, sf_dir), folder), _users_pipeline(spark, folder)
    tables = pipeline.spec.tables
    feed = spark.read.schema(FEED_SCHEMA).parquet(path)
    cut = feed.agg(F.floor(F.max("off") / 2)).first()[0]
    feed.where(F.col("off") < cut).write.mode("append").parquet(f"{folder}/parts")
    pipeline.run(read_files(spark, f"{folder}/parts", True, FILES), f"{folder}/checkpoint").awaitTermination()
    pipeline.remove_tables({"shop.users_1"}, "truncate")
    pipeline.remove_tables({"shop.users_2"}, "drop")
    feed.where(F.col("off") >= cut).write.mode("append").parquet(f"{folder}/parts")
    pipeline.run(read_files(spark, f"{folder}/parts", True, FILES), f"{folder}/checkpoint").awaitTermination()
    pipeline.add_table(tables[2], *_users_now(spark, sf_dir, tables[2]))
    pipeline.recover(read_files(spark, path, True, FILES), f"{folder}/again").awaitTermination()
    rows = [pipeline.state(t).current().select("topic", "user_id", "event_type", "value", "off") for t in tables]
    return union_feeds(rows)


@query
def stream_evolved_state(spark, sf_dir):
    """Change stream with DDL between its changes: rows keep their offset in the state, and the
    operations after it bring each live row to the last schema when the state is read."""
    folder = run_dir(spark, "evolve")
    columns = {"event_type": "string", "value": "double", "amount": "double", "origin": "string"}
    row = T.StructType([T.StructField("user_id", T.LongType()), *[T.StructField(c, T._parse_datatype_string(t)) for c, t in columns.items()]])
    feed = view(spark, sf_dir, "evolving_feed").withColumn("part", F.lit(0))
    path = write_feed(envelope.encode_envelope(feed, row.names, ["user_id"]), folder)
    state = state_table(spark, folder, "users", USER_KEYS)

    def decode(batch: DataFrame) -> DataFrame:
        return envelope.good_rows(envelope.decode_envelope(batch, row, ["user_id"]))

    drain(spark, path, folder, fold_into(state, decode))
    operations = evolve.bounded_operations(view(spark, sf_dir, "ddl_between"))
    return evolve.evolve_rows(state.current(), operations, columns).select("topic", "user_id", "off", *columns)


def _ddl_streams(spark: SparkSession, sf_dir: str, epochs: bool) -> DataFrame:
    """Two streams, of changes and of DDL text. With ``epochs`` the feed comes in two parts, and after each the
    operations that the data has passed are folded into the state."""
    folder = run_dir(spark, "ddl")
    columns = {"event_type": "string", "value": "double", "amount": "double", "origin": "string"}
    row = T.StructType([T.StructField("user_id", T.LongType()), *[T.StructField(c, T._parse_datatype_string(t)) for c, t in columns.items()]])
    path = write_feed(envelope.encode_envelope(view(spark, sf_dir, "evolving_feed").withColumn("part", F.lit(0)), row.names, ["user_id"]), folder)
    statements = view(spark, sf_dir, "ddl_statements")
    statements.write.parquet(f"{folder}/ddl")
    topics = view(spark, sf_dir, "feed").select(F.col("topic").alias("tbl")).distinct()
    ddl_stream = spark.readStream.schema(statements.schema).parquet(f"{folder}/ddl")
    path_of_operations = f"{folder}/operations"
    start(ddl_stream, record_into(path_of_operations, lambda: topics, allow_destructive=True), f"{folder}/ddl_checkpoint").awaitTermination()
    operations = read_operations(spark, path_of_operations)
    tables = tuple(TableSpec("shop", f"users_{i}", row, ("user_id",)) for i in range(4))
    pipeline = Pipeline(spark, PipelineSpec(1, 2, "mysql", "shop", tables, frequency="manual"), folder, f"d_{folder.rsplit('-', 1)[1][:12]}", buckets=8)
    feed = spark.read.schema(FEED_SCHEMA).parquet(path)
    cut = feed.agg(F.max("off") - F.floor(F.max("off") / 70)).first()[0]
    for part in ([F.col("off") < cut, F.col("off") >= cut] if epochs else [F.lit(True)]):
        feed.where(part).write.mode("append").parquet(f"{folder}/parts")
        pipeline.run(read_files(spark, f"{folder}/parts", True, FILES), f"{folder}/checkpoint").awaitTermination()
        if epochs:
            for t in tables:
                pipeline.fold_schema(t, operations)
    return union_feeds([pipeline.target_rows(t, operations).select("topic", "user_id", "off", *columns) for t in tables])


@query
def stream_ddl_evolved_state(spark, sf_dir):
    """Two streams, one of changes and one of DDL text: the text is parsed, gated and recorded,
    and the state is read at the schema it leads to."""
    return _ddl_streams(spark, sf_dir, epochs=False)


@query
def stream_ddl_epochs_state(spark, sf_dir):
    """The same with schema epochs: operations that the data has passed are folded into the bases, and only later
    ones are read."""
    return _ddl_streams(spark, sf_dir, epochs=True)


@query
def stream_incidents(spark, sf_dir):
    """Incidents of a stream of status samples, a few hours a batch: opened, kept silent and resolved across batches."""
    folder = run_dir(spark, "incidents")
    samples = view(spark, sf_dir, "health_samples")
    path, cuts = f"{folder}/samples", samples.select(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    width = (cuts.high - cuts.low) / 6
    for i in range(6):  # one file a batch, in the order of time
        later = F.col("ts") >= F.lit(cuts.low + i * width)
        part = samples.where(later if i == 5 else later & (F.col("ts") < F.lit(cuts.low + (i + 1) * width)))
        part.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(path)
    log = IncidentLog(spark, f"i_{folder.rsplit('-', 1)[1][:12]}", folder)
    start(stream, log.on_batch, f"{folder}/checkpoint").awaitTermination()
    return log.incidents()


@query
def stream_events_per_op_window(spark, sf_dir):
    """Windowed counters in append mode: the windows that are final behind a ten-minute watermark."""
    folder = run_dir(spark, "windows")
    rows = view(spark, sf_dir, "feed").select("topic", "op", "off", utc_instant(F.col("ts")).alias("ts"))
    path = write_in_order(rows, "off", folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(path)
    counts = events_per_window(stream, ["topic", "op"], delay="10 minutes")
    out = f"{folder}/out"
    counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(out).withColumn("window_start", zone_free(F.col("window_start")))


@query
def stream_once_per_event(spark, sf_dir):
    """Events delivered twice, kept once."""
    folder = run_dir(spark, "once")
    events = table(spark, sf_dir, "events").select("event_id", utc_instant(F.col("ts")).alias("event_time"), "event_type")
    path = write_in_order(events.unionByName(events), "event_id", folder)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 8).parquet(path)
    once, out = once_per_event(stream), f"{folder}/out"
    once.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(once.schema).parquet(out).select("event_id", "event_type")
