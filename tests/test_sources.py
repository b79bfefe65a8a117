import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changemill.functions import decode, envelope, names
from changemill.sources import ddl_feed, feed as feeds, profile, signals, snapshot

ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
MESSAGE = "topic string, part int, off bigint, key string, value string"


def messages(spark, *values):
    rows = []
    for off, (key, value) in enumerate(values):
        text = value if isinstance(value, str) or value is None else json.dumps(value)
        rows.append(("p.s.t", 0, off, None if key is None else json.dumps({"id": key}), text))
    return spark.createDataFrame(rows, MESSAGE)


def test_envelopes(spark, rows):
    image, other = {"id": 1, "v": "a"}, {"id": 2, "v": "b"}
    df = messages(
        spark,
        (1, {"before": None, "after": image, "op": "c"}), (1, {"after": other, "op": "u"}), (1, {"after": image, "op": "r"}),
        (1, {"before": image, "after": None, "op": "d"}), (7, None), (None, {"op": "t"}),
        (1, {"schema": {}, "payload": {"after": other, "op": "u"}}),
        (1, {"after": None, "op": "u"}), (1, {"after": image, "op": "q"}), (1, "{broken"), (None, {"after": {"v": "x"}, "op": "c"}),
        (None, {"before": image, "op": "d"}),
    )
    decoded = envelope.decode_envelope(df, ROW, ["id"])
    assert [(r.off, r.op, r.id, r.v) for r in envelope.good_rows(decoded).orderBy("off").collect()] == [
        (0, "c", 1, "a"), (1, "u", 2, "b"), (2, "r", 1, "a"), (3, "d", 1, "a"), (4, "d", 7, None), (5, "t", None, None),
        (6, "u", 2, "b"), (11, "d", 1, "a"),
    ]
    assert rows(envelope.dead_rows(decoded), "off", "_error") == [
        (10, "missing_key"), (7, "missing_after"), (8, "unknown_op"), (9, "malformed_json")
    ]
    with pytest.raises(ValueError):
        envelope.decode_envelope(df, T.StructType([T.StructField("op", T.StringType())]), [])


def test_encode_then_decode_is_the_identity(spark, rows):
    df = spark.createDataFrame([("p.s.t", 0, 1, "c", 5, "x"), ("p.s.t", 0, 2, "d", 5, "x"), ("p.s.t", 0, 3, "t", None, None)], "topic string, part int, off bigint, op string, id bigint, v string")
    back = envelope.good_rows(envelope.decode_envelope(envelope.encode_envelope(df, ["id", "v"], ["id"]), ROW, ["id"]))
    assert rows(back, "off", "op", "id", "v") == [(1, "c", 5, "x"), (2, "d", 5, "x"), (3, "t", None, None)]


def test_field_catalog_reads_the_row_after_the_change(spark, rows):
    schemas = {"p.s.t": envelope.envelope_schema(ROW), "p.s.u": ROW}
    out = envelope.field_catalog(spark, schemas, {"p.s.t": ["id"]})
    assert rows(out, "tbl", "name", "pos", "type_name", "is_key") == [
        ("p.s.t", "id", 0, "bigint", True), ("p.s.t", "v", 1, "string", False), ("p.s.u", "id", 0, "bigint", False), ("p.s.u", "v", 1, "string", False)
    ]
    assert envelope.key_fields(T.StructType([ROW["id"]])) == ["id"]


@pytest.mark.parametrize("value", [0, 1, -1, 200, -200, 2**63 - 1, -(2**63), 10**30, -(10**30), 10**37])
def test_decimals(spark, value):
    import base64
    from decimal import Decimal

    raw = value.to_bytes(max(1, (value.bit_length() + 8) // 8), "big", signed=True)
    df = spark.createDataFrame([(base64.b64encode(raw).decode(),)], "t string")
    assert df.select(decode.decimal_from_base64(F.col("t"), 38, 3)).first()[0] == Decimal(value).scaleb(-3)


def test_damaged_decimals_and_dates_become_null(spark):
    df = spark.createDataFrame([("!!",), (None,), ("A" * 24,)], "t string")
    assert [r[0] for r in df.select(decode.decimal_from_base64(F.col("t"), 38, 2)).collect()] == [None, None, None]
    df = spark.createDataFrame([("0000-00-00",), ("2024-02-30 00:00:00",), ("2024-02-29 01:02:03",)], "t string")
    got = [r[0] for r in df.select(decode.timestamp_from_text(F.col("t"))).collect()]
    assert got[:2] == [None, None] and got[2].isoformat() == "2024-02-29T01:02:03"


def test_topic_pattern_and_routing(spark):
    topics = [
        "client_1_db_2_v_1.shop.orders", "client_1_db_2_v_10.sales.dbo.orders", "client_1_db_2_v_1.shop.ddl_events",
        "client_1_db_2_v_1.sales.dbo.debezium_signal", "client_1_db_2_v_1.signals", "client_1_db_3_v_1.shop.orders", "client_2_db_2_v_1.shop.orders",
        "client_1_db_2_v_1.shop.my_ddl_events",
    ]
    df = spark.createDataFrame([(t,) for t in topics], "topic string")
    assert [r.topic for r in feeds.subscribed(df, 1, 2).collect()] == [topics[0], topics[1], topics[7]]
    assert [r.topic for r in feeds.subscribed(df, 1).collect()] == [topics[0], topics[1], topics[5], topics[7]]
    row = df.where(F.col("topic") == topics[1]).select(
        names.default_target(F.col("topic")).alias("target"), names.topic_db_id(F.col("topic")).alias("db"),
        names.reroute_schema(F.col("topic"), F.lit("w")).alias("moved"),
    ).first()
    assert tuple(row) == ("dbo_orders", 2, "client_1_db_2_v_10.w.dbo.orders")


def test_bare_names_and_slugs(spark):
    df = spark.createDataFrame([('"db"."s"."t"', "table"), ("public.users.email", "table column"), ("users", "table column"), ("s.t.c", "table constraint")], "i string, o string")
    assert [r[0] for r in df.select(names.bare_name(F.col("i"), F.col("o"))).collect()] == ["t", "users", "users", "t"]
    df = spark.createDataFrame([("My Shop-DB (new)!",)], "n string")
    assert df.select(names.slug(F.col("n")), names.slug(F.col("n"), 7)).first() == ("my_shop_db_new", "my_shop")


def test_include_list_has_the_capture_tables(spark, rows):
    mapping = spark.createDataFrame([("shop", None, "a", True), ("shop", "x", "b", True), ("shop", None, "c", False)], "database string, source_schema string, source_table string, is_enabled boolean")
    assert rows(feeds.include_list(mapping, "mysql")) == [("shop.a",), ("shop.b",)]
    assert rows(feeds.include_list(mapping, "postgresql")) == [("ddl_capture.ddl_events",), ("public.a",), ("x.b",)]
    assert rows(feeds.include_list(mapping, "mssql")) == [("dbo.a",), ("dbo.debezium_signal",), ("x.b",)]
    assert rows(feeds.include_list(mapping, "oracle", "cdc")) == [("CDC.DEBEZIUM_SIGNAL",), ("CDC.a",), ("x.b",)]


def test_history_and_capture(spark, rows):
    feed = messages(
        spark, (None, {"databaseName": "shop", "ddl": "ALTER TABLE t ADD a INT"}), (None, {"databaseName": "MYSQL", "ddl": "x"}),
        (None, {"databaseName": "shop"}), (None, "{oops"), (None, None),
        (None, {"databaseName": "shop", "tableChanges": [{"type": "ALTER", "id": '"shop"."dbo"."t"', "table": {"columns": [{"name": "a", "typeName": "int"}, {"name": "b", "typeName": "varchar", "length": 5, "optional": False}], "primaryKeyColumnNames": ["a"]}}]}),
    )
    events, dead = ddl_feed.read_history(feed)
    assert [r.off for r in events.orderBy("off").collect()] == [0, 5]
    assert rows(dead, "off", "error") == [(3, "malformed_json")]
    assert rows(ddl_feed.column_catalog(events), "tbl", "pos", "name", "type_name", "length", "optional", "is_key") == [
        ("t", 0, "a", "INT", None, True, True), ("t", 1, "b", "VARCHAR", 5, False, False)
    ]
    def event(i, **kw):
        return (None, {"after": {"event_id": i, "schema_name": "public", "object_name": "public.t", "object_type": "table", **kw}})
    capture = messages(spark, event("a"), event("a", object_name="public.late"), event("b", processed=True), event("c", schema_name="pg_toast"), (None, {"after": None}))
    assert rows(ddl_feed.read_capture(capture), "event_id", "off", "tbl") == [("a", 0, "t")]


def test_ddl_feeds_become_statements_of_the_data_topic(spark, rows):
    feed = messages(
        spark, (None, {"databaseName": "shop", "ddl": "alter table `shop`.`t` ADD a INT"}),
        (None, {"databaseName": "shop", "ddl": "ALTER TABLE x RENAME COLUMN a TO b", "tableChanges": [{"type": "ALTER", "id": '"shop"."y"', "table": {}}]}),
    )
    events, _ = ddl_feed.read_history(feed)
    assert rows(ddl_feed.history_statements(events, "p"), "off", "system", "tbl") == [(0, "mysql", "p.shop.t"), (1, "mysql", "p.shop.y")]
    after = {"event_id": "e", "schema_name": "public", "object_name": "public.t.c", "object_type": "table column", "ddl_command": "ALTER TABLE t DROP c"}
    capture = ddl_feed.read_capture(messages(spark, (None, {"after": after})))
    assert rows(ddl_feed.capture_statements(capture, "p", "db"), "ddl_id", "tbl", "ddl") == [("e", "p.db.t", "ALTER TABLE t DROP c")]


def test_signals(spark, rows):
    def body(kind, *tables):
        return json.dumps({"id": "1", "type": kind, "data": {"type": "incremental", "data-collections": list(tables)}})
    feed = spark.createDataFrame([("p", 1, body("execute-snapshot", "s.a", "s.b")), ("p", 2, body("pause-snapshot")), ("q", 1, body("log")), ("q", 2, "{")], "key string, off bigint, value string")
    read = signals.read_signals(feed)
    mapping = spark.createDataFrame([("s", "a", "s_a", True), ("s", "b", "s_b", False)], "source_schema string, source_table string, target_table string, is_enabled boolean")
    assert rows(signals.requested_tables(read, mapping), "prefix", "target_table") == [("p", "s_a")]
    assert rows(signals.active_snapshots(read)) == [("p", "paused", 2)]


@pytest.mark.parametrize("mode,fresh,kept", [("initial", True, False), ("when_needed", True, False), ("never", False, False), ("always", True, True), ("schema_only", False, False), ("recovery", False, False)])
def test_snapshot_modes(mode, fresh, kept):
    assert snapshot.needs_data(mode, has_state=False) is fresh
    assert snapshot.needs_data(mode, has_state=True) is kept
    assert snapshot.needs_data("when_needed", has_state=True, offset_usable=False)
    with pytest.raises(ValueError):
        snapshot.needs_data("sometimes", True)


def test_chunks_lose_to_the_log_inside_their_window_only(spark, rows):
    table = spark.range(10).select(F.col("id").alias("k"), F.lit("snap").alias("v"))
    chunks = snapshot.chunk_snapshot(table, ["k"], 4)
    assert rows(chunks.groupBy("chunk").count()) == [(0, 4), (1, 4), (2, 2)]
    # key 1 changes inside its window, key 5 before its window, key 6 after it, key 9 is deleted inside
    log = spark.createDataFrame([(1, "log", 7, "u"), (5, "log", 3, "u"), (6, "log", 25, "u"), (9, None, 22, "d")], "k bigint, v string, off bigint, op string")
    reads = snapshot.surviving_reads(chunks, log, ["k"], 10)
    state = dict(rows(snapshot.merge_snapshot(reads, log, ["k"]), "k", "v"))
    assert state == {0: "snap", 1: "log", 2: "snap", 3: "snap", 4: "snap", 5: "snap", 6: "log", 7: "snap", 8: "snap"}


def test_resync_starts_the_table_over(spark, rows):
    from changemill.operators.fold import truncate_aware_state

    feed = spark.createDataFrame([("a", 1, "c", 1, "old"), ("a", 4, "c", 2, "old"), ("b", 3, "c", 1, "other"), ("a", 9, "u", 1, "new"), ("a", 6, "u", 3, "tied")], "topic string, off bigint, op string, k bigint, v string")
    table = spark.createDataFrame([(1, "read"), (3, "read")], "k bigint, v string")
    state = truncate_aware_state(snapshot.resync(feed, table, "a", 6), ["topic", "k"])
    assert rows(state, "topic", "k", "v") == [("a", 1, "new"), ("a", 3, "read"), ("b", 1, "other")]


def test_profile(spark, rows, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "t"))
    tables = {"t": spark.read.parquet(str(tmp_path / "t")), "sys.x": spark.range(1), "dbo.debezium_signal": spark.range(1)}
    assert rows(profile.table_profile(spark, tables, {"t": ["id"]})) == [("t", 1, 1, 7)]
    size = profile.table_bytes({"t": tables["t"]}).first()
    assert size.bytes > 0 and size.files >= 1


class Recorder:
    """Stands in for a reader or writer and keeps the options it is given."""

    def __init__(self):
        self.given = {}

    def __getattr__(self, name):
        def call(*args, **kwargs):
            if name == "option":
                self.given[args[0]] = args[1]
            elif name == "options":
                self.given.update(kwargs)
            else:
                self.given[name] = args[0] if args else None
            return self
        return call


class Session:
    def __init__(self):
        self.read, self.readStream = Recorder(), Recorder()


def test_jdbc_reader_options():
    session = Session()
    snapshot.read_jdbc(session, "jdbc:x", "t", {"user": "u"}, key="id", bounds=(1, 900), partitions=8)
    assert session.read.given == {
        "format": "jdbc", "user": "u", "url": "jdbc:x", "dbtable": "t", "fetchsize": 10000, "partitionColumn": "id",
        "lowerBound": 1, "upperBound": 900, "numPartitions": 8, "load": None,
    }
    session = Session()
    snapshot.read_jdbc(session, "jdbc:x", "t", {})
    assert "numPartitions" not in session.read.given


def test_kafka_reader_options(spark):
    session = Session()
    feeds.read_kafka(session, "b:9092", 1, 2, max_offsets_per_trigger=5000, options={"failOnDataLoss": "true"})
    given = session.readStream.given
    assert given["format"] == "kafka" and given["kafka.bootstrap.servers"] == "b:9092" and given["maxOffsetsPerTrigger"] == 5000
    assert given["subscribePattern"] == names.topic_pattern(1, 2) and given["failOnDataLoss"] == "true"
    session = Session()
    feeds.read_kafka(session, "b:9092", 1, streaming=False)
    assert session.readStream.given == {} and session.read.given["subscribePattern"] == names.topic_pattern(1)


def test_small_decoders_and_filters(spark, rows):
    import base64

    df = spark.createDataFrame([(base64.b64encode(b"ab").decode(), 1700000000123)], "t string, ms bigint")
    row = df.select(decode.bytes_from_base64(F.col("t")), decode.timestamp_from_millis(F.col("ms"))).first()
    assert bytes(row[0]) == b"ab" and row[1].isoformat() == "2023-11-14T22:13:20.123000"
    df = spark.createDataFrame([("shop",), ("Sys",), ("pg_catalog",), (None,)], "db string")
    assert [r.db for r in feeds.without_system_schemas(df, "db").collect()] == ["shop", None]


def test_target_names(spark, rows):
    from changemill.operators.routing import target_name

    mapping = spark.createDataFrame([("a", "custom", True), ("b", "off", False)], "source_table string, target_table string, is_enabled boolean")
    tables = spark.createDataFrame([("shop", "a"), ("shop", "b")], "database string, source_table string")
    assert rows(target_name(tables, mapping), "source_table", "target_table") == [("a", "custom"), ("b", "shop_b")]
