"""Feeds of several partitions: position vector, barriers, commit positions, source positions, wrapped keys."""

import json
import random

import pytest
from pyspark.sql import types as T

from changemill.functions import envelope
from changemill.operators import barriers
from changemill.session import run_dir
from changemill.sources.feed import read_files
from changemill.spec import PipelineSpec, TableSpec
from changemill.streaming.apply import Pipeline
from changemill.tables.state_table import StateTable

ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.StringType())])
COLUMNS = "topic string, part int, off long, pos long, op string, id long, v string"
PARTS = 3


def a_feed(rnd, n):
    """Changes in source order, dealt by key; offsets count by partition."""
    offsets, rows = [0] * PARTS, []
    for pos in range(10, 10 + 3 * n, 3):
        key = rnd.randint(1, 12)
        part, op = key % PARTS, rnd.choice("cuuudt")
        rows.append(("t", part, offsets[part], pos, op, None if op == "t" else key, None if op in "td" else f"v{pos}"))
        offsets[part] += 1
    return rows


def expected(rows, parts=PARTS):
    """(live rows, pending truncates, commit positions) by the rules, row by row."""
    reached, following = {}, {}
    for _, part, off, pos, *_ in rows:
        reached[part] = max(reached.get(part, 0), pos)
        following[part] = max(following.get(part, 0), off + 1)
    floor = min(reached.values()) if len(reached) >= parts else -1
    pending = sorted(((r[1], r[2]) for r in rows if r[4] == "t" and r[3] > floor), key=repr)
    wiped = max((r[3] for r in rows if r[4] == "t" and r[3] <= floor), default=-1)
    last = {}
    for r in sorted(rows, key=lambda r: r[3]):
        if r[4] != "t":
            last[r[5]] = r
    live = sorted(((r[5], r[6], r[3]) for r in last.values() if r[4] != "d" and r[3] > wiped), key=repr)
    commit = sorted((p, min([n, *[o for q, o in pending if q == p]])) for p, n in following.items())
    return live, pending, commit


@pytest.mark.parametrize("seed", range(6))
def test_state_does_not_depend_on_cuts(spark, rows, seed):
    """Partitions come at their own pace, batches are cut anywhere, the base is written in between, batches are replayed."""
    rnd = random.Random(seed)
    feed = a_feed(rnd, 60)
    queues = [[r for r in feed if r[1] == p] for p in range(PARTS)]
    state = StateTable(spark, f"parts_{seed}", ["topic", "id"], run_dir(spark, "parts"), buckets=2, order="pos", partitions=PARTS)
    seen, number = [], 0
    while any(queues):
        batch = []
        for queue in queues:
            for _ in range(rnd.randint(0, 14)):
                if queue:
                    batch.append(queue.pop(0))
        if not batch:
            continue
        seen += batch
        df = spark.createDataFrame(batch, COLUMNS)
        state.apply(df, number)
        if rnd.random() < 0.4:
            state.compact()
        if rnd.random() < 0.3:
            state.apply(df, number)
        number += 1
        live, pending, commit = expected(seen)
        if rnd.random() < 0.5 or not any(queues):
            assert rows(state.current(), "id", "v", "pos") == live
            assert rows(state.pending(), "part", "off") == pending
            assert rows(state.commit_positions(), "part", "commit_position") == commit
    df = spark.createDataFrame(feed, COLUMNS)
    assert rows(barriers.partitioned_state(df, ["topic", "id"], partitions=PARTS), "id", "v", "pos") == live
    assert rows(barriers.pending_truncates(df, partitions=PARTS), "part", "off") == pending


def test_nothing_is_passed_while_a_partition_is_unknown(spark, rows):
    early = [("t", 0, 0, 10, "c", 3, "a"), ("t", 0, 1, 12, "t", None, None)]
    df = spark.createDataFrame(early, COLUMNS)
    assert rows(barriers.pending_truncates(df, partitions=2), "off") == [(1,)]
    assert rows(barriers.partitioned_state(df, ["topic", "id"], partitions=2), "id") == [(3,)]
    # without a number of partitions those seen count as all
    assert rows(barriers.pending_truncates(df), "off") == []
    both = df.union(spark.createDataFrame([("t", 1, 0, 11, "c", 1, "late"), ("t", 1, 1, 13, "c", 4, "b")], COLUMNS))
    assert rows(barriers.partitioned_state(both, ["topic", "id"], partitions=2), "id", "v") == [(4, "b")]


def test_soft_deletes_keep_images_by_position(spark, rows):
    state = StateTable(spark, "soft_parts", ["topic", "id"], run_dir(spark, "softparts"), buckets=2, order="pos", keep_images=True)
    state.apply(spark.createDataFrame([("t", 1, 7, 20, "c", 1, "x")], COLUMNS), 0)
    state.compact()
    state.apply(spark.createDataFrame([("t", 1, 8, 22, "d", 1, None)], COLUMNS), 1)
    assert rows(state.soft_deleted(), "id", "v", "__deleted") == [(1, "x", True)]


def test_offsets_order_partitions_by_themselves(spark, rows):
    """Without source positions keyed rows of all partitions are applied, and a truncate empties its own partition."""
    folder = run_dir(spark, "byoffset")
    topic = "client_1_db_2_v_1.shop.a"
    events = [(topic, 0, 5, "c", 2, "a"), (topic, 1, 1, "c", 1, "b"), (topic, 1, 9, "u", 1, "c"), (topic, 0, 6, "t", None, None), (topic, 0, 7, "c", 4, "d")]
    df = spark.createDataFrame(events, "topic string, part int, off long, op string, id long, v string")
    messages = envelope.encode_envelope(df, ["id", "v"], ["id"]).selectExpr("topic", "part", "off", "CAST(NULL AS TIMESTAMP_NTZ) AS ts", "key", "value")
    messages.write.parquet(f"{folder}/feed")
    spec = PipelineSpec(1, 2, "mysql", "shop", (TableSpec("shop", "a", ROW, ("id",)),), frequency="manual")
    pipeline = Pipeline(spark, spec, folder, "byoffset", buckets=2, compact_every=1)
    pipeline.run(read_files(spark, f"{folder}/feed", True), f"{folder}/ck").awaitTermination()
    assert rows(pipeline.state(spec.tables[0]).current(), "id", "v") == [(1, "c"), (4, "d")]
    assert rows(pipeline.commit_positions(), "part", "commit_position") == [(0, 8), (1, 10)]


def test_source_positions_of_several_systems(spark, rows):
    sources = [{"lsn": 77}, {"scn": "78"}, {"file": "mysql-bin.000002", "pos": 5}, {"file": "mysql-bin.000002", "pos": 6, "payload": 1}, {"ts_ms": 1}]
    messages = [("t", i % 2, i, json.dumps({"id": i}), json.dumps({"op": "c", "after": {"id": i, "v": "x"}, "source": s})) for i, s in enumerate(sources)]
    messages.append(("t", 1, 9, json.dumps({"id": 1}), None))
    feed = spark.createDataFrame(messages, "topic string, part int, off long, key string, value string")
    decoded = envelope.decode_envelope(feed, ROW, ["id"], position=True)
    found = {r.off: (r.pos, r._error) for r in decoded.collect()}
    assert found == {0: (77, None), 1: (78, None), 2: ((2 << 40) + 5, None), 3: ((2 << 40) + 6, None), 4: (None, "missing_position")}
    with pytest.raises(ValueError, match="clash"):
        envelope.decode_envelope(feed, T.StructType([T.StructField("pos", T.LongType())]), [], position=True)


def test_keys_wrapped_with_their_schema(spark, rows):
    wrapped = json.dumps({"schema": {"type": "struct"}, "payload": {"id": 6}})
    gone = json.dumps({"schema": {}, "payload": {"op": "d"}})
    messages = [("t", 0, 1, wrapped, None), ("t", 0, 2, wrapped, gone), ("t", 0, 3, json.dumps({"id": 7}), None), ("t", 0, 4, json.dumps({"payload": {}}), None)]
    decoded = envelope.decode_envelope(spark.createDataFrame(messages, "topic string, part int, off long, key string, value string"), ROW, ["id"])
    assert rows(decoded, "off", "op", "id", "_error") == [(1, "d", 6, None), (2, "d", 6, None), (3, "d", 7, None), (4, "d", None, "missing_key")]
    own = T.StructType([T.StructField("payload", T.StringType()), T.StructField("v", T.StringType())])
    plain = spark.createDataFrame([("t", 0, 1, json.dumps({"payload": "k"}), None)], "topic string, part int, off long, key string, value string")
    assert rows(envelope.decode_envelope(plain, own, ["payload"]), "payload", "_error") == [("k", None)]
