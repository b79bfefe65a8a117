"""The folds against brute force, and batch, micro-batches, replays and any order alike."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from changemill.operators import fold
from changemill.session import run_dir
from changemill.tables.state_table import StateTable

SCHEMA = "topic string, k bigint, op string, off bigint, v string"
KEYS = ["topic", "k"]


def brute(events):
    state = {}
    for topic, k, op, off, v in sorted(events, key=lambda e: e[3]):
        if op == "t":
            state = {key: val for key, val in state.items() if key[0] != topic}
        elif op == "d":
            state.pop((topic, k), None)
        else:
            state[(topic, k)] = (off, v)
    return sorted((t, k, off, v) for (t, k), (off, v) in state.items())


def random_feed(n, seed, hot=False):
    rng = random.Random(seed)
    events = []
    for off in range(n):
        topic = "hot" if hot and rng.random() < 0.4 else rng.choice(["a", "b", "c"])
        op = rng.choices("cudrt", [4, 8, 3, 2, 0.3])[0]
        key = None if op == "t" else (0 if hot and rng.random() < 0.4 else rng.randrange(12))
        events.append((topic, key, op, off, None if op in "dt" else f"v{off}"))
    return events


def live(df):
    return sorted(map(tuple, df.select("topic", "k", "off", "v").collect()))


@pytest.mark.parametrize("seed,hot", [(1, False), (2, True), (3, True)])
def test_batch_fold_equals_brute_force(spark, seed, hot):
    events = random_feed(400, seed, hot)
    shuffled = events[:]
    random.Random(seed).shuffle(shuffled)
    df = spark.createDataFrame(shuffled, SCHEMA)
    assert live(fold.truncate_aware_state(df, KEYS)) == brute(events)
    no_truncates = [e for e in events if e[2] != "t"]
    assert live(fold.current_state(df, KEYS)) == brute(no_truncates)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 3), st.sampled_from("cudrt")), min_size=1, max_size=30))
def test_fold_property(spark, ops):
    events = [(t, None if op == "t" else k, op, off, None if op in "dt" else str(off)) for off, (t, k, op) in enumerate(ops)]
    assert live(fold.truncate_aware_state(spark.createDataFrame(events, SCHEMA), KEYS)) == brute(events)


@pytest.mark.parametrize("seed", [11, 12])
def test_any_split_any_order_and_replays_give_the_batch_answer(spark, seed):
    events = random_feed(240, seed, hot=True)
    rng = random.Random(seed)
    table = StateTable(spark, f"split_{seed}", KEYS, run_dir(spark, "split"), buckets=4)
    shuffled = events[:]
    rng.shuffle(shuffled)
    parts = [shuffled[i::4] for i in range(4)]
    for number, part in enumerate(parts):
        table.apply(spark.createDataFrame(part, SCHEMA), number)
        if number == 1:
            table.compact()
        # a replay of the same batch changes nothing
        table.apply(spark.createDataFrame(part, SCHEMA), number)
    assert live(table.current()) == brute(events)
    table.compact()
    assert live(table.current()) == brute(events)
    # older offsets that come again after a compaction change nothing either
    table.apply(spark.createDataFrame(parts[0], SCHEMA), table.next_batch())
    assert live(table.current()) == brute(events)
    table.compact()
    table.compact()
    assert live(table.current()) == brute(events)
    table.drop()


def test_delete_markers_keep_replays_out_until_they_are_purged(spark):
    table = StateTable(spark, "markers", KEYS, run_dir(spark, "markers"), buckets=2)
    table.apply(spark.createDataFrame([("a", 1, "c", 1, "x"), ("a", 1, "d", 5, None), ("a", 2, "c", 6, "y")], SCHEMA), 0)
    table.compact()
    table.apply(spark.createDataFrame([("a", 1, "u", 3, "old")], SCHEMA), 1)
    assert live(table.current()) == [("a", 2, 6, "y")]
    assert {r.k for r in table.with_deletes().collect()} == {1, 2}
    table.compact(purge_deletes_before=6)
    assert {r.k for r in table.with_deletes().collect()} == {2}
    assert [tuple(r) for r in table.positions().collect()] == [("a", 6)]
    table.drop()


def test_new_columns_are_added_as_nullable(spark):
    table = StateTable(spark, "wider", KEYS, run_dir(spark, "wider"), buckets=2)
    table.apply(spark.createDataFrame([("a", 1, "c", 1, "x")], SCHEMA), 0)
    table.apply(spark.createDataFrame([("a", 2, "c", 2, "y", 7)], SCHEMA + ", extra int"), 1)
    assert sorted(map(tuple, table.current().select("k", "v", "extra").collect())) == [(1, "x", None), (2, "y", 7)]
    table.compact()
    table.apply(spark.createDataFrame([("a", 1, "u", 3, "z", 9, "n")], SCHEMA + ", extra int, more string"), 2)
    assert sorted(map(tuple, table.current().select("k", "v", "extra").collect())) == [(1, "z", 9), (2, "y", 7)]
    table.drop()


def test_insert_and_update_modes(spark, rows):
    state = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    changes = spark.createDataFrame(
        [(2, "x", 1, "c"), (3, "y", 2, "c"), (3, "z", 3, "c"), (1, "n", 4, "u"), (1, None, 5, "d")], "k bigint, v string, off bigint, op string"
    )
    good, bad = fold.split_insert_mode(state, changes.where("op = 'c'"), ["k"])
    assert rows(good, "k", "v") == [(3, "y")]
    assert rows(bad, "k", "off", "reason") == [(2, 1, "key_exists"), (3, 3, "duplicate_in_batch")]
    assert rows(fold.update_mode_state(state, changes, ["k"]), "k", "v") == [(2, "x")]
    assert rows(fold.insert_mode_state(state, changes, ["k"]), "k", "v") == [(2, "b"), (3, "y")]
    assert rows(fold.merge_changes(state, changes, ["k"]), "k", "v") == [(2, "x"), (3, "z")]


def test_key_modes(spark):
    assert fold.key_columns("none") == {}
    assert set(fold.key_columns("kafka")) == {"__topic", "__partition", "__offset"}
    assert set(fold.key_columns("record_value", value_fields=["a", "b"])) == {"a", "b"}
    for bad in (("record_key", (), ()), ("record_value", (), ()), ("other", (), ())):
        with pytest.raises(ValueError):
            fold.key_columns(*bad)


@pytest.mark.parametrize("mode", ["insert", "update"])
def test_modes_do_not_depend_on_where_a_batch_is_cut(spark, mode):
    """One batch of a key's changes gives the state that one batch a change gives."""
    ops = [(1, "c"), (1, "d"), (1, "c"), (2, "d"), (2, "u"), (3, "u"), (3, "u"), (2, "c"), (4, "c"), (4, "d"), (3, "d"), (1, "c")]
    changes = [(k, f"v{i}", i, op) for i, (k, op) in enumerate(ops)]
    schema = "k bigint, v string, off bigint, op string"
    apply = fold.insert_mode_state if mode == "insert" else fold.update_mode_state
    start = [(2, "b"), (3, "c")]
    results = []
    for size in (len(changes), 5, 3):
        state = spark.createDataFrame(start, "k bigint, v string")
        for at in range(0, len(changes), size):
            found = apply(state, spark.createDataFrame(changes[at : at + size], schema), ["k"]).collect()
            state = spark.createDataFrame(found, "k bigint, v string")
        results.append(sorted(tuple(r) for r in state.collect()))
    expected = {}
    for k, v in start:
        expected[k] = v
    for k, v, _, op in changes:
        if op == "d":
            expected.pop(k, None)
        elif (k in expected) == (mode == "update"):
            expected[k] = v
    assert results == [sorted(expected.items())] * 3
