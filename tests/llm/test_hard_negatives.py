"""Hard negatives against a plain search and SQL."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from changemill.llm import hard_negatives
from changemill.llm.queries import QUERIES
from changemill.llm.sql import oracle_sql


def plain(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    least = {}
    for key, label, vector in rows:
        if key is not None and label is not None and vector is not None and all(x is not None for x in vector):
            least[key] = min(least.get(key, (label, vector)), (label, vector))
    out = []
    for key, (label, vector) in least.items():
        if not is_anchor(key):
            continue
        score = lambda v: sum(a * b for a, b in zip(vector, v, strict=False))  # noqa: B023, E731
        same = sorted((-score(v), k) for k, (m, v) in least.items() if m == label and k != key)[:positives]
        other = sorted((-score(v), k) for k, (m, v) in least.items() if m != label)
        for p, positive in same:
            fit = [(s, k) for s, k in other if low * -p <= 100 * -s <= high * -p]
            out += [(key, positive, n, k, -p, -s) for n, (s, k) in enumerate(fit[:negatives], 1)]
    return sorted(out)


def collected(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert df.columns == names
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("scale", [2, 60, 1 << 20, 1 << 27])
def test_windows_ties_and_copies(spark, monkeypatch, scale):
    """Small blocks, many ties, repeated keys, one label and one vector that hold a third of the rows."""
    for name, value in {"MOST_ROWS": 40, "MOST_ANCHORS": 7, "_ROWS": 16, "_ANCHORS": 3}.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rnd = random.Random(scale)
    rows = []
    for i in range(300):
        vector = [1, 1, 1, 1] if i % 3 == 0 else [rnd.randint(-scale, scale) for _ in range(rnd.choice([4, 4, 4, 3, 0]))]
        rows.append((i if rnd.random() < 0.9 else rnd.randint(0, 300), rnd.choice([1, 1, 2, 3, None]), vector))
    rows += [(None, 1, [1]), (5, 1, None), (10, 2, [1, None])]
    df = spark.createDataFrame(rows, "vec_id long, label int, vector array<long>")
    found = collected(hard_negatives.mine(df, F.col("vec_id") % 5 == 0))
    assert found == plain(rows, lambda k: k % 5 == 0)
    assert len(found) > 30


def test_slots_answer_every_window():
    rnd = random.Random(3)
    for _ in range(500):
        scores = [rnd.randint(0, 60) for _ in range(rnd.randint(0, 5))]
        slots = hard_negatives._slots(scores, 50, 95)
        assert all(a[1] > b[0] for a, b in zip(slots, slots[1:], strict=False))
        inside = lambda n: any(b <= n <= t for t, b in slots)  # noqa: B023, E731
        assert all(inside(n) or not any(50 * s <= 100 * n <= 95 * s for s in scores) for n in range(70))


def test_op13_equals_its_sql(spark, sf_dir):
    sf_dir = sf_dir.replace("0.001", "0.01")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    expected = sorted(con.execute(oracle_sql()["op13_hard_negatives"]).fetchall())
    assert collected(QUERIES["op13_hard_negatives"](spark, sf_dir)) == expected and expected


def test_op13_of_odd_vectors(spark, tmp_path):
    """Nulls and numbers that are not finite, against a plain search."""
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.normal(size=8).astype("float32").tolist(), int(rnd.integers(0, 10))) for i in range(400)]
    rows += [(400, [math.nan] * 8, 1), (450, [1.0] * 7 + [math.inf], 1), (500, [None] + [1.0] * 7, 1), (550, None, 1), (600, [0.5] * 8, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/embeddings.parquet")
    usable = [(k, (m + 1) % 10 if k % 7 == 0 else m, [math.floor(256 * x) for x in v]) for k, v, m in rows[:400]]
    found = collected(QUERIES["op13_hard_negatives"](spark, str(tmp_path)))
    assert found == plain(usable, lambda k: k % 50 == 0) and found


def test_odd_tables(spark):
    df = spark.createDataFrame([(50, [1, 2], 1, 2)], "vec_id long, vector array<long>, label int, line int")
    assert hard_negatives.mine(df, F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    huge = spark.createDataFrame([(0, [1 << 40], 1), (1, [1 << 40], 1)], "vec_id long, vector array<long>, label int")
    with pytest.raises(Exception, match="beyond a long"):
        hard_negatives.mine(huge, F.col("vec_id") == 0).count()
