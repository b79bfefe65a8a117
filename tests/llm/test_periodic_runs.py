"""Periodic runs against a plain search of every period."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pytest

from changemill.llm import periodic_runs
from changemill.llm.queries import QUERIES

WORD = re.compile("[^ \t-\r]+")


def least_period(x):
    border = [0] * len(x)
    for i in range(1, len(x)):
        k = border[i - 1]
        while k and x[i] != x[k]:
            k = border[k - 1]
        border[i] = k + (x[i] == x[k])
    return len(x) - border[-1]


def plain_runs(x, least=24, times=3):
    found = []
    for q in range(1, len(x) // times + 1):
        t = 0
        while t + q < len(x):
            begin = t
            while t + q < len(x) and x[t] == x[t + q]:
                t += 1
            length = t - begin + q
            if t > begin and length >= max(least, times * q) and least_period(x[begin : begin + length]) == q:
                found.append((begin, length, q))
            t += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_kept(x, runs):
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(x) if i not in dropped]


def as_tuples(found):
    return list(zip(*(a.tolist() for a in found), strict=True))


def a_sequence(rnd):
    kind = rnd.random()
    if kind < 0.3:
        return [rnd.choice("ab") for _ in range(rnd.randint(0, 140))]
    out = []
    while len(out) < rnd.randint(1, 200):
        block = [rnd.choice("abcdefgh"[: rnd.randint(1, 8)]) for _ in range(rnd.randint(1, 40))]
        times = rnd.choice([1, 2, 3, 3, 4, 9])
        out += (block * times)[: len(block) * times - rnd.randint(0, len(block) - 1)]
    return out


@pytest.mark.parametrize("least", [3, 5, 24, 40])
def test_runs_are_those_of_a_plain_search(least):
    rnd, seen = random.Random(11), 0
    for _ in range(400):
        x = a_sequence(rnd)
        codes = np.array([ord(c) for c in x], np.int64)
        found = as_tuples(periodic_runs.runs(codes, least))
        assert found == plain_runs(x, least), x
        seen += len(found)
    assert seen > 100


def test_texts_of_a_slice_do_not_meet():
    rnd = random.Random(5)
    texts = [a_sequence(rnd) for _ in range(60)]
    codes = np.array([i << 32 | ord(c) for i, x in enumerate(texts) for c in x], np.int64)
    starts = np.cumsum([0, *map(len, texts)])
    expected = [(starts[i] + s, n, q) for i, x in enumerate(texts) for s, n, q in plain_runs(x)]
    assert as_tuples(periodic_runs.runs(codes)) == expected


def test_long_texts_take_time_in_proportion():
    block = np.random.default_rng(1).integers(0, 1000, 70_000)
    for make in (lambda n: np.zeros(n, np.int64), lambda n: np.arange(n) % 7, lambda n: np.resize(block, n)):
        took = []
        for n in (250_000, 1_000_000):
            began = time.process_time()
            found = as_tuples(periodic_runs.runs(make(n)))
            took.append(time.process_time() - began)
            assert len(found) == 1 and found[0][:2] == (0, n)
        assert took[1] < 9 * took[0] + 1


def test_op11_equals_a_plain_search(spark, sf_dir, documents):
    rows = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, sf_dir).collect()}
    assert rows.keys() == documents.keys()
    with_runs = 0
    for key, text in documents.items():
        x = WORD.findall(text)
        h = zlib.crc32(str(key).encode())
        g, n = h // 10, len(x)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            x = x[:a] + [x[a + (i - a) % p] for i in range(a, n)]
        if len(x) > 3000:
            continue  # the plain search takes the square of the length
        runs, row = plain_runs(x), rows[key]
        with_runs += bool(runs)
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if runs else (None,) * 3
        milli = 1000 * best[1] // best[2] if runs else None
        assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (len(runs), *best, milli)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(" ".join(plain_kept(x, runs)).encode()).hexdigest()
    assert with_runs > 10


def test_odd_rows(spark, odd):
    out = periodic_runs.find_runs(odd, out="FOUND")
    assert sorted(c.lower() for c in out.columns) == sorted(odd.columns)
    rows = out.collect()
    assert len(rows) == odd.count()
    for row in rows:
        x = WORD.findall(row.text or "")
        found = [tuple(r) for r in row.FOUND.runs]
        if len(x) < 3000:
            assert found == plain_runs(x) and row.FOUND.kept == plain_kept(x, found)
        else:
            assert found == [(0, 20_000, 1), (20_000, 1000, 2)] and row.FOUND.kept == ["word", "😀", "end."]
    assert periodic_runs.find_runs(odd.limit(0)).count() == 0
    with pytest.raises(ValueError, match="three periods"):
        periodic_runs.find_runs(odd, times=2)


def test_best_run_of_equals(spark):
    runs = "array(named_struct('start', 0L, 'length', 30L, 'period', 10L), named_struct('start', 5L, 'length', 24L, 'period', 3L), named_struct('start', 7L, 'length', 48L, 'period', 6L))"
    df = spark.sql(f"SELECT {runs} AS r UNION ALL SELECT slice({runs}, 1, 0)")
    found = [r.best for r in df.select(periodic_runs.longest_repeat("r").alias("best")).collect()]
    assert tuple(found[0]) == (5, 24, 3) and found[1] is None
