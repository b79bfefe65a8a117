"""The n-gram Jaccard join against all pairs, with both kinds of signature and every edge case."""

import itertools
import random

import duckdb
import pytest

from changemill.llm import ngram_join
from changemill.llm.queries import QUERIES
from changemill.llm.sql import oracle_sql

SCHEMA = "doc_id long, text string, node string, comp string"


def grams(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def brute(docs, n, percent):
    """Least id that each can reach, by comparing all pairs."""
    sets = {key: grams(text, n) for key, text in docs}
    least = {key: key for key in sets}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((find(a), find(b)))
            least[high] = low
    return {key: (len(sets[key]), find(key)) for key in sets}


def corpus(seed):
    """Bases of many lengths, edited at random places, with passages that many of them share."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 4)))
    passages = [[word() for _ in range(40)] for _ in range(3)]
    docs = []
    for size in (1, 2, 3, 4, 5, 8, 12, 16, 17, 19, 30, 33, 60, 70, 130, 300):
        base = [word() for _ in range(size)] + (passages[size % 3] * 3 if size > 15 and size % 2 else [])
        for edits in (0, 0, 1, 1, 1, 2, 3, 5, 8, 13):
            text = list(base)
            for _ in range(min(edits, size // 3)):
                text[rnd.randrange(len(text))] = word()
            docs.append(" ".join(text).upper() if edits == 1 else "\n".join(text))
    docs += [" ".join(rnd.choice(passages) + rnd.choice(passages)) for _ in range(12)] + ["", None, " \t"]
    return list(enumerate(docs))


@pytest.mark.parametrize("frequent", [1, 3, 1000])
@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, frequent, n, percent):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    docs = corpus(frequent)
    found = ngram_join.classify(spark.createDataFrame(docs, "doc_id long, text string"), n, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(docs, n, percent)


def test_prefixes_of_linked_sets_share_a_signature():
    import numpy as np

    rnd = random.Random(5)
    for _ in range(400):
        n = rnd.randint(1, 400)
        universe = np.array(rnd.sample(range(1, 1 << 60), 600), np.uint64)
        counts = np.array([rnd.choice([1, 2, 40, 90]) for _ in universe], np.uint32)
        left = set(rnd.sample(range(600), n))
        right = set(left)
        for _ in range(rnd.randint(0, max(1, n // 8))):
            right.discard(rnd.choice(sorted(right) or [0]))
            right.add(rnd.randrange(600)) if rnd.random() < 0.5 else None
        if not right or 100 * len(left & right) < 80 * len(left | right):
            continue
        a, b = (ngram_join.signatures(universe[sorted(s)], counts[sorted(s)], 32, 80)[0] for s in (left, right))
        assert np.intersect1d(a, b).size


@pytest.mark.parametrize("small", [0, 3])
@pytest.mark.parametrize("frequent", [1, 3])
def test_differences_to_a_hub_lose_no_link(spark, monkeypatch, frequent, small):
    """Postings of any size joined by differences, after two hub rounds and after none."""
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "SMALL_POSTING", small)
    monkeypatch.setattr(ngram_join, "HUB_ROUNDS", 1 if small else 2)
    docs = corpus(10 + frequent + small) + [(1000 + i, t) for i, t in enumerate(near_copies(60, small))]
    docs += [(i, docs[j][1] + " xx yy") for i, j in ((80, 140), (1003, -1), (1004, -9))]  # several texts of one id
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {(r.doc_id, r.component_id) for r in ngram_join.classify(df, 4, 85).collect()}
    assert found == set(brute_of_ids(docs, 4, 85).items())


def near_copies(n, seed):
    """Edits of one text that is not among them: five to seven words each, or one more in a copy of another's."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base, out = [word() for _ in range(300)], []
    for i in range(n):
        text = list(rnd.choice(out)) if i % 10 == 9 else list(base)
        for at in rnd.sample(range(300), 1 if i % 10 == 9 else rnd.randint(5, 7)):
            text[at] = word()
        out.append(text)
    return [" ".join(text) for text in out]


def brute_of_ids(docs, n, percent):
    """Least id that each can reach, rows of one id being one node."""
    sets = [(key, grams(text, n)) for key, text in docs]
    least = {key: key for key, _ in docs}

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for (a, x), (b, y) in itertools.combinations(sets, 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((find(a), find(b)))
            least[high] = low
    return {key: find(key) for key in least}


def test_near_copies_that_do_not_link_are_not_paired(spark, monkeypatch):
    """Copies that share a base but link with few others: the pairs compared follow the rows, not their square."""
    pairs, keep = [], ngram_join._Folder.keep

    def counted(folder, df):
        kept = keep(folder, df)
        if kept.columns == ["a", "b"]:
            pairs.append(kept.count())
        return kept

    monkeypatch.setattr(ngram_join._Folder, "keep", counted)
    docs = list(enumerate(near_copies(240, 1)))
    found = ngram_join.classify(spark.createDataFrame(docs, "doc_id long, text string"), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute(docs, 4, 85)
    assert max(pairs) < 10 * len(docs)


def test_tokens_around_a_hub_are_not_joined_with_the_square_of_a_group(spark, monkeypatch):
    """Edits of one text, few to many: the rows that meet by a token follow the prefixes, not the square of the family."""
    met, join = [], type(spark.range(1)).join

    def counted(left, right, on=None, how=None):
        if isinstance(on, list) and "token" in on:
            n, m = (side.groupBy(*on).count().withColumnRenamed("count", name) for side, name in ((left, "n"), (right, "m")))
            met.append(join(n, m, on).selectExpr("sum(n * m)").first()[0] or 0)
        return join(left, right, on, how)

    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    base, docs = [word() for _ in range(300)], []
    for i in range(160):
        text = list(base)
        for at in rnd.sample(range(300), rnd.randint(4, 24)):
            text[at] = rnd.choice(["one", "two", "three"]) if i % 2 else word()
        docs.append((i, " ".join(text)))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    expected = brute([tuple(r) for r in docs.collect()], 4, 85)
    monkeypatch.setattr(type(docs), "join", counted)
    found = ngram_join.classify(docs, 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
    assert met and sum(met) < 8_000


def test_edge_cases(spark):
    rows = [(1, "a b c d e f", "x", "y"), (1, "a b c d e f", "x", "y"), (None, "a b c d e f", "z", "z"), (3, None, None, None), (2, "A B\tC D E F", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classify(df, 4, 85).collect())
    assert found == [(1, 3, 1), (1, 3, 1), (2, 3, 1), (3, 0, 3)]
    kept = ngram_join.first_of_each(df, 4, 85)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (False, 1), (False, 3), (True, None)]
    assert ngram_join.classify(df.limit(0)).count() == 0


def test_op6_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    expected = con.execute(oracle_sql()["op6_ngram_join"]).fetchall()
    found = QUERIES["op6_ngram_join"](spark, sf_dir).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found)) == sorted(expected)
