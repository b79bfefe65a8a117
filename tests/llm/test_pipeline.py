"""The stages of the pipeline on the smallest tables, each against plain Python on its own input."""

import json
import re

import corpus_pipeline
import duckdb
import pytest

import __spark_entry__ as registry
from changemill.llm import ngram_join, quality
from changemill.llm.queries import QUERIES
from changemill.llm.sql import oracle_sql

from test_ngram_join import brute
from test_texts import base_spans, plain_dedup
from test_tokens import WORDS, check_pieces


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """Rows before the first stage and after each."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.collect())
    return out


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "shared_lines", "near_duplicates", "secrets", "windows"]
    for rows in steps[:-1]:
        assert list(rows[0].asDict()) == corpus_pipeline.COLUMNS
        assert all(r.n_chars == len(r.text) for r in rows)


def test_quality_keeps_what_the_rules_keep(spark, sf_dir, steps):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = quality.fit(docs, quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    kept = {r.doc_id for r in quality.judge(docs, weights).where("kept").collect()}
    assert {r.doc_id for r in steps[1]} == kept and 0 < len(kept) < len(steps[0])


def test_lines(steps):
    expected = plain_dedup([(r.doc_id, r.text) for r in steps[1]], 40, 5)
    assert len(steps[2]) == len(steps[1])
    found = {r.doc_id: r.text for r in steps[2]}
    assert sorted(re.sub(r", \d+, \d+\)$", ")", e) for e in expected) == sorted(repr((k, v)) for k, v in found.items())


def test_near_duplicates(steps):
    docs = [(r.doc_id, r.text) for r in steps[2]]
    expected = {k for k, (_, first) in brute(docs, 5, 80).items() if k == first}
    assert {r.doc_id for r in steps[3]} == expected


def test_secrets_and_windows(steps):
    before = {r.doc_id: r.text for r in steps[3]}
    after = {r.doc_id: r.text for r in steps[4]}
    assert before.keys() == after.keys()
    assert all((before[k] == after[k]) or "[SECRET]" in after[k] for k in before)
    assert all("[SECRET]" in after[k] for k in before if base_spans(before[k]))
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    encoded = tokenizer.encode_batch(list(after.values()), add_special_tokens=False)
    check_pieces(steps[5], {k: [*e.ids, 2] for k, e in zip(after, encoded, strict=True)}, 4096)


def test_run_gives_the_last_stage(spark, sf_dir, steps):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert sum(r.length for r in rows) == sum(r.length for r in steps[5])


def test_eleven_queries_are_registered():
    found = registry.queries()
    assert "pipeline" in found
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert json.dumps(sorted(registry.oracle_sql()))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df, expected = QUERIES[name](spark, sf_dir), con.sql(oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    want = sorted(repr(tuple(dict(zip(expected.columns, r, strict=True))[c] for c in columns)) for r in expected.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want


def test_op6_and_op9_over_whole_tables(spark, sf_dir, documents):
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op6_ngram_join"](spark, sf_dir).collect()}
    assert found == brute(list(documents.items()), 4, 85)
    assert ngram_join.tokens("a b c", 4).size == 1
    assert QUERIES["op9_quality"](spark, sf_dir).count() == len(documents)
