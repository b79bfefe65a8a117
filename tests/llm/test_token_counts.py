"""Token counts of prefixes against the unaltered library."""

import random
import time
import unicodedata

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from changemill.llm import token_counts
from changemill.llm.queries import QUERIES

FILE = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [*"aAbzq.,!' \n\t\x0b'sé1ٱΣςİ中　\xa0\x1c\x85́가", "'s", "'LL", "'re", "  ", "😀", "가", "<|endoftext|>", "the", "ing", "..."]


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounts.load(FILE)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(FILE)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def of_prefixes(counter, text):
    total, width, steps = counter.text(text)
    counts = np.cumsum(np.frombuffer(steps, np.int8 if width == 1 else "<i4"), dtype=np.int64).tolist()
    assert len(counts) == len(text) and total == (counts[-1] if counts else 0)
    return counts


def test_every_prefix_counts_as_encoded_alone(counter, library):
    rnd = random.Random(12)
    for _ in range(2500):
        text = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 14)))
        counts, expected = of_prefixes(counter, text), library([text[: i + 1] for i in range(len(text))])
        if unicodedata.is_normalized("NFC", text):
            assert counts == expected, text
        else:  # every prefix that composition does not reach beyond
            ends = np.cumsum([len(p) for p in token_counts.sections(text)])
            assert all(counts[e - 1] == expected[e - 1] for e in ends), text


def test_prefixes_of_whole_documents(counter, library, documents):
    for text in sorted(documents.values(), key=len)[::20]:
        counts, places = of_prefixes(counter, text), range(0, len(text), max(1, len(text) // 15))
        assert [counts[i] for i in places] == library([text[: i + 1] for i in places])


def test_long_words_take_time_in_proportion(counter, library):
    counter.text("warm")
    for unit in ("a", "ab'", "!", "é", "é"):
        took = []
        for n in (10_000, 40_000):
            text = unit * n
            began = time.process_time()
            total = counter.text(text)[0]
            took.append(time.process_time() - began)
            assert [total] == library([text])
        assert took[1] < 12 * took[0] + 0.5, unit


def test_steps_that_no_byte_holds(counter, monkeypatch):
    counter.text("warm")
    own = counter._steps
    monkeypatch.setattr(counter, "memo", {})
    monkeypatch.setattr(counter, "_steps", lambda word: [300, -299, 0, 0] if word == "wide" else own(word))
    assert counter.text("a wide b") == (3, 4, np.array([1, 0, 300, -299, 0, 0, 0, 1], "<i4").tobytes())


def test_op12_counts_every_document(spark, sf_dir, documents, library):
    rows = {r.doc_id: r for r in QUERIES["op12_token_counts"](spark, sf_dir).collect()}
    expected = dict(zip(documents, library(list(documents.values())), strict=True))
    assert {k: r.n_tokens for k, r in rows.items()} == expected
    assert all(r.n_bytes == len(documents[k].encode()) and r.over_limit == (r.n_tokens > 2048) for k, r in rows.items())
    assert any(r.over_limit for r in rows.values())


def test_budgets_without_encoding_again(spark, documents, library):
    texts = sorted(documents.values(), key=len)[::8]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    df = token_counts.prefix_counts(df, FILE).select(
        "*", token_counts.longest_within("prefix_counts", 50).alias("most"), token_counts.count_at("prefix_counts", 77).alias("at"),
    )
    for row in df.collect():
        assert library([row.text[:77]]) == [row.at]
        counts = library([row.text[:i] for i in range(min(len(row.text), row.most + 40) + 1)])
        assert row.most == max(i for i, c in enumerate(counts) if c <= 50)
    short = token_counts.truncate(df, 50).collect()
    assert all(library([r.text])[0] <= 50 and len(r.text) == r.most for r in short)


def test_odd_rows(spark, odd, library):
    out = token_counts.prefix_counts(odd, FILE, out="FOUND")
    assert sorted(c.lower() for c in out.columns) == sorted(odd.columns)
    rows = out.withColumn("n", F.col("found.total")).collect()
    assert len(rows) == odd.count()
    assert [r.n for r in rows] == library([r.text or "" for r in rows])
    assert token_counts.prefix_counts(odd.limit(0), FILE).count() == 0
    nothing = out.select(
        token_counts.count_at("found", F.lit(None)).alias("a"), token_counts.longest_within("found", -1).alias("b"),
        token_counts.count_at("found", 0).alias("c"), token_counts.longest_within("found", 10**9).alias("d"), F.length("text").alias("n"),
    ).collect()
    assert all((r.a, r.b, r.c, r.d) == (None, None, 0, r.n or 0) for r in nothing)


def test_other_files_are_refused(tmp_path):
    with pytest.raises(ValueError, match="not a file"):
        token_counts.PrefixCounts.load(public_tokenizers.path("piece_bpe_32k.model"))
    with pytest.raises(ValueError, match="word ends"):
        token_counts.PrefixCounts.load(public_tokenizers.path("byte_bpe_50k.json")).text("a")
