"""Encoders, packing and token files against the libraries themselves."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from changemill.llm import bpe, packing, token_store, tokens
from changemill.llm.tokens import WordIds

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PATTERN = public_tokenizers.PATTERN
ALPHABET = [*"aAbz.,!' \n\t\x0b'sé1ٱΣςİ中　\xa0\x1ć", "'s", "'LL", "  ", "😀", "<|endoftext|>", "the", " of"]


def odd_texts(n):
    rnd = random.Random(4)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def words():
    tokenizer = Tokenizer.from_file(WORDS)
    tokenizer.encode_special_tokens = True
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_byte_ids_are_those_of_the_library(documents):
    codec = bpe.load(RANKS, PATTERN)
    own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    for text in [*documents.values(), *odd_texts(4000), "a" * 5000, "ab " * 3000]:
        ids = np.frombuffer(codec.encode(text), "<i4")
        assert ids.tolist() == own.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_perfect_hash_is_minimal_and_exact():
    values = {f"key{i}".encode(): i for i in range(3000)}
    table = bpe.PerfectHash(values)
    assert len(table.keys) == 3000 and None not in table.keys
    assert all(table.find(k) == v for k, v in values.items())
    assert table.find(b"other") == -1 and bpe.PerfectHash({}).find(b"x") == -1


def test_bpe_of_odd_rows(spark, odd):
    out = bpe.decode(bpe.encode(odd, RANKS, PATTERN), RANKS, PATTERN)
    assert set(out.columns) == {*odd.columns, "decoded"}
    rows = out.collect()
    assert len(rows) == odd.count()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in rows)
    assert bpe.encode(odd.limit(0), RANKS, PATTERN).count() == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode(spark.sql("SELECT array(99999999) AS ids"), RANKS, PATTERN).collect()


def test_word_ids_are_those_of_the_library(documents, words):
    texts = [*documents.values(), *odd_texts(4000)]
    encoder = WordIds.load(WORDS)
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == words(texts)


def test_a_full_memory_keeps_the_words_at_hand(monkeypatch, words):
    monkeypatch.setattr(tokens, "MEMO_WORDS", 60)
    encoder, learnt = WordIds.load(WORDS), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda missing: (learnt.extend(missing), learn(missing)))
    common = [f"common{chr(97 + i)}" for i in range(20)]
    for i in range(12):
        texts = [" ".join([*common, *[f"rare{chr(97 + i)}{chr(97 + j)}" for j in range(15)]])]
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == words(texts)
        assert len(encoder.memo) <= 60
    assert all(learnt.count(w) == 1 for w in common)


def check_pieces(rows, expected, size):
    """Every id in one piece; sequences without gaps and no longer than ``size``."""
    by_sequence, found = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        found[r.doc_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for key, ids in expected.items():
        pieces = sorted(found[key], key=lambda r: r.start)
        assert b"".join(r.ids for r in pieces) == np.array(ids, "<u4").tobytes()
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces[:-1]]]).tolist()
        assert {r.doc_tokens for r in pieces} == {len(ids)}
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
        total += at
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding, total


@pytest.mark.parametrize("size", [1024, 4096])
def test_packing_keeps_every_id_with_little_padding(spark, sf_dir, documents, words, size):
    expected = {k: [*ids, 2] for k, ids in zip(documents, words(list(documents.values())), strict=True)}
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(2)
    padding, total = check_pieces(packing.pack(df, WORDS, 2, size).collect(), expected, size)
    assert padding < 0.06 * total


def test_cuts_are_the_cheapest():
    rnd = random.Random(8)
    for _ in range(150):
        places = [0, *sorted(rnd.sample(range(1, 60), rnd.randint(3, 12)))]
        size = 16
        if max(b - a for a, b in zip(places, places[1:], strict=False)) > size:
            continue
        weights = [0, *[rnd.choice([0, 3, 9]) for _ in places[1:]]]
        cuts = packing.best_cuts(places, weights, size, last=False)
        price = lambda chain: sum(weights[j] + size - places[j] + places[i] for i, j in zip(chain, chain[1:], strict=False))
        best = {0: 0}
        for j in range(1, len(places)):
            best[j] = min(best[i] + price([i, j]) for i in range(j) if places[j] - places[i] <= size)
        assert price([places.index(c) for c in cuts]) == best[len(places) - 1]


def test_packing_of_odd_rows(odd):
    rows = packing.pack(odd, WORDS, 2).collect()
    assert sum(r.length for r in rows if r.doc_id == 2) == 2
    assert sum(r.length for r in rows if r.doc_id is None) == 1
    assert packing.pack(odd.limit(0), WORDS, 2).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(odd, WORDS, 2, 1000)


def test_planes_give_the_ids_back():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 64, 1000):
        ids = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
        assert (token_store.unpack(token_store.pack(ids, block=64), n, block=64) == ids).all()


def test_files_give_every_document_back(spark, sf_dir, documents, words, tmp_path):
    expected = [(k, [*ids, 2]) for k, ids in sorted(zip(documents, words(list(documents.values())), strict=True))]
    token_store.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), str(tmp_path), WORDS, 2, rows_per_range=7)
    rows = {r.doc_id: r for r in token_store.read(spark, str(tmp_path)).collect()}
    start = 0
    for key, ids in expected:
        assert rows[key].start == start
        assert np.frombuffer(rows[key].ids, "<u4").tolist() == ids
        start += len(ids)
    chunks = token_store.index(spark, str(tmp_path)).orderBy("start").collect()
    assert sum(c.n_ids for c in chunks) == start
    assert all(a.last_doc < b.first_doc for a, b in zip(chunks, chunks[1:], strict=False))


def test_files_of_odd_rows(spark, odd, tmp_path):
    token_store.write(odd, str(tmp_path / "a"), WORDS, 2)
    rows = token_store.read(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, 1, 2, 2, 3, 4, 4]
    token_store.write(odd.limit(0), str(tmp_path / "b"), WORDS, 2)
    assert token_store.read(spark, str(tmp_path / "b")).count() == 0


def test_added_tokens_have_the_ids_of_the_unaltered_library(spark, tmp_path):
    """Packed and stored ids of texts that hold the file's added tokens, in any place and case."""
    texts = ["a <|endoftext|> b", "<|endoftext|>", "A<|startoftext|><|endoftext|>.B\n", "<|ENDOFTEXT|> x", "end|> <|endoftext", None, ""]
    texts += [t.replace("'LL", "<|startoftext|>") for t in odd_texts(2000)]
    unaltered = Tokenizer.from_file(WORDS)
    expected = {i: [*unaltered.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    assert sum(49407 in ids for ids in expected.values()) > 300 and sum(49406 in ids for ids in expected.values()) > 300
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_pieces(packing.pack(df, WORDS, 2).collect(), expected, 4096)
    token_store.write(df, str(tmp_path), WORDS, 2)
    rows = token_store.read(spark, str(tmp_path)).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == expected
