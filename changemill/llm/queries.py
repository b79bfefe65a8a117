"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changemill.llm import bpe, fingerprint, hard_negatives, html_extract, line_dedup, ngram_join, packing, periodic_runs, quality, secret_scan, token_counts, token_store, url_filter
from changemill.llm.common import let, whole, words
from changemill.llm.sql import UNWANTED_LABELS
from changemill.session import run_dir

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sha(text: str | Column) -> Column:
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


@query
def op1_byte_bpe(spark, sf_dir):
    """Encodes every text by the byte-level vocabulary and decodes its ids again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, path, public_tokenizers.PATTERN).drop("text")
    both = bpe.decode(ids, path, public_tokenizers.PATTERN)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        _sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        _sha("decoded").alias("decoded_sha256"),
    )


WORDS, END_ID = "word_bpe_49k.json", 2


@query
def op4_pack(spark, sf_dir):
    """Packs the ids of every document into sequences of at most 4096."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path(WORDS), END_ID).drop("ids")


@query
def op10_bit_planes(spark, sf_dir):
    """Writes every document's ids in byte planes and reads the files back."""
    folder = run_dir(spark, "token-store")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    token_store.write(docs, folder, public_tokenizers.path(WORDS), END_ID)
    return token_store.read(spark, folder).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@query
def op8_url_filter(spark, sf_dir):
    """Judges every page's URL by the rules, else by the list of pages of unwanted hosts."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    unwanted = F.arrays_overlap(F.split(host, r"\."), F.array(*map(F.lit, UNWANTED_LABELS)))
    blocklist = pages.where(unwanted).select(url_filter.canonical(host, path).alias("canonical"))
    return url_filter.judge(pages, URL_RULES, blocklist).select("page_id", "host", "path", "rule", "verdict")


@query
def op9_quality(spark, sf_dir):
    """Judges every text against multinomials of the corpus and of its trusted part."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.fit(docs, quality.trusted_ids(_table(spark, sf_dir, "labels")))
    return quality.judge(docs, weights).drop("text", "score")


@query
def op5_line_dedup(spark, sf_dir):
    """Drops the lines that five documents or more share from all but the last of them."""
    docs = line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", _sha(whole("text")).alias("kept_sha256"))


@query
def op3_secrets(spark, sf_dir):
    """Finds the secrets in every text."""
    docs = secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind_no"] < 3)
    count = lambda no: F.size(F.filter("secrets", lambda s: s["kind_no"] == no)).cast("long")
    return docs.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        _sha(secret_scan.as_text(base)).alias("base_sha256"), secret_scan.as_text(F.col("secrets")).alias("spans"),
    )


@query
def op6_ngram_join(spark, sf_dir):
    """Links documents whose sets of 4-word shingles agree in 85 of 100 and names their components."""
    return ngram_join.classify(_table(spark, sf_dir, "documents").select("doc_id", "text"), n=4, percent=85)


@query
def op2_lz_fingerprint(spark, sf_dir):
    """Fingerprints every text and its edited text, whose second half the next document gives."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", whole("text").alias("text"))
    docs = docs.withColumn("fp", fingerprint.fingerprint("text"))
    docs = fingerprint.with_next(docs, ["text", "fp"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half))
    docs = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "fp", "next_fp")
    docs = docs.withColumn("edited_fp", fingerprint.fingerprint("edited"))
    return docs.select(
        "doc_id", "n_chars", _sha("edited").alias("edited_sha256"),
        F.lower(F.hex("fp")).alias("fingerprint"), F.lower(F.hex("edited_fp")).alias("edited_fingerprint"),
        fingerprint.likeness("fp", "edited_fp").alias("near_edited"), fingerprint.likeness("fp", "next_fp").alias("near_next"),
    )


@query
def op7_html_text(spark, sf_dir):
    """Main text of every page by its host's wrapper."""
    pages = html_extract.extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


#: Tokens of a document that are too many.
LIMIT = 2048


@query
def op12_token_counts(spark, sf_dir):
    """Counts every text's tokens by the store of its prefixes' counts."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = token_counts.prefix_counts(docs, public_tokenizers.path(WORDS))
    n_tokens = token_counts.total()
    return docs.select(
        "doc_id", F.octet_length(whole("text")).cast("long").alias("n_bytes"), n_tokens.alias("n_tokens"), (n_tokens > LIMIT).alias("over_limit")
    )


def _planted(key: str, text: str) -> Column:
    """Words of a text; in one document of ten a block of them, chosen by its id, repeats to the end."""
    h = F.crc32(F.col(key).cast("string"))
    g = F.floor(h / 10)

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)) + 1).cast("int")
        block = F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int"))
        made = F.concat(F.slice(w, F.lit(1), a), F.slice(F.flatten(block), F.lit(1), n - a))
        return F.when((h % 10 == 0) & (n > 0), made).otherwise(w)

    return let(words(whole(text)), repeat)


@query
def op11_periodic_runs(spark, sf_dir):
    """Finds every text's periodic runs of words and collapses them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = periodic_runs.find_runs(docs, of_words=_planted("doc_id", "text")).drop("text")
    runs = F.col("periodic")["runs"]
    docs = docs.withColumn("best", periodic_runs.longest_repeat(runs))
    best = {c: F.col("best")[c] for c in ("start", "length", "period")}
    return docs.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), *[c.alias(name) for name, c in best.items()],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        _sha(periodic_runs.as_text(runs)).alias("runs_sha256"), _sha(F.array_join(F.col("periodic")["kept"], " ")).alias("collapsed_sha256"),
    )


@query
def op13_hard_negatives(spark, sf_dir):
    """Mines negatives for every anchor's positives from integer vectors; every seventh id's label is off by one."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    rows = hard_negatives.usable(rows, "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    return hard_negatives.mine(rows.select("vec_id", vector.alias("vector"), label.alias("label")), F.col("vec_id") % 50 == 0)
