"""A training corpus from raw documents: five stages, each a Spark job over all rows of the last.

Quality rules drop documents, shared lines are removed, near duplicates go, secrets are masked, and
what is left is packed into windows of token ids. All stages but the last keep the columns of
``documents``; the count of characters follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changemill.llm import line_dedup, ngram_join, packing, quality, secret_scan
from changemill.session import run_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates: five words, eight shingles of ten.
WORDS, PERCENT = 5, 80
END_ID = 2


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents, with the character count of the text as it is now."""
    chars = F.length("text").cast(df.schema["n_chars"].dataType)
    return df.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(chars)).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    trusted = quality.trusted_ids(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    weights = quality.fit(docs, trusted)
    return quality.judge(docs, weights).where("kept").select(*COLUMNS)


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them."""
    return _documents(line_dedup.dedup(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one of the least id."""
    return ngram_join.first_of_each(docs, WORDS, PERCENT).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return _documents(secret_scan.redact(docs))


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of token ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("shared_lines", shared_lines),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("windows", windows),
]

#: Hashed features, set joins and a tokenizer are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written and read again by the next."""
    folder = run_dir(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
