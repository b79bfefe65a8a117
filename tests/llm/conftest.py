import pytest

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def documents(spark):
    """doc_id and text of the smallest table, as Python values."""
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty, repeated and very long texts, and columns with names that
    operators use for their own."""
    long = "word " * 20_000 + "😀 end.\n" * 500
    rows = [
        (1, None, "x", 1, None), (2, "", "y", 2, "a"), (2, "", "y", 2, "a"), (None, None, None, None, None),
        (3, long, "z", 3, "b"), (4, "One  line.\nTwo é 😀\n\n", "z", 3, "b"), (4, "Other text of the same id", "z", 3, "b"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_lines int, found string")
