import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


ODD = [(1, None), (2, ""), (3, "one"), (4, "  a  b\n\n\tc "), (5, "\n"), (6, "x" * 5000), (7, "word " * 3000), (8, "ünï çødé 日本 😀 a b"), (8, "ünï çødé 日本 😀 a b"), (None, "no id"), (9, "The Cat sat on the mat"), (10, "The Cat sat on the mat")]


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and very long texts, repeated rows and ids."""
    return make(ODD)
