"""The session of tests/conftest.py, and small fixtures."""

import public_tokenizers
import pytest

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long, _size string, n string, label string"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns whose names clash."""
    long = "word " * 40_000 + "end"
    rows = [
        (1, None, None, None, None, "a", "b", "c"), (2, "", "en", "s1", 0, None, None, None), (3, " \n\t ", "en", None, 4, "", "", ""),
        (4, long, "en", "s1", len(long), "x", "y", "z"), (5, long, "en", "s2", len(long), "x", "y", "z"),
        (6, "One two three four five six seven", "de", "s2", 33, None, "n", None), (6, "One two three four five six seven", "de", "s2", 33, None, "n", None),
        (7, "one TWO three four five six seven", "de", "s3", 33, None, None, None), (None, "a text without an id", "fr", "s3", 20, None, None, None),
        (8, "mail a.b@c.example.org or call +1 (212) 555-0100 now", "en", "s3", 50, None, None, None),
        (9, "x" * 30_000, "en", "s1", 30_000, None, None, None), (10, "é日本 😀 <|endoftext|> Σ", None, "s1", 10, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCUMENT).repartition(3)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")


@pytest.fixture(scope="session")
def byte_bpe():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def word_bpe():
    return public_tokenizers.path("word_bpe_49k.json")
