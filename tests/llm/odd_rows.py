import os

import pytest

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and wordless texts, repeats, a long word, extra columns with clashing names."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a"),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a"),
        (2, None, "en", "b"), (3, "", None, None), (4, " \n\t ", "de", "b"), (None, "null id text", None, "a"),
        (None, None, None, None), (5, "été à la plage 😀 日本語", "fr", None), (6, "x" * 3000, "en", "c"),
        (7, "12 34 !!", "en", "c"), (8, "Tie tie TIE", "en", "c"), (9, "Tie tie TIE", "en", "d"),
    ]
    extra = [r + (0.5, "k", 1, "z", 3, True) for r in rows]
    return spark.createDataFrame(
        extra, "doc_id long, text string, lang string, source string, score double, key string, th long, "
               "_row string, n long, fp boolean")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("1 = 0")
