from __future__ import annotations

import pytest

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, row_key string, length int, digest string, hits string"

LOREM = " ".join(f"word{i}" for i in range(60))

#: Nulls in every column, empty and odd texts, equal rows, one id twice, and columns that operators use inside.
ODD = [
    (1, LOREM, "en", "a", "k", 1, "d", "h"),
    (1, LOREM, "en", "a", "k", 1, "d", "h"),
    (2, LOREM, None, None, None, None, None, None),
    (3, "", "en", "a", "k", 1, "d", "h"),
    (4, None, "en", "a", "k", 1, "d", "h"),
    (4, "short one", "en", "b", "k", 1, "d", "h"),
    (None, "no id here", "de", "b", "k", 1, "d", "h"),
    (None, None, None, None, None, None, None, None),
    (5, "x" * 5000, "en", "a", "k", 1, "d", "h"),
    (6, "a  b\n\n c \t<|endoftext|> é中😀 \x1c\x85 it's " * 40, "fr", "b", "k", 1, "d", "h"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ODD, COLUMNS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")
