"""The session and helpers are those of the tests above this folder."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, size string, row string, n string"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    """The test documents as Python rows."""
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


@pytest.fixture
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns with names used inside."""
    long = "Lorem ipsum dolor sit amet, consectetur. " * 3000 + "x" * 50_000
    rows = [
        (None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, long, "en", "a", 1), (3, long, None, None, 2),
        (4, " \t\n ", "fr", "b", 3), (5, "eins zwei drei vier fünf sechs sieben acht neun zehn elf", "de", "b", 4),
        (5, "one two three four five six seven eight nine ten eleven", "en", None, 5), (None, "öäü", "de", "b", 6), (6, "12 34", None, "c", 7),
    ]
    return spark.createDataFrame([(*r, "f", "s", "r", "n") for r in rows], COLUMNS)


@pytest.fixture
def none(odd):
    return odd.where("false")
