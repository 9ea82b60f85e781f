import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size string, dropped int, length int, h string, kept string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and blank texts, a long one, rows that repeat, clashing names."""
    long_ = "the of and word " * 20_000
    rows = [(1, "Hello the world", "en"), (2, None, "en"), (3, "", None), (4, " \n\t ", "de"), (5, long_, "en"), (6, "Hello the world", "en"), (6, "Hello the world", "en"), (None, "no id here", "en"), (7, "123 456", None), (8, "é", "fr"), (9, "12\n\n\n34", "es")]
    return spark.createDataFrame([(*r, "s", None if i % 2 else 1, "x", i, i, "y", "z") for i, r in enumerate(rows)], COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def frame(spark):
    """Documents from texts, ids from 0."""
    return lambda texts, lang="en": spark.createDataFrame([(i, t, lang) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
