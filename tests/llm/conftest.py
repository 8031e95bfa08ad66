import pytest

TEXTS = [
    "One two three four five six seven eight nine ten eleven twelve.",
    "One two three four five six seven eight nine ten eleven twelve.",
    "one two three four five six seven eight nine ten eleven twelve. thirteen",
    "",
    None,
    "   \n\t ",
    "é😀 write to x@y.example or +1 (499) 555-6503, 10.0.0.1",
    "word " * 30_000,
    "x" * 60_000,
    "Released under the MIT Licence.\nCopyright 2020 nobody",
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [(i, t, "en" if i % 3 else None, "s0" if i % 2 else None, None, 1.0, "k", True) for i, t in enumerate(TEXTS)]
    rows += [rows[0], rows[0], (None, "no id", "de", "s1", 3, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, id boolean")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.filter("doc_id = -1")


@pytest.fixture(scope="session")
def odd_labels(spark):
    return spark.createDataFrame([(0, 1, 0), (2, 0, 1), (6, None, None), (None, 1, 1), (9, 1, 0), (9, 0, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
