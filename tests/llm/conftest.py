import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, range string, h string, queue int, w string, stratum int, kept_id bigint, label_id string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names operators use inside."""
    long = "the quick brown fox jumps over the lazy dog and the small cat. " * 3000
    rows = [
        (1, "Hello there, the password: hunter2x!", "en", "a", 5),
        (1, "Hello there, the password: hunter2x!", "en", "a", 5),
        (2, "", "en", "b", 0),
        (3, None, None, None, None),
        (None, "der die das und ein Haus mit Garten", "de", "a", None),
        (4, long, "en", None, len(long)),
        (5, " \t\n\r ", "fr", "c", 5),
        (6, "\U0001f600 ÄÖÜ ß\x00\x1f  x", "de", "c", 1),
        (-7, "the quick brown fox jumps over the lazy dog", "en", "b", 43),
        (7, "the quick brown fox jumps over the lazy dog", "en", "b", 43),
    ]
    return spark.createDataFrame([(*r, 1, "r", "h", 2, "w", 3, 9, "l") for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 1), (7, 0, 0), (None, 1, 1), (99, None, None)], "doc_id bigint, quality int, toxic int")
