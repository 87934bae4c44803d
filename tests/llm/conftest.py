import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, one id with two texts, and
    columns whose names operators use inside."""
    long = " ".join(random.Random(1).choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(i % 977) for i in range(60_000))
    rows = [(1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27), (1, "another text of the same id", "en", "b", 27),
            (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n", "en", None, 3), (None, "one two three four five six", None, "c", None),
            (5, long, "de", "a", len(long)), (6, "short words", "fr", "b", 11), (7, "short words", "fr", "b", 11), (8, "mail a.b@example.com or +1 (462) 555-7216", "en", "b", 40)]
    extra = "words long, position long, content long, score double, _content string, _row int, finish double, size long, region long, kept boolean, row long"
    values = (5, 6, 7, 0.5, "x", 1, 0.25, 9, 3, False, 11)
    return spark.createDataFrame([(*r, *values) for r in rows], f"{SCHEMA}, {extra}")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
