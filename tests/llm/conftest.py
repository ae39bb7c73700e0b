import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra") for b in ("n", "st", "rel", "do", "vi")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture
def edge_docs(spark):
    """Nulls in every column, empty, blank, tiny and very long texts, repeated rows, an extra column."""
    rows = [
        (1, prose(1, 60), "s1", "x"), (1, prose(1, 60), "s1", "x"), (2, None, "s1", None), (3, "", None, "x"), (4, " \n\t ", "s2", "x"),
        (None, prose(2, 40), "s2", "x"), (5, "One", "s2", "x"), (6, "é 日本 ü " + prose(3, 20000), "s3", "x"), (7, prose(1, 60), "s3", "x"), (8, "a" * 70_000, "", "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string")


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, score string")
