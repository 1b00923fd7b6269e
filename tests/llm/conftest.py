import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, one hot source."""
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "délta", "x", "mit", "license", "token", "the", "of"]
    long_one = " ".join(rng.choice(words) for _ in range(6000))
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))), "en", "hot" if i % 3 else f"s{i % 5}", 1) for i in range(200)]
    rows += [(300, None, None, None, None), (301, "", "en", "hot", 0), (302, " \t\n\x0b\x0c\r", "en", None, 5), (303, long_one, "en", "hot", 1), (304, long_one, "en", "s1", 1), (305, long_one + " end", "de", "s1", 1)]
    rows += [(None, "no id here", "en", "hot", 3), (306, "same row twice", "en", "s2", 3), (306, "same row twice", "en", "s2", 3), (307, "same row  twice", "en", "s2", 3)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
