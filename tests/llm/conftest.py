import random

import pytest

WORDS = [a + b + c for a in ("the", "ban", "or", "mi", "ta", "re") for b in ("lo", "ne", "sti", "qua", "ru") for c in ("n", "s", "del", "ing", "")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, anchor int, key string"


def prose(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def odd_rows():
    """Nulls, empties, a long text, ties, repeated rows."""
    return [
        (None, "a row without an id but with quite a few words in it", "en", "s", 1, 1, "k"),
        (900, None, None, None, None, None, None),
        (901, "", "en", "s", 0, 1, "k"),
        (902, " \n\t ", "en", "s", 4, 1, "k"),
        (903, "word " * 30_000, "en", "s", 150_000, 1, "k"),
        (904, "same text here for two rows of it all", "en", "s", 1, 1, "k"),
        (904, "same text here for two rows of it all", "en", "s", 1, 1, "k"),
        (905, "same text here for two rows of it all", "de", "t", 1, 2, "l"),
        (906, "Ünïcödé АВ x\u0000y \U0001f389 naïve", "fr", "s", 1, 1, "k"),
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """documents with odd rows and extra columns whose names operators use inside."""
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def rng():
    return random.Random(5)


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
