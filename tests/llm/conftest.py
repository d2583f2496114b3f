import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and a column whose name clashes with the operators' own."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    long = " ".join(word() for _ in range(30_000))
    rows = [
        (1, None, "en", None, None), (2, "", None, "s", 0), (3, "   \n\t ", "en", "s", 6), (4, "one two", "en", "s", 7), (5, long, "en", "s", len(long)),
        (5, long, "en", "s", len(long)), (6, long + " tail", "en", "t", len(long) + 5), (None, "no id here at all", "en", "s", 17), (7, "12345 !!!", None, "s", 9),
        (8, "One  TWO", "de", "s", 8), (9, "one two", "en", "s", 7),
    ]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], f"{DOCS}, score string, n long")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.01"
