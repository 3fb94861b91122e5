import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, gneiss string, key long, r1 long, r2 long, parts string, spans string, text_ string, n long, count long, label int, gneiss_r1 string, gneiss_spans long, home long, id string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names the operators use themselves."""

    def docs(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, "x", 7, 1, 2, "p", "s", "t", 3, 4, 5, "g", 6, 7, "i") for i, t in rows], SCHEMA)

    return docs


@pytest.fixture(scope="session")
def prose():
    """n words of a small vocabulary, the same for one seed."""

    def words(n, seed, vocabulary=400):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))

    return words
