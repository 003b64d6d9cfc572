import datetime as dt
import random

import pytest

#: Texts of the edge cases: null, empty, blank, one word, ties, very long.
EDGES = [None, "", " \n\t ", "word", "same same same", "x" * 50_000, "long text " * 5_000, "Straße naïve 数据 🙂 " * 10]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, score double, key string, n long, label string, spans string, row string, bucket string, component_id string, tile string, held_out string, c date"


@pytest.fixture(scope="session")
def documents(spark):
    """Rows (doc_id, text) as a table with the columns of documents and others whose names the operators use themselves."""

    def make(rows, sources=("a", "b", "c", "d", "e", "f")):
        full = [(i, t, "en", sources[k % len(sources)], len(t or ""), 0.5, "k", 7, "l", "s", "r", "b", "c", "t", "h", dt.date(2024, 1, 1)) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def edges(documents):
    """Edge texts, a null doc_id, a repeated row and a doc_id with two texts."""
    rows = list(enumerate(EDGES)) + [(None, "no id here at all"), (None, None), (3, "word"), (4, "another text of the same id")]
    return documents(rows), rows


@pytest.fixture(scope="session")
def prose():
    """Texts of random words from a small vocabulary, so that runs of words repeat now and then."""
    chance = random.Random(7)
    return lambda n, words=60: " ".join(f"w{chance.randrange(words)}" for _ in range(n))
