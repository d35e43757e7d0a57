"""Small document tables with every awkward case, shared by the tests of all operators."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, `key` string, `hash` string"


def rows_of(texts, start=0, lang="en"):
    return [(start + i, t, lang, f"s{i % 3}", len(t or ""), i, "k", "h") for i, t in enumerate(texts)]


@pytest.fixture
def table(spark):
    """A documents table (extra columns with names that operators use inside) from rows or texts."""

    def build(rows):
        if rows and not isinstance(rows[0], tuple):
            rows = rows_of(rows)
        return spark.createDataFrame(rows, SCHEMA)

    return build


@pytest.fixture(scope="session")
def awkward():
    """Null, empty, blank, very long and repeated texts, ties, and a row without id."""
    long = " ".join(random.Random(4).choice(["alpha", "beta", "gamma", "delta"]) + str(i % 977) for i in range(60_000))
    rows = rows_of([None, "", "   \t\n ", "one", "One two", "one  two", "one two", long, long + " end", "one", "Äpfel ÄPFEL\näpfel"])
    return [*rows, (None, "one two", None, None, None, None, None, None), rows[3]]


@pytest.fixture(scope="session")
def prose():
    """Seeded texts of three invented languages."""
    words = {
        "aa": ["the", "thing", "shore", "rather", "whole", "other", "those", "with"],
        "bb": ["und", "schon", "zwischen", "fahrt", "nicht", "straße", "über", "sich"],
        "cc": ["que", "jamás", "llano", "rojo", "cuyo", "niño", "allí", "ella"],
    }

    def build(lang, n, seed):
        pick = random.Random(f"{lang}{seed}")
        return " ".join(pick.choice(words[lang]) + pick.choice(["", "", "s", "."]) for _ in range(n))

    return build
