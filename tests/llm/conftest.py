import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, key string, size string, rank string"


def make_rows(seed=3, n=60):
    """Documents with nulls in any column, empty and long texts, ties, copies, near copies and repeated rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäñé") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(k))
    rows = []
    for i in range(n):
        rows.append((i, text(rng.randint(1, 120)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None]), None, "x", "k", "s", "r"))
    base = text(150)
    for i in range(n, n + 12):
        words = base.split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words) if i % 2 else base, "en", "a", 5, None, None, None, None))
    rows += [(n + 20 + i, t, "fr", "b", 0, "", "", "", "") for i, t in enumerate([None, "", "   \n\t ", "x", "x", "one two", "One TWO", text(6000), " ", "a\x0bb\x0cc"])]
    rows += [(None, "no id here", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    rows += [rows[0], rows[0], rows[n + 1]]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
