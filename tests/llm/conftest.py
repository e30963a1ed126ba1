import random

import pytest

#: Columns of documents, then names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, slot long, score double, id long, part long"


def document(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", len(text or ""), 7, 8, 0.5, 9, 10)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, blanks, a long text, ties, repeated rows and near copies."""
    rng = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "über", "niño", "thé", "one", "two", "three"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(n)) + "."
    rows = [document(i, prose(rng.randint(5, 60)), rng.choice(["en", "de"])) for i in range(40)]
    rows += [document(100 + i, rows[i][1]) for i in range(8)]
    rows += [document(120 + i, rows[i][1] + " tail words of its own " + prose(5)) for i in range(8)]
    rows += [document(200, None, None), document(None, "a text without an id " * 5), document(201, ""), document(202, " \n\t "), document(203, prose(4000)), document(204, "x"), document(205, "日本語 🙂 ▁ ok"), document(206, "spam spam " * 200)]
    return rows + rows[:3]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, edge_rows):
    rows = [(r[0], r[0] % 2, (r[0] // 2) % 2) for r in edge_rows if r[0] is not None and r[0] < 200]
    return spark.createDataFrame([*rows, (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int")
