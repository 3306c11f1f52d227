import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept_text string"


def edge_rows():
    """Nulls, empty and long texts, ties, repeated rows and clashing extra columns."""
    r = random.Random(4)
    words = ["alpha", "beta", "Gamma", "delta", "é", "中文", "x", "don't", "#1", "a|b"]
    text = lambda n: " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(n))
    base, shared = text(120), text(45)
    rows = [(i, text(r.randrange(1, 150)).replace(" ", "\n", 3), "en", "s", 1, "a", "b") for i in range(1, 30)]
    rows += [(30 + i, base if i % 2 else base.replace("alpha", "Alpha", 1), "de", None, None, None, None) for i in range(6)]
    rows += [(40 + i, f"{text(10)} {shared} {text(8)}", None, "s", 1, "a", "b") for i in range(4)]
    rows += [(50, None, None, None, None, None, None), (51, "", "en", "s", 0, "", ""), (52, " \t\n\x0b ", "en", "s", 5, "", "")]
    rows += [(None, text(30), "en", "s", 1, "a", "b"), (None, None, None, None, None, None, None)]
    rows += [(53, text(6000), "fr", "s", 1, "a", "b")]
    rows += [rows[3], rows[3], (60, "one two", "en", "s", 1, "a", "b"), (61, "One TWO", "en", "s", 1, "a", "b")]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(1, 45)] + [(None, 1, 0), (5, None, None)], "doc_id long, quality int, toxic int")
