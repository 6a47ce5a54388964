import random

import pytest

WORDS = "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were".split()


@pytest.fixture(scope="session")
def rng():
    return random.Random(5)


@pytest.fixture(scope="session")
def make_text():
    def make(rng, n):
        return " ".join(rng.choice(WORDS) + rng.choice(("", "", "a", "er", "ing", "ly")) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def docs_of(spark):
    """Rows (doc_id, text[, source]) as documents, with columns whose names clash with the operators' own."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7, 0.5, "x") for r in rows]
        kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, score double, labels string"
        return spark.createDataFrame(full, kind)

    return build
