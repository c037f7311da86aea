import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def corpus(spark):
    """Builds documents with the columns of the table from (doc_id, text[, source]) tuples."""

    def build(rows, schema=SCHEMA):
        full = [(i, t, "en", (r[0] if r else "s"), len(t) if t is not None else None) for i, t, *r in rows]
        return spark.createDataFrame(full, schema).repartition(3)

    return build


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(400)]

    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(vocab) for _ in range(n))

    return make
