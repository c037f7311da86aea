import random

import pytest

from polyrun.llm.toxicity import toxicity

LANGS = ["en", "de", "fr", "es"]


@pytest.mark.parametrize("lang", LANGS)
def test_held_out_accuracy_of_every_language(scored, lang):
    """On a table with enough labelled rows of each language, of which toxic ones hold two to five of ten words of it."""
    got = scored[scored.lang == lang]
    true = got.toxic == 1
    assert true.sum() >= 50
    assert (got.predicted[true] == 1).mean() >= 0.97 and (got.predicted[~true] == 0).mean() >= 0.995


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäéñ") for _ in range(rng.randint(2, 9)))
    plain, marks = {k: [word() for _ in range(1500)] for k in LANGS}, {k: [word() + k for _ in range(10)] for k in LANGS}
    rows = []
    for i in range(9000):
        lang, toxic = LANGS[i % 4], int(rng.random() < 0.15)
        words = rng.choices(plain[lang], k=rng.choice([20, 60, 200]))
        for _ in range(rng.randint(2, 5) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(marks[lang]).title())
        rows.append((i, " ".join(words), lang, toxic))
    t = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(4).cache()
    return toxicity(t.select("doc_id", "text"), t.select("doc_id", "toxic")).where("held_out").join(t.drop("text"), "doc_id").toPandas()
