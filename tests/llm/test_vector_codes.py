import hashlib
import math
import random

import numpy as np
import pytest

from polyrun.llm import common
from polyrun.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """Rows of vector_codes(), one part and one entry at a time."""
    kept = [(i, [math.floor(256 * x) for x in v], l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    d = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][d * p : d * p + d] for r in first] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            got = [[] for _ in books[p]]
            for _, v, _ in kept:
                x = v[d * p : d * p + d]
                got[near(p, x)[1]].append(x)
            books[p] = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else b for g, b in zip(got, books[p], strict=True)]
    out, by_label = [], {}
    for i, v, l in kept:
        each = [near(p, v[d * p : d * p + d]) for p in range(parts)]
        error = sum(x for x, _ in each)
        by_label[l] = by_label.get(l, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in each), error, l))
    sha = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    return sorted(((i, c, e, by_label[l], sha) for i, c, e, l in out), key=str)


def made(n, seed=3, dim=64, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(8)]
    f = lambda x: float(np.float32(x))
    return [(i, [f(c + spread * rng.gauss(0, 0.4)) for c in centres[rng.randrange(8)]], rng.choice([0, 0, 0, 1, 2, None])) for i in rng.sample(range(10 * n), n)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    data = made(700)
    assert rows(vc.vector_codes(spark.createDataFrame(data, SCHEMA).repartition(3))) == brute(data)


def test_drops_ties_copies_and_extremes(spark):
    data = made(150, seed=5)
    data += [(7_000, None, 1), (7_001, [None] * 64, 1), (7_002, [float("nan")] * 64, 1), (7_003, [float("-inf")] + [0.0] * 63, 1)]
    data += [(1, [0.0] * 64, 3)] * 40 + [(1, [0.5] * 64, 3)] * 40 + [(None, [0.25] * 64, None), (5, [-900_000.0] * 64, 4), (6, [900_000.0] * 64, 4), (7, [-0.001] * 64, 5)]
    assert rows(vc.vector_codes(spark.createDataFrame(data, SCHEMA).repartition(3))) == brute(data)


def test_labels_that_are_rare_and_small_parts(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 3)
    data = [(i, v, i % 50 if i % 3 else None) for i, v, _ in made(120, seed=7, dim=8)]
    assert rows(vc.vector_codes(spark.createDataFrame(data, SCHEMA), parts=4, entries=5, rounds=3)) == brute(data, 4, 5, 3)


def test_few_or_no_vectors_and_clashing_columns(spark):
    assert vc.vector_codes(spark.createDataFrame([], SCHEMA)).collect() == []
    got = vc.vector_codes(spark.createDataFrame([(1, None, 2)], SCHEMA))
    assert got.collect() == [] and got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    data = made(3)
    odd = spark.createDataFrame([(*r, "x", 1) for r in data], SCHEMA + ", code string, of int")
    assert rows(vc.vector_codes(odd)) == brute(data)


def test_vectors_of_two_lengths_are_refused(spark):
    with pytest.raises(Exception, match="one length"):
        vc.vector_codes(spark.createDataFrame([(1, [0.0] * 64, 1), (2, [0.0] * 32, 1)], SCHEMA).coalesce(1)).collect()


def test_filtering_looks_at_few_distances_and_assigns_whole_subtrees():
    rng = np.random.default_rng(1)
    points = rng.integers(-400, 400, (2, 50, 4))[:, rng.integers(0, 50, 5_000)] + rng.integers(-9, 9, (2, 5_000, 4))
    books = np.stack([p[:64] for p in points])
    trees = vc.Trees(points[np.arange(2)[:, None], vc.build(points)])
    code, error = trees.codes(books)
    want = ((trees.points[:, :, None] - books[:, None]) ** 2).sum(axis=3)
    assert (code == want.argmin(axis=2)).all() and (error == want.min(axis=2)).all()
    whole = []
    looked = trees.assign(books, lambda p, level, k, e: whole.append(len(p)), lambda *_: None)
    assert looked < want.size / 3 and sum(whole) > 100
    total, count = trees.sums(books)
    assert count.sum() == 10_000 and (total.sum(axis=1) == points.sum(axis=1)).all()
