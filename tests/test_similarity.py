import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyrun.functions import dna
from polyrun.functions import similarity as sim
from polyrun.operators import cluster
from polyrun.plans import queries


def edits(pattern, text):
    """Fewest edits of pattern against any stretch of text, a cell at a time."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        last, row[0] = 0, 0
        for i, x in enumerate(pattern, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (x != c))
        best = min(best, row[-1])
    return best


def test_edit_distances_equal_dynamic_programming(monkeypatch):
    rng = random.Random(4)
    dna = lambda n, letters="ACGT": "".join(rng.choice(letters) for _ in range(n))
    pairs = [("kitten", "xxsittenxx"), ("abc", ""), ("", "abc"), ("", ""), ("é🙂", "a🙂b"), ("A" * 64, "A" * 63), ("A" * 65, "T" + "A" * 64 + "T"), ("A" * 130, "A" * 200)]
    for n in (1, 5, 63, 64, 65, 127, 128, 129, 200):
        for _ in range(4):
            t = dna(rng.randrange(1, 260))
            p = list(t[rng.randrange(len(t)) :][:n].ljust(n, "A"))
            for _ in range(rng.randrange(6)):
                p[rng.randrange(n)] = rng.choice(["", "A", "CC", "N"])
            pairs.append(("".join(p), t))
    want = [edits(p, t) for p, t in pairs]
    assert sim.best_edit_distances(*map(list, zip(*pairs, strict=True))).tolist() == want
    monkeypatch.setattr(sim, "CELLS", 100)
    assert sim.best_edit_distances(*map(list, zip(*pairs, strict=True))).tolist() == want
    assert sim.best_edit_distances([], []).tolist() == []


def test_pattern_distance_of_columns(spark):
    df = spark.createDataFrame([("ACGA", "TTACGTT"), (None, "A"), ("A", None)], "p string, t string")
    assert [r.d for r in df.select(sim.pattern_distance("p", "t").alias("d")).collect()] == [1, None, None]


def scores(a, b, least):
    """Words of a and b on each diagonal, a pair of words at a time."""
    word = lambda s, i: ["".join(s[i + o] for o in mask) for mask in ((0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 1, 2, 4, 5), (0, 1, 3, 4, 5), (0, 2, 3, 4, 5))]
    d = {}
    for i in range(len(a) - 5):
        for j in range(len(b) - 5):
            d[i - j] = d.get(i - j, 0) + sum(x == y for x in word(a, i) for y in word(b, j))
    return sum(n for n in d.values() if n > least)


@pytest.mark.parametrize("cells", [1 << 22, 500])
def test_diagonals(monkeypatch, cells):
    monkeypatch.setattr(sim, "CELLS", cells)
    monkeypatch.setattr(sim, "MATCHES", cells)
    rng = random.Random(2)
    seqs = ["".join(rng.choice("AACGT") for _ in range(rng.choice([0, 3, 6, 20, 60]))) for _ in range(14)]
    seqs += [seqs[-1][5:] + "ACG", "A" * 30, seqs[3]]
    got = sim.diagonals(seqs[:9], seqs, 12)
    assert np.array_equal(got, [[scores(a, b, 12) for a in seqs[:9]] for b in seqs])


def test_diagonal_scores_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(sim, "ASKED", 3)
    rng = random.Random(9)
    seqs = ["".join(rng.choice("ACGT") for _ in range(40)) for _ in range(30)]
    seqs += [s[4:] + "AC" for s in seqs[:10]] + ["A" * 40]
    df = spark.createDataFrame([*enumerate(seqs), (99, None)], "id long, seq string").repartition(3)
    got = {(r.asked_id, r.id): r.score for r in sim.diagonal_scores(df, df.where(F.col("id") % 4 == 0), 40).collect()}
    want = {(i, j): scores(a, b, 40) for i, a in enumerate(seqs) if i % 4 == 0 for j, b in enumerate(seqs)}
    assert got == {k: v for k, v in want.items() if v}


def test_edits_of_a_query_set(spark):
    """Of all pairs with one key and different ids, against one string at a time."""
    rng = random.Random(31)
    word = lambda n: "".join(rng.choice("ACGT.é") for _ in range(n))
    rows = [(i % 2, i, word(rng.choice([0, 1, 9, 32, 33, 64]))) for i in range(40)] + [(0, 99, None)]
    d = spark.createDataFrame(rows, "k int, id long, value string")
    known = [r for r in rows if r[2] is not None]
    pairs = [(a[2], b[2]) for a in known for b in known if a[0] == b[0] and a[1] != b[1] and a[1] % 4 == 0]
    best = sim.best_edit_distances(*map(list, zip(*pairs, strict=True))).tolist()
    for whole, want in ((True, [cluster.levenshtein(a, b) for a, b in pairs]), (False, best)):
        got = sim.edit_distances(d.where("id % 4 = 0"), d, ["k"], whole)
        assert sorted(map(tuple, got.collect())) == sorted((a, b, n) for (a, b), n in zip(pairs, want, strict=True))
    with pytest.raises(ValueError, match="64"):
        sim.edit_matrix(["A" * 65], ["A"], True)


def test_distances_of_vectors(spark):
    """The same sums, in the same order, as of one pair at a time; null where that is null."""
    rng = random.Random(32)
    rows = [(i, [rng.gauss(0, 1) for _ in range(24)]) for i in range(60)] + [(60, None), (61, [1.0, None]), (62, [1.0, 2.0]), (63, []), (64, [0.5, float("nan")])]
    e = spark.createDataFrame(rows, "id long, value array<float>")
    want = e.alias("a").crossJoin(e.alias("b")).where("a.id % 5 = 0 or a.id > 59").select("a.id", "b.id", dna.euclidean("a.value", "b.value"))
    got = sim.vector_distances(e.where("id % 5 = 0 or id > 59"), e)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


def test_codes_tell_distances(spark):
    rng = random.Random(33)
    word = lambda: "".join(rng.choice("ACGT") for _ in range(8))
    d = spark.createDataFrame([(word(), word(), word(), word()) for _ in range(300)] + [("ACGTACGT", "A" * 8, "CGTACGTA", "T" * 8)], "l1 string, r1 string, l2 string, r2 string")
    a, b, x, y = (dna.kmer_code(c) for c in ("l1", "r1", "l2", "r2"))
    plain = dna.code_distance(a, x) + dna.code_distance(b, y)
    moved = dna.code_shift_distance(a, x, 8) + dna.code_shift_distance(b, y, 8)
    assert d.where((plain != dna.pair_distance("l1", "r1", "l2", "r2")) | (moved != dna.shift_distance("l1", "r1", "l2", "r2", 8))).count() == 0


def test_codes_tell_common_ends(spark):
    """Also of strings of several lengths, of which one may begin or end with the other; and pairs get the codes made once per string."""
    rng = random.Random(34)
    word = lambda n: "".join(rng.choice("ACA") for _ in range(n))
    rows = [(word(rng.choice([1, 4, 30, 31])), word(rng.choice([1, 5, 31]))) for _ in range(300)]
    rows += [(x, x) for x, _ in rows[:20]] + [(x, (x + "AAT")[:31]) for x, _ in rows[:20]] + [("A" * 20, "A" * 21), ("T" * 31, "T" * 31), ("T" * 30 + "G", "T" * 31), ("", "A"), ("", "")]
    d = spark.createDataFrame(rows, "a string, b string")
    codes, reverse_codes = [tuple(dna.kmer_code(f(F.col(c))) for c in ("a", "b")) for f in (lambda x: x, F.reverse)]
    got = d.select("a", "b", dna.common_prefix("a", "b", codes), dna.common_suffix("a", "b", codes, reverse_codes), dna.common_prefix("a", "b"), dna.common_suffix("a", "b")).collect()
    assert all(tuple(r[2:4]) == tuple(r[4:6]) for r in got) and len({tuple(r[2:4]) for r in got}) > 20
    plan = queries.common_prefix_suffix(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan[: plan.index("Join")]
