import random
import resource

import numpy as np
import pytest

from polyrun.llm.decontaminate import Items, contamination, tiles, without_contaminated


def greedy(a, b, least):
    """The longest unmarked match each time, first in a then in b."""
    ma, mb, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        out.append((i, j, n))
        for k in range(n):
            ma[i + k] = mb[j + k] = True


def test_tiles_cover_as_greedily_found_ones():
    rng = random.Random(2)
    for _ in range(60):
        b = [rng.randrange(1, 40) for _ in range(rng.randrange(5, 40))]
        cuts = sorted(rng.sample(range(len(b)), 2))
        parts = [b[: cuts[0]], b[cuts[0] : cuts[1]], b[cuts[1] :]]
        rng.shuffle(parts)
        a = [x for p in parts for x in [*p, 1000 + rng.randrange(9)]]
        got = tiles(np.array(a, np.uint64), np.array(b, np.uint64), 3)
        want = greedy(a, b, 3)
        assert sum(x[2] for x in got) == sum(x[2] for x in want)
        for i, j, n in got:
            assert a[i : i + n] == b[j : j + n]


@pytest.fixture(scope="module")
def benchmark_table(spark, words):
    rows = [(i, words(40, 5000 + i)) for i in range(30)] + [(100, "too short"), (101, None), (None, words(40, 1)), (102, ""), (40, words(40, 5003))]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_leaks_in_any_order(corpus, benchmark_table, words):
    item = {i: words(40, 5000 + i).split() for i in range(30)}
    mid = lambda a, x, b: words(30, a) + " " + " ".join(x) + " " + words(300, b)
    rows = [(i, words(150, i)) for i in range(40)]
    rows += [(100, mid(1, item[1], 2)), (101, mid(1, item[2][20:] + item[2][:20], 3)), (102, mid(1, [w.upper() + "," for w in item[3]], 3)), (103, mid(4, item[4][:12], 5))]
    rows += [(104, mid(1, item[5][30:] + ["and"] + item[5][10:20] + ["or"] + item[5][:9], 2)), (105, None), (106, ""), (107, "too short"), (108, mid(1, item[6] + item[7], 8)), (109, words(100_000, 3) + " " + " ".join(item[8]))]
    docs = corpus(rows).withColumnRenamed("lang", "item_id").withColumnRenamed("source", "coverage")
    got = {r.doc_id: r for r in contamination(docs, benchmark_table).collect()}
    assert {i for i, r in got.items() if r.contaminated} == {100, 101, 102, 104, 108, 109}
    assert {i: got[i].item_id for i in (100, 101, 102, 104, 108, 109)} == {100: 1, 101: 2, 102: 3, 104: 5, 108: 6, 109: 8}
    assert got[100].coverage == 1 and got[101].n_tiles == 2 and got[103].coverage == 0 and got[104].coverage == pytest.approx(29 / 40)
    kept = without_contaminated(docs, benchmark_table)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.contaminated}


def test_a_large_benchmark_is_joined_and_gives_the_same(corpus, benchmark_table, words):
    docs = corpus([(i, words(60, 5000 + i) if i < 30 else words(60, i)) for i in range(60)] + [(200, None), (None, words(60, 5001)), (3, words(60, 5003)), (3, "clean")]).withColumnRenamed("lang", "t")
    for d in (docs, docs.limit(0)):
        whole = sorted(map(tuple, contamination(d, benchmark_table).collect()), key=str)
        assert sorted(map(tuple, contamination(d, benchmark_table, sent_bytes=100).collect()), key=str) == whole
        kept = sorted(map(tuple, without_contaminated(d, benchmark_table).collect()), key=str)
        assert sorted(map(tuple, without_contaminated(d, benchmark_table, sent_bytes=100).collect()), key=str) == kept
        assert len(kept) == sum(not x[1] for x in whole)
    assert sum(x[1] for x in contamination(docs, benchmark_table, sent_bytes=100).collect()) == 32


def test_one_repeated_word_takes_bounded_memory():
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    items = Items([1, 2], [b"again " * 200, b"x " * 30 + b"again " * 170], 5)
    (got,) = items.best([b"again " * 170_000], 0.5)
    assert got[0] == 1 and got[1] == 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_empty(corpus, benchmark_table, words):
    docs = corpus([(i, words(60, 5000 + i) if i < 30 else words(60, i)) for i in range(60)])
    assert contamination(docs.limit(0), benchmark_table).count() == 0
    assert contamination(docs, benchmark_table.limit(0)).where("contaminated").count() == 0
    assert without_contaminated(docs, benchmark_table.limit(0)).count() == 60
