import hashlib
import random
import re

import numpy as np

from polyrun.llm.rolling import anchors
from polyrun.llm.substrings import factored, parsed

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, k=13):
    first, out = {}, []
    for i, t in rows:
        w = WORD.findall(t or "")
        for j in range(len(w) - k + 1):
            g = tuple(w[j : j + k])
            if i is not None:
                first[g] = min(i, first.get(g, i))
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for j in range(len(w) - k + 1):
            at = first.get(tuple(w[j : j + k]))
            if at is not None and (i is None or at < i):
                gone |= set(range(j, j + k))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=str)


def sample(words):
    rng = random.Random(4)
    passage = words(60, 999)
    rows = [(i, words(80, i)) for i in range(30)]
    for i in range(30, 90):
        w = words(100, i).split()
        p = passage.split()[: rng.randrange(8, 60)]
        at = rng.randrange(100)
        rows.append((i, " ".join(w[:at] + p + w[at:] + words(40, rng.randrange(30)).split())))
    rows += [(100 + i, words(80, i)[: rng.randrange(20, 500)]) for i in range(20)]
    rows += [(200, None), (201, ""), (202, " \t"), (203, "a " * 500), (204, "a " * 20), (205, "a " * 13), (206, "a " * 12), (3, words(80, 3)), (None, words(80, 4)), (None, passage), (-5, passage + "  \n" + passage), (300, words(50_000, 1)), (301, "Ä ö " * 40)]
    rng.shuffle(rows)
    return rows


def test_words_that_repeat_are_removed(corpus, words):
    rows = sample(words)
    docs = corpus(rows).withColumnRenamed("lang", "g").withColumnRenamed("source", "bucket")
    want = brute(rows)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in parsed(docs).collect()), key=str) == [x[:4] for x in want]
    assert sorted(((r.doc_id, r.text) for r in parsed(docs, give="text").collect()), key=str) == sorted(((x[0], x[4]) for x in want), key=str)


def test_factors_point_to_equal_words(corpus, words):
    rows = [r for r in sample(words) if r[0] not in (3, None)]
    texts = {i: WORD.findall(t or "") for i, t in rows}
    factors = parsed(corpus(rows), give="factors").collect()
    assert factors
    for f in factors:
        assert f.ref_doc < f.doc_id and f.n_words >= 13
        assert texts[f.doc_id][f.start : f.start + f.n_words] == texts[f.ref_doc][f.ref_start : f.ref_start + f.n_words]


def test_small_windows(corpus):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(30)))) for i in range(60)]
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in parsed(corpus(rows), window=5, seed=2).collect()), key=str)
    assert got == [x[:4] for x in brute(rows, 5)]


def test_empty(corpus):
    assert parsed(corpus([(1, "a")]).limit(0)).count() == 0


def test_each_window_has_one_anchor():
    rng = np.random.default_rng(1)
    for size, values, width in [(50, 4, 5), (300, 3, 7), (300, 10**6, 9), (40, 1, 6), (3, 9, 2)]:
        h = rng.integers(0, values, size).astype(np.uint64) << np.uint64(40)
        text = np.sort(rng.integers(0, 4, size))  # windows do not cross texts
        ok = np.arange(size) + width <= np.searchsorted(text, text, side="right")
        at, lo, hi = anchors(h, ok, width)
        got = {}
        for a, x, y in zip(at, lo, hi, strict=True):
            for j in range(x, y + 1):
                assert j not in got
                got[j] = a
        want = {j: j + int(np.argmin(np.maximum(h[j : j + width] >> np.uint64(32), 1))) for j in np.flatnonzero(ok)}
        assert got == want


def test_greedy_factors_and_their_boundaries():
    rng = random.Random(2)
    for _ in range(300):
        window, at, runs = 4, 0, []
        for _ in range(rng.randrange(1, 8)):
            at += rng.randrange(0, 6)
            size = rng.randrange(1, 7)
            runs.append((at, at + size))
            at += size
        run, begin, end, straddling = factored(*(np.array(x) for x in zip(*runs, strict=True)), window)
        assert all(runs[k][0] <= b and e == runs[k][1] + window - 1 for k, b, e in zip(run, begin, end, strict=True))
        assert (begin[1:] >= end[:-1]).all()  # factors do not overlap
        want = {x for a, z in runs for p in range(a, z) for x in range(p, p + window)}
        assert {x for a, z in [*zip(begin, end, strict=True), *straddling] for x in range(a, z)} == want


def test_long_periodic_words_are_told_apart(corpus):
    """Thue-Morse strings, which any polynomial modulo 2^64 hashes alike when they are long."""
    t = "a"
    for _ in range(11):
        t += t.translate(str.maketrans("ab", "ba"))
    other = t.translate(str.maketrans("ab", "ba"))
    rest = " ".join(f"w{i}" for i in range(12))
    got = {r.doc_id: r.n_removed for r in parsed(corpus([(1, f"{t} {rest}"), (2, f"{other} {rest}"), (3, f"{t} {rest}")])).collect()}
    assert got == {1: 0, 2: 0, 3: 13}
