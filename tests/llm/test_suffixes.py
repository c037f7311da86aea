import hashlib
import random

import numpy as np
import pytest

from polyrun.llm import suffixes
from polyrun.llm.suffixes import RunLengthIndex, repeats


def brute(rows, k):
    seen = {}
    for i, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for j in range(len(b) - k + 1):
            seen.setdefault(b[j : j + k], []).append((i, j))
    gone = [np.zeros(len((t or "").encode()), bool) for _, t in rows]
    for places in seen.values():
        if len(places) > 1:
            for i, j in places:
                gone[i][j : j + k] = True
    out = []
    for (i, t), g in zip(rows, gone, strict=True):
        b = np.frombuffer((t or "").encode(), np.uint8)
        spans = int((np.diff(np.concatenate([[0], g.astype(int)])) == 1).sum())
        out.append((i, len(b), int(g.sum()), spans, hashlib.sha256(b[~g].tobytes()).hexdigest()))
    return sorted(out, key=str)


def sample(words, seed=1):
    rng = random.Random(seed)
    passage = words(200, 777)
    rows = [(i, words(200, i)) for i in range(12)]
    for i in range(12, 40):
        a = rng.randrange(400)
        rows.append((i, words(60, i) + passage[a : a + rng.randrange(100, 900)] + words(30, 1000 + i)))
    rows += [(50 + i, words(200, i % 12)[rng.randrange(200) :]) for i in range(8)]
    rows += [(70, None), (71, ""), (72, "é" * 500), (73, "ab" * 700), (74, "x" * 1500), (75, passage[:450] + " - " + passage[:450]), (3, words(200, 3)), (None, words(200, 5)), (80, words(20_000, 1))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [1000, 3])
def test_bytes_that_repeat_are_removed(corpus, words, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "SEED_STRETCHES", hot)
    rows = sample(words)
    docs = corpus(rows).withColumnRenamed("lang", "kind").withColumnRenamed("source", "g")
    assert sorted(map(tuple, repeats(docs).collect()), key=str) == brute(rows, 400)


def test_short_windows(corpus):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(60)))) for i in range(60)]
    assert sorted(map(tuple, repeats(corpus(rows), length=9, seed=3).collect()), key=str) == brute(rows, 9)


def test_kept_bytes_and_empty(corpus, words):
    rows = [(1, words(100, 1)), (2, words(100, 1) + "tail"), (3, words(90, 3))]
    got = {r.doc_id: bytes(r.kept) for r in repeats(corpus(rows), give="text").collect()}
    assert got == {1: b"", 2: b"tail", 3: rows[2][1].encode()}
    assert repeats(corpus(rows).limit(0)).count() == 0


def test_index_of_stretches():
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("ab") for _ in range(n))
    for _ in range(60):
        texts, group, left = [], [], []
        for g in range(rng.randrange(1, 5)):
            seed, around = some(6), some(20)
            for _ in range(rng.randrange(1, 9)):
                before, after = (around[:10] if rng.random() < 0.6 else some(10))[rng.randrange(8) :], (around[10:] if rng.random() < 0.6 else some(10))[: rng.randrange(1, 10)]
                texts.append((before + seed + after).encode())
                group.append(g)
                left.append(len(before))
        got = RunLengthIndex(texts, np.array(group), np.array(left)).matches(10)
        most = max(left)
        for i, t in enumerate(texts):
            for c in range(most + 1):
                at = c - most + left[i]
                own = t[at : at + 10] if at >= 0 else b""
                want = len(own) == 10 and any(o[x : x + 10] == own for j, o in enumerate(texts) if j != i and group[j] == group[i] and (x := c - most + left[j]) >= 0)
                assert got[i, c] == want
