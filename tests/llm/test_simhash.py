import random
import re

import numpy as np
import pytest
import xxhash

from polyrun.llm import simhash
from polyrun.llm.common import components
from polyrun.llm.simhash import gray_links, links, near_duplicates, pigeonhole_masks, simhash_components, without_near_duplicates


def fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, pairs):
    label = list(range(n))
    for _ in range(n):
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    return label


def near_copy(text, seed, edits):
    rng, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"edit{rng.randrange(99)}"
    return " ".join(words)


def brute(rows, limit=3):
    f = [fingerprint(t) for _, t in rows]
    label = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= limit])
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        if i is not None:
            least[x] = min(i, least.get(x, i))
    return sorted(((i, f"{f[k]:016x}", least.get(label[k])) for k, (i, _) in enumerate(rows)), key=str)


def test_components_of_documents(corpus, words):
    rows = [(i, words(60, i)) for i in range(40)]
    rows += [(100 + i, near_copy(words(800, 3 + i % 3), i, 1 + i % 4)) for i in range(60)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "One"), (204, "one"), (205, "one two"), (206, "x " * 30_000), (7, words(60, 7)), (None, words(60, 9)), (None, "nobody else")]
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash_components(corpus(rows)).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("node_rows", [40, 16_384])
def test_links_are_exact_on_dense_and_sparse_fingerprints(spark, monkeypatch, node_rows):
    monkeypatch.setattr(simhash, "NODE_ROWS", node_rows)
    rng = random.Random(2)
    f = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(4):
        seed = rng.getrandbits(64)
        f |= {seed ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(9))) for _ in range(120)}
        f |= {seed ^ x for x in range(70)}
    f = sorted(f)
    want = roots(len(f), [(i, j) for i in range(len(f)) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 3])
    frame = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) * 2 for x in f], "node long, f0 long")
    edges = [(r.u % 2**64, r.v % 2**64) for r in links(frame, 1, pigeonhole_masks(3), [3]).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in edges)
    at = {x: i for i, x in enumerate(f)}
    assert roots(len(f), [(at[a], at[b]) for a, b in edges]) == want


def test_forest_spans_within_groups_only():
    rng = np.random.default_rng(0)
    f = rng.integers(0, 16, (500, 1)).astype(np.uint64)
    group = np.sort(rng.integers(0, 5, 500))
    a, b = gray_links(f, group, [1])
    assert (group[a] == group[b]).all()
    assert len(a) == 500 - 5


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 300)] + [(1000, 1001), (1001, 1002), (5000, 5000)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 301), 1), **dict.fromkeys((1000, 1001, 1002), 1000)}


def jaccard(a, b, k=5):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}

    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def test_near_duplicates_of_five_words(corpus, words):
    rows = [(i, words(120, i)) for i in range(60)]
    rows += [(100 + i, near_copy(words(400, i % 20), i, i % 9)) for i in range(120)]
    rows += [(500, ""), (501, None), (502, "two words"), (503, "two words")]
    docs = corpus(rows).withColumnRenamed("lang", "node")
    comp = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    texts = {i: t or "" for i, t in rows}
    pairs = [(i, j) for i in texts for j in texts if i < j and texts[j] and texts[i] and jaccard(texts[i], texts[j]) >= 0.8]
    hit = sum(comp.get(i, i) == comp.get(j, j) for i, j in pairs)
    assert hit >= 0.99 * len(pairs)
    linked = roots(1000, pairs)
    assert all(linked[i] == linked[c] for i, c in comp.items())
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i in texts if comp.get(i, i) == i}


def test_texts_with_the_same_filler_are_no_duplicates(corpus, words):
    """A shingle in over half of the places decides no bits: unrelated texts stay, equal sets and near copies go."""
    rows = [(i, words(40, i) + " -" * 500) for i in range(12)]
    rows += [(20, words(40, 3) + " -" * 700), (21, near_copy(words(400, 50), 1, 3) + " x" * 900), (22, words(400, 50) + " x" * 600)]
    comp = {r.doc_id: r.component_id for r in near_duplicates(corpus(rows)).collect()}
    assert comp == {**{i: i for i in range(12)}, 20: 3, 21: 21, 22: 21}


@pytest.mark.parametrize("node_rows", [24, 16_384])
def test_recall_at_the_threshold(corpus, words, monkeypatch, node_rows):
    """Families in which many pairs are just below and just above 0.8, in small and in split nodes, against brute force."""
    monkeypatch.setattr(simhash, "NODE_ROWS", node_rows)
    rows = []
    for base in range(4):
        for group in range(50):  # the two of a group are about 0.82 from each other, 0.68 to 0.78 from other groups
            centre = near_copy(words(300, 900 + base), 100 * base + group, 2)
            rows += [(1000 * base + 10 * group + k, near_copy(centre, 7000 + 1000 * base + 10 * group + k, 3)) for k in range(2)]
    texts = dict(rows)
    true = [(i, j) for i in texts for j in texts if i < j and i // 1000 == j // 1000 and jaccard(texts[i], texts[j]) >= 0.8]
    near = [(i, j) for i, j in true if jaccard(texts[i], texts[j]) < 0.9]
    comp = {r.doc_id: r.component_id for r in near_duplicates(corpus(rows)).collect()}
    at = {i: k for k, i in enumerate(sorted(texts))}
    want = roots(len(at), [(at[i], at[j]) for i, j in true])
    assert len(near) > 150 and sum(comp[i] == comp[j] for i, j in near) >= 0.98 * len(near)
    assert all(want[at[i]] == want[at[c]] for i, c in comp.items())


def test_empty(corpus):
    docs = corpus([(1, "a b c")])
    assert simhash_components(docs.limit(0)).count() == 0
    assert without_near_duplicates(docs.limit(0)).count() == 0
    assert simhash_components(docs.withColumnRenamed("lang", "f0").withColumnRenamed("source", "component_id")).first().component_id == 1
