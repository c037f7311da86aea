import hashlib
import random
import re
from collections import Counter, defaultdict

from polyrun.llm.exact_dedup import PatriciaTrie, owners


def brute(rows):
    groups = defaultdict(list)
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    for i, t in norm:
        groups[t].append(i)
    out = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def check(docs, rows):
    assert sorted((tuple(r) for r in owners(docs).collect()), key=str) == brute(rows)


def test_groups_nulls_and_ties(corpus, words):
    rows = [(i, words(20, i % 37)) for i in range(200)]
    rows += [(300, None), (301, ""), (302, " "), (303, "\t\n"), (304, "a b"), (305, "a \t b"), (306, " a b"), (307, "a b "), (308, "a b"), (5, words(20, 5)), (None, "a b"), (None, "alone")]
    check(corpus(rows), rows)


def test_one_text_in_a_third_of_the_rows(corpus, words):
    rows = [(i, "same old text" if i % 3 == 0 else words(30, i)) for i in range(900)] + [(1000, "x" * 3_000_000), (1001, "x" * 3_000_000)]
    check(corpus(rows), rows)


def test_empty_and_clashing(corpus):
    docs = corpus([(1, "a")])
    assert owners(docs.limit(0)).count() == 0
    assert owners(docs.withColumnRenamed("lang", "salt").withColumnRenamed("source", "keep_id")).first().kept


def test_trie_splits_edges():
    trie = PatriciaTrie()
    keys = [b"", b"a", b"abc", b"abd", b"ab", b"b", b"abc", b"x" * 1000, b"x" * 999 + b"y"]
    for i, k in enumerate(keys):
        trie.add(k, i, 1)
    assert {k: (i, n) for k, i, n, _ in trie.terminals()} == {b"": (0, 1), b"a": (1, 1), b"abc": (2, 2), b"abd": (3, 1), b"ab": (4, 1), b"b": (5, 1), b"x" * 1000: (7, 1), b"x" * 999 + b"y": (8, 1)}


def test_spilled_subtrees_keep_all_keys_under_one_prefix():
    rng = random.Random(3)
    keys = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(4000)]
    trie, gone, prefix = PatriciaTrie(), Counter(), {}
    for k in keys:
        to = trie.add(k, 1, 1)
        if to is not None:
            gone[k] += 1
            assert k.startswith(to) and prefix.setdefault(k, to) == to
        if trie.bytes > 60_000:
            for to, found in trie.spill(mark=True):
                for key, _, n, _ in found:
                    gone[key] += n
                    assert prefix.setdefault(key, to) == to
    assert prefix
    for k, _, n, _ in trie.terminals():
        assert k not in prefix
        gone[k] += n
    assert gone == Counter(keys)


def test_crowded_partitions_are_spilled_by_subtree(corpus, words):
    rows = [(i, words(3, i % 500)) for i in range(1500)] + [(2000 + i, "same beginning " + words(40, i % 90)) for i in range(300)] + [(3000, None), (3001, "")]
    want = brute(rows)
    for held in (1000, 5000, 40_000):
        assert sorted((tuple(r) for r in owners(corpus(rows), held_bytes=held).collect()), key=str) == want


def test_texts_that_share_a_hash_stay_apart(corpus):
    rows = [(i, f"{i % 300:04d}") for i in range(900)] + [(1000, "lone")]
    assert sorted((tuple(r) for r in owners(corpus(rows), key_bytes=1).collect()), key=str) == brute(rows)
