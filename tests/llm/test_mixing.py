import hashlib
import re
from collections import defaultdict

import pytest

from polyrun.llm import mixing
from polyrun.llm.mixing import QUANTUM, fair_queue, mix, mixed_documents


def targets(sizes):
    """Water filling, one stop at a time."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, out = 1.5 * sum(sizes.values()), {}
    while len(out) < len(sizes):
        open_ = [s for s in order if s not in out]
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if 2 * sizes[s] <= weight[s] * level]
        if not full:
            out |= {s: weight[s] * level for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= 2 * sizes[s]
    return out


def served(rows, sizes, order):
    """(doc_id, words taken) in one pass over all items by finish time, until the budget."""
    left, items, taken = int(1.5 * sum(sizes.values())), [], defaultdict(int)
    for s in sizes:
        end, weight = 0, (5, 2, 1)[order[s] % 3]
        own = sorted((hashlib.md5(f"mix:{i}".encode()).hexdigest(), i, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, x in rows if x == s)
        for _ in range(2):
            for _, i, n in own:
                for a in range(0, n, QUANTUM):
                    w = min(QUANTUM, n - a)
                    end += w
                    items.append((end / weight, order[s], i, w))
    for _, _, i, w in sorted(items):
        taken[i] += min(w, left)
        left -= min(w, left)
    return {(i, taken[i]) for i, _, _ in rows}


def test_targets_and_taken(corpus, words):
    rows = [(i, words(1 + i % 60, i), f"src{i % 7}") for i in range(400)] + [(1000 + i, words(50, i), None) for i in range(30)] + [(2000 + i, words(3, i), "tiny") for i in range(3)] + [(3000, None, "nothing"), (3001, "", "src1")]
    rows += [(7, "twice the id", "src0")]
    docs = corpus(rows)
    got = mix(docs).collect()
    assert len(got) == len(rows)
    sizes, source = defaultdict(int), {}
    for i, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        source[i] = s
    want = targets(sizes)
    taken = defaultdict(int)
    for r in got:
        s = source[r.doc_id]
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s] and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= QUANTUM  # one item of each queue at most
    assert sum(taken.values()) == int(1.5 * sum(sizes.values()))
    order = {s: i for i, s in enumerate(sorted(s for s in sizes if s is not None))} | {None: len(sizes) - 1}
    assert {(r.doc_id, r.taken) for r in got if r.doc_id != 7} == {(i, n) for i, n in served(rows, sizes, order) if i != 7}  # two rows have the id 7
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix(docs.repartition(5)).collect()), key=str)


def test_the_queue_is_in_order_of_finish(corpus, words):
    rows = sorted(fair_queue(corpus([(i, words(20, i), f"s{i % 3}") for i in range(60)])).collect(), key=lambda r: (r.offset, r.finish))
    assert [r.finish for r in rows if r.taken] == sorted(r.finish for r in rows if r.taken)
    at = 0
    for r in rows:
        assert r.offset == at
        at += r.taken
    assert at <= 1.5 * 60 * 20


def test_the_global_order_decides(corpus, words, monkeypatch):
    """With another order of the items than by finish time, other words are taken: nothing else cuts a source."""
    docs = corpus([(i, words(20, i), f"s{i % 3}") for i in range(90)])
    fair = {r.doc_id: r.taken for r in mix(docs).collect()}
    real = mixing.running

    def backwards(rows, order, **values):
        return real(rows, [order[1], order[0]] if "until" in values else order, **values)

    monkeypatch.setattr(mixing, "running", backwards)
    other = {r.doc_id: r.taken for r in mix(docs).collect()}
    assert other != fair and sum(other.values()) == sum(fair.values())


def test_long_documents_queue_in_stretches(corpus, words):
    docs = corpus([(0, words(30_000, 1), "a"), *((i, words(100, i), f"s{i % 2}") for i in range(1, 200))])
    got = mix(docs).collect()
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.source_size, r.target].append(r.taken)
    assert len(by) == 3 and all(abs(sum(x) - target) <= 2 * QUANTUM for (_, target), x in by.items())


def test_documents_of_the_mix(corpus, words):
    docs = corpus([(i, words(20, i), f"s{i % 3}") for i in range(60)]).withColumnRenamed("lang", "pass")
    out = mixed_documents(docs)
    assert out.columns == docs.columns and 80 <= out.count() <= 100


def test_empty(corpus):
    docs = corpus([(1, "a", "s")])
    assert mix(docs.limit(0)).count() == 0
    assert mix(corpus([(1, "", "s"), (2, None, None)])).select("taken").distinct().first().taken == 0
