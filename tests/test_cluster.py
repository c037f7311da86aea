import random

import pytest
from pyspark.sql import functions as F

from polyrun.operators import ranges
from polyrun.operators.cluster import assign_tracts, cluster_contexts, context_step, histogram_step, levenshtein, merge_histograms, tract_step
from polyrun.options import Options

OPTIONS = Options(kmer=4, min_tract=3, max_dist=2)
ELEMENT = "sample_idx int, base string, left_ctx string, right_ctx string, length int, count long, location long, ref_id int, loc_pos int, loc_last int, mismatches int, neg_strand boolean, multi boolean"


def elements(seed, n=250):
    rng = random.Random(seed)
    out = {}
    while len(out) < n:
        s, p, base, k = rng.randrange(3), rng.randrange(600), rng.choice("AC"), rng.randrange(3, 8)
        left, right = rng.choice(["ACGT", "ACGA", "TTTT"]), rng.choice(["GGGG", "GGGC"])
        out.setdefault((s, p, base, left, right, k), (s, base, left, right, k, rng.randrange(1, 40), p, 0, p, p + 7 + k, rng.randrange(2), p % 2 == 0, False))
    return list(out.values())


def fold(step, rows):
    out, state = [], None
    for r in rows:
        state, closed = step(state, r)
        out += [closed] if closed is not None else []
    return out + ([state] if state is not None else [])


def fold_contexts(rows, options):
    return fold(context_step(options), rows)


def fold_histograms(rows, options):
    return fold(histogram_step(options), rows)


def fold_tracts(rows, options):
    out, leader, block = [], None, -1
    for r in rows:
        leader, d = tract_step(options)(leader, r)
        block += d is None
        out.append((block, d or 0))
    return out


def as_dicts(rows):
    names = [x.split()[0] for x in ELEMENT.split(", ")]
    return [dict(zip(names, r, strict=True)) for r in rows]


def key(r):
    return (r["location"], -r["length"], r["base"], r["left_ctx"][::-1], r["right_ctx"][::-1])


def sequential(rows, options):
    """The three passes over all rows of each sample, without islands."""
    samples = {}
    for s in range(3):
        h = fold_contexts(sorted((r for r in rows if r["sample_idx"] == s), key=key), options)
        samples[s] = fold_histograms(sorted(h, key=lambda r: (r["location"], r["base"], r["name"])), options)
    concat = sorted((h for x in samples.values() for h in x), key=lambda r: (r["location"], -r["sample_idx"]))
    return samples, [(h["sample_idx"], h["location"], i, b, d) for i, (h, (b, d)) in enumerate(zip(concat, fold_tracts(concat, options), strict=True))]


@pytest.mark.parametrize(("seed", "parts", "tail"), [(0, 4, 20_000), (1, 12, 2)])
def test_ranges_give_what_one_pass_gives(spark, monkeypatch, seed, parts, tail):
    """Few and many ranges, many of them without any gap, so that groups cross several."""
    monkeypatch.setattr(ranges, "TAIL", tail)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = elements(seed)
        samples, tracts = sequential(as_dicts(rows), OPTIONS)
        h = merge_histograms(cluster_contexts(spark.createDataFrame(rows, ELEMENT), OPTIONS), OPTIONS).persist()
        got = sorted((r.sample_idx, r.location, r.name, r.n_context, r.integral, r.mode_length, r.indel, sorted((x.length, x["count"]) for x in r.lengths)) for r in h.collect())
        want = sorted((x["sample_idx"], x["location"], x["name"], x["n_context"], x["integral"], x["mode_length"], x["indel"], sorted(x["lengths"].items())) for v in samples.values() for x in v)
        assert got == want
        assert sum(r[4] for r in got) == sum(r[5] for r in rows)
        ids = assign_tracts(h.withColumn("hist", F.map_from_entries("lengths")), OPTIONS)
        assert sorted((r.sample_idx, r.location, r.concat_idx, r.tract_id, r.lev) for r in ids.collect()) == sorted(tracts)
        dropped = merge_histograms(cluster_contexts(spark.createDataFrame(rows, ELEMENT), OPTIONS), Options(kmer=4, min_tract=3, max_dist=2, compat=True))
        assert dropped.count() == len(got) - 3
        h.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_no_rows(spark):
    empty = cluster_contexts(spark.createDataFrame([], ELEMENT), OPTIONS)
    assert empty.collect() == [] and merge_histograms(empty, OPTIONS).collect() == [] and assign_tracts(empty, OPTIONS).collect() == []


def test_rules():
    a = {"base": "A", "left_ctx": "ACGT", "right_ctx": "GGGG", "length": 4, "count": 5, "location": 10, "ref_id": 0, "loc_pos": 10, "loc_last": 20, "mismatches": 0, "neg_strand": False, "multi": False, "sample_idx": 0}
    one = Options(kmer=4, min_tract=3)
    same = {**a, "length": 5, "count": 9, "location": 12}
    assert len(fold_contexts([a, same], one)) == 1 and fold_contexts([a, same], one)[0]["location"] == 12
    assert len(fold_contexts([a, {**same, "location": 14}], one)) == 2  # too far
    assert len(fold_contexts([a, {**same, "base": "C"}], one)) == 2
    other = {**same, "left_ctx": "ACGA"}
    assert fold_contexts([a, other], one)[0]["indel"]  # one substitution: by the edit distance of names
    assert len(fold_contexts([a, other], Options(kmer=4, min_tract=3, leven=1))) == 2
    assert levenshtein("kitten", "sitting") == 3 and levenshtein("", "ab") == 2
