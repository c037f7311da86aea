import random

import pytest
from pyspark.sql import functions as F

from polyrun.operators import mapping

CONTIG = "ref_id int, contig string, seq string, len int"


def contigs(spark, seqs):
    return spark.createDataFrame([(i, f"c{i}", s, len(s)) for i, s in enumerate(seqs)], CONTIG)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(queries, seqs, edits):
    rc = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    out = set()
    for q in set(queries):
        for s, neg in ((q, False), (rc(q), True)):
            for i, g in enumerate(seqs):
                for p in range(len(g)):
                    for n in range(len(s) - edits, len(s) + edits + 1):
                        if p + n <= len(g) and (d := distance(s, g[p : p + n])) <= edits:
                            out.add((q, i, p, p + n - 1, d, neg))
    return out


def made(seed, poly=0):
    rng = random.Random(seed)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    seqs = [dna(160) + "A" * poly + dna(120), dna(90) + "ACACACACACAC" + dna(60)]
    queries = ["A" * 18] if poly else []
    for _ in range(12):
        s = rng.choice(seqs)
        p = rng.randrange(len(s) - 24)
        q = list(s[p : p + 24])
        for _ in range(rng.randrange(4)):
            q[rng.randrange(len(q))] = rng.choice(["", "A", "CG", "T"])
        queries.append("".join(q)[:24].ljust(18, "A"))
    return seqs, queries


@pytest.mark.parametrize(("seed", "edits", "poly"), [(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 2, 80)])
def test_all_places_are_found(spark, seed, edits, poly):
    seqs, queries = made(seed, poly)
    got = mapping.locate(spark.createDataFrame([(q,) for q in queries], "query string"), contigs(spark, seqs), 6, edits)
    rows = [tuple(r) for r in got.select("query", "ref_id", "loc_pos", "loc_last", "mismatches", "neg_strand").collect()]
    assert set(rows) == brute(queries, seqs, edits) and len(rows) == len(set(rows))


def test_a_run_of_one_base_is_no_hot_key(spark):
    c = contigs(spark, ["A" * 4000 + "".join(random.Random(1).choice("ACGT") for _ in range(400))])
    index = mapping.build_index(c, 6)
    assert index.frequencies.where("qgram = 'AAAAAA'").first().slots > 500
    assert index.positions.groupBy("key").count().agg(F.max("count")).first()[0] < 60
    asked = spark.createDataFrame([("A" * 10 + "CTG" + "A" * 7, "A" * 10 + "CTG" + "A" * 7, False)], "query string, s string, neg_strand boolean")
    assert mapping.rarest_seeds(asked, mapping.build_index(contigs(spark, ["A" * 300 + "AACTGA" + "A" * 300]), 5), 0).first().qgram != "AAAAA"


def test_short_queries_are_refused(spark):
    with pytest.raises(Exception, match="no piece of 6"):
        mapping.locate(spark.createDataFrame([("ACGTACGTAC",)], "query string"), contigs(spark, ["ACGT" * 20]), 6, 1).collect()


def test_stored_index(spark, tmp_path):
    """Written once, read without a shuffle of the reference; another reference, or a session without its tables, is told apart."""
    seqs, queries = made(5)
    c, q = contigs(spark, seqs), spark.createDataFrame([(x,) for x in queries], "query string")
    folder = str(tmp_path / "index")
    first = mapping.stored_index(c, 6, folder, 3)
    names = sorted(p.name for p in (tmp_path / "index").iterdir())
    stamp = sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "index").rglob("*.parquet"))
    for kind in ("positions", "frequencies"):
        spark.sql(f"DROP TABLE polyrun_{kind}_{names[0]}")  # as in a new session
    again = mapping.stored_index(c.repartition(2), 6, folder, 8)
    assert stamp == sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "index").rglob("*.parquet"))
    assert sorted(map(tuple, again.positions.collect())) == sorted(map(tuple, mapping.build_index(c, 6).positions.collect()))
    assert set(map(tuple, mapping.locate(q, c, 6, 2, again).collect())) == set(map(tuple, mapping.locate(q, c, 6, 2).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = mapping.locate(q, c, 6, 2, again)._jdf.queryExecution().executedPlan().toString()
        read = next(x for x in plan.splitlines() if f"positions_{names[0]}" in x)
        above = plan.splitlines()[: plan.splitlines().index(read)]
        indent = len(read) - len(read.lstrip(" :+-"))
        for line in reversed(above):  # what stands above the scan of the places, up to its join
            if len(line) - len(line.lstrip(" :+-")) < indent:
                indent = len(line) - len(line.lstrip(" :+-"))
                assert "Exchange" not in line
                if "Join" in line:
                    break
        assert "Bucketed: true" in read
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    changed = mapping.stored_index(contigs(spark, [seqs[0] + "A", seqs[1]]), 6, folder, 3)
    assert len(list((tmp_path / "index").iterdir())) == 2 and changed.positions.count() == first.positions.count() + 1


def test_compat_keeps_what_a_pass_over_hits_keeps(spark):
    """Hits best first, one after the other: fewer mismatches or more to the left replaces."""
    rng = random.Random(12)
    c = contigs(spark, ["A" * 300, "C" * 200])
    rows = list({(f"q{rng.randrange(12)}", r := rng.randrange(2), p := rng.randrange(150), p + 20, rng.randrange(3), rng.random() < 0.5): None for _ in range(60)})
    want = {}
    for q, r, p, last, nm, neg in sorted(rows, key=lambda x: (x[4], x[2] + 300 * x[1], x[5], x[3])):
        at, now = p + 300 * r, want.get(q)
        if now is None:
            want[q] = (at, nm, neg, last, False)
        elif now[1] > nm or now[0] > at:
            want[q] = (at, nm, neg, last, True)
    hits = spark.createDataFrame(rows, "query string, ref_id int, loc_pos int, loc_last int, mismatches int, neg_strand boolean").repartition(5)
    got = {r.query: (r.location, r.mismatches, r.neg_strand, r.loc_last, r.multi) for r in mapping.leftmost_match(hits, c).collect()}
    assert got == want and any(x[4] for x in want.values())


def test_nothing_that_grows_is_broadcast(spark):
    """Spark takes what is exploded or mapped of a small file for small; only the hot stretches (HOT rows at most) go through the driver."""
    from polyrun.operators import annotate
    from polyrun.sources import derived

    d = "/root/testdata/sf0.001"
    c = derived.contigs(spark, d)
    broadcasts = lambda df: df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")
    assert broadcasts(derived.reads(spark, d)) == 0
    assert broadcasts(mapping.locate(c.select(F.substring("seq", 100, 40).alias("query")), c, 15)) <= 1
    assert broadcasts(mapping.locate(c.select(F.substring("seq", 100, 40).alias("query")), c, 9, 1)) <= 1
    assert broadcasts(annotate.feature_hits(c.select("contig", F.lit(7).alias("position")), derived.features(spark, d))) == 0


def test_two_edits_next_to_other_letters_and_borders(spark):
    """Seeds are known but for one edit, whatever letters the reference holds there."""
    rng = random.Random(21)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    seqs = [dna(70), dna(19), dna(60)]
    queries = [seqs[1], seqs[0][:20], seqs[2][-22:], seqs[0][30:53]]
    seqs[0] = seqs[0][:8] + "N" + seqs[0][9:37] + "NR" + seqs[0][39:]
    got = mapping.locate(spark.createDataFrame([(q,) for q in queries], "query string"), contigs(spark, seqs), 6, 2)
    assert {tuple(r) for r in got.collect()} == brute(queries, seqs, 2)


def test_few_places_are_verified_for_two_edits(spark):
    """A stretch of 6 bases alone points to a 4096th of all places; seeds over two pieces to far fewer."""
    rng = random.Random(22)
    g = "".join(rng.choice("ACGT") for _ in range(20000))
    both = spark.createDataFrame([(g[i : i + 18],) * 2 + (False,) for i in range(0, 3000, 100)], "query string, s string, neg_strand boolean")
    near = mapping.near_pairs(both, contigs(spark, [g]), 6)
    assert near.select("s").distinct().count() == 30 and near.count() < 30 * 8
    assert 3 * 20000 / 4096 > 14  # places by single stretches of 6, of each string


def test_few_places_are_verified_for_one_edit(spark):
    """Two stretches of 6 bases point to far fewer places than one of 9 of each half."""
    rng = random.Random(23)
    g = "".join(rng.choice("ACGT") for _ in range(200000))
    both = spark.createDataFrame([(g[i : i + 19],) * 2 + (False,) for i in range(0, 3000, 100)], "query string, s string, neg_strand boolean")
    near = mapping.near_gaps(both, contigs(spark, [g]), 6)
    assert near.select("s").distinct().count() == 30 and near.count() < 30 * 5
    plan = mapping.locate(both.select("query"), contigs(spark, [g]), 9, 1)._jdf.queryExecution().executedPlan().toString()
    assert "gram" in plan and "qgram" not in plan
    assert 9 * 2 * 200000 / 4**9 > 13  # starts and lengths to verify by stretches of 9, of each string


@pytest.mark.parametrize(("seed", "poly"), [(4, 0), (5, 900)])
def test_one_edit_by_seeds_that_span_pieces(spark, seed, poly):
    """Also next to other letters, at borders of contigs, and for hot grams, which lie in slots."""
    seqs, queries = made(seed, poly)
    seqs += [queries[0], queries[1][1:], queries[2][:9] + "N" + queries[2][10:], queries[3] + "R"]
    c = contigs(spark, seqs)
    assert (max(mapping.hot_gaps(c, 6).values(), default=0) > 500) == (poly > 0)
    got = mapping.locate(spark.createDataFrame([(q,) for q in queries if len(q) >= 18], "query string"), c, 9, 1)
    want = {x for x in brute([q for q in queries if len(q) >= 18 and q != "A" * 18], seqs, 1)}
    rows = [tuple(r) for r in got.where(F.col("query") != "A" * 18).select("query", "ref_id", "loc_pos", "loc_last", "mismatches", "neg_strand").collect()]
    assert set(rows) == want and len(rows) == len(want)
    if poly:
        assert got.where(F.col("query") == "A" * 18).where("mismatches = 0 and not neg_strand").count() >= poly - 17


@pytest.mark.parametrize(("q", "edits"), [(6, 2), (9, 1)])
def test_places_to_verify_are_not_stored(spark, q, edits):
    """They grow as queries times genome: only hits are shuffled after the search, and both sides of it once."""
    seqs, queries = made(7)
    plan = mapping.locate(spark.createDataFrame([(x,) for x in queries if len(x) >= 18], "query string"), contigs(spark, seqs), q, edits)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Join" not in plan
    above = plan[: plan.index("met_by_gram")]
    assert above.count("Exchange") == 1 and "hashpartitioning(query" in above


@pytest.mark.parametrize("edits", [1, 2])
def test_many_blocks_spans_and_packed_rows(spark, edits, monkeypatch):
    """The same hits in small blocks, also over borders of spans and blocks."""
    rng = random.Random(31)
    g = "".join(rng.choice("ACGT") for _ in range(700))
    seqs = [g, g[300:420], "N" + g[:30] + "\u00e9\u0141" + g[60:90]]
    queries = [g[i : i + 18 + i % 5] for i in range(0, 680, 17)]
    queries += [q[:4] + "T" + q[5:] for q in queries]
    for name, size in (("BLOCK", 200), ("SPAN", 64), ("OVERLAP", 40), ("STRINGS", 9), ("PACKED", 4), ("PLACES", 7), ("SEEDED", 3)):
        monkeypatch.setattr(mapping, name, size)
    c = contigs(spark, seqs)
    both = spark.createDataFrame([(q,) for q in queries], "query string")
    got = [tuple(r) for r in mapping.locate(both, c, 6 if edits == 2 else 9, edits).select("query", "ref_id", "loc_pos", "loc_last", "mismatches", "neg_strand").collect()]
    assert set(got) == brute(queries, [s.upper() for s in seqs], edits) and len(got) == len(set(got))
