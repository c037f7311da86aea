import random

import pytest
from pyspark.sql import functions as F

from polyrun.operators import scan
from polyrun.operators.counts import element_counts, sample_coverage, with_depth
from polyrun.operators.scan import sequence_hits, sequence_monomers, tract_hits, tract_hits_columns
from polyrun.streaming.counts import streaming_counts

ROWS = [
    ("CCGAAAGAT", [("A", "CCG", "GAT", 3, 0, 1)]),
    ("ATCTTTCGG", [("A", "CCG", "GAT", 3, 0, 2)]),
    ("TGACCCAAAATGC", [("C", "TGA", "AAA", 3, 0, 1), ("A", "CCC", "TGC", 4, 3, 1)]),
    ("CGAAAGAT", []),
    ("CCGAAAGA", []),
    ("CCGNNNGAT", []),
    ("CCGaaaGAT", [("A", "CCG", "GAT", 3, 0, 1)]),
    ("CNGAAAGAT", [("A", "CAG", "GAT", 3, 0, 1)]),
    ("", []),
    (None, []),
    ("AUCUUUCGG", [("A", "CCG", "GAT", 3, 0, 2)]),
]


@pytest.mark.parametrize("scan", [tract_hits, tract_hits_columns])
def test_sequences(spark, scan):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(ROWS)], "read_id int, seq string")
    got = {}
    for r in scan(df, 3, 3).collect():
        got.setdefault(r.read_id, []).append(tuple(r)[1:])
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, (_, x) in enumerate(ROWS) if x}


def test_case_counts_in_compat():
    assert sequence_hits("CCGaaaGAT", 3, 3, fold=False) == []


def test_hits_of_the_reverse_complement():
    rng = random.Random(1)
    for _ in range(50):
        s = "".join(rng.choice("AACCGT") for _ in range(80))
        r = s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        for scan in (lambda x: sequence_hits(x, 4, 2), lambda x: sequence_monomers(x, 4)):
            assert sorted(h[:4] for h in scan(s)) == sorted(h[:4] for h in scan(r))


def test_counts_depth_and_coverage(spark):
    df = spark.createDataFrame([(0, "CCGAAAGAT")] * 3 + [(0, "ATCTTTCGG")] * 2 + [(0, "CCGAAAAGAT"), (1, "CCGCCCGAT")], "sample_idx int, seq string")
    e = element_counts(tract_hits(df, 3, 3))
    got = {(r.sample_idx, r.base, r.length): (r["count"], r.canon_flag) for r in e.collect()}
    assert got == {(0, "A", 3): (5, 3), (0, "A", 4): (1, 1), (1, "C", 3): (1, 1)}
    assert {r.depth for r in with_depth(e, 5).where("deep").collect()} == {6}
    assert {r.sample_idx: r.coverage for r in sample_coverage(e).collect()} == {0: 6, 1: 1}


def test_stream_of_reads(spark, tmp_path):
    df = spark.createDataFrame([(0, "CCGAAAGAT")] * 3 + [(0, "ATCTTTCGG")], "sample_idx int, seq string")
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    s = streaming_counts(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 3, 3)
    q = s.writeStream.outputMode("complete").format("memory").queryName("tract_counts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["count"], r.canon_flag) for r in spark.table("tract_counts").collect()] == [(4, 3)]
    assert df.select(F.count("*")).first()[0] == 4


@pytest.mark.parametrize("fold", [True, False])
def test_arrays_give_what_rows_give(spark, fold):
    rng = random.Random(6)
    seqs = ["".join(rng.choice(letters) * rng.choice([1, 1, 2, 3, 9]) for _ in range(rng.randrange(60))) for letters in ("ACGT", "ACGTNacgtuU", "AC", "acgtn") for _ in range(30)]
    seqs += ["", "A", "A" * 50, "ACGT" * 3 + "AAAA" + "CGTA" * 3]
    for k in (2, 4):
        for least, most in ((2, None), (3, None), (1, 1), (1, None)):
            row, cols = scan.array_hits(seqs, k, least, most, fold)
            got = sorted(zip(row.tolist(), *(c.to_pylist() for c in cols), strict=True))
            want = [(i, *h) for i, s in enumerate(seqs) for h in ([] if most == 1 else scan.sequence_hits(s, k, least, fold)) + (scan.sequence_monomers(s, k, fold) if least < 2 else [])]
            assert got == sorted(want)
    assert len(scan.array_hits([], 4, 2, None, fold)[0]) == 0
    odd = spark.createDataFrame([(1, "ACGTé" + "ACGTAAAACGTA"), (2, None), (3, "CCGTAAAACGTA")], "id int, seq string")
    assert sorted((r.id, r.base, r.length, r.read_offset) for r in scan.tract_hits(odd, 4, 3).collect()) == [(1, "A", 4, 5), (3, "A", 4, 0)]


def test_counted_monomers(spark):
    """Counts by numbers equal counts by strings, whatever the flanks' size and the letters; only numbers are shuffled."""
    rng = random.Random(41)
    rows = [(i % 3, "".join(rng.choice("ACGTNacg") for _ in range(50))) for i in range(60)] + [(0, None), (1, ""), (2, "ACGT\u0130" + "ACGT" * 12), (2, "CA" * 30)]
    df = spark.createDataFrame(rows, "sample_idx int, seq string")
    for k in (3, 8, 15, 16):
        want = scan.monomer_hits(df, k).groupBy("sample_idx", "base", "left_ctx", "right_ctx").agg(F.count("*").alias("n"), F.bit_or("canon_flag").alias("canon_flag"))
        got = scan.monomer_counts(df, k, ["sample_idx"])
        assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = scan.monomer_counts(df, 8, ["sample_idx"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(sample_idx#" in plan and ", code#" in plan.split("hashpartitioning(")[1].split(")")[0]
