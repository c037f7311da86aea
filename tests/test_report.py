import random

import pytest
from pyspark.sql import functions as F

from polyrun.functions import dna
from polyrun.operators import annotate, mapping, reference, report, stats
from polyrun.options import Options
from polyrun.plans.pipeline import TractPipeline


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_functions(spark):
    lit = F.lit
    assert one(spark, dna.revcomp(lit("ACGTU")), dna.context_name(lit("CCG"), lit("A"), lit("GAT"), lit(True)), dna.tract_string(lit("CC"), lit("A"), lit("GT"), lit(3), lit(True))) == ("AACGT", "ATC.T.CGG", "ACTTTGG")
    assert one(spark, dna.kmer_code(lit("CA")), dna.kmer_code(lit("AC")), dna.pair_distance(lit("AC"), lit("GT"), lit("AA"), lit("TT"))) == (1, 4, 2)
    assert one(spark, dna.common_prefix(lit("ABCX"), lit("ABDX")), dna.common_suffix(lit("ABCX"), lit("ABDX")), dna.common_prefix(lit("AA"), lit("AAA")), dna.common_suffix(lit("AA"), lit("AAA")), dna.common_prefix(lit(""), lit("A"))) == (2, 1, 2, 0, 0)
    assert one(spark, dna.shift_distance(lit("ACGTAC"), lit("GGGGGG"), lit("CGTACT"), lit("GGGGGG"), 6)) == (1,)
    assert one(spark, dna.translate_protein(lit("ATGGCCTAANN")), dna.translate_protein(lit("ATGNCC")), dna.translate_protein(lit("AT")), dna.translate_protein(lit("TTAGGCCAT"), True)) == ("MA*", "MX", "", "MA*")
    assert one(spark, dna.tract_label(lit(7)), F.round(dna.euclidean(F.array(lit(0.0), lit(3.0)), F.array(lit(4.0), lit(0.0))), 6)) == ("tid_000007", 5.0)
    assert Options(kmer=99, max_dist=99, min_reads=-1, min_tract=0) == Options(kmer=32, max_dist=16, min_reads=0, min_tract=1) and Options().leven == 2


def contigs(spark, *seqs):
    return spark.createDataFrame([(i, f"c{i}", s, len(s)) for i, s in enumerate(seqs)], "ref_id int, contig string, seq string, len int")


def test_variant_row(spark):
    """A tract of four T at 74435 that is five long in a sample."""
    seq = "G" * 74410 + "ACGTACGTACGTACGTACGTACGAC" + "TTTT" + "GACGTACGTACGTACGTACGTACGA" + "C" * 50
    ref = contigs(spark, seq)
    concat = spark.createDataFrame([(0, 3, 0, "A", dna_rc(seq[74439:74464]), dna_rc(seq[74410:74435]), 5, True, 74410, 74463)], "sample_idx int, tract_id int, ref_id int, base string, mode_left string, mode_right string, mode_length int, neg_strand boolean, loc_pos int, loc_last int")
    tract = spark.createDataFrame([(3, 0, 74435, 4)], "tract_id int, ref_id int, ht_location int, tract_length int")
    got = report.vcf_rows(concat, tract, ref, spark.createDataFrame([(3, True)], "tract_id int, variable boolean"), 25).collect()
    assert [tuple(r) for r in got] == [(0, "c0", 74439, "T", "TT", "tid_000003")]


def dna_rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def test_mapping_with_edits_on_both_strands(spark):
    import random

    rng = random.Random(4)
    seq = "".join(rng.choice("ACGT") for _ in range(9000))
    c = contigs(spark, seq[:5000], seq[5000:])
    wanted = {seq[4000:4030]: (0, 4000, 0, False), dna_rc(seq[6000:6030]): (1, 1000, 0, True), seq[4090:4105] + seq[4106:4120]: (0, 4090, 1, False)}
    q = spark.createDataFrame([(k,) for k in wanted] + [("A" * 30,)], "query string")
    best = mapping.best_match(mapping.locate(q, c, 12, 1), c).collect()
    assert {r["query"]: (r.ref_id, r.loc_pos, r.mismatches, r.neg_strand) for r in best} == wanted
    assert {r.contig: r.flat_offset for r in mapping.with_offsets(c).collect()} == {"c0": 0, "c1": 5000}


def test_features(spark):
    f = spark.createDataFrame([("c", "gene", 1, 9000, "g"), ("c", "CDS", 10, 8000, "x"), ("c", "CDS", 20, 7000, "y"), ("c", "region", 1, 99999, "r")], "contig string, type string, start int, end int, feature_id string")
    p = spark.createDataFrame([(1, "c", 5), (2, "c", 5000), (3, "c", 9500), (4, "d", 5)], "id int, contig string, position int")
    assert {r.id: (r.feature_type, r.feature_id) for r in annotate.with_feature(p, f, ["id"]).collect()} == {1: ("gene", "g"), 2: ("CDS", "x"), 3: (None, None), 4: (None, None)}


def test_next_location(spark):
    t = spark.createDataFrame([(0, 0, 5), (1, 0, 5), (2, 0, 9), (3, 0, 5), (4, 1, 7)], "tract_id int, ref_id int, ht_location int")
    assert {r.tract_id: r.next_ht for r in reference.next_locations(t).collect()} == {0: 9, 1: 9, 2: 5, 3: None, 4: None}


def test_variability_counts_absent_samples_as_zero(spark):
    rows = [(0, s, 1, 4.0, 1.0, 0.0, 4) for s in range(2)] + [(1, 0, 2, 4.0, 1.0, 0.0, 4)] + [(2, s, 3, 4.0, 1.0, 0.0, 5) for s in range(2)] + [(3, s, 4, 4.0 + s, 1.0, 0.0, 4) for s in range(2)]
    d = spark.createDataFrame(rows, "tract_id int, sample_idx int, location long, mean_length double, modal_freq double, entropy double, mode_length int").withColumn("prop_coverage", F.lit(0.5)).withColumn("cov_per_context", F.lit(1.0))
    ref = spark.createDataFrame([(i, 4) for i in range(4)], "tract_id int, tract_length int")
    assert {r.tract_id: r.variable for r in stats.variable_tracts(d, ref, 2).collect()} == {0: False, 1: True, 2: True, 3: True}




@pytest.mark.parametrize("name", ["ht_counts", "leftmost_tract", "kmer_hamming", "context_names", "contig_offsets", "map_exact", "tract_spread", "map_edits", "pattern_distance", "diagonal_scores", "assign_tracts", "context_differs_from_ref"])
def test_queries_match_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("part", "events"):
        con.execute(f"create view {t} as select * from read_parquet('{d}/{t}.parquet')")
    df = entry.queries()[name](spark, d)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    tidy = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(tuple(tidy(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(map(tidy, r)) for r in cur.fetchall())


def test_run_without_tracts_or_with_unknown_contigs_stops(spark):
    rng = random.Random(1)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    c = contigs(spark, genome)
    empty = TractPipeline(spark.createDataFrame([(0, "ACGTACGTACGT")], "sample_idx int, seq string"), c, None, Options(kmer=5, min_tract=3, min_reads=1))
    with pytest.raises(ValueError, match="no sample has a tract"):
        empty.samples  # noqa: B018
    lost = spark.createDataFrame([("nowhere", "gene", 1, 9, "g")], "contig string, type string, start int, end int, feature_id string")
    run = TractPipeline(spark.createDataFrame([(0, genome)], "sample_idx int, seq string"), c, lost, Options(kmer=5, min_tract=3, min_reads=1))
    with pytest.raises(ValueError, match="nowhere"):
        run.histograms  # noqa: B018


def test_a_sequence_is_cleaned_once_not_for_every_codon(spark):
    plan = spark.createDataFrame([("ACGT",)], "seq string").select(dna.translate_protein("seq", True).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("reverse(") == 1
