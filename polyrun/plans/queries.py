"""The registered queries: (spark, sf_dir) -> DataFrame, and SQL with the same rows where SQL can tell them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyrun.functions import dna, similarity
from polyrun.operators import annotate, cluster, counts, mapping, reference, report, scan, stats
from polyrun.options import Options
from polyrun.plans import cluster_sql
from polyrun.plans.pipeline import TractPipeline
from polyrun.sources import derived
from polyrun.sources.shared import checkpointed, shuffled

K, M, DEPTH = 8, 3, 5
OPTIONS = Options(kmer=K, min_tract=M, min_reads=DEPTH, max_edits=1)
SAMPLES = list(range(derived.SAMPLES))
#: One in ASKED is in the query set of distances.
ASKED = 50


def _hits(spark, d):
    return scan.tract_hits(derived.reads(spark, d), K, M)


def _elements(spark, d):
    return counts.element_counts(_hits(spark, d))


def _unbiased(spark, d):
    return checkpointed(counts.drop_biased(_elements(spark, d)))


def _located_of(unbiased, spark, d):
    deep = counts.with_depth(unbiased, DEPTH).where("deep").drop("depth", "deep")
    return checkpointed(mapping.located_elements(deep, derived.contigs(spark, d), 15))


def _located(spark, d):
    return _located_of(_unbiased(spark, d), spark, d)


def _simple_concat(spark, d) -> DataFrame:
    """Histograms of exactly mapped contexts; contexts at one place are one tract. The reads are scanned once."""
    place = ["ref_id", "loc_pos", "loc_last", "mismatches", "neg_strand", "location", "multi"]
    unbiased = _unbiased(spark, d)
    e = _located_of(unbiased, spark, d)
    h = counts.length_histograms(e).join(shuffled(e.select(*counts.CONTEXT, *place).distinct()), counts.CONTEXT)
    h = h.withColumn("n_context", F.lit(1)).withColumn("mode_left", F.col("left_ctx")).withColumn("mode_right", F.col("right_ctx")).withColumn("name", dna.context_name("left_ctx", "base", "right_ctx", "neg_strand"))
    return checkpointed(stats.histogram_stats(cluster.numbered(h), counts.sample_coverage(unbiased)))


def _simple_ref(spark, d, c=None) -> DataFrame:
    c = _simple_concat(spark, d) if c is None else c
    return checkpointed(reference.best_reference_tract(reference.tract_borders(c), c, derived.contigs(spark, d), OPTIONS))


def _annotated(spark, d, c=None) -> DataFrame:
    c = (_simple_concat(spark, d) if c is None else c).join(derived.contigs(spark, d).select("ref_id", "contig"), "ref_id").withColumn("position", F.col("loc_pos") + K)
    return annotate.with_feature(c, derived.features(spark, d), ["sample_idx", "location"])


def _simple_variable(spark, d, c=None, ref=None):
    c = _simple_concat(spark, d) if c is None else c
    return stats.variable_tracts(c, _simple_ref(spark, d, c) if ref is None else ref, derived.SAMPLES)


def _pipeline(spark, d) -> TractPipeline:
    return TractPipeline(derived.reads(spark, d), derived.contigs(spark, d), derived.features(spark, d), OPTIONS)


def _contexts(spark, d):
    return _elements(spark, d).select("base", "left_ctx", "right_ctx").distinct()


def _near_pairs(spark, d, of_a=None, of_b=None):
    """Contexts whose codes' sum is divisible by ASKED, each with all others of its base that begin with the same three bases: what distances are asked of.

    A stated query set against all; there are few beginnings, so the others are dealt out by a salt and the asked ones sent to every salt.
    of_a, of_b: further columns of the asked ones and of the others, made once per context and not once per pair.
    """
    c, of_a, of_b = _coded(spark, d), of_a or {}, of_b or {}
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = _asked(c).select("*", *(x.alias(n) for n, x in of_a.items())).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    other = c.select("base", "start", F.col("left_ctx").alias("l2"), F.col("right_ctx").alias("r2"), F.col("lc").alias("lc2"), F.col("rc").alias("rc2"), F.pmod(F.hash("left_ctx", "right_ctx"), F.lit(salts)).alias("salt"), *(x.alias(n) for n, x in of_b.items()))
    return asked.join(other, ["base", "start", "salt"]).where("left_ctx <> l2 or right_ctx <> r2").select("base", "left_ctx", "right_ctx", "l2", "r2", "lc", "rc", "lc2", "rc2", *of_a, *of_b)


def _coded(spark, d):
    """Contexts with the codes of their flanks, lc and rc, made once for all pairs."""
    return checkpointed(_contexts(spark, d).select("*", F.substring("left_ctx", 1, 3).alias("start"), dna.kmer_code("left_ctx").alias("lc"), dna.kmer_code("right_ctx").alias("rc")))


def _asked(coded):
    return coded.where((F.col("lc") + F.col("rc")) % ASKED == 0)


def _near_edits(spark, d, a, b, whole):
    """Edits of the strings a and b of the pairs of _near_pairs()."""
    c = _coded(spark, d)
    each = lambda x, value: x.select("base", "start", (F.col("lc") * 4**K + F.col("rc")).alias("id"), value.alias("value"))
    return similarity.edit_distances(each(_asked(c), a), each(c, b), ["base", "start"], whole)


def ht_scan(spark, d):
    return _hits(spark, d).select("sample_idx", "read_id", "base", "left_ctx", "right_ctx", "length", "read_offset", "canon_flag")


def ht_scan_columns(spark, d):
    return scan.tract_hits_columns(derived.reads(spark, d), K, M).select("sample_idx", "read_id", "base", "left_ctx", "right_ctx", "length", "read_offset", "canon_flag")


def monomer_scan(spark, d):
    return scan.monomer_counts(derived.reads(spark, d), K, ["sample_idx"])


def leftmost_tract(spark, d):
    return _hits(spark, d).groupBy("read_id").agg(F.min_by(F.struct(dna.context_name("left_ctx", "base", "right_ctx").alias("name"), "length"), "read_offset").alias("x")).select("read_id", "x.name", "x.length")


def ht_counts(spark, d):
    return _elements(spark, d)


def strand_bias_filter(spark, d):
    return _unbiased(spark, d)


def keep_bias_filter(spark, d):
    return counts.drop_singletons(_elements(spark, d))


def depth_filter(spark, d):
    return counts.with_depth(_unbiased(spark, d), DEPTH)


def sample_coverage(spark, d):
    return counts.sample_coverage(_unbiased(spark, d))


def length_histogram(spark, d):
    return counts.length_histograms(_unbiased(spark, d)).drop("hist")


def histogram_statistics(spark, d):
    return _simple_concat(spark, d).select("sample_idx", "location", "mean_length", "modal_freq", "prop_coverage", "cov_per_context", "entropy")


def kmer_codes(spark, d):
    return _contexts(spark, d).select("base", "left_ctx", "right_ctx", dna.kmer_code("left_ctx").alias("left_code"), dna.kmer_code("right_ctx").alias("right_code"))


def kmer_hamming(spark, d):
    return _near_pairs(spark, d).select("base", "left_ctx", "right_ctx", "l2", "r2", (dna.code_distance("lc", "lc2") + dna.code_distance("rc", "rc2")).alias("distance"), F.least(dna.code_distance("lc", "lc2"), F.lit(2)).alias("capped"))


def shift_distance(spark, d):
    return _near_pairs(spark, d).select("base", "left_ctx", "right_ctx", "l2", "r2", (dna.code_shift_distance("lc", "lc2", K) + dna.code_shift_distance("rc", "rc2", K)).alias("distance"))


def context_levenshtein(spark, d):
    name = dna.context_name("left_ctx", "base", "right_ctx")
    part = lambda x, at, n: F.substring(x, at, n)
    return _near_edits(spark, d, name, name, True).select(part("a", K + 2, 1).alias("base"), part("a", 1, K).alias("left_ctx"), part("a", K + 4, K).alias("right_ctx"), part("b", 1, K).alias("l2"), part("b", K + 4, K).alias("r2"), "distance")


def common_prefix_suffix(spark, d):
    a, b = (dna.tract_string("left_ctx", "base", "right_ctx", F.lit(n)) for n in (4, 5))
    each = lambda name, s: {name: s, f"{name}_code": dna.kmer_code(s), f"{name}_reverse": dna.kmer_code(F.reverse(s))}
    p = _near_pairs(spark, d, each("a", a), each("b", b))
    codes, reverse_codes = ("a_code", "b_code"), ("a_reverse", "b_reverse")
    return p.select("a", "b", dna.common_prefix("a", "b", codes).alias("prefix"), dna.common_suffix("a", "b", codes, reverse_codes).alias("suffix"))


def pattern_distance(spark, d):
    """Fewest edits of a context against any stretch of the tract of another."""
    return _near_edits(spark, d, F.concat("left_ctx", "base", "right_ctx"), dna.tract_string("left_ctx", "base", "right_ctx", F.lit(5)), False)


def diagonal_scores(spark, d):
    """Spaced words on diagonals of the tracts of the asked contexts and all contexts; a tract is told by its code."""
    c = _contexts(spark, d).where("base = 'A'").select((dna.kmer_code("left_ctx") * 4**K + dna.kmer_code("right_ctx")).alias("id"), dna.tract_string("left_ctx", "base", "right_ctx", F.lit(4)).alias("seq"))
    c = checkpointed(c)
    return similarity.diagonal_scores(c, c.where(F.col("id") % ASKED == 0), 20)


def context_names(spark, d):
    neg = F.col("canon_flag") == 2
    return _elements(spark, d).select("sample_idx", "length", dna.context_name("left_ctx", "base", "right_ctx", neg).alias("name"), dna.tract_string("left_ctx", "base", "right_ctx", "length", neg).alias("tract"))


def revcomp(spark, d):
    return derived.reads(spark, d).select("read_id", dna.revcomp("seq").alias("rc"))


def translate_protein(spark, d):
    return derived.reads(spark, d).select("read_id", dna.translate_protein("seq").alias("protein"), dna.translate_protein("seq", True).alias("reverse_protein"))


def contig_offsets(spark, d):
    return mapping.with_offsets(derived.contigs(spark, d)).select("ref_id", "contig", "len", "flat_offset")


def _queries_of(spark, d):
    e = _unbiased(spark, d).groupBy("base", "left_ctx", "right_ctx").agg(F.max("length").alias("n"))
    return e.select(F.concat("left_ctx", F.repeat("base", F.col("n")), "right_ctx").alias("query"))


def map_exact(spark, d):
    return mapping.locate(_queries_of(spark, d), derived.contigs(spark, d), 15)


def map_edit(spark, d):
    """Best place within one edit of the tract strings that do not occur in the genome."""
    q, c = _queries_of(spark, d), derived.contigs(spark, d)
    new = q.join(shuffled(mapping.locate(q, c, 15).select("query")), "query", "left_anti")
    return mapping.best_match(mapping.locate(new, c, 9, 1), c).select("query", "mismatches", "location", "neg_strand", "loc_last")


def _changed(query):
    """query with two edits: its third base replaced by the next of ACGT, and its last but three taken out."""
    n = F.length(query)
    return F.concat(F.substring(query, F.lit(1), F.lit(2)), F.translate(F.substring(query, F.lit(3), F.lit(1)), "ACGT", "CGTA"), F.substring(query, F.lit(4), n - 7), F.substring(query, n - 2, F.lit(3)))


def map_edits(spark, d):
    """All places within two edits of the tract strings of all contexts, each changed by two edits."""
    q = _queries_of(spark, d).select(_changed(F.col("query")).alias("query"))
    return mapping.locate(q, derived.contigs(spark, d), 6, 2)


def leftmost_match(spark, d):
    """Of the places of map_edits the one that stays in compat: the leftmost, however many edits it has."""
    q, c = _queries_of(spark, d).select(_changed(F.col("query")).alias("query")), derived.contigs(spark, d)
    return mapping.leftmost_match(mapping.locate(q, c, 6, 2), c).select("query", "location", "mismatches", "neg_strand", "loc_last", "multi")


def best_match(spark, d):
    return _located(spark, d).select(*counts.CONTEXT, "length", "location", "loc_pos", "loc_last", "mismatches", "neg_strand", "multi")


def feature_lookup(spark, d):
    p = _simple_concat(spark, d).join(derived.contigs(spark, d).select("ref_id", "contig"), "ref_id").select("contig", (F.col("loc_pos") + K).alias("position")).distinct()
    return annotate.feature_hits(p, derived.features(spark, d)).select("contig", "position", "type", "start", "end", "feature_id")


def feature_priority(spark, d):
    return _annotated(spark, d).select("sample_idx", "location", "feature_type", "feature_id")


def sample_union_order(spark, d):
    return _simple_concat(spark, d).select("concat_idx", "sample_idx", "location", "tract_id")


def tract_reference_borders(spark, d):
    return reference.tract_borders(_simple_concat(spark, d))


def best_reference_ht(spark, d):
    return _simple_ref(spark, d).select("tract_id", "tract_length", "ht_location", "ref_tract")


def next_ht(spark, d):
    return reference.next_locations(_simple_ref(spark, d))


def variable_tracts(spark, d):
    return _simple_variable(spark, d)


def tract_spread(spark, d):
    return stats.tract_spread(_simple_concat(spark, d))


def selected_tracts(spark, d):
    c = _simple_concat(spark, d)
    return stats.selected_tracts(stats.tract_spread(c), c.groupBy("tract_id").agg(F.lit(0).alias("lev_distance")), derived.SAMPLES).select("tract_id", "n_hist")


def pairwise_histogram_distance(spark, d):
    return stats.pairwise_distances(_simple_concat(spark, d))


def pivot_average_length(spark, d):
    return report.matrix(stats.last_of_sample(_simple_concat(spark, d)), "mean_length", SAMPLES)


def pivot_modal_frequency(spark, d):
    return report.matrix(stats.last_of_sample(_simple_concat(spark, d)), "modal_freq", SAMPLES)


def pivot_prop_coverage(spark, d):
    return report.matrix(stats.last_of_sample(_simple_concat(spark, d)), "prop_coverage", SAMPLES)


def bed(spark, d):
    c = _simple_concat(spark, d)
    ref = _simple_ref(spark, d, c)
    return report.bed(ref, derived.contigs(spark, d), _simple_variable(spark, d, c, ref), K)


def tract_list(spark, d):
    c = _simple_concat(spark, d)
    return report.tract_list(_simple_ref(spark, d, c), _annotated(spark, d, c), derived.contigs(spark, d))


def context_differs_from_ref(spark, d):
    """Tracts of the whole run, places within one edit, whose context is not that of the reference."""
    return _pipeline(spark, d).tract_list.where("tract <> ref_tract").select("tract_id", "tract", "ref_tract")


def frameshift_proxy(spark, d):
    return report.frameshift_counts(tract_list(spark, d))


def mapping_counts(spark, d):
    """Contexts and elements of each sample that are found on the reference, and those that are not."""
    e = _unbiased(spark, d)
    return mapping.mapping_counts(e, _located_of(e, spark, d))


def tract_by_id(spark, d):
    """The matrices' rows of the tracts of the tract list: average length, modal frequency and list entry side by side."""
    c = _simple_concat(spark, d)
    own = stats.last_of_sample(c).select(F.format_string("tid_%06d", F.col("tract_id").cast("long")).alias("tract_id"), "sample_idx", "mean_length", "modal_freq")
    listed = report.tract_list(_simple_ref(spark, d, c), _annotated(spark, d, c), derived.contigs(spark, d))
    return listed.join(shuffled(own), "tract_id").select("tract_id", "contig_name", "location_in_contig", "feature", "sample_idx", "mean_length", "modal_freq")


def tracts_per_report(spark, d):
    """Tracts in the list, and variable ones (rows of the BED file), of each contig."""
    c = _simple_concat(spark, d)
    ref = _simple_ref(spark, d, c)
    v = _simple_variable(spark, d, c, ref)
    return ref.join(shuffled(v), "tract_id").join(derived.contigs(spark, d).select("ref_id", "contig"), "ref_id").groupBy("contig").agg(F.count("*").alias("listed"), F.sum(F.col("variable").cast("long")).alias("variable"))


def tract_samples(spark, d):
    """The samples that have each tract."""
    return report.tract_samples(_simple_concat(spark, d))


def context_evidence(spark, d):
    """Contexts behind every tract with the counts of each length, joined to the matrices' values of their tract and sample."""
    c = _simple_concat(spark, d)
    values = stats.last_of_sample(c).select("tract_id", "sample_idx", "n_hist", F.col("mean_length").alias("tract_length"), F.col("modal_freq").alias("tract_freq"), F.col("prop_coverage").alias("tract_coverage"))
    return c.select("tract_id", "sample_idx", "name", "n_lengths", "integral", "mode_length", "mode_count", "mean_length").join(shuffled(values), ["tract_id", "sample_idx"])


def cluster_contexts(spark, d):
    return cluster.cluster_contexts(_pipeline(spark, d).located, OPTIONS).select("sample_idx", "location", "name", "n_context", "integral", "mode_length", "indel")


def merge_histograms(spark, d):
    return _pipeline(spark, d).histograms.select("sample_idx", "location", "name", "n_context", "integral", "mode_length", "feature_type", "feature_id")


def assign_tracts(spark, d):
    return cluster.assign_tracts(_pipeline(spark, d).histograms, OPTIONS).select("sample_idx", "location", "concat_idx", "tract_id", "lev")


def run_variable_tracts(spark, d):
    return _pipeline(spark, d).variable


def run_selected_tracts(spark, d):
    return _pipeline(spark, d).selected


def run_average_length(spark, d):
    return _pipeline(spark, d).matrix()


def vcf_rows(spark, d):
    return _pipeline(spark, d).vcf


def vcf_concat_distinct(spark, d):
    return report.distinct_variants(_pipeline(spark, d).vcf)


def vcf_multi_sample(spark, d):
    return report.multi_sample(_pipeline(spark, d).vcf, SAMPLES)


def euclidean_distance(spark, d):
    """Distance of every vector whose id is divisible by 50 to all vectors."""
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("value"))
    return similarity.vector_distances(e.where("id % 50 = 0"), e)


_NOT_QUERIES = {"queries", "oracle_sql"}


def queries():
    return {k: f for k, f in globals().items() if callable(f) and getattr(f, "__module__", "") == __name__ and not k.startswith("_") and k not in _NOT_QUERIES}


def _code(c: str) -> str:
    return "(" + " + ".join(f"(strpos('ACGT', substr({c}, {i + 1}, 1)) - 1) * {4**i}" for i in range(K)) + ")"


_FIXTURE = f"""
contigs AS (
  SELECT CAST(p_partkey // {derived.CONTIG_KEYS} AS INT) AS ref_id, 'contig' || CAST(p_partkey // {derived.CONTIG_KEYS} AS VARCHAR) AS contig,
         string_agg(translate(md5(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY p_partkey) AS seq
  FROM part GROUP BY 1, 2),
offsets AS (SELECT ref_id, contig, seq, length(seq) AS len, CAST(coalesce(sum(length(seq)) OVER (ORDER BY ref_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS flat_offset FROM contigs),
features AS (
  SELECT contig, CASE i % 3 WHEN 0 THEN 'CDS' WHEN 1 THEN 'gene' ELSE 'region' END AS type, CAST(i * 150 + 1 AS INT) AS start, CAST(i * 150 + 220 AS INT) AS "end", 'f' || i AS feature_id
  FROM (SELECT contig, unnest(range(0, length(seq) // 150 + 1)) AS i FROM contigs)),
pieces AS (
  SELECT CAST(user_id % {derived.SAMPLES} AS INT) AS sample_idx, event_id AS read_id, substr(seq, CAST(event_id * 37 % (length(seq) - {derived.READ}) + 1 AS BIGINT), {derived.READ}) AS r
  FROM events JOIN contigs ON ref_id = (event_id // 2) % (SELECT max(ref_id) + 1 FROM contigs) AND length(seq) > {derived.READ}),
changed AS (SELECT sample_idx, read_id, CASE sample_idx WHEN 1 THEN replace(r, 'CAAAG', 'CAAAAG') WHEN 2 THEN replace(r, 'GTTTA', 'GTTTTTA') ELSE r END AS r FROM pieces),
reads AS (SELECT sample_idx, read_id, CASE WHEN read_id % 2 = 0 THEN r ELSE reverse(translate(r, 'ACGT', 'TGCA')) END AS seq FROM changed)"""

_RUNS = f"""{_FIXTURE},
places AS (SELECT sample_idx, read_id, seq, unnest(range(1, length(seq) + 1)) AS i FROM reads),
starts AS (SELECT * FROM places WHERE i = 1 OR substr(seq, i, 1) <> substr(seq, i - 1, 1)),
runs AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY read_id ORDER BY i), length(seq) + 1) - i AS n FROM starts),
flanked AS (SELECT *, substr(seq, i, 1) AS c, substr(seq, i - {K}, {K}) AS l, substr(seq, i + n, {K}) AS r FROM runs WHERE i > {K} AND i - 1 + n + {K} <= length(seq)),
canon AS (
  SELECT sample_idx, read_id, CAST(n AS INT) AS length, CAST(i - 1 - {K} AS INT) AS read_offset, CASE WHEN c IN ('A', 'C') THEN 1 ELSE 2 END AS canon_flag,
         CASE WHEN c IN ('A', 'C') THEN c ELSE translate(c, 'TG', 'AC') END AS base,
         CASE WHEN c IN ('A', 'C') THEN l ELSE reverse(translate(r, 'ACGT', 'TGCA')) END AS left_ctx,
         CASE WHEN c IN ('A', 'C') THEN r ELSE reverse(translate(l, 'ACGT', 'TGCA')) END AS right_ctx FROM flanked)"""

_COUNTS = f"""{_RUNS},
hits AS (SELECT * FROM canon WHERE length >= {M}),
elements AS (SELECT sample_idx, base, left_ctx, right_ctx, length, count(*) AS count, bit_or(canon_flag) AS canon_flag FROM hits GROUP BY ALL),
unbiased AS (SELECT * FROM elements WHERE canon_flag = 3),
depths AS (SELECT *, CAST(sum(count) OVER (PARTITION BY sample_idx, base, left_ctx, right_ctx) AS BIGINT) AS depth FROM unbiased),
coverage AS (SELECT sample_idx, max(n) AS coverage FROM (
  SELECT sample_idx, k, CAST(sum(count) AS BIGINT) AS n FROM (SELECT sample_idx, substr(left_ctx, 1, 15) AS k, count FROM unbiased UNION ALL SELECT sample_idx, substr(right_ctx, 1, 15), count FROM unbiased) GROUP BY 1, 2) GROUP BY 1),
pool AS (SELECT DISTINCT base, left_ctx, right_ctx FROM elements),
near_pairs AS (
  SELECT a.base, a.left_ctx, a.right_ctx, b.left_ctx AS l2, b.right_ctx AS r2 FROM pool a JOIN pool b ON a.base = b.base AND substr(a.left_ctx, 1, 3) = substr(b.left_ctx, 1, 3) AND (a.left_ctx <> b.left_ctx OR a.right_ctx <> b.right_ctx)
  WHERE ({_code("a.left_ctx")} + {_code("a.right_ctx")}) % {ASKED} = 0)"""

_PLACES = f"""{_COUNTS},
asked AS (SELECT * EXCLUDE (m), left_ctx || repeat(base, m) || right_ctx AS query FROM (SELECT sample_idx, base, left_ctx, right_ctx, max(length) AS m FROM depths WHERE depth >= {DEPTH} GROUP BY ALL)),
wanted AS (SELECT DISTINCT left_ctx || repeat(base, m) || right_ctx AS query FROM (SELECT base, left_ctx, right_ctx, max(length) AS m FROM unbiased GROUP BY ALL)),
every AS (SELECT query FROM asked UNION SELECT query FROM wanted),
sizes AS (SELECT DISTINCT length(query) AS n FROM every),
stretches AS (SELECT ref_id, flat_offset, p, n, substr(seq, p + 1, n) AS s FROM (SELECT ref_id, flat_offset, seq, n, unnest(range(0, len - n + 1)) AS p FROM offsets, sizes)),
places_ AS (
  SELECT query, ref_id, CAST(p AS INT) AS loc_pos, CAST(p + n - 1 AS INT) AS loc_last, 0 AS mismatches, false AS neg_strand, flat_offset + p AS location FROM every JOIN stretches ON s = query
  UNION ALL SELECT query, ref_id, p, p + n - 1, 0, true, flat_offset + p FROM every JOIN stretches ON s = reverse(translate(query, 'ACGT', 'TGCA'))),
firsts AS (SELECT *, count(DISTINCT location) OVER (PARTITION BY query) > 1 AS multi, row_number() OVER (PARTITION BY query ORDER BY location, neg_strand) AS nth FROM places_),
located AS (SELECT d.*, ref_id, loc_pos, loc_last, mismatches, neg_strand, location, multi FROM depths d JOIN asked USING (sample_idx, base, left_ctx, right_ctx) JOIN firsts USING (query) WHERE nth = 1 AND depth >= {DEPTH})"""

_STAT = f"""
hist AS (
  SELECT sample_idx, base, left_ctx, right_ctx, ref_id, loc_pos, loc_last, neg_strand, location, CAST(sum(count) AS BIGINT) AS integral, count(*) AS n_lengths, max(count) AS mode_count,
         arg_min(length, -count * 1000 + length) AS mode_length, sum(length * count) / sum(count) AS mean_length, list({{'l': length, 'n': count}} ORDER BY count DESC, length) AS modes FROM located GROUP BY ALL),
stat AS (
  SELECT h.*, mode_count / integral AS modal_freq, integral / coverage AS prop_coverage, CAST(integral AS DOUBLE) AS cov_per_context,
         -list_sum(list_transform(modes, lambda x: (x.n / integral) * ln(x.n / integral))) AS entropy,
         CASE WHEN neg_strand THEN reverse(translate(right_ctx, 'ACGT', 'TGCA')) || '.' || translate(base, 'ACGT', 'TGCA') || '.' || reverse(translate(left_ctx, 'ACGT', 'TGCA')) ELSE left_ctx || '.' || base || '.' || right_ctx END AS name,
         dense_rank() OVER (ORDER BY location) - 1 AS tract_id, row_number() OVER (ORDER BY location, h.sample_idx DESC) - 1 AS concat_idx
  FROM hist h JOIN coverage USING (sample_idx))"""

_TRACTS = f"""
spread AS (
  SELECT tract_id, count(*) AS n_hist, max(mean_length) - min(mean_length) AS rd_mean_length, max(modal_freq) - min(modal_freq) AS rd_modal_freq, max(prop_coverage) - min(prop_coverage) AS rd_prop_coverage,
         max(cov_per_context) - min(cov_per_context) AS rd_cov_per_context, max(entropy) - min(entropy) AS rd_entropy FROM stat GROUP BY 1),
borders AS (
  SELECT tract_id, arg_min(ref_id, concat_idx) AS ref_id, min(loc_pos) AS border_lo, max(loc_last) AS border_hi, max(mode_length) AS max_length, 0 AS best_nm, min(concat_idx) AS exemplar_concat_idx FROM stat GROUP BY 1),
pointed AS (SELECT s.*, contig, loc_pos + {K} AS position FROM stat s JOIN contigs USING (ref_id)),
inside AS (SELECT DISTINCT p.contig, p.position, f.type, f.start, f."end", f.feature_id FROM pointed p JOIN features f ON f.contig = p.contig AND p.position BETWEEN f.start AND f."end"),
best_f AS (SELECT contig, position, arg_max(type, o) AS feature_type, arg_max(feature_id, o) AS feature_id FROM (SELECT *, CASE WHEN type = 'CDS' THEN 1000000 - start ELSE start / 1000000.0 END AS o FROM inside WHERE type <> 'region') GROUP BY 1, 2)"""

_MAPPED = f"{_PLACES},{_STAT},{_TRACTS}"

# the reference's own runs, single bases included, and their distance to the exemplar's flanks
_CANDIDATES = f"""
ref_places AS (SELECT ref_id, seq, len, unnest(range(1, len + 1)) AS i FROM offsets),
ref_starts AS (SELECT * FROM ref_places WHERE i = 1 OR substr(seq, i, 1) <> substr(seq, i - 1, 1)),
ref_runs AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY ref_id ORDER BY i), len + 1) - i AS n FROM ref_starts),
windows AS (
  SELECT b.*, s.base AS h_base, s.neg_strand AS h_neg, s.left_ctx AS h_l, s.right_ctx AS h_r, greatest(0, border_lo - {M + 3}) AS w0, least(border_hi - border_lo + {2 * (M + 3)}, len - greatest(0, border_lo - {M + 3})) AS wn
  FROM borders b JOIN stat s ON s.concat_idx = b.exemplar_concat_idx JOIN offsets o ON o.ref_id = b.ref_id),
cut_runs AS (
  SELECT w.*, r.seq, greatest(r.i - 1, w0) AS a, least(r.i - 1 + r.n, w0 + wn) AS z FROM windows w JOIN ref_runs r ON r.ref_id = w.ref_id AND r.i - 1 < w0 + wn AND r.i - 1 + r.n > w0),
cand AS (
  SELECT *, substr(seq, a + 1, 1) AS c, substr(seq, a - {K} + 1, {K}) AS l, substr(seq, z + 1, {K}) AS r FROM cut_runs WHERE a - w0 >= {K} AND z + {K} <= w0 + wn),
cand2 AS (
  SELECT *, CASE WHEN c IN ('A', 'C') THEN c ELSE translate(c, 'TG', 'AC') END AS cb, c NOT IN ('A', 'C') AS cn,
         CASE WHEN c IN ('A', 'C') THEN l ELSE reverse(translate(r, 'ACGT', 'TGCA')) END AS cl, CASE WHEN c IN ('A', 'C') THEN r ELSE reverse(translate(l, 'ACGT', 'TGCA')) END AS cr FROM cand),
cand3 AS (SELECT *, CASE WHEN cb = h_base AND cn = h_neg THEN {{shift}} ELSE 16777215 END AS d FROM cand2),
chosen AS (SELECT *, row_number() OVER (PARTITION BY tract_id ORDER BY d, CASE WHEN z - a = 1 THEN 1 ELSE 0 END, a) AS nth FROM cand3),
ref_ht AS (SELECT tract_id, ref_id, border_lo, border_hi, max_length, exemplar_concat_idx, CAST(z - a AS INT) AS tract_length, CAST(a AS INT) AS ht_location, l || '.' || c || '.' || r AS ref_tract FROM chosen WHERE nth = 1),
variable AS (
  SELECT tract_id, count(*) < {derived.SAMPLES} OR (max(mean_length) - CASE WHEN count(*) < {derived.SAMPLES} THEN 0 ELSE min(mean_length) END) + (max(modal_freq) - CASE WHEN count(*) < {derived.SAMPLES} THEN 0 ELSE min(modal_freq) END)
         + (max(entropy) - CASE WHEN count(*) < {derived.SAMPLES} THEN 0 ELSE min(entropy) END) > 1e-5 OR bool_or(mode_length <> tract_length) AS variable
  FROM stat JOIN ref_ht USING (tract_id) GROUP BY 1),
tract_list AS (
  SELECT printf('tid_%06d', r.tract_id) AS tract_id, contig AS contig_name, coalesce(feature_type, 'nc') AS feature_type, coalesce(feature_id, 'unannotated') AS feature, ht_location AS location_in_contig,
         max_length AS max_tract_length, tract_length AS ref_tract_length, name AS tract, ref_tract
  FROM ref_ht r JOIN pointed p ON p.concat_idx = r.exemplar_concat_idx LEFT JOIN best_f USING (contig, position))"""


_REF = f"{_MAPPED},{_CANDIDATES}"

# the whole run: places within one edit, then the folds; what follows is asked of merged histograms
_CONTEXTS = f"{_PLACES},{cluster_sql.located(DEPTH)},{cluster_sql.contexts(K, OPTIONS)}"
_FOLDED = f"{_CONTEXTS},{cluster_sql.merged(OPTIONS)},{cluster_sql.tracts(OPTIONS)},{cluster_sql.STAT},{_TRACTS}".replace(
    "0 AS best_nm, min(concat_idx) AS exemplar_concat_idx", "min(mismatches) AS best_nm, arg_min(concat_idx, mismatches * 1000000000 + concat_idx) AS exemplar_concat_idx"
)
_RUN = f"{_FOLDED},{_CANDIDATES.replace('ref_ht AS', 'some_ht AS').replace('variable AS', 'other_variable AS').replace('FROM stat JOIN ref_ht', 'FROM stat JOIN some_ht').replace('FROM ref_ht', 'FROM some_ht')},{cluster_sql.run(derived.SAMPLES)}"


def _ham(a: str, b: str, n: int = K) -> str:
    return "(" + " + ".join(f"CASE WHEN substr({a}, {i}, 1) = substr({b}, {i}, 1) THEN 0 ELSE 1 END" for i in range(1, n + 1)) + ")"


def _shift(a: str, b: str) -> str:
    moved = [f"{s} + {_ham(f'substr({x}, {s + 1})', y, K - s)}" for x, y in ((a, b), (b, a)) for s in (1, 2, 3)]
    return f"least({', '.join([_ham(a, b), *moved])})"


def _lcp(a: str, b: str) -> str:
    return f"coalesce(list_min(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: substr({a}, i, 1) <> substr({b}, i, 1))) - 1, least(length({a}), length({b})))"


def _protein(s: str) -> str:
    codons = ", ".join(f"'{k}': '{v}'" for k, v in sorted(dna.CODONS.items()))
    return f"array_to_string(list_transform(range(0, length({s}) // 3), lambda i: coalesce(MAP {{{codons}}}[substr({s}, i * 3 + 1, 3)], 'X')), '')"


def oracle_sql():
    ref, run = (x.replace("{shift}", f"{_shift('cl', 'h_l')} + {_shift('cr', 'h_r')}") for x in (_REF, _RUN))
    vcf = f"WITH RECURSIVE {run}, {cluster_sql.variants(K, _lcp)}"
    hit = "sample_idx, read_id, base, left_ctx, right_ctx, length, read_offset, canon_flag"
    code = _code
    pivot = lambda v: f"WITH {_MAPPED} SELECT tract_id, " + ", ".join(f"max(CASE WHEN sample_idx = {s} AND {v} > 0 THEN {v} END) AS sample_{s}" for s in SAMPLES) + " FROM stat GROUP BY 1"
    a4, b5 = "(left_ctx || repeat(base, 4) || right_ctx)", "(l2 || repeat(base, 5) || r2)"
    rank = "least(length(a.modes), length(b.modes))"
    d1 = f"list_sum(list_transform(range(1, {rank} + 1), lambda i: (1 + abs(a.modes[i].l - b.modes[i].l)) * abs(a.modes[i].n / a.integral - b.modes[i].n / b.integral)))"
    rc = "reverse(translate(seq, 'ACGT', 'TGCA'))"
    edits = f"""WITH {_PLACES},
        altered AS (SELECT DISTINCT substr(query, 1, 2) || translate(substr(query, 3, 1), 'ACGT', 'CGTA') || substr(query, 4, length(query) - 7) || right(query, 3) AS query FROM wanted),
        turned AS (SELECT query, query AS s, false AS neg FROM altered UNION ALL SELECT query, {rc.replace("seq", "query")}, true FROM altered),
        thirds AS (SELECT *, i * (length(s) // 3) AS off, CASE WHEN i = 2 THEN length(s) - 2 * (length(s) // 3) ELSE length(s) // 3 END AS m FROM (SELECT *, unnest([0, 1, 2]) AS i FROM turned)),
        lengths AS (SELECT DISTINCT m FROM thirds),
        spans AS (SELECT ref_id, p, m, substr(seq, p + 1, m) AS piece FROM (SELECT ref_id, seq, m, unnest(range(0, len - m + 1)) AS p FROM offsets, lengths)),
        around AS (SELECT DISTINCT query, s, neg, ref_id, p - off + d AS p FROM (SELECT t.*, ref_id, p, unnest([-2, -1, 0, 1, 2]) AS d FROM thirds t JOIN spans ON spans.m = t.m AND piece = substr(s, off + 1, t.m))),
        tried AS (SELECT a.*, e, substr(seq, p + 1, length(s) + e) AS g FROM (SELECT *, unnest([-2, -1, 0, 1, 2]) AS e FROM around WHERE p >= 0) a JOIN contigs USING (ref_id) WHERE p + length(s) + e <= length(seq)),
        places2 AS (SELECT query, ref_id, CAST(p AS INT) AS loc_pos, CAST(p + length(g) - 1 AS INT) AS loc_last, CAST(levenshtein(s, g) AS INT) AS mismatches, neg AS neg_strand FROM tried WHERE levenshtein(s, g) <= 2)"""
    return {
        "ht_scan": f"WITH {_COUNTS} SELECT {hit} FROM hits",
        "ht_scan_columns": f"WITH {_COUNTS} SELECT {hit} FROM hits",
        "monomer_scan": f"WITH {_RUNS} SELECT sample_idx, base, left_ctx, right_ctx, count(*) AS n, bit_or(canon_flag) AS canon_flag FROM canon WHERE length = 1 GROUP BY ALL",
        "leftmost_tract": f"WITH {_COUNTS} SELECT read_id, arg_min(left_ctx || '.' || base || '.' || right_ctx, read_offset) AS name, arg_min(length, read_offset) AS length FROM hits GROUP BY 1",
        "ht_counts": f"WITH {_COUNTS} SELECT * FROM elements",
        "strand_bias_filter": f"WITH {_COUNTS} SELECT * FROM unbiased",
        "keep_bias_filter": f"WITH {_COUNTS} SELECT * FROM elements WHERE count > 1",
        "depth_filter": f"WITH {_COUNTS} SELECT *, depth >= {DEPTH} AS deep FROM depths",
        "sample_coverage": f"WITH {_COUNTS} SELECT * FROM coverage",
        "length_histogram": f"WITH {_COUNTS} SELECT sample_idx, base, left_ctx, right_ctx, CAST(sum(count) AS BIGINT) AS integral, count(*) AS n_lengths, arg_min(length, -count * 1000 + length) AS mode_length, max(count) AS mode_count FROM unbiased GROUP BY ALL",
        "histogram_statistics": f"WITH {_MAPPED} SELECT sample_idx, location, mean_length, modal_freq, prop_coverage, cov_per_context, entropy FROM stat",
        "kmer_codes": f"WITH {_COUNTS} SELECT base, left_ctx, right_ctx, CAST({code('left_ctx')} AS BIGINT) AS left_code, CAST({code('right_ctx')} AS BIGINT) AS right_code FROM pool",
        "kmer_hamming": f"WITH {_COUNTS} SELECT *, {_ham('left_ctx', 'l2')} + {_ham('right_ctx', 'r2')} AS distance, least(2, {_ham('left_ctx', 'l2')}) AS capped FROM near_pairs",
        "shift_distance": f"WITH {_COUNTS} SELECT *, {_shift('left_ctx', 'l2')} + {_shift('right_ctx', 'r2')} AS distance FROM near_pairs",
        "context_levenshtein": f"WITH {_COUNTS} SELECT *, levenshtein(left_ctx || '.' || base || '.' || right_ctx, l2 || '.' || base || '.' || r2) AS distance FROM near_pairs",
        "common_prefix_suffix": f"WITH {_COUNTS}, p AS (SELECT {a4} AS a, {b5} AS b FROM near_pairs), q AS (SELECT *, reverse(a) AS ra, reverse(b) AS rb FROM p) SELECT a, b, CAST({_lcp('a', 'b')} AS INT) AS prefix, CAST(least({_lcp('ra', 'rb')}, least(length(a), length(b)) - {_lcp('a', 'b')}) AS INT) AS suffix FROM q",
        "pattern_distance": f"""WITH {_COUNTS}, p AS (SELECT left_ctx || base || right_ctx AS a, {b5} AS b, row_number() OVER () AS r FROM near_pairs),
            w AS (SELECT r, a, b, i, unnest(range(0, length(b) - i + 2)) AS n FROM (SELECT *, unnest(range(1, length(b) + 1)) AS i FROM p))
            SELECT a, b, CAST(min(levenshtein(a, substr(b, i, n))) AS INT) AS distance FROM w GROUP BY r, a, b""",
        "diagonal_scores": f"""WITH {_COUNTS}, s AS (SELECT {_code("left_ctx")}::BIGINT * {4**K} + {_code("right_ctx")} AS id, {a4} AS seq FROM pool WHERE base = 'A'),
            w AS (SELECT id, i, unnest([{", ".join(" || ".join(f"substr(seq, i + {o}, 1)" for o in mask) for mask in similarity.SPACED)}]) AS word FROM (SELECT *, unnest(range(1, length(seq) - 4)) AS i FROM s)),
            g AS (SELECT a.id AS asked_id, b.id, a.i - b.i AS diagonal, count(*) AS n FROM w a JOIN w b USING (word) WHERE a.id % {ASKED} = 0 GROUP BY 1, 2, 3)
            SELECT asked_id, id, CAST(sum(n) AS BIGINT) AS score FROM g WHERE n > 20 GROUP BY 1, 2""",
        "context_names": f"WITH {_COUNTS}, e AS (SELECT *, canon_flag = 2 AS neg, left_ctx || repeat(base, length) || right_ctx AS t FROM elements) SELECT sample_idx, length, CASE WHEN neg THEN reverse(translate(right_ctx, 'ACGT', 'TGCA')) || '.' || translate(base, 'ACGT', 'TGCA') || '.' || reverse(translate(left_ctx, 'ACGT', 'TGCA')) ELSE left_ctx || '.' || base || '.' || right_ctx END AS name, CASE WHEN neg THEN reverse(translate(t, 'ACGT', 'TGCA')) ELSE t END AS tract FROM e",
        "revcomp": f"WITH {_FIXTURE} SELECT read_id, {rc} AS rc FROM reads",
        "translate_protein": f"WITH {_FIXTURE}, t AS (SELECT read_id, seq, {rc} AS back FROM reads) SELECT read_id, {_protein('seq')} AS protein, {_protein('back')} AS reverse_protein FROM t",
        "contig_offsets": f"WITH {_FIXTURE} SELECT ref_id, contig, len, flat_offset FROM offsets",
        "map_exact": f"WITH {_MAPPED} SELECT query, ref_id, loc_pos, loc_last, mismatches, neg_strand FROM places_ WHERE query IN (SELECT query FROM wanted)",
        "map_edit": f"""WITH {_MAPPED}, fresh AS (SELECT query FROM wanted WHERE query NOT IN (SELECT query FROM places_)),
            sides AS (SELECT query, query AS s, false AS neg FROM fresh UNION ALL SELECT query, reverse(translate(query, 'ACGT', 'TGCA')), true FROM fresh),
            spots AS (SELECT query, s, neg, flat_offset + p AS location, p + m - 1 AS loc_last, substr(seq, p + 1, m) AS g FROM (SELECT *, unnest(range(0, len - m + 1)) AS p FROM (SELECT query, s, neg, ref_id, flat_offset, seq, len, unnest([length(s) - 1, length(s), length(s) + 1]) AS m FROM sides, offsets))),
            ok AS (SELECT *, levenshtein(s, g) AS nm FROM spots WHERE levenshtein(s, g) <= 1)
            SELECT query, nm AS mismatches, location, neg AS neg_strand, CAST(loc_last AS INT) AS loc_last FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY nm, location, neg, loc_last) AS nth FROM ok) WHERE nth = 1""",
        "map_edits": f"{edits} SELECT * FROM places2",
        "leftmost_match": f"""{edits}, x AS (SELECT query, mismatches, neg_strand, loc_last, flat_offset + loc_pos AS location FROM places2 JOIN offsets USING (ref_id)),
            y AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY location, mismatches, neg_strand, loc_last) AS nth, first(location) OVER (PARTITION BY query ORDER BY mismatches, location ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best FROM x)
            SELECT query, location, mismatches, neg_strand, loc_last, best <> location AS multi FROM y WHERE nth = 1""",
        "best_match": f"WITH {_MAPPED} SELECT sample_idx, base, left_ctx, right_ctx, length, location, loc_pos, loc_last, mismatches, neg_strand, multi FROM located",
        "feature_lookup": f"WITH {_MAPPED} SELECT * FROM inside",
        "feature_priority": f"WITH {_MAPPED} SELECT sample_idx, location, feature_type, feature_id FROM pointed LEFT JOIN best_f USING (contig, position)",
        "sample_union_order": f"WITH {_MAPPED} SELECT concat_idx, sample_idx, location, tract_id FROM stat",
        "tract_reference_borders": f"WITH {_MAPPED} SELECT * FROM borders",
        "best_reference_ht": f"WITH {ref} SELECT tract_id, tract_length, ht_location, ref_tract FROM ref_ht",
        "next_ht": f"WITH {ref} SELECT a.tract_id, arg_min(b.ht_location, b.tract_id) AS next_ht FROM ref_ht a LEFT JOIN ref_ht b ON a.ref_id = b.ref_id AND b.tract_id > a.tract_id AND b.ht_location <> a.ht_location GROUP BY 1",
        "variable_tracts": f"WITH {ref} SELECT * FROM variable",
        "tract_spread": f"WITH {_MAPPED} SELECT * FROM spread",
        "selected_tracts": f"WITH {_MAPPED} SELECT tract_id, n_hist FROM spread WHERE n_hist < {derived.SAMPLES} OR greatest(rd_modal_freq, rd_mean_length, rd_entropy) > 1e-6",
        "mapping_counts": f"""WITH {_MAPPED}, c AS (SELECT sample_idx, base, left_ctx, right_ctx, count(*) AS n, bool_or(EXISTS (SELECT 1 FROM located l WHERE l.sample_idx = u.sample_idx AND l.base = u.base AND l.left_ctx = u.left_ctx AND l.right_ctx = u.right_ctx)) AS found FROM unbiased u GROUP BY 1, 2, 3, 4)
            SELECT sample_idx, count(*) FILTER (found) AS contexts_found, count(*) FILTER (NOT found) AS contexts_not_found, CAST(coalesce(sum(n) FILTER (found), 0) AS BIGINT) AS elements_found, CAST(coalesce(sum(n) FILTER (NOT found), 0) AS BIGINT) AS elements_not_found FROM c GROUP BY 1""",
        "tract_by_id": f"WITH {ref} SELECT t.tract_id, contig_name, location_in_contig, feature, sample_idx, arg_max(mean_length, concat_idx) AS mean_length, arg_max(modal_freq, concat_idx) AS modal_freq FROM tract_list t JOIN stat s ON t.tract_id = printf('tid_%06d', s.tract_id) GROUP BY ALL",
        "tracts_per_report": f"WITH {ref} SELECT contig, count(*) AS listed, CAST(sum(CASE WHEN variable THEN 1 ELSE 0 END) AS BIGINT) AS variable FROM ref_ht JOIN variable USING (tract_id) JOIN contigs USING (ref_id) GROUP BY 1",
        "tract_samples": f"WITH {_MAPPED} SELECT tract_id, count(*) AS n_samples, string_agg(CAST(sample_idx AS VARCHAR), ',' ORDER BY sample_idx) AS samples FROM (SELECT DISTINCT tract_id, sample_idx FROM stat) GROUP BY 1",
        "context_evidence": f"""WITH {_MAPPED}, each AS (SELECT tract_id, sample_idx, count(*) AS n_hist, arg_max(mean_length, location) AS tract_length, arg_max(modal_freq, location) AS tract_freq, arg_max(prop_coverage, location) AS tract_coverage FROM stat GROUP BY 1, 2)
            SELECT tract_id, sample_idx, name, n_lengths, integral, mode_length, mode_count, mean_length, n_hist, tract_length, tract_freq, tract_coverage FROM stat JOIN each USING (tract_id, sample_idx)""",
        "pairwise_histogram_distance": f"WITH {_MAPPED} SELECT a.tract_id, a.concat_idx AS a, b.concat_idx AS b, {d1} AS d1, pow(a.mean_length - b.mean_length, 2) AS d2 FROM stat a JOIN stat b ON a.tract_id = b.tract_id AND a.concat_idx < b.concat_idx",
        "pivot_average_length": pivot("mean_length"),
        "pivot_modal_frequency": pivot("modal_freq"),
        "pivot_prop_coverage": pivot("prop_coverage"),
        "bed": f"WITH {ref} SELECT contig, border_lo + {K} AS start, border_hi - {K} + 1 AS \"end\", printf('tid_%06d', tract_id) AS label FROM ref_ht JOIN variable USING (tract_id) JOIN contigs USING (ref_id) WHERE variable",
        "tract_list": f"WITH {ref} SELECT * FROM tract_list",
        "context_differs_from_ref": f"WITH RECURSIVE {run} SELECT printf('tid_%06d', r.tract_id) AS tract_id, s.name AS tract, ref_tract FROM ref_ht r JOIN stat s ON s.concat_idx = r.exemplar_concat_idx WHERE s.name <> ref_tract",
        "frameshift_proxy": f"WITH {ref} SELECT feature_type = 'CDS' AS coding, (max_tract_length - ref_tract_length) % 3 = 0 AS in_frame, count(*) AS n_tracts FROM tract_list GROUP BY 1, 2",
        "euclidean_distance": "SELECT a.vec_id AS query_id, e.vec_id, sqrt(list_sum(list_transform(range(1, len(e.embedding) + 1), lambda i: pow(CAST(a.embedding[i] AS DOUBLE) - CAST(e.embedding[i] AS DOUBLE), 2)))) AS distance FROM embeddings a JOIN embeddings e ON a.vec_id % 50 = 0",
        "cluster_contexts": f"WITH RECURSIVE {_CONTEXTS} SELECT sample_idx, location, name, n_context, CAST(integral AS BIGINT) AS integral, mode_length, indel FROM hist1",
        "merge_histograms": f"WITH RECURSIVE {_FOLDED} SELECT sample_idx, location, name, n_context, CAST(integral AS BIGINT) AS integral, mode_length, feature_type, feature_id FROM pointed LEFT JOIN best_f USING (contig, position)",
        "assign_tracts": f"WITH RECURSIVE {_FOLDED} SELECT sample_idx, location, concat_idx, tract_id, lev FROM assigned",
        "run_variable_tracts": f"WITH RECURSIVE {run} SELECT * FROM variable",
        "run_selected_tracts": f"WITH RECURSIVE {_FOLDED} SELECT s.*, lev_distance FROM spread s JOIN (SELECT tract_id, max(lev) AS lev_distance FROM assigned GROUP BY 1) USING (tract_id) WHERE n_hist < {derived.SAMPLES} OR lev_distance > 0 OR greatest(rd_modal_freq, rd_mean_length, rd_entropy) > 1e-6",
        "run_average_length": f"WITH RECURSIVE {run} SELECT tract_id, " + ", ".join(f"max(CASE WHEN sample_idx = {x} AND mean_length > 0 THEN mean_length END) AS sample_{x}" for x in SAMPLES) + " FROM of_sample JOIN variable USING (tract_id) WHERE variable GROUP BY 1",
        "vcf_rows": f"{vcf} SELECT * FROM variants",
        "vcf_concat_distinct": f"{vcf} SELECT DISTINCT chrom, pos, ref, alt, tid FROM variants",
        "vcf_multi_sample": f"{vcf} SELECT chrom, pos, ref, alt, " + ", ".join(f"max(CASE WHEN sample_idx = {x} THEN 1 ELSE 0 END) AS sample_{x}" for x in SAMPLES) + " FROM variants GROUP BY 1, 2, 3, 4",
    }
