"""Reports: matrices, regions, tract list, variants, and the questions asked of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyrun.functions.dna import common_prefix, common_suffix, tract_label, tract_string
from polyrun.sources.shared import shuffled

from .mapping import with_segment
from .reference import next_locations


def matrix(each: DataFrame, value: str, samples: list[int]) -> DataFrame:
    """One row per tract, a column sample_<i> per sample; absent and non-positive values are null."""
    v = F.when(F.col(value) > 0, F.col(value))
    p = each.withColumn("_v", v).groupBy("tract_id").pivot("sample_idx", samples).agg(F.first("_v"))
    return p.select("tract_id", *[F.col(str(s)).alias(f"sample_{s}") for s in samples])


def sample_table(values: DataFrame, tract_ref: DataFrame, concat: DataFrame, value: str, names: dict[int, str]) -> DataFrame:
    """A matrix as it is written: tract_id, location, feature, reference, then a column per sample by name.

    The reference is its own tract length, 1 for modal frequencies, and nothing for coverage.
    """
    own = concat.select(F.col("concat_idx").alias("exemplar_concat_idx"), F.coalesce("feature_id", F.lit("unannotated")).alias("feature"))
    ref = {"mean_length": F.col("tract_length"), "modal_freq": F.lit(1)}.get(value, F.lit(None)).cast("int")
    d = values.join(shuffled(tract_ref.select("tract_id", "ht_location", "tract_length", "exemplar_concat_idx")), "tract_id").join(shuffled(own), "exemplar_concat_idx")
    return d.select(tract_label("tract_id").alias("tract_id"), F.col("ht_location").alias("location"), "feature", ref.alias("reference"), *[F.col(f"sample_{s}").alias(n) for s, n in names.items()])


def selected_table(selected: DataFrame, concat: DataFrame) -> DataFrame:
    """Tracts of interest as they are written: tract_id, GFF3_info (of the first histogram, null if it lies in no feature), begin_context, n_genomes, lev_distance and the five spreads."""
    first = concat.groupBy("tract_id").agg(F.min_by("location", "concat_idx").alias("begin_context"), F.min_by("feature_id", "concat_idx").alias("GFF3_info"))
    spread = {"rd_modal_freq": "rd_frequency", "rd_mean_length": "rd_avge_tract_length", "rd_prop_coverage": "rd_coverage", "rd_cov_per_context": "rd_context_covge", "rd_entropy": "rd_entropy"}
    return selected.join(shuffled(first), "tract_id").select(tract_label("tract_id").alias("tract_id"), "GFF3_info", "begin_context", F.col("n_hist").alias("n_genomes"), "lev_distance", *[F.col(a).alias(b) for a, b in spread.items()])


def tract_samples(concat: DataFrame) -> DataFrame:
    """tract_id, n_samples and the samples (ascending, separated by commas) that have the tract; a list is as long as there are samples at most."""
    own = concat.groupBy("tract_id").agg(F.sort_array(F.collect_set("sample_idx")).alias("s"))
    return own.select("tract_id", F.size("s").cast("long").alias("n_samples"), F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("samples"))


def bed(tract_ref: DataFrame, contigs: DataFrame, variable: DataFrame, k: int) -> DataFrame:
    """contig, start, end, label of variable tracts."""
    d = tract_ref.join(shuffled(variable.where("variable").select("tract_id")), "tract_id").join(contigs.select("ref_id", "contig"), "ref_id")
    return d.select("contig", (F.col("border_lo") + k).alias("start"), (F.col("border_hi") - k + 1).alias("end"), tract_label("tract_id").alias("label"))


def tract_list(tract_ref: DataFrame, concat: DataFrame, contigs: DataFrame) -> DataFrame:
    """The nine columns of the tract list. concat has name, feature_type and feature_id."""
    own = concat.select(F.col("concat_idx").alias("exemplar_concat_idx"), "name", "feature_type", "feature_id")
    d = tract_ref.join(shuffled(own), "exemplar_concat_idx").join(contigs.select("ref_id", "contig"), "ref_id")
    return d.select(
        tract_label("tract_id").alias("tract_id"),
        F.col("contig").alias("contig_name"),
        F.coalesce("feature_type", F.lit("nc")).alias("feature_type"),
        F.coalesce("feature_id", F.lit("unannotated")).alias("feature"),
        F.col("ht_location").alias("location_in_contig"),
        F.col("max_length").alias("max_tract_length"),
        F.col("tract_length").alias("ref_tract_length"),
        F.col("name").alias("tract"),
        "ref_tract",
    )


def vcf_rows(concat: DataFrame, tract_ref: DataFrame, contigs: DataFrame, variable: DataFrame, k: int) -> DataFrame:
    """sample_idx, chrom, pos (from 1), ref, alt, tid of every histogram of a variable tract that differs from the reference in its tract or right flank."""
    t = tract_ref.join(shuffled(variable.where("variable").select("tract_id")), "tract_id").join(shuffled(next_locations(tract_ref)), "tract_id", "left").select("tract_id", "ht_location", "tract_length", "next_ht")
    d = concat.join(shuffled(t), "tract_id").join(contigs.select("ref_id", "contig"), "ref_id")
    d = with_segment(d, contigs, F.col("loc_pos"), F.col("loc_last") - F.col("loc_pos") + 1, "ref")
    d = d.withColumn("alt", tract_string("mode_left", "base", "mode_right", "mode_length", "neg_strand"))
    over = F.greatest(F.lit(0), F.col("loc_last") + 1 - F.coalesce("next_ht", F.col("loc_last") + 1))
    cut = lambda c: F.substring(F.col(c), F.lit(1), F.greatest(F.length(c) - over, F.lit(0)))
    d = d.withColumn("ref", cut("ref")).withColumn("alt", cut("alt"))
    d = d.withColumn("r", F.substring(F.col("ref"), F.col("ht_location") - F.col("loc_pos") + 1, F.length("ref"))).withColumn("a", F.substring(F.col("alt"), F.lit(k + 1), F.length("alt")))
    d = d.where((F.substring("r", 1, 1) != F.substring("a", 1, 1)) | (F.col("tract_length") != F.col("mode_length"))).where("r <> a")
    d = d.withColumn("l0", common_prefix("r", "a")).withColumn("l1", common_suffix("r", "a")).where("l0 > 0")
    # the last common base, then what differs
    piece = lambda c: F.substring(F.col(c), F.col("l0"), F.greatest(F.length(c) - F.col("l1") - F.col("l0") + 1, F.lit(1)))
    return d.select("sample_idx", F.col("contig").alias("chrom"), (F.col("ht_location") + F.col("l0")).cast("int").alias("pos"), piece("r").alias("ref"), piece("a").alias("alt"), tract_label("tract_id").alias("tid"))


def distinct_variants(rows: DataFrame) -> DataFrame:
    return rows.select("chrom", "pos", "ref", "alt", "tid").distinct()


def multi_sample(rows: DataFrame, samples: list[int]) -> DataFrame:
    """One row per variant; sample_<i> is 1 where the sample has it, else 0."""
    p = rows.groupBy("chrom", "pos", "ref", "alt").pivot("sample_idx", samples).agg(F.lit(1))
    return p.select("chrom", "pos", "ref", "alt", *[F.coalesce(F.col(str(s)), F.lit(0)).alias(f"sample_{s}") for s in samples])


def frameshift_counts(tracts: DataFrame) -> DataFrame:
    """Tracts of a tract list by kind of feature and whether the longest length differs from the reference's by whole codons."""
    delta = F.col("max_tract_length") - F.col("ref_tract_length")
    return tracts.groupBy((F.col("feature_type") == "CDS").alias("coding"), (F.pmod(delta, F.lit(3)) == 0).alias("in_frame")).agg(F.count("*").alias("n_tracts"))
