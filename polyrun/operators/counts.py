"""Counts of tracts per context, their filters, and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyrun.sources.shared import shuffled

CONTEXT = ["sample_idx", "base", "left_ctx", "right_ctx"]


def element_counts(hits: DataFrame) -> DataFrame:
    """count and strands seen (bits) per sample, context and length; combined before the shuffle."""
    return hits.groupBy(*CONTEXT, "length").agg(F.count("*").alias("count"), F.bit_or("canon_flag").alias("canon_flag"))


def drop_biased(elements: DataFrame) -> DataFrame:
    return elements.where("canon_flag = 3")


def drop_singletons(elements: DataFrame) -> DataFrame:
    return elements.where("count > 1")


def with_depth(elements: DataFrame, min_reads: int) -> DataFrame:
    """Elements with the reads of their context (depth) and whether it has enough; shallow ones stay, unmapped."""
    depth = elements.groupBy(*CONTEXT).agg(F.sum("count").alias("depth"))
    return elements.join(shuffled(depth), CONTEXT).withColumn("deep", F.col("depth") >= min_reads)


def sample_coverage(elements: DataFrame, compat: bool = False) -> DataFrame:
    """Reads of the most frequent flank of each sample. Flanks are told apart by 15 bases; compat: and one bit of the next."""
    flanks = elements.select("sample_idx", F.explode(F.array("left_ctx", "right_ctx")).alias("flank"), "count")
    key = F.substring("flank", 1, 15)
    if compat:
        key = F.concat(key, F.translate(F.substring("flank", 16, 1), "ACGT", "0101"))
    return flanks.groupBy("sample_idx", key.alias("key")).agg(F.sum("count").alias("n")).groupBy("sample_idx").agg(F.max("n").alias("coverage"))


def length_histograms(elements: DataFrame) -> DataFrame:
    """One row per context: reads, distinct lengths, modal length (of equals the shortest) and its reads."""
    return elements.groupBy(*CONTEXT).agg(
        F.sum("count").alias("integral"),
        F.count("*").alias("n_lengths"),
        F.max_by("length", F.struct("count", -F.col("length"))).alias("mode_length"),
        F.max("count").alias("mode_count"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("length", "count")))).alias("hist"),
    )
