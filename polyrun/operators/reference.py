"""Tracts on the reference: borders, the best tract there, and the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyrun.functions.dna import context_name, shift_distance
from polyrun.options import Options
from polyrun.sources.shared import shuffled

from .mapping import with_segment
from .scan import run_hits

_FAR = 0xFFFFFF


def tract_borders(concat: DataFrame) -> DataFrame:
    """Per tract the outermost borders, the longest modal length, and the histogram with the fewest mismatches (of equals the first)."""
    return concat.groupBy("tract_id").agg(
        F.min_by("ref_id", "concat_idx").alias("ref_id"),
        F.min("loc_pos").alias("border_lo"),
        F.max("loc_last").alias("border_hi"),
        F.max("mode_length").alias("max_length"),
        F.min("mismatches").alias("best_nm"),
        F.min_by("concat_idx", F.struct("mismatches", "concat_idx")).alias("exemplar_concat_idx"),
    )


def best_reference_tract(borders: DataFrame, concat: DataFrame, contigs: DataFrame, options: Options) -> DataFrame:
    """borders with tract_length, ht_location and ref_tract of the reference's tract that is most like the exemplar.

    Candidates are the runs, then the single bases, of the window around the borders; those of another base or strand are as good as
    none, and of equals the first counts. A window without any candidate gives length 0 in its middle.
    """
    k, extra = options.kmer, options.min_tract + 3
    own = concat.select(F.col("concat_idx").alias("exemplar_concat_idx"), F.col("base").alias("h_base"), F.col("neg_strand").alias("h_neg"), "mode_left", "mode_right")
    b = borders.join(shuffled(own), "exemplar_concat_idx").join(contigs.select("ref_id", "len"), "ref_id")
    b = b.withColumn("w_start", F.greatest(F.lit(0), F.col("border_lo") - extra))
    b = b.withColumn("w_len", F.least(F.col("border_hi") - F.col("border_lo") + 2 * extra, F.col("len") - F.col("w_start")))
    cut = with_segment(b, contigs, F.col("w_start"), F.col("w_len"))
    keep = ["tract_id", "h_base", "h_neg", "mode_left", "mode_right", "w_start"]
    c = run_hits(cut, k, keep, "segment").withColumn("mono", (F.col("length") == 1).cast("int"))
    alike = (F.col("base") == F.col("h_base")) & (((F.col("canon_flag") == 1) & ~F.col("h_neg")) | ((F.col("canon_flag") == 2) & F.col("h_neg")))
    dist = F.when(alike, shift_distance("left_ctx", "right_ctx", "mode_left", "mode_right", k, options.compat)).otherwise(_FAR)
    name = context_name("left_ctx", "base", "right_ctx", F.col("canon_flag") == 2)
    best = c.groupBy("tract_id").agg(F.min_by(F.struct("length", (F.col("w_start") + F.col("read_offset") + k).alias("at"), name.alias("name")), F.struct(dist.alias("d"), "mono", "read_offset")).alias("x"))
    d = cut.join(shuffled(best), "tract_id", "left")
    size = F.col("border_hi") - F.col("border_lo")
    raw = F.substring(F.col("segment"), F.col("border_lo") - F.col("w_start") + 1, size)
    return d.select(*borders.columns, F.coalesce("x.length", F.lit(0)).alias("tract_length"), F.coalesce("x.at", F.col("border_lo") + F.floor(size / 2).cast("int")).alias("ht_location"), F.coalesce("x.name", raw).alias("ref_tract"))


def next_locations(tract_ref: DataFrame) -> DataFrame:
    """tract_id and next_ht: the location of the first later tract of the contig that lies elsewhere; null if none."""
    w = Window.partitionBy("ref_id").orderBy("tract_id")
    d = tract_ref.select("tract_id", "ref_id", "ht_location").withColumn("turn", F.coalesce((F.col("ht_location") != F.lag("ht_location").over(w)).cast("int"), F.lit(0)))
    d = d.withColumn("turn", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = d.groupBy("ref_id", "turn").agg(F.first("ht_location").alias("next_ht")).withColumn("turn", F.col("turn") - 1)
    return d.join(shuffled(first), ["ref_id", "turn"], "left").select("tract_id", "next_ht")
