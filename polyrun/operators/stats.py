"""Descriptive statistics of histograms and of tracts across samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyrun.sources.shared import shuffled

STATS = ["mean_length", "modal_freq", "prop_coverage", "cov_per_context", "entropy"]


def _over(hist: Column, f) -> Column:
    return F.aggregate(F.map_entries(hist), F.lit(0.0), lambda s, e: s + f(e["key"].cast("double"), e["value"].cast("double")))


def histogram_stats(histograms: DataFrame, coverage: DataFrame) -> DataFrame:
    """Adds the five statistics to histograms (sample_idx, hist, integral, n_context, mode_count). coverage has a row per sample."""
    n = F.col("integral").cast("double")
    return histograms.join(coverage, "sample_idx").select(
        *[histograms[c] for c in histograms.columns],
        (_over(F.col("hist"), lambda k, v: k * v) / n).alias("mean_length"),
        (F.array_max(F.map_values("hist")) / n).alias("modal_freq"),
        (n / F.col("coverage")).alias("prop_coverage"),
        (n / F.col("n_context")).alias("cov_per_context"),
        (-_over(F.col("hist"), lambda k, v: (v / n) * F.ln(v / n))).alias("entropy"),
    )


def last_of_sample(stats: DataFrame) -> DataFrame:
    """Per tract and sample the statistics of its last histogram, and the number of histograms."""
    value = F.max_by(F.struct(*STATS, "mode_length"), "location")
    return stats.groupBy("tract_id", "sample_idx").agg(value.alias("x"), F.count("*").alias("n_hist")).select("tract_id", "sample_idx", "n_hist", "x.*")


def tract_spread(stats: DataFrame) -> DataFrame:
    """Maximum less minimum of each statistic over the histograms that a tract has."""
    return stats.groupBy("tract_id").agg(F.count("*").alias("n_hist"), *[(F.max(c) - F.min(c)).alias(f"rd_{c}") for c in STATS])


def variable_tracts(stats: DataFrame, reference: DataFrame, n_samples: int) -> DataFrame:
    """tract_id and whether it varies: absent somewhere, spread of mean length, modal frequency and entropy (absent samples are 0), or another length than the reference's."""
    each = last_of_sample(stats)
    present = each.groupBy("tract_id").agg(
        F.sum("n_hist").alias("n_hist"),
        F.count("*").alias("n_present"),
        F.collect_set("mode_length").alias("modes"),
        *[F.max(c).alias(f"hi_{c}") for c in ("mean_length", "modal_freq", "entropy")],
        *[F.min(c).alias(f"lo_{c}") for c in ("mean_length", "modal_freq", "entropy")],
    )
    low = lambda c: F.when(F.col("n_present") < n_samples, F.least(F.lit(0.0), F.col(f"lo_{c}"))).otherwise(F.col(f"lo_{c}"))
    spread = sum((F.col(f"hi_{c}") - low(c) for c in ("mean_length", "modal_freq", "entropy")), F.lit(0.0))
    lengths = stats.groupBy("tract_id").agg(F.min("mode_length").alias("lo"), F.max("mode_length").alias("hi"))
    d = present.join(shuffled(lengths), "tract_id").join(shuffled(reference.select("tract_id", "tract_length")), "tract_id")
    return d.select("tract_id", ((F.col("n_hist") < n_samples) | (spread > 1e-5) | (F.col("lo") != F.col("tract_length")) | (F.col("hi") != F.col("tract_length"))).alias("variable"))


def selected_tracts(spread: DataFrame, lev: DataFrame, n_samples: int) -> DataFrame:
    """Tracts of interest: absent somewhere, names that differ, or any spread of frequency, length or entropy."""
    some = F.greatest("rd_modal_freq", "rd_mean_length", "rd_entropy") > 1e-6
    return spread.join(shuffled(lev), "tract_id").where((F.col("n_hist") < n_samples) | (F.col("lev_distance") > 0) | some)


def pairwise_distances(stats: DataFrame) -> DataFrame:
    """(tract_id, a, b, d1, d2) for histograms of a tract with concat index a < b.

    d1: over ranks of modes (frequent first, of equals the shorter) that both have, (1 + difference of lengths) times the
    difference of their shares; d2: squared difference of mean lengths. A tract has a histogram per sample, so pairs per tract
    are bounded by the samples.
    """
    modes = F.transform(
        F.array_sort(F.transform(F.map_entries("hist"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("len")))),
        lambda e: F.struct(e["len"].alias("len"), (-e["n"] / F.col("integral")).alias("p")),
    )
    x = stats.select("tract_id", "concat_idx", modes.alias("modes"), "mean_length")
    a, b = x.alias("a"), x.alias("b")
    j = a.join(shuffled(b), (F.col("a.tract_id") == F.col("b.tract_id")) & (F.col("a.concat_idx") < F.col("b.concat_idx")))
    n = F.least(F.size("a.modes"), F.size("b.modes"))
    each = F.zip_with(F.slice("a.modes", F.lit(1), n), F.slice("b.modes", F.lit(1), n), lambda p, q: (1 + F.abs(p["len"] - q["len"])) * F.abs(p["p"] - q["p"]))
    d = F.col("a.mean_length") - F.col("b.mean_length")
    return j.select("a.tract_id", F.col("a.concat_idx").alias("a"), F.col("b.concat_idx").alias("b"), F.aggregate(each, F.lit(0.0), lambda s, v: s + v).alias("d1"), (d * d).alias("d2"))
