"""Features at a position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyrun.sources.shared import shuffled

#: Bases of a bin of the range join.
BIN = 1 << 12


def feature_hits(points: DataFrame, features: DataFrame) -> DataFrame:
    """points (contig, position) joined to all features with start <= position <= end.

    Features are cut into bins of the genome, so the range join is an equi-join on (contig, bin) with a filter.
    """
    f = features.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor(F.col("end") / BIN))))
    p = points.withColumn("bin", F.floor(F.col("position") / BIN))
    return p.join(shuffled(f), ["contig", "bin"]).where("start <= position and position <= end").drop("bin")


def with_feature(points: DataFrame, features: DataFrame, key: list[str]) -> DataFrame:
    """points (key, contig, position) with feature_type and feature_id: the first CDS, else the last feature that is no region; null if none."""
    order = F.struct(F.when(F.col("type") == "CDS", 1).otherwise(0).alias("cds"), F.when(F.col("type") == "CDS", -F.col("start")).otherwise(F.col("start")).alias("place"), F.when(F.col("type") == "CDS", "").otherwise(F.col("feature_id")).alias("id"))
    best = feature_hits(points.select(*key, "contig", "position"), features).where("type <> 'region'").groupBy(*key).agg(F.max_by(F.struct("type", "feature_id"), order).alias("f"))
    return points.join(shuffled(best.select(*key, F.col("f.type").alias("feature_type"), F.col("f.feature_id").alias("feature_id"))), key, "left")
