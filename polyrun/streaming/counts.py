"""Counts of tracts over a stream of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame

from polyrun.operators.counts import element_counts
from polyrun.operators.scan import tract_hits


def streaming_counts(reads: DataFrame, k: int, min_tract: int) -> DataFrame:
    """element_counts() of a streaming DataFrame (sample_idx, seq); its state is one row per context and length. Write it in complete or update mode."""
    return element_counts(tract_hits(reads, k, min_tract, ["sample_idx"]))
