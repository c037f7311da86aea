"""Options of a run."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    """k-mer size, shortest tract, least reads of a context, distances; values are clamped to what they may be."""

    kmer: int = 25
    min_tract: int = 4
    min_reads: int = 5
    max_dist: int = 1
    leven: int = -1
    remove_biased: bool = True
    paired: bool = False
    vcf: bool = False
    max_edits: int = 0
    compat: bool = False

    def __post_init__(self) -> None:
        put = lambda name, value: object.__setattr__(self, name, value)
        put("kmer", min(max(self.kmer, 2), 32))
        put("min_tract", min(max(self.min_tract, 1), 32))
        put("min_reads", min(max(self.min_reads, 0), 65_535))
        put("max_dist", min(max(self.max_dist, 0), self.kmer // 2))
        put("leven", self.max_dist + 1 if self.leven < 0 else self.leven)
