"""The whole run as one lazy plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyrun.operators import annotate, cluster, counts, mapping, reference, report, scan, stats
from polyrun.options import Options
from polyrun.sources.shared import checkpointed, shuffled


@dataclass
class TractPipeline:
    """reads (sample_idx, seq), contigs (ref_id, contig, seq, len), features (contig, type, start, end, feature_id) -> tables by attribute.

    Every table is made when it is asked for. `keep` is applied to tables that several others use (histograms and
    tracts); the default checkpoints them in the shared folder.
    """

    reads: DataFrame
    contigs: DataFrame
    features: DataFrame | None = None
    options: Options = Options()
    keep: Callable[[DataFrame], DataFrame] = field(default=checkpointed)
    #: Folder of stored indexes of references; None: the index is made for this run.
    index_dir: str | None = None

    @cached_property
    def hits(self) -> DataFrame:
        return scan.tract_hits(self.reads, self.options.kmer, self.options.min_tract, ["sample_idx"], compat=self.options.compat)

    @cached_property
    def elements(self) -> DataFrame:
        """Counted elements that pass the strand or singleton filter."""
        e = counts.element_counts(self.hits)
        return self.keep(counts.drop_biased(e) if self.options.remove_biased else counts.drop_singletons(e))

    @cached_property
    def coverage(self) -> DataFrame:
        return counts.sample_coverage(self.elements, self.options.compat)

    @cached_property
    def located(self) -> DataFrame:
        deep = counts.with_depth(self.elements, self.options.min_reads).where("deep")
        q = min(15, (2 * self.options.kmer + max(self.options.min_tract, 2)) // (self.options.max_edits + 1))
        index = mapping.stored_index(self.contigs, q, self.index_dir) if self.index_dir else None
        return self.keep(mapping.located_elements(deep, self.contigs, q, self.options.max_edits, index, self.options.compat))

    @cached_property
    def histograms(self) -> DataFrame:
        h = cluster.merge_histograms(cluster.cluster_contexts(self.located, self.options), self.options)
        h = h.withColumn("hist", F.map_from_entries("lengths")).drop("lengths")
        if self.features is not None:
            unknown = [r.contig for r in self.features.join(self.contigs, "contig", "left_anti").select("contig").distinct().orderBy("contig").limit(5).collect()]
            if unknown:
                raise ValueError(f"features lie on contigs that the reference does not have: {', '.join(map(str, unknown))}")
            h = h.join(self.contigs.select("ref_id", "contig"), "ref_id").withColumn("position", F.col("loc_pos") + self.options.kmer)
            h = annotate.with_feature(h, self.features, ["sample_idx", "location"]).drop("contig", "position")
        else:
            h = h.withColumn("feature_type", F.lit(None).cast("string")).withColumn("feature_id", F.lit(None).cast("string"))
        return self.keep(h)

    @cached_property
    def samples(self) -> list[int]:
        """Samples with a histogram; the others are left out, and it is an error if none is left."""
        found = sorted(r.sample_idx for r in self.histograms.select("sample_idx").distinct().collect())
        if not found:
            counts_ = "; ".join(f"sample {r.sample_idx}: {r.contexts_found} contexts found on the reference, {r.contexts_not_found} not" for r in self.mapping_counts.orderBy("sample_idx").limit(20).collect())
            raise ValueError(f"no sample has a tract that passes the filters and lies on the reference ({counts_ or 'no tract passes the strand or depth filter'})")
        return found

    @cached_property
    def mapping_counts(self) -> DataFrame:
        """Contexts and elements of each sample that are found on the reference, and those that are not."""
        return mapping.mapping_counts(self.elements, self.located)

    @cached_property
    def concat(self) -> DataFrame:
        """Histograms of all samples with tract_id, concat_idx and statistics."""
        return self.keep(stats.histogram_stats(cluster.assign_tracts(self.histograms, self.options), self.coverage))

    @cached_property
    def tract_ref(self) -> DataFrame:
        return self.keep(reference.best_reference_tract(reference.tract_borders(self.concat), self.concat, self.contigs, self.options))

    @cached_property
    def variable(self) -> DataFrame:
        return stats.variable_tracts(self.concat, self.tract_ref, len(self.samples))

    @cached_property
    def spread(self) -> DataFrame:
        return stats.tract_spread(self.concat)

    @cached_property
    def selected(self) -> DataFrame:
        return stats.selected_tracts(self.spread, self.concat.groupBy("tract_id").agg(F.max("lev").alias("lev_distance")), len(self.samples))

    def matrix(self, value: str = "mean_length") -> DataFrame:
        """Of variable tracts: average length (mean_length), modal_freq or prop_coverage by sample."""
        some = self.concat.join(shuffled(self.variable.where("variable").select("tract_id")), "tract_id")
        return report.matrix(stats.last_of_sample(some), value, self.samples)

    @cached_property
    def bed(self) -> DataFrame:
        return report.bed(self.tract_ref, self.contigs, self.variable, self.options.kmer)

    @cached_property
    def tract_list(self) -> DataFrame:
        return report.tract_list(self.tract_ref, self.concat, self.contigs)

    @cached_property
    def vcf(self) -> DataFrame:
        return report.vcf_rows(self.concat, self.tract_ref, self.contigs, self.variable, self.options.kmer)
