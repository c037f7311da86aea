"""Command line: reads of several samples and an annotated reference in, the reports of a run out."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from polyrun.operators import report
from polyrun.options import Options
from polyrun.plans.pipeline import TractPipeline
from polyrun.sources import gff, sinks
from polyrun.sources.fastx import read_contigs, read_samples, sample_name, simplified_names


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m polyrun", description=__doc__)
    d = Options()
    p.add_argument("-p", "--paired", action="store_true", help="two consecutive files are one sample")
    p.add_argument("-b", "--keep_bias", action="store_true", help="keep tracts seen on one strand only")
    p.add_argument("-V", "--vcf", action="store_true", help="write variants per sample")
    p.add_argument("-k", "--kmer", type=int, default=d.kmer, help="bases of each flank")
    p.add_argument("-m", "--minsize", type=int, default=d.min_tract, help="shortest tract")
    p.add_argument("-i", "--minreads", type=int, default=d.min_reads, help="least reads of a context")
    p.add_argument("-d", "--maxdist", type=int, default=d.max_dist, help="distance of flanks that are merged")
    p.add_argument("-l", "--leven", type=int, default=d.leven, help="edit distance of contexts that are merged")
    p.add_argument("-e", "--edits", type=int, default=d.max_edits, help="edits within which a context is mapped")
    p.add_argument("-g", "--gff", required=True, help="GFF3 annotation, with or without sequences")
    p.add_argument("-f", "--fasta", help="sequences of the reference, before those of the annotation")
    p.add_argument("-o", "--outdir", help="folder of the reports, or the word random")
    p.add_argument("--index", help="folder where the index of the reference is kept for later runs")
    p.add_argument("reads", nargs="+", help="FASTA or FASTQ files, plain or gzip")
    return p


def main(argv: list[str] | None = None) -> None:
    a = arguments().parse_args(argv)
    spark = SparkSession.builder.appName("polyrun").getOrCreate()
    options = Options(kmer=a.kmer, min_tract=a.minsize, min_reads=a.minreads, max_dist=a.maxdist, leven=a.leven, remove_biased=not a.keep_bias, paired=a.paired, vcf=a.vcf, max_edits=a.edits)
    contigs = gff.with_reference(gff.read_sequences(spark, a.gff), read_contigs(spark, a.fasta) if a.fasta else None)
    if contigs.isEmpty():
        raise SystemExit("no reference sequence: give --fasta, or an annotation with sequences")
    run = TractPipeline(read_samples(spark, a.reads, a.paired), contigs, gff.read_features(spark, a.gff), options, index_dir=a.index)
    names = dict(enumerate(simplified_names([sample_name(x) for x in (a.reads[: len(a.reads) // 2 * 2 : 2] if a.paired else a.reads)])))
    started = time.time()
    for r in run.mapping_counts.orderBy("sample_idx").collect():  # a row per sample
        print(f"{names[r.sample_idx]}: contexts found {r.contexts_found}, not found {r.contexts_not_found}; with lengths, {r.elements_found} and {r.elements_not_found}")
    print(f"samples with tracts: {len(run.samples)} of {len(names)}; counted and mapped in {time.time() - started:.1f} s")
    out = sinks.output_dir(a.outdir)
    tables = {"average_length": ("mean_length", 2), "modal_frequency": ("modal_freq", 2), "proportional_coverage": ("prop_coverage", 5)}
    for name, (value, decimals) in tables.items():
        d = report.sample_table(run.matrix(value), run.tract_ref, run.concat, value, {s: names[s] for s in run.samples})
        sinks.write_tsv(d, f"{out}per_sample_{name}.tsv", dict.fromkeys(d.columns[4:], decimals))
    sinks.write_tsv(run.bed, out + "variable_tracts.bed", header=False)
    sinks.write_tsv(run.tract_list, out + "tract_list.tsv")
    selected = report.selected_table(run.selected, run.concat)
    sinks.write_tsv(selected.where("GFF3_info is not null"), out + "selected_tracts_annotated.tsv")
    sinks.write_tsv(selected.where("GFF3_info is null").drop("GFF3_info"), out + "selected_tracts_unknown.tsv")
    if options.vcf:
        sinks.write_vcf(run.vcf, contigs, names, out + "vcf")
    print(f"reports in {out}, {time.time() - started:.1f} s in all")


if __name__ == "__main__":
    main()
