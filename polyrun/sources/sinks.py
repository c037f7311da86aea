"""Output folders and files of a run."""

from __future__ import annotations

import gzip
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage


def output_dir(name: str | None) -> str:
    """The folder that a run writes to: here by default, a new name for "random"."""
    if not name:
        return "./"
    if name == "random":
        return f"out{uuid.uuid4().hex[:12]}/"
    return name if name.endswith("/") else name + "/"


def write_tsv(df: DataFrame, path: str, decimals: dict[str, int] | None = None, header: bool = True) -> None:
    """Tab-separated files; numbers are formatted here only, null is an empty cell."""
    cell = lambda c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{decimals[c]}f", c)) if decimals and c in decimals else F.col(c).cast("string")
    out = df.select(*[cell(c).alias(c) for c in df.columns])
    out.write.mode("overwrite").csv(path, sep="\t", header=header, nullValue="", emptyValue="", quote="")


#: The lines that the format asks for.
VCF_HEAD = ("##fileformat=VCFv4.2", '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">', '##INFO=<ID=TID,Number=A,Type=String,Description="Tract identifier">')
VCF_COLUMNS = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT"


@dataclass
class _Written(WriterCommitMessage):
    """Files that a task has finished, by sample, under names of their own."""

    files: dict[int, str]


class _VcfWriter(DataSourceArrowWriter):
    """Each task writes whole files under names of its own; the job moves those of the tasks that count into place, and adds samples without variants."""

    def __init__(self, options: dict) -> None:
        self.path, self.names = options["path"].rstrip("/"), {int(k): v for k, v in json.loads(options["names"]).items()}
        self.contigs, self.own = json.loads(options["contigs"]), f"_writing-{uuid.uuid4().hex}"

    def _head(self, sample: int) -> bytes:
        return "".join(f"{x}\n" for x in (*VCF_HEAD, *self.contigs, f"{VCF_COLUMNS}\t{self.names[sample]}")).encode()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = file_system(self.path)
        fs.create_dir(f"{base}/{self.own}", recursive=True)
        files: dict[int, str] = {}
        out = now = None
        try:
            for batch in iterator:
                sample, lines = batch.column("sample_idx").to_pylist(), batch.column("line").to_pylist()
                for s, line in zip(sample, lines, strict=True):
                    if s != now:
                        if out is not None:
                            raw = out.fileobj
                            out.close()
                            raw.close()
                        now, files[s] = s, f"{base}/{self.own}/{uuid.uuid4().hex}.gz"
                        out = gzip.GzipFile(fileobj=fs.open_output_stream(files[s], compression=None), mode="wb", mtime=0)
                        out.write(self._head(s))
                    out.write(f"{line}\n".encode())
        finally:
            if out is not None:
                raw = out.fileobj
                out.close()
                raw.close()
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = file_system(self.path)
        fs.create_dir(f"{base}/{self.own}", recursive=True)
        found = {s: f for m in messages if m is not None for s, f in m.files.items()}
        for s, name in self.names.items():
            if s not in found:
                found[s] = f"{base}/{self.own}/{s}.gz"
                with fs.open_output_stream(found[s], compression=None) as f:
                    f.write(gzip.compress(self._head(s), mtime=0))
            fs.move(found[s], f"{base}/{name}.vcf.gz")
        fs.delete_dir(f"{base}/{self.own}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = file_system(self.path)
        if fs.get_file_info(f"{base}/{self.own}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{base}/{self.own}")


class VcfSink(DataSource):
    """Variants (sample_idx, line) as one gzip file per sample: rows of a sample follow each other in one task."""

    @classmethod
    def name(cls) -> str:
        return "vcf"

    def schema(self) -> str:
        return "sample_idx int, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _VcfWriter(self.options)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; without a scheme it is local."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def vcf_lines(rows: DataFrame) -> DataFrame:
    """sample_idx and line of variants, a sample in one partition by contig and position."""
    line = F.concat_ws("\t", "chrom", F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.lit("."), F.lit("."), F.concat(F.lit("TID="), "tid"), F.lit("GT"), F.lit("1"))
    return rows.repartition("sample_idx").sortWithinPartitions("sample_idx", "chrom", "pos", "tid", "ref", "alt").select(F.col("sample_idx").cast("int").alias("sample_idx"), line.alias("line"))


def write_vcf(rows: DataFrame, contigs: DataFrame, names: dict[int, str], path: str) -> None:
    """<name>.vcf.gz of each sample: header lines, then its rows by contig and position; a sample without variants has the header.

    A file appears when the whole job has succeeded: a task that is killed, run twice or fails leaves nothing in place. Files of samples with one name would be one, so
    the sample's number is added to it. The contigs' names and lengths, a line each, are part of every header and pass through the driver.
    """
    spark = rows.sparkSession
    spark.dataSource.register(VcfSink)
    clean = {k: "".join("_" if c in "/\"' \\" else c for c in v) for k, v in names.items()}
    twice = {v for v in clean.values() if list(clean.values()).count(v) > 1}
    clean = {k: f"{v}_{k}" if v in twice else v for k, v in clean.items()}
    lines = [f"##contig=<ID={r.contig},length={r.len}>" for r in contigs.select("ref_id", "contig", "len").orderBy("ref_id").collect()]
    some = rows.where(F.col("sample_idx").isin(list(names)))
    vcf_lines(some).write.format("vcf").mode("overwrite").option("names", json.dumps(clean)).option("contigs", json.dumps(lines)).save(path)
