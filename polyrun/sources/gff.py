"""GFF3 annotation, with or without sequences."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fastx

#: Fixed value: the line that begins the sequences.
_MARK = b"##FASTA"


def _ranges(spark: SparkSession, path: str, size: int, split: int) -> DataFrame:
    cuts = [*range(0, max(1, size), split), size]
    return spark.createDataFrame([(path, a, b) for a, b in zip(cuts, cuts[1:], strict=False)], "path string, lo long, stop long").repartition(len(cuts) - 1)


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The place of the first line in a range that begins the sequences; a line belongs to the range where it begins."""
    for batch in batches:
        for r in batch.to_pylist():
            with fastx.open_input(r["path"]) as f:
                at, found = r["lo"], None
                while at < r["stop"] and found is None:
                    data = f.read_at(min(fastx.CHUNK, r["stop"] - at) + len(_MARK), max(0, at - 1))  # with the byte before, and enough of a line
                    i = data.find(b"\n" + _MARK)
                    if at == 0 and data.startswith(_MARK):
                        found = 0
                    elif i >= 0:
                        found = max(0, at - 1) + i + 1
                    at += fastx.CHUNK
            if found is not None and found < r["stop"]:
                yield pa.RecordBatch.from_arrays([pa.array([found], pa.int64())], names=["at"])


def sequences_begin(spark: SparkSession, path: str, split: int | None = None) -> tuple[str, int, int | None]:
    """(kind of file, its size, the byte after the line that begins the sequences or None). Plain files are searched in ranges; a place per range at most comes to the driver."""
    with fastx.open_input(path) as f:
        kind, size = fastx.kind_of(f), f.size()
    if kind != "plain":
        return kind, size, None
    at = _ranges(spark, path, size, split or fastx.SPLIT).mapInArrow(_marks, "at long").agg(F.min("at")).first()[0]
    if at is None:
        return kind, size, None
    with fastx.open_input(path) as f:
        line = f.read_at(1 << 12, at)
    return kind, size, at + (line.find(b"\n") + 1 or len(line))


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of annotation that begin in a range, up to the one that begins the sequences."""
    for batch in batches:
        for r in batch.to_pylist():
            with fastx.open_input(r["path"]) as f:
                kind = fastx.kind_of(f)
                text = fastx._Text(f, kind, max(0, r["lo"] - 1) if kind == "plain" else 0)
                place, skip = (max(0, r["lo"] - 1), r["lo"] > 0) if kind == "plain" else (0, False)
                stop = r["stop"] if kind == "plain" else None
                over = False
                while not over:
                    text.more(fastx.CHUNK)
                    end = len(text.buffer) if text.eof else text.buffer.rfind(b"\n") + 1
                    lines, at = text.buffer[:end].split(b"\n"), place
                    out = []
                    for x in lines:
                        if skip:
                            skip = False
                        elif (stop is not None and at >= stop) or x.startswith(_MARK):
                            over = True
                            break
                        elif x and not x.startswith(b"#"):
                            out.append(x.rstrip(b"\r"))
                        at += len(x) + 1
                    place += end
                    text.drop(end)
                    over |= text.eof
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()).cast(pa.string())], names=["line"])


def read_features(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """contig, source, type, start, end (1-based, inclusive), strand, attributes, feature_id (the ID attribute), read in byte ranges; a gzip file in one task."""
    kind, size, begin = sequences_begin(spark, path, split)
    rows = _ranges(spark, path, size if begin is None else begin, (split or fastx.SPLIT) if kind == "plain" else max(1, size))
    line = rows.mapInArrow(_lines, "line string")
    c = F.split("line", "\t")
    line = line.where(F.size(c) == 9).select(c[0].alias("contig"), c[1].alias("source"), c[2].alias("type"), c[3].cast("int").alias("start"), c[4].cast("int").alias("end"), c[6].alias("strand"), F.str_to_map(c[8], F.lit(";"), F.lit("=")).alias("attributes"))
    return line.withColumn("feature_id", F.try_element_at("attributes", F.lit("ID")))


def _zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records after the line that begins the sequences of a gzip file."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with fastx.open_input(path) as f:
                text = fastx._Text(f, fastx.kind_of(f), 0)
                found, n = False, 0
                while True:
                    text.more(max(fastx.CHUNK, len(text.buffer)))
                    if not found:
                        i = 0 if text.buffer.startswith(_MARK) else text.buffer.find(b"\n" + _MARK)
                        found = i >= 0
                        text.drop(i + 1 if found else max(0, len(text.buffer) - len(_MARK)) if not text.eof else len(text.buffer))
                    if found:
                        records, used, bad = fastx.parse(text.buffer, text.eof)
                        text.drop(used)
                        yield from fastx._batches(iter([records]), 0, n)
                        n += len(records)
                        if bad:
                            break
                    if text.eof:
                        break


def read_sequences(spark: SparkSession, path: str, split: int | None = None) -> DataFrame:
    """contig, seq and place (in the file) of the FASTA part, read in splits; no rows if there is none."""
    kind, size, begin = sequences_begin(spark, path, split)
    if kind != "plain":
        records = _ranges(spark, path, size, max(1, size)).mapInArrow(_zipped, fastx.SCHEMA)
    elif begin is None:
        records = spark.createDataFrame([], fastx.SCHEMA)
    else:
        spark.dataSource.register(fastx.FastxSource)
        records = spark.read.format("fastx").option("plan", json.dumps(fastx.planned(spark, [path], split, begin))).load(path)
    return records.where("name <> '' and seq <> ''").select(F.col("name").alias("contig"), F.upper("seq").alias("seq"), F.col("read_id").alias("place"))


def with_reference(sequences: DataFrame, contigs: DataFrame | None) -> DataFrame:
    """ref_id, contig, seq, len: a FASTA's sequences, where it has them, before those of the annotation.

    Contigs are numbered in the order of the FASTA, then those that only the annotation has in its order.
    """
    if contigs is None:
        d = sequences.withColumn("first", F.lit(1))
    else:
        own = contigs.select("contig", F.col("seq").alias("own"), F.col("ref_id").alias("own_place"))
        d = sequences.join(own, "contig", "full").select("contig", F.coalesce("own", "seq").alias("seq"), F.coalesce("own_place", "place").alias("place"), F.when(F.col("own").isNull(), 1).otherwise(0).alias("first"))
    return d.withColumn("ref_id", F.row_number().over(Window.orderBy("first", "place")) - 1).select("ref_id", "contig", "seq", F.length("seq").alias("len"))
