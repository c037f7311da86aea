"""DNA derived from relational tables by hashing: a small genome with features, and reads of it with known variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyrun.sources.shared import shuffled, width

#: Part keys of each contig, reads' length, samples.
CONTIG_KEYS, READ, SAMPLES = 96, 100, 5


def _dna(x):
    return F.translate(F.md5(x.cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")


def _spread(df: DataFrame) -> DataFrame:
    """df in as many partitions as there are cores: a small table is one file, and so one task, however long its rows take afterwards."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= n else df.repartition(n)


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref_id, contig, seq, len: a contig for every CONTIG_KEYS part keys, 32 bases of each; the genome grows with the table."""
    p = _spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"))
    p = p.select(F.floor(F.col("p_partkey") / CONTIG_KEYS).cast("int").alias("ref_id"), "p_partkey", _dna(F.col("p_partkey")).alias("d"))
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "d"))), lambda x: x["d"]), "")
    return p.groupBy("ref_id").agg(seq.alias("seq")).select("ref_id", F.concat(F.lit("contig"), F.col("ref_id")).alias("contig"), "seq", F.length("seq").alias("len"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """contig, type, start, end (1-based, inclusive), feature_id: overlapping intervals of three types."""
    c = contigs(spark, sf_dir)
    i = F.col("i")
    return c.select("contig", F.explode(F.sequence(F.lit(0), F.floor(F.col("len") / 150).cast("int"))).alias("i")).select(
        "contig",
        F.element_at(F.array(F.lit("CDS"), F.lit("gene"), F.lit("region")), i % 3 + 1).alias("type"),
        (i * 150 + 1).alias("start"),
        (i * 150 + 220).alias("end"),
        F.concat(F.lit("f"), i).alias("feature_id"),
    )


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_idx, read_id, seq: 100-base pieces of the contigs on both strands; two samples have longer tracts."""
    e = _spread(spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("user_id") % SAMPLES).cast("int").alias("sample_idx")))
    last = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.max("p_partkey")).first()[0]
    n = 1 + (last or 0) // CONTIG_KEYS
    e = e.withColumn("ref_id", (F.floor(F.col("event_id") / 2) % n).cast("int"))
    e = e.repartition(width(e), "ref_id").join(shuffled(contigs(spark, sf_dir).where(F.col("len") > READ)), "ref_id")
    r = F.substring("seq", (F.col("event_id") * 37 % (F.col("len") - READ) + 1).cast("int"), F.lit(READ))
    r = F.when(F.col("sample_idx") == 1, F.replace(r, F.lit("CAAAG"), F.lit("CAAAAG"))).when(F.col("sample_idx") == 2, F.replace(r, F.lit("GTTTA"), F.lit("GTTTTTA"))).otherwise(r)
    e = e.select("sample_idx", F.col("event_id").alias("read_id"), r.alias("r"))
    return e.select("sample_idx", "read_id", F.when(F.col("read_id") % 2 == 0, F.col("r")).otherwise(F.reverse(F.translate("r", "ACGT", "TGCA"))).alias("seq"))
