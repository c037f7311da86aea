"""Helpers that the text operators share: tables, the shared folder, Arrow batches, links to components."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words of all operators on words.
WS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local master gets one of its own; a cluster is refused."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='polyrun-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/polyrun-{kind}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df from a checkpoint in the shared folder: later jobs neither compute it again nor depend on an executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_values(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 20):
    """Row slices of a batch with about limit bytes in column (a longer row is a slice of its own)."""
    n = batch.num_rows
    if n:
        size = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.binary())), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // limit)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
            yield batch.slice(a, b - a)


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indexes start[0], start[0]+1, ... (length[0] of them), then start[1], ..."""
    total = int(length.sum())
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(total)


def spanning(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(labels, indexes into the pairs of a spanning forest): earlier pairs are preferred; the label of a node is the smallest node it reaches."""
    label = np.arange(n) if label is None else label
    used, left = [], np.arange(len(a))
    while len(left):
        x, y = label[a[left]], label[b[left]]
        open_ = x != y
        left, x, y = left[open_], x[open_], y[open_]
        if not len(left):
            break
        high, first = np.unique(np.maximum(x, y), return_index=True)
        label[high] = np.minimum(x, y)[first]
        used.append(left[first])
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped
    return label, np.concatenate(used) if used else np.zeros(0, np.int64)


def thinned(edges: DataFrame, window: int = 1 << 20) -> DataFrame:
    """Edges (u, v: long) with the components of edges: of each `window` edges of a few partitions, those that span them."""

    def run(batches):
        held: list = []

        def spanned():
            u, v = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            ids = np.unique(np.concatenate([u, v]))
            _, used = spanning(len(ids), np.searchsorted(ids, u), np.searchsorted(ids, v))
            return u[used], v[used]

        for batch in batches:
            held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
            if sum(len(x[0]) for x in held) > window:
                held = [spanned()]
                if len(held[0][0]) > window // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["u", "v"])
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in spanned()], names=["u", "v"])

    few = edges.select("u", "v")
    return few.coalesce(max(1, width(edges.sparkSession) // 16)).mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node in edges (u, v: long), root the smallest node reachable.

    Alternating large and small stars: each round is two grouped minima and two joins on node ids, so a hub's
    rows are combined before the shuffle and split by the skewed-join rule; nothing is gathered by the driver.
    """
    e = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = checkpointed(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components: more rounds are needed")
    root = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return root.union(e.select("v", "v").distinct().toDF("node", "root"))


#: A key that a thousandth of all rows or more hold is hot; there are HOT such keys at most.
HOT = 1_000


def with_hot_keys(rows: DataFrame, keys: DataFrame, on, count: str) -> DataFrame:
    """rows joined to keys (one per key; checkpointed, with the number of rows that hold each in `count`), every row once; a hot key does not meet its rows in one task.

    The HOT keys at most that hold a HOT-th of all rows each are sent to the rows; the others are joined by a shuffle, where each is small.
    """
    total = keys.agg(F.sum(count)).first()[0] or 0
    met = rows.join(F.broadcast(keys.where(F.col(count) * HOT >= total).withColumn("_hot", F.lit(True))), on, "left")
    rest = met.where("_hot is null").select(*[rows[c] for c in rows.columns]).join(keys.where(F.col(count) * HOT < total), on)
    names = [*rows.columns, *keys.columns]
    return met.where("_hot").select(*names).union(rest.select(*names))
