"""Tables that several steps use are written once to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df from a checkpoint: later steps neither compute it again nor carry its plan, and a lost executor costs nothing.

    Where the session names no spark.checkpoint.dir, a local master gets a folder of its own; a cluster is refused.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            path = f"file://{tempfile.mkdtemp(prefix='polyrun-')}"
        context.setCheckpointDir(path)
    return df.checkpoint()


def width(df: DataFrame) -> int:
    """Partitions to deal rows out to that are few bytes and much work; Spark does not merge them if they are asked for by number."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never sent whole through the driver.

    Spark expects rows that are exploded, mapped or aggregated of a table to be as few bytes as its file, and would broadcast a genome and its index. While
    a plan runs it goes by compressed bytes: contexts that were under its limit of 10 MB so were 275 MB on the driver. What is left to it are catalogues: contigs, samples, ranges.
    """
    return df.hint("merge")
