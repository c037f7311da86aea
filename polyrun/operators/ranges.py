"""Sequential folds over rows in a global order, a range of rows a task.

A fold looks at each row in turn with the group that is open, and either adds the row or closes the group and opens the next.
What a range does depends on what came before it only through that open group, and a row that is farther from the one before than any rule
reaches opens a group whatever was open. So every range first folds only what follows its last such gap: that gives the
group that it leaves open. Each range is then folded once, from the group that the range before left open, and closes that
group in its place. A range without any gap passes on what it gets: it is folded from its predecessor's group as soon as that is known,
which takes as many rounds as there are such ranges in a row.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from polyrun.sources.shared import checkpointed

#: Rows after the last gap that a task keeps before it folds them.
TAIL = 20_000

Step = Callable[[Any, dict], tuple[Any, Any]]
"""(open group or None, row) -> (open group, what is closed or told of the row, or None)."""


def in_ranges(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """df in ranges of (by, location), each in order, with _part, the number of the range; rows with equal (by, location) share a range."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    d = df.repartitionByRange(n, *by, "location").sortWithinPartitions(*by, "location", *order)
    return checkpointed(d.withColumn("_part", F.spark_partition_id()))


def _gaps(batch: pa.RecordBatch, by: list[str], gap: int, before: tuple | None) -> np.ndarray:
    """Whether each row opens a group whatever was open: its `by` differs from that of the row before, or its location is more than gap away."""
    at = np.diff(batch.column("location").to_numpy(), prepend=before[1] if before else 0) > gap
    for i, c in enumerate(by):
        v = batch.column(c).to_numpy()
        at |= np.concatenate([[before is not None and v[0] != before[0][i]], v[1:] != v[:-1]])
    if before is None:
        at[0] = False  # what is before the range decides
    return at


def _tails(step: Step, by: list[str], gap: int, given: dict[int, bytes] | None):
    """A row per range: _part, n, whether the state is certain, the state. given: states to start from, of the ranges to be done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part, certain, before, state = 0, None, False, None, None
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if part is None:
                part = batch.column("_part")[0].as_py()
                if given is not None and part not in given:
                    return
                if given is not None:
                    state, certain = pickle.loads(given[part]), True
            n += batch.num_rows
            hit = np.flatnonzero(_gaps(batch, by, gap, before))
            before = tuple(batch.column(c)[-1].as_py() for c in by), batch.column("location")[-1].as_py()
            if len(hit):
                kept, state, certain = [], None, True
                batch = batch.slice(int(hit[-1]))
            kept.append(batch)
            if sum(x.num_rows for x in kept) > TAIL:
                for r in (r for x in kept for r in x.to_pylist()):
                    state, _ = step(state, r)
                kept = []
        if part is None:
            return
        for r in (r for x in kept for r in x.to_pylist()):
            state, _ = step(state, r)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([certain]), pa.array([pickle.dumps(state)], pa.binary())], names=["_part", "n", "certain", "state"])

    return run


def open_groups(ranged: DataFrame, by: list[str], gap: int, step: Step) -> tuple[dict[int, bytes], list[tuple[int, int]]]:
    """The group that each range starts with, and (range, rows) of the ranges that have rows. One row per range comes to the driver."""
    kinds = "_part int, n long, certain boolean, state binary"
    found = {r["_part"]: r for r in ranged.mapInArrow(_tails(step, by, gap, None), kinds).collect()}
    parts = sorted(found)
    state = {p: bytes(found[p].state) for p in parts if found[p].certain or p == parts[0]}
    while len(state) < len(parts):
        todo = {p: state[q] for q, p in zip(parts, parts[1:], strict=False) if p not in state and q in state}
        state |= {r["_part"]: bytes(r.state) for r in ranged.mapInArrow(_tails(step, by, gap, todo), kinds).collect()}
    return {p: state[q] for q, p in zip(parts, parts[1:], strict=False)}, [(p, found[p].n) for p in parts]


def fold_ranges(ranged: DataFrame, by: list[str], gap: int, step: Step, finish: Callable[[Any], dict], schema: str, arrow: pa.Schema) -> DataFrame:
    """One row, finish(group), per group of a fold over all ranges."""
    start, parts = open_groups(ranged, by, gap, step)
    last = parts[-1][0] if parts else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = state = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if part is None:
                    part = r["_part"]
                    state = pickle.loads(start[part]) if part in start else None
                state, closed = step(state, r)
                if closed is not None:
                    out.append(finish(closed))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if part is not None and part == last:
            yield pa.RecordBatch.from_pylist([finish(state)], schema=arrow)

    return ranged.mapInArrow(run, schema)
