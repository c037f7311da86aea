"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpointed, width

#: Passes over a source at most, so that no document is taken more often.
PASSES = 2
#: Words of an item of a queue at most: longer documents queue in stretches, as one of them must not hold up the others.
QUANTUM = 512


def word_count(text: str | Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def running(rows: DataFrame, order: Sequence[Column], **values: Column) -> DataFrame:
    """rows, checkpointed, with running sums of values in a global order, the row itself included.

    Rows are dealt out by ranges of the order; sums within a range are added to the totals of the ranges before it, of
    which there is one row each. No window reaches over more than a range.
    """
    n = width(rows.sparkSession)
    names = list(values)
    ranged = rows.select("*", *[v.alias(f"_{k}") for k, v in values.items()])
    ranged = checkpointed(ranged.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy("_range").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in names])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_range", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_base_{k}") for k in names])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = ranged.select("*", *[F.sum(f"_{k}").over(inside).alias(f"_sum_{k}") for k in names])
    summed = summed.join(F.broadcast(bases), "_range")  # at most n rows
    return summed.select(*rows.columns, *[(F.col(f"_sum_{k}") + F.col(f"_base_{k}")).alias(k) for k in names])


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5) -> DataFrame:
    """source, source_size, weight, source_start, target of each source in sizes (source, size).

    Sources in code point order, null last, get the weights in turn and share `share` times all sizes. A target
    stops at PASSES times its source's size; what is above is shared again by weight. In the order of (limit /
    weight) the stopped sources come first, so running sums over the table of sources give all targets at once.
    source_start is the size of all sources before it. The table has a row per source and may be as large as it likes.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = running(s, [F.col("source").asc_nulls_last()], rank=F.lit(1).cast("long"), source_end=F.col("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(PASSES))
    s = s.select("source", "source_size", (F.col("source_end") - F.col("source_size")).alias("source_start"), weight.alias("weight"), limit.alias("limit"))
    order = [(F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last()]
    s = running(s, order, up_limit=F.col("limit"), up_weight=F.col("weight"))
    all_size, all_weight = s.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = float(all_size or 0) * share
    level = (F.lit(budget) - (F.col("up_limit") - F.col("limit"))) / (F.lit(float(all_weight or 1)) - (F.col("up_weight") - F.col("weight")))
    s = s.withColumn("level", level).withColumn("stopped", F.col("limit") <= F.col("weight") * F.col("level"))
    cut = s.where("not stopped").agg(F.min(F.struct((F.col("limit") / F.col("weight")).alias("at"), F.col("level").alias("level")))).first()[0]
    open_ = F.col("weight") * F.lit(float(cut.level) if cut else None).cast("double")
    return s.select("source", "source_size", "weight", "source_start", F.when(F.col("stopped"), F.col("limit")).otherwise(open_).alias("target"))


def fair_queue(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, seed: str = "mix") -> DataFrame:
    """The queue as items: row (an id of the row of docs), doc_id, source, size, source_size, target, pass, stretch, words, finish, offset, taken.

    docs has doc_id, source and text. Documents of a source queue in the order of a hash of seed and doc_id, long ones in stretches of
    QUANTUM words, and queue again up to PASSES times. An item's virtual finish time is the words queued in its
    source up to its end, divided by the weight. All items are sorted globally by finish time and taken until the
    total budget (`share` times all words) is used up; the item that reaches it is cut there, and what follows is not taken. offset
    is the place of an item in the mix (words before it). Nothing else decides what is taken: a source's words
    come out near its target (within about QUANTUM words of each source) because its queue is served at its weight, and a
    source that stops at PASSES times its size does so because its queue is empty.

    Running sums are made over ranges of a global order, so no source is gathered in one task. Null texts and texts
    without words have size 0 and no items; a null source is a source; rows with the same doc_id are separate; an
    empty table gives no items.
    """
    items, rows = _queued(docs, weights, share, seed)
    return items.join(rows.select("row", "doc_id", "source", "size", "source_size", "target"), "row").select("row", "doc_id", "source", "size", "source_size", "target", "pass", "stretch", "words", "finish", "offset", "taken")


def _queued(docs: DataFrame, weights: Sequence[float], share: float, seed: str) -> tuple[DataFrame, DataFrame]:
    """Items (row, pass, stretch, words, finish, offset, taken), and the rows of docs (row, doc_id, source, size, source_size, target)."""
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count("text").alias("size"))
    sized = checkpointed(sized.select("doc_id", "source", "size", key.alias("shuffle_key"), F.monotonically_increasing_id().alias("row")))  # the only pass over the texts
    targets = checkpointed(source_targets(sized, weights, share))
    order = [F.col("source").asc_nulls_last(), *(F.col(c).asc_nulls_first() for c in ("shuffle_key", "doc_id", "size", "row"))]
    queued = running(sized, order, end=F.col("size"))
    queued = queued.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    queued = queued.withColumn("start", F.col("end") - F.col("size") - F.col("source_start"))
    items = queued.where("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1))).alias("pass"))
    items = items.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / QUANTUM))).alias("stretch"))
    done = F.least("size", (F.col("stretch") + 1) * QUANTUM)
    items = items.select("row", "source", "pass", "stretch", (done - F.col("stretch") * QUANTUM).alias("words"), ((F.col("start") + F.col("pass") * F.col("source_size") + done) / F.col("weight")).alias("finish"))
    # finish times of one source differ, so this order has no ties
    served = running(items, [F.col("finish").asc(), F.col("source").asc_nulls_last()], until=F.col("words"))
    budget = int((sized.agg(F.sum("size")).first()[0] or 0) * share)
    taken = F.greatest(F.lit(0), F.least(F.col("words"), F.lit(budget) - F.col("until") + F.col("words"))).cast("long")
    items = served.select("row", "pass", "stretch", "words", "finish", F.least(F.col("until") - F.col("words"), F.lit(budget)).alias("offset"), taken.alias("taken"))
    return items, queued.select("row", "doc_id", "source", "size", "source_size", "target")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, seed: str = "mix") -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken (words of it in the mix, repeats counted), as fair_queue() takes them."""
    items, rows = _queued(docs, weights, share, seed)
    taken = items.groupBy("row").agg(F.sum("taken").alias("taken"))
    return rows.join(taken, "row", "left").select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with their columns, that the mix takes, each as often as whole copies of it are taken (half a copy counts as one)."""
    taken = mix(docs, **options).groupBy("doc_id").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    times = taken.select(F.col("doc_id").alias("m_doc_id"), F.round(F.col("taken") / F.when(F.col("size") > 0, F.col("size"))).cast("int").alias("m_copies")).where("m_copies > 0")
    return docs.join(times, F.col("doc_id").cast("long").eqNullSafe(F.col("m_doc_id"))).withColumn("m_copy_no", F.explode(F.sequence(F.lit(1), F.col("m_copies")))).select(*[docs[c] for c in docs.columns])
