"""Merging of neighbours in location order: contexts into histograms, histograms into one another, and across samples into tracts.

Each rule compares a row with the last group only, so all three are folds over ranges of the genome (ranges.py).
"""

from __future__ import annotations

import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from polyrun.options import Options
from polyrun.sources.shared import checkpointed

from .ranges import fold_ranges, in_ranges, open_groups

HISTOGRAM = "sample_idx int, base string, name string, contexts array<string>, n_context int, integral long, location long, ref_id int, loc_pos int, loc_last int, mismatches int, neg_strand boolean, multi boolean, indel boolean, mode_count long, mode_length int, mode_left string, mode_right string, lengths array<struct<length:int,count:bigint>>"
_PLAIN = ["sample_idx", "base", "left_ctx", "right_ctx", "length", "count", "location", "ref_id", "loc_pos", "loc_last", "mismatches", "neg_strand", "multi"]
_COMPLEMENT = str.maketrans("ACGT", "TGCA")


@lru_cache(maxsize=1 << 16)
def levenshtein(a: str, b: str) -> int:
    """Edits between two strings: a column of differences is two integers with a bit per symbol of a."""
    if not a:
        return len(b)
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    plus, minus = full, 0
    for c in b:
        eq = masks.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (~(d | plus) & full), plus & d
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = down | (~(x | up) & full), up & x
    return score


def _name(left: str, base: str, right: str, neg: bool) -> str:
    return f"{right.translate(_COMPLEMENT)[::-1]}.{base.translate(_COMPLEMENT)}.{left.translate(_COMPLEMENT)[::-1]}" if neg else f"{left}.{base}.{right}"


def _differ(a: str, b: str, cap: int) -> int:
    return 0 if a == b else min(cap, sum(x != y for x, y in zip(a, b, strict=True)))


def context_distance(h: dict, e: dict, options: Options) -> tuple[int | None, int]:
    """(distance or None if out of reach, index of the equal context or -1) of an element and a histogram: the largest over its contexts."""
    if h["base"] != e["base"] or h["ref_id"] != e["ref_id"] or abs(e["location"] - h["location"]) > options.min_tract:
        return None, -1
    cap, most = 2 * options.max_dist, 0
    for i, c in enumerate(h["contexts"]):
        left, right = c.split(".")
        d = _differ(left, e["left_ctx"], cap)
        if d < cap:
            d += _differ(right, e["right_ctx"], cap - d)
        if d >= cap:
            return d, -1
        if d == 0:
            return 0, i
        most = max(most, d)
    return most, -1


def context_step(options: Options):
    """Adds an element to the open histogram of its sample, or closes it; an element is compared with the last histogram only."""

    def step(h: dict | None, e: dict) -> tuple[dict, dict | None]:
        name, context = _name(e["left_ctx"], e["base"], e["right_ctx"], e["neg_strand"]), f"{e['left_ctx']}.{e['right_ctx']}"
        joined, closed, match = False, None, -1
        if h is not None and h["sample_idx"] == e["sample_idx"]:
            d, match = context_distance(h, e, options)
            if d is not None and d < options.max_dist:
                joined = True
            elif d is not None and levenshtein(h["name"], name) < options.leven:
                joined = h["indel"] = True
        if not joined:
            closed = h
            h = {"contexts": [], "n_context": 0, "integral": 0, "mode_count": 0, "indel": False, "multi": False, "lengths": {}, "base": e["base"], "sample_idx": e["sample_idx"]}
            match = -1
        if match < 0:
            h["contexts"].append(context)
            h["n_context"] += 1
        if h["mode_count"] < e["count"]:
            h.update(mode_count=e["count"], mode_length=e["length"], mode_left=e["left_ctx"], mode_right=e["right_ctx"], name=name, **{c: e[c] for c in ("location", "ref_id", "loc_pos", "loc_last", "mismatches", "neg_strand")})
        h["multi"] |= e["multi"]
        h["integral"] += e["count"]
        h["lengths"][e["length"]] = h["lengths"].get(e["length"], 0) + e["count"]
        return h, closed

    return step


def overlap(a: dict, b: dict, options: Options) -> int | None:
    """Distance of names if two histograms are at one place or near and alike, else None."""
    if a["ref_id"] != b["ref_id"] and not options.compat:
        return None
    apart = abs(a["location"] - b["location"])
    if apart == 0:
        return 0
    if apart > min(a["mode_length"], b["mode_length"]) - 1 or a["base"] != b["base"]:
        return None
    d = levenshtein(a["name"], b["name"])
    return d if d <= options.leven else None


def histogram_step(options: Options):
    """Merges a histogram into the last one kept of its sample if they overlap."""

    def step(to: dict | None, h: dict) -> tuple[dict, dict | None]:
        lengths = h["lengths"] if isinstance(h["lengths"], dict) else {x["length"]: x["count"] for x in h["lengths"]}
        h = {**h, "lengths": lengths}
        if to is None or to["sample_idx"] != h["sample_idx"] or overlap(to, h, options) is None:
            return h, to
        lengths = dict(to["lengths"])
        for n, c in h["lengths"].items():
            lengths[n] = lengths.get(n, 0) + c
        first, second = (h, to) if to["mode_count"] < h["mode_count"] else (to, h)
        contexts = list(dict.fromkeys(first["contexts"] + second["contexts"]))
        return {**first, "contexts": contexts, "n_context": len(contexts), "lengths": lengths, "integral": to["integral"] + h["integral"], "multi": to["multi"] | h["multi"], "indel": to["indel"] | h["indel"]}, None

    return step


def tract_step(options: Options):
    """(leader, distance to it or None if the row leads the next tract) of each histogram in order."""

    def step(leader: dict | None, h: dict) -> tuple[dict, int | None]:
        d = None if leader is None else overlap(h, leader, options)
        return ({c: h[c] for c in ("ref_id", "location", "mode_length", "base", "name")} if d is None else leader), d

    return step


def _finished(h: dict) -> dict:
    return {**{f.name: h[f.name] for f in _ARROW if f.name != "lengths"}, "lengths": [{"length": n, "count": c} for n, c in sorted(h["lengths"].items())]}


_ARROW = pa.schema(
    [("sample_idx", pa.int32()), ("base", pa.string()), ("name", pa.string()), ("contexts", pa.list_(pa.string())), ("n_context", pa.int32()), ("integral", pa.int64()), ("location", pa.int64()), ("ref_id", pa.int32()), ("loc_pos", pa.int32()), ("loc_last", pa.int32()), ("mismatches", pa.int32()), ("neg_strand", pa.bool_()), ("multi", pa.bool_()), ("indel", pa.bool_()), ("mode_count", pa.int64()), ("mode_length", pa.int32()), ("mode_left", pa.string()), ("mode_right", pa.string()), ("lengths", pa.list_(pa.struct([("length", pa.int32()), ("count", pa.int64())])))]
)


def cluster_contexts(located: DataFrame, options: Options) -> DataFrame:
    """Histograms of contexts that are near and alike, per sample."""
    d = in_ranges(located.select(*_PLAIN), ["sample_idx"], [F.desc("length"), F.col("base"), F.reverse("left_ctx"), F.reverse("right_ctx")])
    return fold_ranges(d, ["sample_idx"], options.min_tract, context_step(options), _finished, HISTOGRAM, _ARROW)


def _reach(histograms: DataFrame) -> int:
    """How far apart two histograms that overlap can be, at most."""
    return (histograms.agg(F.max("mode_length")).first()[0] or 1) - 1


def merge_histograms(histograms: DataFrame, options: Options) -> DataFrame:
    """Neighbouring histograms of a sample that overlap become one. compat: the last one of each sample is dropped."""
    d = in_ranges(histograms, ["sample_idx"], [F.col("base"), F.col("name")])
    out = fold_ranges(d, ["sample_idx"], _reach(d), histogram_step(options), _finished, HISTOGRAM, _ARROW)
    if options.compat:
        out = checkpointed(out)
        last = out.groupBy("sample_idx").agg(F.max("location").alias("last"))
        out = out.join(last, "sample_idx").where("location < last").drop("last")
    return out


def assign_tracts(histograms: DataFrame, options: Options) -> DataFrame:
    """Histograms of all samples with concat_idx (place in order of location, larger sample first), tract_id and lev (distance to the tract's leader).

    The rows are not moved again after they are in ranges: each range tells its places and the tracts that it begins, and is added the totals of the ranges before, of which there is a row each.
    """
    ranged = in_ranges(histograms, [], [F.desc("sample_idx"), F.col("name")])
    step = tract_step(options)
    start, _ = open_groups(ranged, [], _reach(ranged), step)

    def run(batches):
        part = leader = None
        n = t = 0
        for batch in batches:
            levs, tracts = [], []
            slim = batch.select(["ref_id", "location", "mode_length", "base", "name", "_part"])
            for r in slim.to_pylist():
                if part is None:
                    part = r["_part"]
                    leader = pickle.loads(start[part]) if part in start else None
                leader, d = step(leader, r)
                t += d is None
                tracts.append(t)
                levs.append(d or 0)
            place = np.arange(n, n + batch.num_rows)
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64()), pa.array(tracts, pa.int64()), pa.array(levs, pa.int32())], names=[*batch.schema.names, "_n", "_t", "lev"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema)
    led = checkpointed(ranged.mapInArrow(run, f"{kinds}, _n long, _t long, lev int"))
    sums = led.groupBy("_part").agg(F.count("*").alias("_rows"), F.max("_t").alias("_tracts"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sums = sums.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_tracts").over(before), F.lit(0)).alias("_t0"))
    out = led.join(F.broadcast(sums), "_part")
    return out.withColumn("concat_idx", (F.col("_n0") + F.col("_n")).cast("int")).withColumn("tract_id", (F.col("_t0") + F.col("_t") - 1).cast("int")).drop("_part", "_n", "_t", "_n0", "_t0")


def numbered(histograms: DataFrame) -> DataFrame:
    """histograms with tract_id (rank of their location) and concat_idx (place in order of location, larger sample first).

    Places are counted within ranges of location and added to the totals of the ranges before, of which there is a row each;
    a location lies in one range.
    """
    d = checkpointed(histograms.repartitionByRange("location").withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy("_part").orderBy("location", F.desc("sample_idx"))
    sums = d.groupBy("_part").agg(F.count("*").alias("_n"), F.count_distinct("location").alias("_t"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_t0"))
    out = d.withColumn("concat_idx", F.row_number().over(w) - 1).withColumn("tract_id", F.dense_rank().over(Window.partitionBy("_part").orderBy("location")) - 1).join(F.broadcast(sums), "_part")
    return out.withColumn("concat_idx", (F.col("concat_idx") + F.col("_n0")).cast("int")).withColumn("tract_id", (F.col("tract_id") + F.col("_t0")).cast("int")).drop("_part", "_n0", "_t0")
