"""Benchmark decontamination: greedy string tiling of each text with the benchmark items that share seeds with it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, checkpointed, pieces, ragged
from .rolling import Stretches
from .substrings import Words

#: Words of the shortest tile (a seed), and the share of an item's words that tiles must cover.
MIN_TILE, COVERAGE = 5, 0.5
#: Bytes of benchmark text that are sent to every task, at most; larger benchmarks are joined to the texts by seeds.
BLOCK_BYTES = 8 << 20
#: Pairs of places that are compared at a time.
PAIRS = 1 << 20

_PLAIN = bytes(b if chr(b).isalnum() or b >= 128 else 32 for b in range(256))


def plain_words(texts: list[bytes]) -> Words:
    """Words without case and ASCII punctuation."""
    return Words([t.decode("utf-8", "replace").lower().encode().translate(_PLAIN) for t in texts])


def _free(marked: np.ndarray) -> np.ndarray:
    """Of each place, how many unmarked ones follow, itself included."""
    at = np.arange(len(marked))
    stop = np.where(marked, at, len(marked))
    return (np.minimum.accumulate(stop[::-1])[::-1] if len(marked) else stop) - at


def _matches(a: np.ndarray, b: np.ndarray, ha: Stretches, hb: Stretches, marked_a: np.ndarray, marked_b: np.ndarray, s: int) -> np.ndarray:
    """Rows (words, place in a, place in b) of the maximal unmarked matches of s words or more.

    Stretches of s words are found in both by running Karp-Rabin hashes, PAIRS pairs of places at a time; a pair whose
    words before agree, too, belongs to a match that starts earlier. The others grow by halving steps on the hashes.
    """
    free_a, free_b = _free(marked_a), _free(marked_b)
    i, j = np.flatnonzero(free_a >= s), np.flatnonzero(free_b >= s)
    out = [np.zeros((0, 3), np.int64)]
    if not len(i) or not len(j):
        return out[0]
    va, vb = ha.hash(i, i + s), hb.hash(j, j + s)
    order = np.argsort(vb, kind="stable")
    vb, j = vb[order], j[order]
    lo, hi = np.searchsorted(vb, va, side="left"), np.searchsorted(vb, va, side="right")
    hit = hi > lo
    i, lo, hi = i[hit], lo[hit], hi[hit]
    total = np.cumsum(hi - lo)
    at = 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, side="right")))
        n = hi[at:to] - lo[at:to]
        x, y = np.repeat(i[at:to], n), j[ragged(lo[at:to], n)]
        later = (x > 0) & (y > 0)
        later[later] = (a[x[later] - 1] == b[y[later] - 1]) & ~marked_a[x[later] - 1] & ~marked_b[y[later] - 1]
        x, y = x[~later], y[~later]
        low, high = np.full(len(x), s), np.minimum(free_a[x], free_b[y])
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = ha.hash(x, x + mid) == hb.hash(y, y + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        out.append(np.stack([low, x, y], axis=1))
        at = to
    return np.concatenate(out)


def tiles(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two arrays of word hashes: (place in a, place in b, words), longest first, none overlapping.

    If a match of s unmarked words or more reaches twice s, s grows to it and the search is made again; else all matches are
    marked from the longest down, unless a longer one has taken their words, and s is halved, down to `least`.
    """
    marked_a, marked_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    ha, hb = Stretches(a), Stretches(b)
    out: list[tuple[int, int, int]] = []
    s = max(least, min(20, len(a), len(b)))
    while True:
        matches = _matches(a, b, ha, hb, marked_a, marked_b, s)
        if len(matches) and matches[:, 0].max() > 2 * s:
            s = int(matches[:, 0].max())
            continue
        again = False
        for n, x, y in matches[np.lexsort((matches[:, 2], matches[:, 1], -matches[:, 0]))].tolist():
            taken = marked_a[x : x + n] | marked_b[y : y + n]
            if taken.any():
                again |= n - int(taken.sum()) >= s  # a part of it may still be a match
                continue
            if (a[x : x + n] != b[y : y + n]).any():
                continue  # equal hashes of unequal words
            marked_a[x : x + n] = marked_b[y : y + n] = True
            out.append((x, y, n))
            if not (_free(marked_b) >= s).any():  # no room in b
                again = False
                break
        if again:
            continue
        if s <= least or not (_free(marked_b) >= least).any():
            return out
        s = max(least, s // 2)


class Items:
    """Benchmark items: their words as hashes, and their seeds in an index."""

    def __init__(self, ids: list[int], texts: list[bytes], least: int) -> None:
        w = plain_words(texts)
        self.ids, self.least = ids, least
        self.word = w.word
        self.before, self.count = w.before, w.count
        self.gram, self.full = w.gram(least)
        at = np.flatnonzero(self.full)
        order = np.argsort(self.gram[at], kind="stable")
        self.place = at[order]
        self.item = w.text[self.place]
        self.distinct, self.first, self.many = np.unique(self.gram[self.place], return_index=True, return_counts=True)

    def best(self, texts: list[bytes], share: float) -> list[tuple[float, int, int] | None]:
        """(coverage, item id, tiles) of the item that covers each text best (of equals the smallest id), if one reaches `share`."""
        out: list[tuple[float, int, int] | None] = [None] * len(texts)
        w = plain_words(texts)
        h, ok = w.gram(self.least)
        if not len(self.distinct) or not ok.any():
            return out
        # seeds of a text, each once, with the places that they have in items; texts at a time with PAIRS places about
        which = np.searchsorted(self.distinct, h)
        which = np.minimum(which, len(self.distinct) - 1)
        hit = np.flatnonzero(ok & (self.distinct[which] == h))
        if not len(hit):
            return out
        seeds = np.unique(w.text[hit].astype(np.int64) * len(self.distinct) + which[hit])
        text, seed = seeds // len(self.distinct), seeds % len(self.distinct)
        n = self.many[seed]
        word = None
        start = np.flatnonzero(np.concatenate([[True], np.diff(text) > 0]))
        total = np.add.reduceat(n, start)
        slice_ = np.cumsum(total) // PAIRS
        cut = np.append(start[np.flatnonzero(np.concatenate([[True], np.diff(slice_) > 0]))], len(text))
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            k = ragged(self.first[seed[a:z]], n[a:z])
            pair = np.repeat(text[a:z], n[a:z]) * len(self.count) + self.item[k]
            order = np.lexsort((self.place[k], pair))
            pair, place = pair[order], self.place[k][order]
            head = np.concatenate([[True], np.diff(pair) > 0])
            # words of an item that lie in a shared seed bound what tiles can cover: those of a place up to the next one
            covered = np.minimum(np.append(np.where(head[1:], self.least, np.diff(place)), self.least), self.least)
            at = np.flatnonzero(head)
            for p, c in zip(pair[at].tolist(), np.add.reduceat(covered, at).tolist(), strict=True):
                t, item = divmod(p, len(self.count))
                size = int(self.count[item])
                if c < share * size:
                    continue
                if word is None:
                    word = w.word
                own = np.arange(w.before[t], w.before[t] + w.count[t])
                got = self.tiled(word[own], h[own], ok[own], item)
                if got[0] >= share and (out[t] is None or (-got[0], got[1]) < (-out[t][0], out[t][1])):
                    out[t] = got
        return out

    def tiled(self, word: np.ndarray, seed: np.ndarray, ok: np.ndarray, item: int) -> tuple[float, int, int]:
        """(coverage, item id, tiles) of one item by one text, given its word hashes and its seed at each word."""
        size = int(self.count[item])
        mine = self.word[self.before[item] : self.before[item] + size]
        h, full = self.gram[self.before[item] : self.before[item] + size], self.full[self.before[item] : self.before[item] + size]
        places = np.flatnonzero(ok & np.isin(seed, h[full]))
        edge = np.bincount(places, minlength=len(word) + 1) - np.bincount(np.minimum(places + self.least, len(word)), minlength=len(word) + 1)
        near = np.flatnonzero(np.cumsum(edge)[: len(word)] > 0)  # words in shared seeds; a gap between stretches is no word of the item
        stretch = np.concatenate([[True], np.diff(near) > 1])
        text = np.insert(word[near], np.flatnonzero(stretch), np.arange(int(stretch.sum()), dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        found = tiles(text, mine, self.least)
        return sum(x[2] for x in found) / size, self.ids[item], len(found)


def _usable(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")


def _small(benchmark: DataFrame, least: int, most: int) -> Items | None:
    """The index of the whole benchmark, if its texts have `most` bytes at most."""
    if (benchmark.agg(F.sum(F.octet_length("text").cast("long") + 64)).first()[0] or 0) > most:
        return None
    rows = sorted(benchmark.collect(), key=lambda r: (r.item_id, r.text))
    return Items([r.item_id for r in rows], [r.text.encode() for r in rows], least)


_RESULT = "doc_id long, contaminated boolean, item_id long, coverage double, n_tiles long"


def contamination(docs: DataFrame, benchmark: DataFrame, least: int = MIN_TILE, share: float = COVERAGE, sent_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, contaminated, item_id, coverage, n_tiles.

    A text is contaminated if tiles of at least `least` words cover a share of `share` of the words of a benchmark item, in any
    order; item_id is the item with the largest coverage (of equals the smallest id), coverage its covered share.
    Other texts have null item_id, coverage 0 and no tiles. Case and punctuation do not count. Items of fewer than `least` words
    cannot be told from chance and match nothing, nor do null ones. A benchmark of at most sent_bytes is sent to the texts, which
    are not shuffled; a larger one is joined to them by seeds (see _joined). Null and empty texts are clean; long
    texts are looked at whole, in memory in proportion to their length.
    """
    b = _usable(benchmark)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = _small(b, least, sent_bytes)
    if items is None:
        found = _joined(d, b, least, share)
        of = d.select("doc_id", F.xxhash64("text").alias("t"))
        hit = of.join(found.withColumnRenamed("doc_id", "f_doc_id"), F.col("doc_id").eqNullSafe(F.col("f_doc_id")) & (F.col("t") == F.col("f_t")), "left")
        return hit.select("doc_id", F.col("item_id").isNotNull().alias("contaminated"), "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("n_tiles", F.lit(0).cast("long")).alias("n_tiles"))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                best = items.best(byte_values(part.column("text")), share)
                item, coverage, n = zip(*[(x[1], float(x[0]), x[2]) if x else (None, 0.0, 0) for x in best], strict=True)
                cols = [part.column("doc_id"), pa.array([x is not None for x in best]), pa.array(item, pa.int64()), pa.array(coverage, pa.float64()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "contaminated", "item_id", "coverage", "n_tiles"])

    return d.mapInArrow(run, _RESULT)


def _seeds(rows: DataFrame, key: str, least: int) -> DataFrame:
    """(key, t, seed, many, size): each seed of each text once, with how often it occurs; t is a hash of the text, size its words."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                w = plain_words(byte_values(part.column("text")))
                h, ok = w.gram(least)
                pair, many = np.unique(np.stack([w.text[ok].astype(np.uint64), h[ok]], axis=1), axis=0, return_counts=True) if ok.any() else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
                at = pair[:, 0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(at)), part.column("t").take(pa.array(at)), pa.array(pair[:, 1].view(np.int64) if len(at) else np.zeros(0, np.int64)), pa.array(many), pa.array(w.count[at].astype(np.int64))], names=[key, "t", "seed", "many", "size"])

    return rows.select(key, F.xxhash64("text").alias("t"), "text").mapInArrow(run, f"{key} long, t long, seed long, many long, size long")


def _joined(docs: DataFrame, benchmark: DataFrame, least: int, share: float) -> DataFrame:
    """(f_t, doc_id, item_id, coverage, n_tiles) of the contaminated texts, for benchmarks of any size.

    Seeds of texts and items are joined by hash. A tile of n words has at least n / least seeds, so an item can only be
    covered by a text that shares share / least of its words as seeds; such pairs of a text and an item are tiled.
    Texts are told apart by doc_id and a hash; equal rows have one answer.
    """
    mine = _seeds(docs, "doc_id", least).select("doc_id", "t", "seed")
    theirs = _seeds(benchmark, "item_id", least).select("item_id", F.col("t").alias("i_t"), "seed", "many", "size")
    pairs = mine.distinct().join(theirs.distinct(), "seed").groupBy("doc_id", "t", "item_id", "i_t").agg(F.sum("many").alias("shared"), F.first("size").alias("size"))
    pairs = checkpointed(pairs.where(F.col("shared") * least >= F.col("size") * share).select("doc_id", "t", "item_id", "i_t"))
    texts = docs.select(F.col("doc_id").alias("d_id"), F.xxhash64("text").alias("d_t"), "text").dropDuplicates(["d_id", "d_t"])
    items = benchmark.select(F.col("item_id").alias("b_id"), F.xxhash64("text").alias("b_t"), F.col("text").alias("item")).dropDuplicates(["b_id", "b_t"])
    both = pairs.join(items, (F.col("item_id") == F.col("b_id")) & (F.col("i_t") == F.col("b_t"))).join(texts, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("t") == F.col("d_t")))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = []
                for text, item, i in zip(byte_values(part.column("text")), byte_values(part.column("item")), part.column("item_id").to_pylist(), strict=True):
                    (got,) = Items([i], [item], least).best([text], share)
                    rows.append((got[1], float(got[0]), got[2]) if got else (None, 0.0, 0))
                item, coverage, n = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("t"), pa.array(item, pa.int64()), pa.array(coverage, pa.float64()), pa.array(n, pa.int64())], names=["doc_id", "f_t", "item_id", "coverage", "n_tiles"])

    tiled = both.select("doc_id", "t", "item_id", "item", "text").mapInArrow(run, "doc_id long, f_t long, item_id long, coverage double, n_tiles long").where("item_id is not null")
    best = tiled.groupBy("doc_id", "f_t").agg(F.max_by(F.struct("item_id", "coverage", "n_tiles"), F.struct("coverage", -F.col("item_id"), "n_tiles")).alias("x"))
    return checkpointed(best.select("doc_id", "f_t", "x.item_id", "x.coverage", "x.n_tiles"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = MIN_TILE, share: float = COVERAGE, sent_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, with its columns, without contaminated rows."""
    b = _usable(benchmark)
    items = _small(b, least, sent_bytes)
    if items is None:
        found = _joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), b, least, share).select(F.col("doc_id").alias("f_doc_id"), "f_t")
        return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col("f_doc_id")) & (F.xxhash64(docs["text"]) == F.col("f_t")), "left_anti")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                yield part.filter(pa.array([x is None for x in items.best(byte_values(part.column("text")), share)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
