"""Vector code compression: parts of vectors become indexes into codebooks that rounds of a filtering Lloyd refine."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, with_hot_keys

#: Vectors of a block, which has one tree for each part position; parts in a leaf, about.
BLOCK, LEAF = 8_192, 8
#: Nodes, and pairs of a part and an entry, that are compared at a time.
NODES, PAIRS = 1_024, 1 << 19
#: Integer components are below this, so that squared distances stay exact in 64 bits.
LARGEST = 1 << 28


def integers(vectors: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(which vectors are kept, their components as floor(256 * x)): null vectors and those with null or non-finite components are not."""
    flat = vectors.flatten()
    size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    x = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    end = np.cumsum(size)
    kept = vectors.is_valid().to_numpy(zero_copy_only=False) & (odd[end] == odd[end - size])
    dims = set(size[kept].tolist())
    if not dims:
        return kept, np.zeros((0, 0), np.int64)
    if len(dims) > 1 or max(dims) % parts or not max(dims):
        raise ValueError(f"vectors must be of one length that is a multiple of {parts}: {sorted(dims)[:5]}")
    v = np.floor(256 * x[np.repeat(kept, size)])
    if np.abs(v).max() >= LARGEST:
        raise ValueError(f"components must be below {LARGEST // 256} in absolute value")
    return kept, v.astype(np.int64).reshape(-1, max(dims))


def depth_of(n: int) -> int:
    return max(0, (n // LEAF).bit_length() - 1)


def _bounds(n: int, level: int) -> np.ndarray:
    """Node k of a level has the places from bounds[k] to bounds[k + 1] of the tree's order; its children are 2k and 2k + 1."""
    return n * np.arange((1 << level) + 1) >> level


def build(points: np.ndarray) -> np.ndarray:
    """Order (positions x n) of points (positions x n x d) in a kd-tree for each position: every node is halved across its widest side."""
    many, n, _ = points.shape
    order = np.tile(np.arange(n), (many, 1))
    at = np.arange(many)[:, None]
    for level in range(depth_of(n)):
        bounds = _bounds(n, level)
        now = points[at, order]
        side = np.maximum.reduceat(now, bounds[:-1], axis=1) - np.minimum.reduceat(now, bounds[:-1], axis=1)
        node = np.repeat(np.arange(1 << level), np.diff(bounds))
        value = np.take_along_axis(now, side.argmax(axis=2)[:, node][:, :, None], axis=2)[:, :, 0]
        key = ((at << level) + node[None, :] << 32) + value + LARGEST
        order = order.ravel()[np.argsort(key.ravel(), kind="stable")].reshape(many, n)
    return order


class Trees:
    """The trees of a block with what their nodes cache: bounding boxes, sums and counts, from the leaves (last level) to the roots."""

    def __init__(self, points: np.ndarray) -> None:
        """points (positions x n x d) in the order of build()."""
        self.points = points
        many, n, d = points.shape
        depth = depth_of(n)
        start = _bounds(n, depth)[:-1]
        low, high, total = (f.reduceat(points, start, axis=1) for f in (np.minimum, np.maximum, np.add))
        self.levels = [(low, high, total)]
        for level in range(depth - 1, -1, -1):
            low, high, total = (x.reshape(many, 1 << level, 2, d) for x in (low, high, total))
            low, high, total = low.min(axis=2), high.max(axis=2), total.sum(axis=2)
            self.levels.append((low, high, total))
        self.levels.reverse()
        self.bounds = [_bounds(n, level) for level in range(depth + 1)]

    def assign(self, books: np.ndarray, whole=None, single=None) -> int:
        """Nearest entry of books (positions x entries x d) of every part, ties to the lower index.

        A node keeps the entries that are nearest somewhere in its box: an entry is eliminated when the entry nearest to
        the box's middle is nearer at the corner that favours the other most. With one entry left, whole(position, level, node, entry) gets whole
        subtrees; parts of leaves with more left go to single(position, place, entry, distance). Returns the number of distances looked at.
        """
        entries = books.shape[1]
        looked = 0
        stack = [(0, np.arange(len(books)), np.zeros(len(books), np.int64), np.ones((len(books), entries), bool))]
        while stack:
            level, p, k, open_ = stack.pop()
            if len(p) > NODES:
                stack.append((level, p[NODES:], k[NODES:], open_[NODES:]))
                p, k, open_ = p[:NODES], k[:NODES], open_[:NODES]
            low, high = self.levels[level][0][p, k][:, None], self.levels[level][1][p, k][:, None]
            c = books[p]
            middle = np.where(open_, ((2 * c - low - high) ** 2).sum(axis=2), np.iinfo(np.int64).max)
            looked += int(open_.sum())
            best = middle.argmin(axis=1)
            ahead = c - c[np.arange(len(p)), best][:, None]
            norm = (c**2).sum(axis=2)
            least = norm - norm[np.arange(len(p)), best][:, None] - 2 * np.maximum(ahead * low, ahead * high).sum(axis=2)
            at = np.arange(entries)[None, :]
            open_ &= (least < 0) | ((least == 0) & (at <= best[:, None]))
            one = open_.sum(axis=1) == 1
            if one.any():
                whole(p[one], level, k[one], best[one])
            p, k, open_ = p[~one], k[~one], open_[~one]
            if not len(p):
                continue
            if level + 1 < len(self.levels):
                stack.append((level + 1, np.concatenate([p, p]), np.concatenate([2 * k, 2 * k + 1]), np.concatenate([open_, open_])))
            else:
                looked += self._leaves(level, p, k, open_, books, single)
        return looked

    def _leaves(self, level, p, k, open_, books, single) -> int:
        first, size = self.bounds[level][k], np.diff(self.bounds[level])[k]
        left = open_.sum(axis=1)
        entry = np.nonzero(open_)[1]
        start = np.cumsum(left) - left
        chunk = np.cumsum(left * size) // PAIRS
        for x in np.unique(chunk):
            own = np.flatnonzero(chunk == x)
            leaf = np.repeat(own, size[own])
            place = first[leaf] + np.arange(len(leaf)) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
            n = left[leaf]
            begin = np.cumsum(n) - n
            each = np.repeat(np.arange(len(leaf)), n)
            e = entry[start[leaf][each] + np.arange(len(each)) - begin[each]]
            distance = ((self.points[p[leaf], place][each] - books[p[leaf][each], e]) ** 2).sum(axis=1)
            nearest = np.minimum.reduceat(distance, begin)
            hit = np.flatnonzero(distance == nearest[each])
            hit = hit[np.concatenate([[True], each[hit[1:]] != each[hit[:-1]]])]
            single(p[leaf], place, e[hit], nearest)
        return int((left * size).sum())

    def sums(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums and counts of the parts that each entry gets, whole subtrees from their caches."""
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)

        def whole(p, level, k, entry):
            np.add.at(total, (p, entry), self.levels[level][2][p, k])
            np.add.at(count, (p, entry), np.diff(self.bounds[level])[k])

        def single(p, place, entry, _):
            np.add.at(total, (p, entry), self.points[p, place])
            np.add.at(count, (p, entry), 1)

        self.assign(books, whole, single)
        return total, count

    def codes(self, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each part, in the tree's order."""
        shape = self.points.shape[:2]
        code = np.zeros(shape, np.int64)

        def whole(p, level, k, entry):
            size = np.diff(self.bounds[level])[k]
            place = np.repeat(self.bounds[level][k] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            code[np.repeat(p, size), place] = np.repeat(entry, size)

        def single(p, place, entry, _):
            code[p, place] = entry

        self.assign(books, whole, single)
        return code, ((self.points - books[np.arange(shape[0])[:, None], code]) ** 2).sum(axis=2)


def _blocks(parts: int):
    """Kept vectors in blocks: ids and labels of a block, and, for all positions in turn, its parts in the order of the trees with the places that they come from."""

    def run(batches):
        for batch in batches:
            kept, v = integers(batch.column("embedding"), parts)
            ids, labels = (batch.column(c).filter(pa.array(kept)) for c in ("vec_id", "label"))
            for at in range(0, len(v), BLOCK):
                now = v[at : at + BLOCK]
                points = now.reshape(len(now), parts, -1).transpose(1, 0, 2)
                order = build(points)
                packed = points[np.arange(parts)[:, None], order].astype(np.int32)
                one = pa.array([0, len(now)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.ListArray.from_arrays(one, ids[at : at + BLOCK]), pa.ListArray.from_arrays(one, labels[at : at + BLOCK]), pa.array([now.shape[1]], pa.int32()), pa.array([order.astype(np.int32).tobytes()]), pa.array([packed.tobytes()])],
                    names=["ids", "labels", "dim", "places", "points"],
                )

    return run


def _opened(batch, books):
    """(row, trees, places) of each block of a batch."""
    parts, _, d = books.shape
    for i, (dim, places, points) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("dim", "places", "points")), strict=True)):
        if dim != parts * d:
            raise ValueError(f"vectors must be of one length: {dim}, {parts * d}")
        yield i, Trees(np.frombuffer(points, np.int32).reshape(parts, -1, d).astype(np.int64)), np.frombuffer(places, np.int32).reshape(parts, -1)


def _summing(books):
    parts, entries, d = books.shape

    def run(batches):
        total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for _, trees, _ in _opened(batch, books):
                t, c = trees.sums(books)
                total += t
                count += c
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), *(pa.array(total[p, e, k]) for k in range(d))], names=["p", "e", "n", *(f"s{k}" for k in range(d))])

    return run


def _coding(books, kinds):
    def run(batches):
        for batch in batches:
            for i, trees, places in _opened(batch, books):
                code, error = trees.codes(books)
                n = code.shape[1]
                of, total = np.zeros((n, len(books)), np.uint8), np.zeros(n, np.int64)
                for p in range(len(books)):
                    of[places[p], p] = code[p]
                    total[places[p]] += error[p]
                text = of.tobytes().hex()
                step = 2 * len(books)
                yield pa.RecordBatch.from_arrays([batch.column("ids").slice(i, 1).flatten(), batch.column("labels").slice(i, 1).flatten(), pa.array([text[x : x + step] for x in range(0, len(text), step)], pa.string()), pa.array(total)], names=kinds)

    return run


def codebooks(blocks: DataFrame, first: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Codebooks (positions x entries x d) after `rounds` rounds over the blocks, from `first`. Each round brings a row per entry to the driver, whatever the table's size."""
    books = first
    parts, entries, d = books.shape
    sums = [f"s{k}" for k in range(d)]
    for _ in range(rounds):
        part = blocks.mapInArrow(_summing(books), ", ".join(["p long", "e long", "n long", *(f"{c} long" for c in sums)]))
        new = books.copy()
        for r in part.groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums]).collect():
            new[r.p, r.e] = [r[c] // r.n for c in sums]
        books = new
    return books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """One row per kept row of vectors (vec_id, embedding, label): vec_id, code, error, label_error, codebooks_sha256.

    Rows whose embedding is null or holds a null or non-finite component are dropped. Components become floor(256 * x);
    vectors, which must be of one length, are cut into `parts` equal parts. Each position has a codebook of `entries` (256 at most) entries,
    at first those parts of the vectors of smallest vec_id (null last; equal ids by their components; fewer vectors: fewer entries).
    A round gives each part to its nearest entry (ties: the lower index) and replaces each used entry by the floor of its parts' mean.
    error is the squared distance of all parts after the last round, label_error its sum over rows of one label, nulls together.
    Equal vectors and repeated ids are rows of their own. An empty table, or one without kept rows, gives no rows. Other columns are not read.

    Vectors are held in blocks with a kd-tree for each position, built once and written to the shared folder. Every pass reads them and assigns
    whole subtrees where the boxes leave one entry. Only codebooks and the sums of their entries pass through the driver.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    label = rows.schema["label"].dataType
    kinds = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label)), T.StructField("dim", T.IntegerType()), T.StructField("places", T.BinaryType()), T.StructField("points", T.BinaryType())])
    blocks = checkpointed(rows.mapInArrow(_blocks(parts), kinds))
    finite = ~F.exists("embedding", lambda x: F.coalesce(F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")), F.lit(True)))
    scaled = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")))
    first = rows.where("embedding is not null").where(finite).select("vec_id", scaled.alias("v")).orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    final = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("label", label), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not first:
        return rows.sparkSession.createDataFrame([], T.StructType([final[0], *final[2:], T.StructField("label_error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())]))
    books = np.array([r.v for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    books = codebooks(blocks, books, rounds)
    coded = checkpointed(blocks.mapInArrow(_coding(books, final.names), final))
    sums = checkpointed(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")).withColumnRenamed("label", "of"))
    out = with_hot_keys(coded, sums, F.col("label").eqNullSafe(F.col("of")), "n")
    return out.select("vec_id", "code", "error", "label_error").withColumn("codebooks_sha256", F.lit(books_sha256(books)))
