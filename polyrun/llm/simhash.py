"""SimHash near-dedup: fingerprints, their links by a Gray-order hierarchical index, and components."""

from __future__ import annotations

import random
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, checkpointed, components, pieces, spanning, thinned, width, with_hot_keys
from .ngram_join import region_links, shingle_set

#: Rows of one upper node that a task holds at a time; larger nodes are split by more of their bits.
NODE_ROWS = 16_384
FAN = 8
#: Pairs of nodes that are opened at a time; each makes up to FAN * FAN pairs below it.
PAIRS = 2_500
#: Bits of 256 that candidates may differ in: of a pair of similarity 0.8, 39 are expected with a deviation of 5.7 (0.4 % differ in more).
BITS_APART = 54


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `shingle` words of the text in lower case; fewer words: of all of them; none: empty."""
    words = text.lower().split()
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)] if words else [], np.uint64)
    joined = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate([[0], end[: -shingle] + 1])
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(first.tolist(), end[shingle - 1 :].tolist(), strict=True)], np.uint64)


def _more(h: np.ndarray, word: int) -> np.ndarray:
    """Another 64 bits from a hash, by a finalising mix."""
    if word:
        h = h ^ np.uint64(0x9E3779B97F4A7C15 * word % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return h


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each document (counts[i] hashes in turn) the 64 bits that are set in over half its hashes."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    # 0/1 bytes, eight to a lane; a lane can add 255 rows
    lanes = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
    n = counts[full]
    blocks = (n + 254) // 255
    start = np.cumsum(n) - n
    cut = np.repeat(start, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
    part = np.add.reduceat(lanes, cut, axis=0).view(np.uint8).astype(np.int64)
    total = np.add.reduceat(part, np.cumsum(blocks) - blocks, axis=0)
    out[full] = np.packbits(2 * total > n[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def fingerprints(docs: DataFrame, shingle: int, words: int = 1) -> DataFrame:
    """doc_id and the fingerprint of each row of docs as `words` longs f0, f1, ...; texts without words: zero."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                each = [shingle_hashes(t, shingle) for t in byte_values(part.column("text"))]
                n = np.fromiter(map(len, each), np.int64, len(each))
                h = np.concatenate(each)
                cols = [pa.array(majority(_more(h, k), n).view(np.int64)) for k in range(words)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], names=["doc_id", *(f"f{k}" for k in range(words))])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(["doc_id long", *(f"f{k} long" for k in range(words))]))


def gray_links(f: np.ndarray, group: np.ndarray, limits: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside groups: index pairs (a, b) of rows of f that differ in limits[-1] bits at most.

    f is rows x words of uint64, each group contiguous and in Gray order, so neighbours share many bits. Nodes of FAN
    rows keep the bits that all their rows share, upper nodes those of FAN nodes, and so on up to one node a group.
    Pairs of nodes are followed downwards from the top; a pair is pruned, with all rows below it, when the shared
    bits alone differ in too many places, or when everything below is linked already. Smaller limits are
    tried first, so that the forest prefers close links.
    """
    n = len(f)
    label = np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def link(a, b):
        _, used = spanning(n, a, b, label)
        found.append((a[used], b[used]))

    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(starts, n))
    levels = []  # (first child, children) of each node; leaves' children are rows
    first, count = starts, size
    while True:
        nodes = (count + FAN - 1) // FAN
        top = np.cumsum(nodes) - nodes
        rank = np.arange(nodes.sum()) - np.repeat(top, nodes)
        at = np.repeat(first, nodes) + FAN * rank
        levels.append((at, np.minimum(FAN, np.repeat(first + count, nodes) - at)))
        if (nodes == 1).all():
            break
        first, count = top, nodes
    ands, ors = [], []
    below_a = below_o = f
    for at, _ in levels:
        below_a, below_o = np.bitwise_and.reduceat(below_a, at, axis=0), np.bitwise_or.reduceat(below_o, at, axis=0)
        ands.append(below_a)
        ors.append(below_o)
    shared = [~(a ^ o) for a, o in zip(ands, ors, strict=True)]

    for limit in limits:
        for step in range(1, 4):
            a = np.flatnonzero(group[step:] == group[:-step]) if n > step else np.zeros(0, np.int64)
            near = np.bitwise_count(f[a] ^ f[a + step]).sum(axis=1) <= limit
            link(a[near], a[near] + step)
        low, high, of = [], [], label
        of_high = label
        for at, _ in levels:
            of, of_high = np.minimum.reduceat(of, at), np.maximum.reduceat(of_high, at)
            low.append(of)
            high.append(of_high)
        root = np.flatnonzero(size > 1)
        stack = [(len(levels) - 1, root, root)]
        while stack:
            level, u, v = stack.pop()
            if len(u) > PAIRS:
                stack.append((level, u[PAIRS:], v[PAIRS:]))
                u, v = u[:PAIRS], v[:PAIRS]
            apart = np.bitwise_count((ands[level][u] ^ ands[level][v]) & shared[level][u] & shared[level][v]).sum(axis=1)
            one = (low[level][u] == high[level][v]) & (high[level][u] == low[level][v]) & (low[level][u] == high[level][u])
            keep = (apart <= limit) & ~one
            u, v = u[keep], v[keep]
            if not len(u):
                continue
            at, children = levels[level]
            cu, cv = children[u], children[v]
            total = cu * cv
            pair = np.repeat(np.arange(len(u)), total)
            k = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
            x, y = at[u][pair] + k // cv[pair], at[v][pair] + k % cv[pair]
            if level:
                ordered = x <= y
                stack.append((level - 1, x[ordered], y[ordered]))
            else:
                ordered = (x < y) & (label[x] != label[y])
                x, y = x[ordered], y[ordered]
                near = np.bitwise_count(f[x] ^ f[y]).sum(axis=1) <= limit
                link(x[near], y[near])
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def pigeonhole_masks(limit: int, depth: int = 4) -> list[dict[tuple, list[tuple]]]:
    """For each depth, node mask -> masks of the nodes below. Rows that differ in `limit` bits agree on one of limit + 1 parts of the free bits."""

    def below(mask: int) -> list[tuple]:
        free = [b for b in range(64) if not mask >> b & 1]
        return [(mask | sum(1 << b for b in x),) for x in (free[len(free) * k // (limit + 1) : len(free) * (k + 1) // (limit + 1)] for k in range(limit + 1))]

    out, now = [], [(0,)]
    for _ in range(depth):
        out.append({m: below(m[0]) for m in now})
        now = [x for m in now for x in out[-1][m]]
    return out


def sampled_masks(words: int, bits: int, tables: int, seed: int = 7) -> list[dict[tuple, list[tuple]]]:
    """As pigeonhole_masks, of bits drawn at random: tables masks of `bits` bits; links() splits their large nodes by blocks."""
    rng = random.Random(seed)

    def mask() -> tuple:
        out = [0] * words
        for b in rng.sample(range(64 * words), bits):
            out[b // 64] |= 1 << b % 64
        return tuple(out)

    return [{(0,) * words: [mask() for _ in range(tables)]}]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def links(nodes: DataFrame, words: int, masks: list[dict[tuple, list[tuple]]], limits: Sequence[int]) -> DataFrame:
    """(u, v) node ids that span what is linked at limits[-1] bits. nodes: node (long) and f0, f1, ... (node is distinct).

    The index is dealt out by its upper nodes: a node is a mask with the bits that its rows have under it. A task
    sorts the rows of its nodes by Gray rank and runs gray_links() on them. A node with over NODE_ROWS rows is not
    held: its rows come back and are dealt out again by nodes with more bits, so a dense region is spread over
    many tasks. At the last depth, rows that agree in so many bits are few with pigeonhole masks (2^20 with 3 bits).
    With sampled masks, which have one depth, a large node is split without loss: its rows are dealt to blocks, and
    each two blocks meet in one task.
    """
    names = [f"f{k}" for k in range(words)]
    n = width(nodes.sparkSession)
    blocks = len(masks) == 1  # large nodes are split by blocks of rows
    rows = nodes.select("node", *names, F.lit(0).alias("m"))
    ids, parents = {0: (0,) * words}, [0]
    edges: list[DataFrame] = []
    gray = F.col("f0")
    for s in (1, 2, 4, 8, 16, 32):
        gray = gray.bitwiseXOR(F.shiftrightunsigned(gray, s))

    def found(dealt, last):
        dealt = dealt.repartition(n, "key").sortWithinPartitions("key", "m", gray.bitwiseXOR(F.lit(-(2**63))), *names)
        kinds = ", ".join(["u long", "v long", "m int", *(f"{c} long" for c in names), "key long"])
        return checkpointed(dealt.mapInArrow(_linker(names, limits, last), kinds))

    for depth, below in enumerate(masks):
        last = depth == len(masks) - 1 and not blocks
        choice = None
        made: list[int] = []
        for p in parents:
            options = []
            for mask in below[ids[p]]:
                i = len(ids)
                ids[i] = mask
                made.append(i)
                options.append(F.struct(F.lit(i).alias("m"), F.xxhash64(F.lit(i), *[F.col(c).bitwiseAND(F.lit(_signed(w))) for c, w in zip(names, mask, strict=True)]).alias("key")))
            each = F.array(*options)
            choice = F.when(F.col("m") == p, each) if choice is None else choice.when(F.col("m") == p, each)
        parents = made
        dealt = rows.select("node", *names, F.explode(choice).alias("x")).select("node", *names, "x.m", "x.key")
        out = found(dealt, last)
        edges.append(out.where("m is null").select("u", "v"))
        rows = out.where("m is not null").select(F.col("u").alias("node"), *names, "m", "key")
        if last or rows.isEmpty():
            break
        if blocks:
            count = rows.groupBy("key", "m").agg((F.floor(2 * F.count("*") / NODE_ROWS) + 1).cast("long").alias("blocks"))
            own = F.pmod(F.xxhash64("node"), F.col("blocks"))
            met = rows.join(count, ["key", "m"]).withColumn("own", own).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
            met = met.select("node", *names, "m", F.xxhash64("m", "key", F.least("own", "other"), F.greatest("own", "other")).alias("key"))
            edges.append(found(met, True).select("u", "v"))
    total = edges[0]
    for e in edges[1:]:
        total = total.union(e)
    return total.distinct()


def _linker(names, limits, last):
    def run(batches):
        fixed = [*names, "key"]
        schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("m", pa.int32()), *((c, pa.int64()) for c in fixed)])

        def linked(key, node, m, f):
            a, b = gray_links(f, key, limits)
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), pa.nulls(len(a), pa.int32()), *[none] * len(fixed)], schema=schema)

        def returned(key, node, m, f):
            cols = [pa.array(f[:, k].view(np.int64)) for k in range(len(names))]
            return pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(m), *cols, pa.array(key)], schema=schema)

        held: list[tuple] = []
        large = None  # the key of a node that is being passed back
        for batch in batches:
            key, node, m = (batch.column(c).to_numpy() for c in ("key", "node", "m"))
            f = np.stack([batch.column(c).to_numpy() for c in names], axis=1).view(np.uint64)
            now = [key, node, m, f]
            if held:
                now = [np.concatenate([h, x]) for h, x in zip(held, now, strict=True)]
            key = now[0]
            if not len(key):
                continue
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            tail = starts[-1]
            done = np.ones(len(key), bool)
            done[tail:] = False
            if large is not None and not last:
                back = key == large
                if back.any():
                    yield returned(*(x[back] for x in now))
                    done &= ~back
                    if key[-1] == large:
                        tail = len(key)
                    else:
                        large = None
                else:
                    large = None
            if len(key) - tail > NODE_ROWS and not last:
                large = key[tail]
                yield returned(*(x[tail:] for x in now))
                tail = len(key)
            if done.any():
                sizes = np.diff(np.append(starts, len(key)))
                big = np.repeat(sizes > NODE_ROWS, sizes) & done
                if big.any() and not last:
                    yield returned(*(x[big] for x in now))
                    done &= ~big
                yield linked(*(x[done] for x in now))
            held = [x[tail:] for x in now]
        if held and len(held[0]):
            yield linked(*held)

    return run


def simhash_components(docs: DataFrame, shingle: int = 3, limit: int = 3) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, fingerprint (16 lowercase hex digits), component_id.

    A fingerprint bit is 1 if it is set in over half of the hashes of the document's shingles, repeats included.
    Fingerprints link at `limit` or fewer differing bits, all of them: the masks of the index are pigeonhole parts.
    component_id is the smallest doc_id reachable. Rows with equal fingerprints are one node, so copies cost
    nothing; links of a dense region are returned as a spanning forest. Null texts and texts without words have fingerprint
    zero, linked like any other. Rows without doc_id take part; component_id is null only if no row reached has one.
    """
    rows = checkpointed(fingerprints(docs, shingle))
    nodes = rows.groupBy("f0").agg(F.min("doc_id").alias("least"))
    edges = links(nodes.select(F.col("f0").alias("node"), "f0"), 1, pigeonhole_masks(limit), [limit])
    root = components(edges)
    named = nodes.join(root, nodes.f0 == root.node, "left").select("f0", "least", F.coalesce("root", "f0").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    to = named.join(least, "root").select("f0", "component_id")
    return rows.join(to, "f0").select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def set_fingerprints(docs: DataFrame, shingle: int, words: int) -> DataFrame:
    """doc_id, n (size), s0 and s1 (128 bits) of the set of shingles, and f0, f1, ... (majority bits of it) of each row with words.

    Each shingle counts once, as in the similarity of sets: a word that is repeated all over a text does not decide its bits.
    """
    names = ["n", "s0", "s1", *(f"f{k}" for k in range(words))]

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                each = [shingle_set(t, shingle) for t in byte_values(part.column("text"))]
                n = np.fromiter(map(len, each), np.int64, len(each))
                h = np.concatenate(each)
                whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in each), np.int64).reshape(-1, 2)
                cols = [n, whole[:, 0], whole[:, 1], *(majority(_more(h, k), n).view(np.int64) for k in range(words))]
                out = pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in cols)], names=["doc_id", *names])
                yield out.filter(pa.array(n > 0))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(["doc_id long", *(f"{c} long" for c in names)]))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, words: int = 4, bits: int = 14, tables: int = 48) -> DataFrame:
    """(doc_id, component_id) of documents that are linked to another by a Jaccard similarity of shingle sets of at least `percent` in 100.

    Fingerprints have 64 * words bits, as a similarity of 0.8 turns about 15 % of a SimHash's bits, too many for an
    exact index of 64. Candidates agree under one of `tables` sampled masks and differ in at most
    BITS_APART bits of 256; the masks find a pair of similarity 0.8 with a probability of over 0.99 by arithmetic, more similar ones almost surely.
    The index gives a forest of candidates; in each of its trees all pairs are verified exactly, by pivots and the triangle inequality
    (ngram_join.py), so no link depends on which candidates the forest holds. Documents with equal shingle sets are one node,
    represented by the smallest doc_id. Rows without doc_id are ignored; texts without words are no duplicates.
    """
    names = [f"f{k}" for k in range(words)]
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    rows = checkpointed(set_fingerprints(d, shingle, words))
    nodes = checkpointed(rows.groupBy(F.col("s0").alias("node")).agg(F.min("doc_id").alias("doc_id"), *[F.min_by(c, "s1").alias(c) for c in ("n", *names)]))
    total = 64 * words
    forest = links(nodes.select("node", *names), words, sampled_masks(words, bits, tables), [total // 12, total * BITS_APART // 256])
    tree = components(thinned(forest))
    regions = nodes.join(tree, "node").select(F.col("root").alias("region"), "node", "doc_id", "n")
    root = components(thinned(region_links(d, regions, shingle, percent)))
    named = nodes.select("node", "doc_id").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    copies = rows.groupBy(F.col("s0").alias("node")).agg(F.count("*").alias("copies"))
    to = checkpointed(named.join(least, "root").join(copies, "node").select("node", "component_id", "copies"))
    return with_hot_keys(rows.select("doc_id", "s0"), to, F.col("s0") == F.col("node"), "copies").select("doc_id", "component_id")


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs, with its columns, without the rows whose near_duplicates() component has a smaller doc_id; rows with one doc_id stay or go together."""
    gone = near_duplicates(docs, **options).where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
