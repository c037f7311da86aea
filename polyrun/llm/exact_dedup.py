"""Exact dedup: compressed radix tries own each text; see owners()."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, byte_values, checkpointed, pieces

_SPACE = b" \t\n\v\f\r"
#: What a node of a trie takes besides its edge, about; a trie is closed at the next partition when it holds so much.
NODE_BYTES, TRIE_BYTES = 400, 8 << 20


def normalised(text: bytes) -> bytes:
    """Each run of white space as one space."""
    inner = b" ".join(text.split())
    if not inner:
        return b" " if text else b""
    return (b" " if text[0] in _SPACE else b"") + inner + (b" " if text[-1] in _SPACE else b"")


class PatriciaTrie:
    """Compressed radix trie over byte strings; a terminal holds [smallest id or None, rows, digest].

    Nodes are [edge, children by first byte, terminal, spilled]. A spilled node is the mark of a subtree that was given away:
    add() returns the prefix of it for every key that belongs there, and keeps nothing.
    """

    def __init__(self) -> None:
        self.root: list = [b"", {}, None, False]
        self.bytes = 0

    @staticmethod
    def _common(a: bytes, b: bytes) -> int:
        low, high = 0, min(len(a), len(b))
        if a[:high] == b[:high]:
            return high
        while low < high:  # the first unequal byte by halving
            mid = (low + high + 1) // 2
            low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
        return low

    def add(self, key: bytes, least: int | None, rows: int, digest: bytes = b"") -> bytes | None:
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = node[1][key[at]] = [key[at:], {}, None, False]
                self.bytes += len(key) - at + NODE_BYTES
                node, at = child, len(key)
                break
            edge = child[0]
            k = len(edge) if key.startswith(edge, at) else self._common(edge, key[at : at + len(edge)])
            if k < len(edge):  # split the edge
                upper = [edge[:k], {edge[k]: child}, None, False]
                child[0] = edge[k:]
                node[1][key[at]] = upper
                self.bytes += NODE_BYTES
                child = upper
            node, at = child, at + k
            if node[3]:
                return key[:at]
        own = node[2]
        if own is None:
            node[2] = [least, rows, digest]
        else:
            own[0] = least if own[0] is None else own[0] if least is None else min(own[0], least)
            own[1] += rows
        return None

    @staticmethod
    def _terminals(prefix: bytes, node: list) -> Iterator[tuple]:
        stack = [(prefix, node)]
        while stack:
            prefix, (edge, children, own, _) = stack.pop()
            prefix += edge
            if own is not None:
                yield prefix, *own
            stack.extend((prefix, x) for x in children.values())

    def terminals(self) -> Iterator[tuple]:
        """(key, smallest id, rows, digest) of every key held."""
        return self._terminals(b"", self.root)

    @staticmethod
    def _size(node: list) -> tuple[int, bool]:
        """Bytes of a subtree, and whether a spilled node is in it."""
        size, marked, stack = 0, False, [node]
        while stack:
            x = stack.pop()
            size += len(x[0]) + NODE_BYTES
            marked |= x[3]
            stack.extend(x[1].values())
        return size, marked

    def spill(self, mark: bool) -> Iterator[tuple[bytes, list[tuple]]]:
        """Gives away the largest subtrees under the first fork, until half of the bytes are left: (prefix, terminals) of each.

        With `mark`, later keys of a spilled subtree are not held either, and no subtree around it is spilled, so that all
        keys of it are given away under one prefix. A trie without a fork holds one key and keeps it.
        """
        prefix, node = b"", self.root
        while len(node[1]) == 1 and node[2] is None:
            (node,) = node[1].values()
            prefix += node[0]
        if len(node[1]) + (node[2] is not None) < 2:
            return
        found, stack = [], [(prefix, node)]
        while stack:
            prefix, node = stack.pop()
            for first, child in node[1].items():
                size, marked = self._size(child)
                if not marked:
                    found.append((size, prefix, node, first))
                elif not child[3]:
                    stack.append((prefix + child[0], child))
        goal = self.bytes // 2
        for size, prefix, node, first in sorted(found, key=lambda x: (-x[0], x[1], x[3])):
            if self.bytes <= goal:
                return
            child = node[1].pop(first)
            self.bytes -= size
            if mark:
                node[1][first] = [child[0], {}, None, True]
                self.bytes += len(child[0]) + NODE_BYTES
            yield prefix + child[0], list(self._terminals(prefix, child))


_PARTS = pa.schema([("n_bytes", pa.int64()), ("part", pa.int32()), ("prefix", pa.binary()), ("sha", pa.binary()), ("key", pa.binary()), ("least", pa.int64()), ("rows", pa.int64())])
_OWNERS = pa.schema([("n_bytes", pa.int64()), ("part", pa.int32()), ("prefix", pa.binary()), ("sha", pa.binary()), ("key", pa.binary()), ("twin", pa.binary()), ("least", pa.int64()), ("rows", pa.int64())])


class _Out:
    """Rows of a schema as batches of some megabytes of keys."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.rows, self.held = schema, [], 0

    def add(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.held += size + 100

    def ready(self, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
        if self.rows and self.held >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*self.rows, strict=True), self.schema, strict=True)], schema=self.schema)
            self.rows, self.held = [], 0


def owners(docs: DataFrame, held_bytes: int = 48 << 20, salts: int = 16, key_bytes: int = 32) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Every task first inserts its texts into a trie of its own and passes on one row per distinct text, so that a
    text that a third of all rows hold crosses the network once per task. Partitions by length and the first two bytes of the
    content's hash then insert the full byte strings into tries again: a trie holds all texts of one or more partitions,
    equal texts meet in one terminal, which has the smallest doc_id, and texts that share length and hash but not all bytes stay apart.
    A trie of over held_bytes gives its largest subtrees away: their keys, and those that come later, are dealt out
    again by (partition, prefix), so a crowded partition is spread over as many tries as it needs, in further rounds.
    Owners of groups are dealt to `salts` copies, so that members of a large group are joined by many tasks.

    Members find their owner by length and SHA-256 of the text (its first key_bytes bytes); where a trie holds several texts with
    that key, members are compared with the texts themselves. Null texts count as empty, empty texts are equal to one
    another. Of equal texts the row with the smallest doc_id stays; rows with equal text and equal doc_id are all counted,
    and each of them carries kept = true if its doc_id is the smallest. Rows without doc_id never own a text
    unless no other row holds it. Other columns are ignored.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def local(batches):
        trie, out = PatriciaTrie(), _Out(_PARTS)

        def give(found):
            for key, least, n, _ in found:
                sha = hashlib.sha256(key).digest()[:key_bytes]
                out.add((len(key), int.from_bytes(sha[:2], "big"), b"", sha, key, least, n), len(key))
                yield from out.ready()

        for batch in batches:
            for part in pieces(batch, "text"):
                for i, text in zip(part.column("doc_id").to_pylist(), byte_values(part.column("text")), strict=True):
                    trie.add(normalised(text), i, 1)
                if trie.bytes > held_bytes:
                    for _, found in trie.spill(mark=False):
                        yield from give(found)
        yield from give(trie.terminals())
        yield from out.ready(0)

    def merged(batches):
        now, trie, out = None, PatriciaTrie(), _Out(_OWNERS)

        def close():
            found = list(trie.terminals())
            same = Counter((len(key), sha) for key, _, _, sha in found)
            for key, least, n, sha in found:
                twin = key if same[len(key), sha] > 1 else None
                if twin is not None or n > 1:
                    out.add((len(key), None, None, sha, None, twin, least, n), len(twin or b""))

        for batch in batches:
            for n_bytes, part, prefix, sha, key, least, n in zip(*(batch.column(c).to_pylist() for c in _PARTS.names), strict=True):
                if (n_bytes, part, prefix) != now:
                    if now is not None and (trie.bytes > TRIE_BYTES or prefix or now[2]):
                        close()
                        trie = PatriciaTrie()
                    now = (n_bytes, part, prefix)
                gone = trie.add(key, least, n, sha)
                if gone is not None:
                    out.add((n_bytes, part, gone, sha, key, None, least, n), len(key))
                elif trie.bytes > held_bytes:
                    for to, found in trie.spill(mark=True):
                        for k, i, rows, s in found:
                            out.add((len(k), int.from_bytes(s[:2], "big"), to, s, k, None, i, rows), len(k))
                            yield from out.ready()
                yield from out.ready()
        close()
        yield from out.ready(0)

    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = d.mapInArrow(local, "n_bytes long, part int, prefix binary, sha binary, key binary, least long, rows long")
    groups = None
    while True:  # one round, unless tries are too full
        dealt = rows.repartition(n, "n_bytes", "part", "prefix").sortWithinPartitions("n_bytes", "part", "prefix")
        found = checkpointed(dealt.mapInArrow(merged, "n_bytes long, part int, prefix binary, sha binary, key binary, twin binary, least long, rows long"))
        own = found.where("key is null").select("n_bytes", F.lower(F.hex("sha")).alias("sha"), "twin", F.col("least").alias("keep_id"), F.col("rows").alias("group_size"))
        groups = own if groups is None else groups.union(own)
        rows = found.where("key is not null").drop("twin")
        if rows.isEmpty():
            break

    norm = F.regexp_replace(F.coalesce("text", F.lit("")), WS, " ")
    hashed = d.select("doc_id", norm.alias("norm")).select("doc_id", "norm", F.octet_length("norm").cast("long").alias("n_bytes"), F.sha2("norm", 256).alias("text_sha256"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt"))
    members = hashed.withColumn("sha", F.substring("text_sha256", 1, 2 * key_bytes))
    salted = lambda x: x.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    plain = members.drop("norm")
    twins = groups.where("twin is not null")
    both = None
    if not twins.isEmpty():
        keys = twins.select("n_bytes", "sha").distinct()
        plain = plain.join(keys, ["n_bytes", "sha"], "left_anti")
        own = salted(twins).withColumn("norm", F.col("twin").cast("string")).drop("twin")
        both = members.join(keys, ["n_bytes", "sha"], "left_semi").join(own, ["n_bytes", "sha", "salt", "norm"], "left").drop("norm")
    joined = plain.join(salted(groups.where("twin is null").drop("twin")), ["n_bytes", "sha", "salt"], "left")
    if both is not None:
        joined = joined.unionByName(both)
    return joined.select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("group_size").isNull() | F.col("keep_id").isNull()).alias("kept"),
        "text_sha256",
    )
