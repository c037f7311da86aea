"""Suffix-array dedup on bytes: a run-length index of the stretches that can repeat, and matching statistics from it."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_values, pieces, ragged
from .rolling import Stretches, anchors
from .substrings import _blob, _by_bucket, _rows, _spark_schema, grouped

#: Stretches around one seed that a task indexes together, at most; seeds with more are counted window by window.
SEED_STRETCHES = 1000
#: Stretches, about, and groups, at most, in one index.
INDEX_ROWS, GROUPS = 4000, 250


class RunLengthIndex:
    """Burrows-Wheeler transform of stretches that share seeds, column by column, in runs.

    Stretches of one seed (a group) lie on one another at the seed, and two equal windows lie in the same columns, so the
    suffixes that start in one column are an order of their own. From the order of the column to the right, the bytes of a
    column are its transform: a stable sort by them is the step to the left (LF mapping). Inside a run of equal bytes
    neighbours stay neighbours and their common prefix grows by one; only at the ends of runs is it sampled anew, as
    the least of those between the two suffixes, plus one. Groups up to GROUPS share an index and are kept apart by the sort.
    """

    def __init__(self, stretches: list[bytes], group: np.ndarray, left: np.ndarray) -> None:
        """left: bytes of each stretch before its seed. group: ascending numbers from 0."""
        self.most = int(left.max())
        self.first = self.most - left  # column of each stretch's first byte
        size = np.fromiter(map(len, stretches), np.int64, len(stretches))
        width = int((self.first + size).max())
        self.columns = np.zeros((width, len(stretches)), np.uint16)  # 0: nothing here
        place = ragged(self.first, size)
        self.columns[place, np.repeat(np.arange(len(stretches)), size)] = np.frombuffer(b"".join(stretches), np.uint8).astype(np.uint16) + 1
        self.group = (group * 257).astype(np.uint16)

    def matches(self, length: int) -> np.ndarray:
        """(stretch, column) -> whether the `length` bytes from there also lie in another stretch; columns 0 to the last start of a window."""
        n = len(self.group)
        out = np.zeros((n, self.most + 1), bool)
        order, common = np.arange(n), np.zeros(n + 1, np.int64)  # of each suffix with the one before it
        for c in range(len(self.columns) - 1, -1, -1):
            byte = self.columns[c][order]
            key = self.group[order] + byte
            to = np.argsort(key, kind="stable")
            key = key[to]
            step = np.diff(to)
            same = (key[1:] == key[:-1]) & (byte[to[1:]] != 0)
            new = np.zeros(n + 1, np.int64)
            new[1:n] = np.where(same, common[to[1:]] + 1, 0)
            ends = np.flatnonzero(same & (step != 1))  # run ends
            if len(ends):
                new[1 + ends] = np.minimum.reduceat(common, np.stack([to[ends] + 1, to[ends + 1] + 1], axis=1).ravel())[::2] + 1
            order, common = order[to], new
            if c <= self.most:
                out[order, c] = np.maximum(common[:-1], common[1:]) >= length
        return out


_SEEDS = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])
_SHARED = pa.schema([("g", pa.int32()), ("hashes", pa.binary()), ("hot", pa.binary())])
_STRETCHES = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("g", pa.int32()), ("keys", pa.binary()), ("many", pa.binary()), ("seeds", pa.binary()), ("windows", pa.binary()), ("lefts", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.binary())])
_ANSWERS = pa.schema([("kind", pa.int32()), ("g", pa.int32()), ("keys", pa.binary()), ("starts", pa.binary()), ("counts", pa.binary())])


def repeats(docs: DataFrame, length: int = 400, seed: int = 64, give: str = "digest") -> DataFrame:
    """What is left of every text when each byte is removed that a string of `length` bytes covers which starts anywhere else too.

    Every window of `length` bytes chooses a seed of `seed` bytes in it (equal windows choose equal seeds). Seeds that occur twice
    anywhere mark the stretches that can repeat: a seed with the windows that chose it. Stretches go to blocks by
    seed, those that a group of documents holds often twice, and each block builds RunLengthIndexes of them, equal ones included,
    and returns the windows that match elsewhere. A seed with over SEED_STRETCHES stretches is never gathered in one task: its windows are counted by
    their hashes in as many tasks as there are blocks, which decides the same question exactly.

    give = "digest": doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of each row of docs; "text": doc_id
    and the kept bytes (a binary column, as a cut can fall inside a character). Null texts are empty; texts shorter than
    a window lose nothing; rows with equal text lose it all, whatever their doc_id. Hashes have 64 bits.
    """
    d, n = grouped(docs)
    inner = length - seed + 1

    class Bytes:
        def __init__(self, part) -> None:
            texts = byte_values(part.column("text"))
            self.size = np.fromiter(map(len, texts), np.int64, len(texts))
            self.end = np.cumsum(self.size)
            self.data = np.frombuffer(b"".join(texts), np.uint8)
            self.stretches = Stretches(self.data)
            i = np.arange(len(self.data))
            last = np.repeat(self.end, self.size)
            ok = i + seed <= last
            h = np.where(ok, self.stretches.hash(i, np.where(ok, i + seed, i)), np.uint64(2**64 - 1))
            self.at, self.lo, self.hi = anchors(h, i + length <= last, inner)
            self.seed = h[self.at]

        def keys(self) -> np.ndarray:
            """Of each stretch: what it holds, where its seed lies and how many windows it has."""
            k = self.stretches.hash(self.lo, self.hi + length)
            for x in (self.seed, (self.at - self.lo).astype(np.uint64), (self.hi - self.lo).astype(np.uint64)):
                k = (k ^ x) * np.uint64(0xC2B2AE3D27D4EB4F)
                k = k ^ (k >> np.uint64(32))
            return k

    def batches(table):
        for batch in table.combine_chunks().to_batches():
            yield from pieces(batch, "text", 1 << 20)

    def seeds(table: pa.Table) -> pa.Table:
        h, count = np.unique(np.concatenate([Bytes(p).seed for p in batches(table)]), return_counts=True)
        g = table.column("g")[0].as_py()
        return _rows(_SEEDS, [(b, g, _blob(h[i]), _blob(count[i].astype(np.int32))) for b, i in _by_bucket(h, n)])

    def shared_seeds(table: pa.Table) -> pa.Table:
        each = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        count = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int32)
        all_ = np.concatenate(each)
        values, where = np.unique(all_, return_inverse=True)
        total = np.bincount(where, weights=count)[where]
        out, e = [], 0
        for g, x in zip(table.column("g").to_pylist(), each, strict=True):
            t = total[e : e + len(x)]
            e += len(x)
            out.append((g, _blob(x[t > 1]), _blob(t[t > 1] > SEED_STRETCHES)))
        return _rows(_SHARED, out)

    def stretches(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(_STRETCHES, [])
        shared = np.frombuffer(b"".join(answers.column("hashes").to_pylist()), np.uint64)
        hot = np.frombuffer(b"".join(answers.column("hot").to_pylist()), bool)
        order = np.argsort(shared)
        shared, hot = shared[order], hot[order]
        if not len(shared):
            return _rows(_STRETCHES, [])
        held: dict[int, list] = {}
        counted: list[np.ndarray] = []
        for part in batches(table):
            b = Bytes(part)
            if not len(b.seed):
                continue
            i = np.minimum(np.searchsorted(shared, b.seed), len(shared) - 1)
            use = shared[i] == b.seed
            dense = use & hot[i]
            if dense.any():
                at = ragged(b.lo[dense], b.hi[dense] - b.lo[dense] + 1)
                counted.append(b.stretches.hash(at, at + length))
            key = b.keys()
            for k in np.flatnonzero(use & ~dense).tolist():
                own = held.get(int(key[k]))
                if own:
                    own[0] = True
                else:
                    held[int(key[k])] = [False, int(b.seed[k]), int(b.hi[k] - b.lo[k] + 1), b.data[b.lo[k] : b.hi[k] + length].tobytes(), int(b.at[k] - b.lo[k])]
        g = table.column("g")[0].as_py()
        rows: list[tuple] = []
        if held:
            keys, many, seed_, windows = np.array(list(held), np.uint64), np.array([x[0] for x in held.values()]), np.array([x[1] for x in held.values()], np.uint64), np.array([x[2] for x in held.values()], np.int32)
            texts, left = [x[3] for x in held.values()], np.array([x[4] for x in held.values()], np.int32)
            for bucket, i in _by_bucket(seed_, n):
                own = [texts[k] for k in i.tolist()]
                rows.append((0, bucket, g, _blob(keys[i]), _blob(many[i]), _blob(seed_[i]), _blob(windows[i]), _blob(left[i]), _blob(np.array([len(t) for t in own], np.int32)), b"".join(own)))
        if counted:
            h, c = np.unique(np.concatenate(counted), return_counts=True)
            rows += [(1, bucket, g, _blob(h[i]), _blob(c[i] > 1), b"", b"", b"", b"", b"") for bucket, i in _by_bucket(h, n)]
            rows.append((2, g % n, g, _blob(shared[hot]), b"", b"", b"", b"", b"", b""))
        return _rows(_STRETCHES, rows)

    def indexed(table: pa.Table) -> pa.Table:
        kind = table.column("kind")[0].as_py()
        gs = table.column("g").to_pylist()
        if kind == 2:
            return _rows(_ANSWERS, [(2, g, k, b"", b"") for g, k in zip(gs, table.column("keys").to_pylist(), strict=True)])
        each = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        many = np.frombuffer(b"".join(table.column("many").to_pylist()), bool)
        cut = np.cumsum([0, *map(len, each)])
        if kind == 1:
            keys, where, count = np.unique(np.concatenate(each), return_inverse=True, return_counts=True)
            copies = count > 1
            copies[where[many]] = True
            return _rows(_ANSWERS, [(1, g, _blob(x[copies[where[a:b]]]), b"", b"") for g, x, a, b in zip(gs, each, cut[:-1].tolist(), cut[1:].tolist(), strict=True)])
        seed_, windows, left, sizes = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("seeds", np.uint64), ("windows", np.int32), ("lefts", np.int32), ("sizes", np.int32)))
        data = table.column("bytes").to_pylist()
        source = np.repeat(np.arange(len(data)), [len(x) for x in each])
        end = np.cumsum(sizes.astype(np.int64))
        begin = end - sizes - np.concatenate([[0], end])[cut[:-1]][source]
        # every stretch is in the index, and once more if its group of documents holds it twice
        row = np.concatenate([np.arange(len(seed_)), np.flatnonzero(many)])
        row = row[np.argsort(seed_[row], kind="stable")]
        new = np.flatnonzero(np.concatenate([[True], np.diff(seed_[row]) != 0]))
        groups = np.diff(np.append(new, len(row)))
        found: dict[int, np.ndarray] = {}

        def close(members: list[tuple[int, int]]) -> None:
            rows = np.concatenate([row[a : a + c] for a, c in members])
            texts = [data[source[k]][begin[k] : begin[k] + sizes[k]] for k in rows.tolist()]
            hit = RunLengthIndex(texts, np.repeat(np.arange(len(members)), [c for _, c in members]), left[rows].astype(np.int64)).matches(length)
            first = int(left[rows].max()) - left[rows]
            for i in np.flatnonzero(hit.any(axis=1)).tolist():
                found[int(rows[i])] = hit[i, first[i] : first[i] + windows[rows[i]]]

        members, size = [], 0
        for a, c in zip(new.tolist(), groups.tolist(), strict=True):
            if c == 1:
                continue  # nothing to match
            members.append((a, c))
            size += c
            if size > INDEX_ROWS or len(members) == GROUPS:
                close(members)
                members, size = [], 0
        if members:
            close(members)
        out = []
        for g, x, a, b in zip(gs, each, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            own, starts, counts = [], [], []
            for k in range(a, b):
                if k in found:
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], found[k].view(np.int8), [0]])))
                    own.append(np.full(len(edge) // 2, x[k - a]))
                    starts.append(edge[::2].astype(np.int32))
                    counts.append((edge[1::2] - edge[::2]).astype(np.int32))
            out.append((0, g, *(b"".join(z.tobytes() for z in y) for y in (own, starts, counts))))
        return _rows(_ANSWERS, out)

    def cut_out(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(result, [])
        by_kind: dict[int, list[dict]] = {0: [], 1: [], 2: []}
        for r in answers.to_pylist():
            by_kind[r["kind"]].append(r)
        keys, starts, counts = (np.frombuffer(b"".join(r[c] for r in by_kind[0]), t) for c, t in (("keys", np.uint64), ("starts", np.int32), ("counts", np.int32)))
        order = np.argsort(keys, kind="stable")
        keys, starts, counts = keys[order], starts[order].astype(np.int64), counts[order].astype(np.int64)
        counted, hot = (np.unique(np.frombuffer(b"".join(r["keys"] for r in by_kind[k]), np.uint64)) for k in (1, 2))
        out = []
        for part in batches(table):
            b = Bytes(part)
            edge = np.zeros(len(b.data) + 1, np.int64)
            if len(keys) and len(b.at):
                own = b.keys()
                a, z = np.searchsorted(keys, own, side="left"), np.searchsorted(keys, own, side="right")
                run = ragged(a, z - a)
                begin = np.repeat(b.lo, z - a) + starts[run]
                np.add.at(edge, begin, 1)
                np.add.at(edge, begin + counts[run] - 1 + length, -1)
            if len(counted) and len(b.at):
                dense = np.isin(b.seed, hot)
                at = ragged(b.lo[dense], b.hi[dense] - b.lo[dense] + 1)
                h = b.stretches.hash(at, at + length)
                at = at[counted[np.minimum(np.searchsorted(counted, h), len(counted) - 1)] == h]
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
            gone = np.cumsum(edge)[:-1] > 0
            text = np.repeat(np.arange(len(b.size)), b.size)
            removed = np.bincount(text[gone], minlength=len(b.size))
            kept = b.data[~gone].tobytes()
            end = np.cumsum(b.size - removed)
            texts = [kept[e - k : e] for e, k in zip(end.tolist(), (b.size - removed).tolist(), strict=True)]
            doc_ids = part.column("doc_id").to_pylist()
            if give == "text":
                out.extend(zip(doc_ids, texts, strict=True))
                continue
            head = gone.copy()
            head[1:] &= ~gone[:-1] | (text[1:] != text[:-1])
            spans = np.bincount(text[head], minlength=len(b.size))
            out.extend(zip(doc_ids, b.size.tolist(), removed.tolist(), spans.tolist(), [hashlib.sha256(t).hexdigest() for t in texts], strict=True))
        return _rows(result, out)

    result = {
        "digest": pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]),
        "text": pa.schema([("doc_id", pa.int64()), ("kept", pa.binary())]),
    }[give]
    shared = d.groupBy("g").applyInArrow(seeds, _spark_schema(_SEEDS)).groupBy("bucket").applyInArrow(shared_seeds, _spark_schema(_SHARED))
    sent = d.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(stretches, _spark_schema(_STRETCHES))
    found = sent.groupBy("kind", "bucket").applyInArrow(indexed, _spark_schema(_ANSWERS))
    return d.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(cut_out, _spark_schema(result))
