"""Substring dedup on words: relative Lempel-Ziv factors of each document against the indexed corpus."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, pieces, ragged, width
from .rolling import Stretches, anchors

LONG_WORD = 256
_NO_ID = np.iinfo(np.int64).max
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """The words of some texts in one array of bytes, each followed by one space."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
        end = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        space = _IS_SPACE[raw]
        after = np.concatenate([[True], space[:-1]])
        keep = ~space | ~after
        self.data = np.where(space, np.uint8(32), raw)[keep]
        place = np.cumsum(keep) - 1
        first = ~space & after
        self.start = place[first]
        self.end = np.flatnonzero(self.data == 32)
        self.text = np.searchsorted(end, np.flatnonzero(first), side="right")
        self.count = np.bincount(self.text, minlength=len(texts))
        self.last = np.repeat(np.cumsum(self.count), self.count)  # one after the text's last word
        self.before = np.cumsum(self.count) - self.count
        self.stretches = Stretches(self.data)
        #: A hash of each word. Polynomials modulo 2^64 can be fooled by long periodic strings, so long words have another one.
        self.word = self.stretches.hash(self.start, self.end)
        for k in np.flatnonzero(self.end - self.start > LONG_WORD).tolist():
            self.word[k] = xxhash.xxh3_64_intdigest(self.data[self.start[k] : self.end[k]].tobytes())
        self._words = Stretches(self.word)

    def gram(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n words from each word on, and whether the text has so many."""
        i = np.arange(len(self.start))
        ok = i + n <= self.last
        h = self._words.hash(i, np.where(ok, i + n, i))
        return np.where(ok, h, np.uint64(2**64 - 1)), ok


def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _by_bucket(h: np.ndarray, buckets: int):
    """(bucket, rows of it) of sorted hashes."""
    b = ((h >> np.uint64(11)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    cut = np.searchsorted(b[order], np.arange(buckets + 1))
    for k in range(buckets):
        if cut[k] < cut[k + 1]:
            yield k, order[cut[k] : cut[k + 1]]


def _rows(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_SEEDS = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("hashes", pa.binary()), ("many", pa.binary())])
_SHARED = pa.schema([("g", pa.int32()), ("hashes", pa.binary())])
_WINDOWS = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("hashes", pa.binary()), ("many", pa.binary()), ("docs", pa.binary()), ("places", pa.binary())])
_POINTERS = pa.schema([("g", pa.int32()), ("hashes", pa.binary()), ("docs", pa.binary()), ("places", pa.binary())])


def _spark_schema(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _ids(part) -> np.ndarray:
    return np.array([_NO_ID if x is None else x for x in part.column("doc_id").to_pylist()], np.int64)


def _first_of(h: np.ndarray, doc: np.ndarray, place: np.ndarray):
    """Per distinct hash: hash, smallest (doc, place), and whether several documents hold it."""
    order = np.lexsort((place, doc, h))
    h, doc, place = h[order], doc[order], place[order]
    new = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    end = np.append(first[1:], len(h))[: len(first)]
    return h[first], doc[first], place[first], doc[first] != doc[end - 1]


def grouped(docs: DataFrame, *more: str) -> tuple[DataFrame, int]:
    """Rows of docs dealt out by g, a hash of the row; several uses of it in one plan share one shuffle of the texts."""
    n = width(docs.sparkSession)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)
    return d.withColumn("g", F.pmod(F.xxhash64("doc_id", "text"), F.lit(4 * n)).cast("int")), n


def _batches(table: pa.Table):
    for batch in table.combine_chunks().to_batches():
        yield from pieces(batch, "text", 2 << 20)


def factored(first: np.ndarray, last: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Greedy factors, one after the other: (run, first word, one after the last word) of each, and the stretches of words at their boundaries.

    Runs are windows first[k] to last[k] - 1, in order, whose reference places go on in one text. A factor is what one run can
    give from the end of the factor before it on. Windows that reach over a boundary (of the run that follows, or of runs
    too short to give a factor after it) are checked there, and stretch the span by their words.
    """
    out, straddling, stop = [], [], 0
    for k, (a, z) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        begin = max(a, stop)
        if a < begin:
            straddling.append((a, min(begin, z) + window - 1))
        if begin < z:
            stop = z + window - 1
            out.append((k, begin, stop))
    run, begin, end = (np.array(x, np.int64) for x in zip(*out, strict=True))
    return run, begin, end, straddling


def parsed(docs: DataFrame, window: int = 13, seed: int = 7, give: str = "digest") -> DataFrame:
    """Relative Lempel-Ziv parse of every text against all texts with smaller doc_id.

    The reference is the whole corpus, indexed by hash blocks. Block entries are windows (`window` consecutive words) with their
    first place: smallest doc_id, then position. So that only windows that can repeat are indexed, each window first
    chooses a seed of `seed` words (equal windows choose equal seeds), and only windows of seeds that several documents
    hold are sent to the blocks. A text is then looked up in every block and parsed greedily (see factored): a factor starts at the first window with
    an earlier place after the factor before it, and grows while the places go on in the same reference text. The words of all factors, and
    of the windows that reach over their boundaries, are the duplicate spans.

    A block gets each window once per group of documents (with its smallest doc_id), so a passage that a third of all
    rows hold is no hot key. Windows are told apart by 64-bit hashes.

    give = "digest": doc_id, n_words, n_removed, n_factors, kept_sha256 of each row of docs; "text": doc_id and text, the kept words
    joined by one space (null texts: empty); "factors": doc_id, start, n_words, ref_doc, ref_start of each factor.
    Null and empty texts have no words; texts shorter than a window lose nothing; a window that repeats in rows of
    the same doc_id only is no duplicate; rows without doc_id come after all others and are no reference.
    """
    d, n = grouped(docs)
    inner = window - seed + 1

    def chosen(w: Words):
        h, _ = w.gram(seed)
        at, lo, hi = anchors(h, np.arange(len(w.start)) + window <= w.last, inner)
        return h[at], lo, hi, w.text[at]

    def seeds(table: pa.Table) -> pa.Table:
        hs, docs_ = [], []
        for part in _batches(table):
            ids = _ids(part)
            h, _, _, text = chosen(Words(byte_values(part.column("text"))))
            hs.append(h)
            docs_.append(ids[text])
        h, doc = np.concatenate(hs), np.concatenate(docs_)
        h, _, _, many = _first_of(h, doc, np.zeros(len(h), np.int8))
        g = table.column("g")[0].as_py()
        return _rows(_SEEDS, [(b, g, _blob(h[i]), _blob(many[i])) for b, i in _by_bucket(h, n)])

    def shared_seeds(table: pa.Table) -> pa.Table:
        each = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        many = np.frombuffer(b"".join(table.column("many").to_pylist()), bool)
        all_ = np.concatenate(each)
        values, where, count = np.unique(all_, return_inverse=True, return_counts=True)
        shared = count > 1
        shared[where[many]] = True
        hit = shared[where]
        end = np.cumsum([len(x) for x in each])
        return _rows(_SHARED, [(g, _blob(all_[e - len(x) : e][hit[e - len(x) : e]])) for g, x, e in zip(table.column("g").to_pylist(), each, end.tolist(), strict=True)])

    def windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _rows(_WINDOWS, [])
        shared = np.sort(np.frombuffer(b"".join(answers.column("hashes").to_pylist()), np.uint64))
        found: list[tuple] = []
        for part in _batches(table):
            ids = _ids(part)
            w = Words(byte_values(part.column("text")))
            h, lo, hi, text = chosen(w)
            if not len(shared) or not len(h):
                continue
            use = shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h
            at = ragged(lo[use], hi[use] - lo[use] + 1)
            value = w.gram(window)[0][at]
            found.append((value, ids[w.text[at]], (at - w.before[w.text[at]]).astype(np.int32)))
        if not found:
            return _rows(_WINDOWS, [])
        h, doc, place, many = _first_of(*(np.concatenate(x) for x in zip(*found, strict=True)))
        g = table.column("g")[0].as_py()
        return _rows(_WINDOWS, [(b, g, _blob(h[i]), _blob(many[i]), _blob(doc[i]), _blob(place[i])) for b, i in _by_bucket(h, n)])

    def pointers(table: pa.Table) -> pa.Table:
        each = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        many, doc, place = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("many", bool), ("docs", np.int64), ("places", np.int32)))
        h = np.concatenate(each)
        values, first_doc, first_place, _ = _first_of(h, doc, place)
        where = np.searchsorted(values, h)
        shared = np.bincount(where, minlength=len(values)) > 1
        shared[where[many]] = True
        hit = shared[where]
        out, e = [], 0
        for g, x in zip(table.column("g").to_pylist(), each, strict=True):
            use = where[e : e + len(x)][hit[e : e + len(x)]]
            e += len(x)
            if len(use):
                out.append((g, _blob(values[use]), _blob(first_doc[use]), _blob(first_place[use])))
        return _rows(_POINTERS, out)

    def parse(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        if not table.num_rows:
            return _rows(result, [])
        h, ref, place = (np.frombuffer(b"".join(answers.column(c).to_pylist()), t) for c, t in (("hashes", np.uint64), ("docs", np.int64), ("places", np.int32)))
        order = np.argsort(h)
        h, ref, place = h[order], ref[order], place[order]
        for part in _batches(table):
            ids = _ids(part)
            w = Words(byte_values(part.column("text")))
            value, ok = w.gram(window)
            covered = np.zeros(len(w.start), bool)
            at = np.zeros(0, np.int64)
            if len(h) and len(value):
                i = np.minimum(np.searchsorted(h, value), len(h) - 1)
                at = np.flatnonzero(ok & (h[i] == value) & (ref[i] < ids[w.text]))
                i = i[at]
                new = np.concatenate([[True], (np.diff(at) > 1) | (w.text[at[1:]] != w.text[at[:-1]]) | (ref[i[1:]] != ref[i[:-1]]) | (place[i[1:]] != place[i[:-1]] + 1)]) if len(at) else np.zeros(0, bool)
                first = np.flatnonzero(new)
                run, begin, end, straddling = factored(at[first], at[np.append(first[1:], len(at)) - 1] + 1, window) if len(at) else (np.zeros(0, np.int64),) * 3 + ([],)
                edge = np.bincount(begin, minlength=len(covered) + 1) - np.bincount(end, minlength=len(covered) + 1)
                for a, z in straddling:
                    edge[a] += 1
                    edge[z] -= 1
                covered = np.cumsum(edge)[: len(covered)] > 0
                i = i[first[run]]
                source, offset = ref[i], place[i] + begin - at[first[run]]
                length = end - begin
            doc_ids = part.column("doc_id").to_pylist()
            if give == "factors":
                if len(at):
                    text = w.text[begin]
                    out.extend(zip([doc_ids[t] for t in text.tolist()], (begin - w.before[text]).tolist(), length.tolist(), source.tolist(), offset.tolist(), strict=True))
                continue
            size = w.end - w.start + 1
            kept = w.data[np.repeat(~covered, size)].tobytes()
            n_kept = np.bincount(w.text[~covered], weights=size[~covered], minlength=len(ids)).astype(np.int64)
            end = np.cumsum(n_kept)
            texts = [kept[e - k : e - 1] if k else b"" for e, k in zip(end.tolist(), n_kept.tolist(), strict=True)]
            if give == "text":
                out.extend(zip(doc_ids, [t.decode() for t in texts], strict=True))
                continue
            removed = np.bincount(w.text[covered], minlength=len(ids))
            factors = np.bincount(w.text[begin], minlength=len(ids)) if len(at) else np.zeros(len(ids), np.int64)
            out.extend(zip(doc_ids, w.count.tolist(), removed.tolist(), factors.tolist(), [hashlib.sha256(t).hexdigest() for t in texts], strict=True))
        return _rows(result, out)

    result = {
        "digest": pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_factors", pa.int64()), ("kept_sha256", pa.string())]),
        "text": pa.schema([("doc_id", pa.int64()), ("text", pa.string())]),
        "factors": pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_words", pa.int64()), ("ref_doc", pa.int64()), ("ref_start", pa.int64())]),
    }[give]
    shared = d.groupBy("g").applyInArrow(seeds, _spark_schema(_SEEDS)).groupBy("bucket").applyInArrow(shared_seeds, _spark_schema(_SHARED))
    indexed = d.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(windows, _spark_schema(_WINDOWS))
    pointed = indexed.groupBy("bucket").applyInArrow(pointers, _spark_schema(_POINTERS))
    return d.groupBy("g").cogroup(pointed.groupBy("g")).applyInArrow(parse, _spark_schema(result))
