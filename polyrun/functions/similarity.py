"""Distances of sequences and vectors of a query set against all, by approximate matching and by spaced words on diagonals, many pairs at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: Cells of the tables that a task holds at a time: masks of patterns, or counts of diagonals; and matches of words.
CELLS, MATCHES = 1 << 22, 1 << 22
#: Asked sequences of a block.
ASKED = 256
_ONE = np.uint64(1)


def _symbols(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters in turn, as code points, and how many each string has."""
    n = np.fromiter(map(len, strings), np.int64, len(strings))
    return np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32), n


def _places(n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def best_edit_distances(patterns: list[str], texts: list[str]) -> np.ndarray:
    """Of each row the fewest edits of its pattern against any stretch of its text.

    A column of the table of differences is a bit per symbol of the pattern, 64 to a word; one step takes the next symbol of the texts of all rows
    at once, and carries go from word to word.
    """
    out = np.zeros(len(patterns), np.int64)
    size = np.fromiter(map(len, patterns), np.int64, len(patterns))
    alphabet = len(set("".join(patterns))) + 1
    words = int(-(-size.max() // 64)) if len(size) else 0
    step = max(1, CELLS // max(1, alphabet * words))
    order = np.argsort([len(t) for t in texts], kind="stable")  # rows that end together go together
    for at in range(0, len(order), step):
        own = order[at : at + step].tolist()
        out[own] = _columns([patterns[i] for i in own], [texts[i] for i in own])
    return out


def _columns(patterns: list[str], texts: list[str]) -> np.ndarray:
    chars, m = _symbols(patterns)
    text, n = _symbols(texts)
    rows, words = len(m), max(1, int(-(-m.max() // 64)) if len(m) else 1)
    known = np.unique(chars)
    mask = np.zeros((len(known) + 1, words, rows), np.uint64)  # the last is of symbols that no pattern has
    row, place = np.repeat(np.arange(rows), m), _places(m)
    np.bitwise_or.at(mask, (np.searchsorted(known, chars), place // 64, row), _ONE << (place % 64).astype(np.uint64))
    code = np.searchsorted(known, text)
    code[(code == len(known)) | (known[np.minimum(code, len(known) - 1)] != text if len(known) else True)] = len(known)
    grid = np.full((int(n.max()) if len(n) else 0, rows), len(known))
    grid[_places(n), np.repeat(np.arange(rows), n)] = code
    every, top_word, top_bit = np.arange(rows), np.maximum(m - 1, 0) // 64, (np.maximum(m - 1, 0) % 64).astype(np.uint64)
    plus, minus = np.full((words, rows), ~np.uint64(0)), np.zeros((words, rows), np.uint64)
    score, best = m.copy(), m.copy()
    for j in range(len(grid)):
        eq = mask[grid[j], :, every].T
        x = eq | minus
        both = eq & plus
        total = np.empty_like(plus)
        carry = np.zeros(rows, np.uint64)
        for w in range(words):
            part = both[w] + plus[w]
            total[w] = part + carry
            carry = ((part < both[w]) | (total[w] < part)).astype(np.uint64)
        d = (total ^ plus) | x
        up, down = minus | ~(d | plus), plus & d
        score += ((up[top_word, every] >> top_bit) & _ONE).astype(np.int64) - ((down[top_word, every] >> top_bit) & _ONE).astype(np.int64)
        np.minimum(best, np.where(j < n, score, best), out=best)
        for v in (up, down):
            over = v >> np.uint64(63)
            v <<= _ONE
            v[1:] |= over[:-1]
        plus, minus = down | ~(x | up), up & x
    return best


@F.pandas_udf(IntegerType())
def pattern_distance(pattern: pd.Series, text: pd.Series) -> pd.Series:
    """best_edit_distances() of two columns; null if either is."""
    known = (pattern.notna() & text.notna()).to_numpy()
    out = pd.Series([None] * len(pattern), dtype="Int32")
    out[known] = best_edit_distances(pattern[known].tolist(), text[known].tolist()).astype(np.int32)
    return out


#: Which five of six bases in a row make a word.
SPACED = ((0, 1, 2, 3, 4), (0, 1, 2, 3, 5), (0, 1, 2, 4, 5), (0, 1, 3, 4, 5), (0, 2, 3, 4, 5))
_SPAN = 6


def _words(sequences: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, sequence, place) of all spaced words; anything but C, G and T counts as A."""
    chars, n = _symbols(sequences)
    code = np.zeros(len(chars), np.int64)
    for v, c in enumerate("CGT", 1):
        code[(chars == ord(c)) | (chars == ord(c.lower()))] = v
    place, of = _places(n), np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(place + _SPAN <= n[of])
    word = np.concatenate([sum(code[at + o] << 2 * (4 - k) for k, o in enumerate(mask)) for mask in SPACED]) if len(at) else np.zeros(0, np.int64)
    return word, np.tile(of[at], len(SPACED)), np.tile(place[at], len(SPACED))


def diagonals(asked: list[str], others: list[str], least: float) -> np.ndarray:
    """Scores (others x asked): of each diagonal the words that both have there, pattern against pattern; summed over diagonals with more than `least`."""
    out = np.zeros((len(others), len(asked)), np.int64)
    wide = max(map(len, asked), default=0) + max(map(len, others), default=0) + 1
    step_a = max(1, min(len(asked), CELLS // wide))
    for a in range(0, len(asked), step_a):
        some = asked[a : a + step_a]
        word, of, place = _words(some)
        order = np.argsort(word, kind="stable")
        of, place = of[order], place[order]
        first = np.searchsorted(word[order], np.arange(4**5 + 1))
        step_b = max(1, CELLS // (wide * len(some)))
        for b in range(0, len(others), step_b):
            w, row, at = _words(others[b : b + step_b])
            counts = np.zeros(min(step_b, len(others) - b) * len(some) * wide, np.int64)
            low, many = first[w], first[w + 1] - first[w]
            cut = [0, *(np.flatnonzero(np.diff(np.cumsum(many) // MATCHES)) + 1).tolist(), len(w)]
            for x, y in zip(cut, cut[1:], strict=False):  # a word that many hold is met in parts
                n = many[x:y]
                hit = np.repeat(low[x:y], n) + _places(n)
                cell = (np.repeat(row[x:y], n) * len(some) + of[hit]) * wide + place[hit] - np.repeat(at[x:y], n) + max(map(len, others))
                counts += np.bincount(cell, minlength=len(counts))
            table = counts.reshape(-1, len(some), wide)
            out[b : b + step_b, a : a + step_a] = np.where(table > least, table, 0).sum(axis=2)
    return out


def diagonal_scores(sequences: DataFrame, asked: DataFrame, least: float = 61.08) -> DataFrame:
    """(asked_id, id, score) of asked (id: long, seq) against all sequences (id: long, seq) where the score is positive: spaced words in common on diagonals.

    Asked sequences are dealt to blocks of about ASKED, and all sequences to every block and, in it, to a salt; a task
    holds a block and streams sequences through it, so no row is made of a pair that only shares words. Null sequences score nothing.
    """
    spark = sequences.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = asked.count() // ASKED + 1
    salts = max(1, n // blocks)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    first = asked.where("seq is not null").select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), every(salts).alias("salt"), F.lit(0).alias("kind"), "id", "seq")
    rest = sequences.where("seq is not null").select(every(blocks).alias("block"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "id", "seq")

    def scored(ids: list[int], seqs: list[str], other: list[tuple[int, str]]) -> pa.RecordBatch:
        s = diagonals(seqs, [x for _, x in other], least)
        b, a = np.nonzero(s)
        own = np.array([i for i, _ in other], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[a]), pa.array(own[b]), pa.array(s[b, a])], names=["asked_id", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, seqs = None, [], []
        for batch in batches:
            other: list[tuple[int, str]] = []
            for block, salt, kind, i, seq in zip(*(batch.column(c).to_pylist() for c in ("block", "salt", "kind", "id", "seq")), strict=True):
                if now != (block, salt):
                    if other:
                        yield scored(ids, seqs, other)
                    now, ids, seqs, other = (block, salt), [], [], []
                if kind == 0:
                    ids.append(i)
                    seqs.append(seq)
                elif ids:
                    other.append((i, seq))
            if other:
                yield scored(ids, seqs, other)

    return first.union(rest).repartition(n, "block", "salt").sortWithinPartitions("block", "salt", "kind").mapInArrow(run, "asked_id long, id long, score long")


#: Pairs that a task computes at a time, and that it sends on at a time; asked vectors of a block.
PAIRS, SENT, VECTORS = 1 << 16, 1 << 18, 4096


def edit_matrix(patterns: list[str], texts: list[str], whole: bool) -> np.ndarray:
    """Edits of each pattern (64 symbols at most) against each text, or against its best stretch: [pattern, text].

    As best_edit_distances(), but a symbol of a text is looked up in the masks of all patterns at once.
    """
    out = np.zeros((len(patterns), len(texts)), np.int32)
    if max(map(len, patterns), default=0) > 64:
        raise ValueError("a pattern has more than 64 symbols")
    for m in sorted(set(map(len, patterns))):
        rows = [i for i, x in enumerate(patterns) if len(x) == m]
        kind = np.uint32 if m <= 32 else np.uint64
        known, chars = np.unique(_symbols([patterns[i] for i in rows])[0], return_inverse=True)
        masks = np.zeros((len(known) + 1, len(rows)), kind)  # the last is of symbols that no pattern has
        for place in range(m):
            masks[chars.reshape(len(rows), m)[:, place], np.arange(len(rows))] |= kind(1 << place)
        for n in sorted(set(map(len, texts))):
            cols = [i for i, x in enumerate(texts) if len(x) == n]
            grid = _symbols([texts[i] for i in cols])[0].reshape(len(cols), n).T
            code = np.searchsorted(known, grid)
            code[(code == len(known)) | (known[np.minimum(code, len(known) - 1)] != grid if len(known) else True)] = len(known)
            out[np.ix_(rows, cols)] = _edit_columns(masks, code, m, whole)
    return out


def _edit_columns(masks: np.ndarray, code: np.ndarray, m: int, whole: bool) -> np.ndarray:
    kind = masks.dtype.type
    one, shape = kind(1), (masks.shape[1], code.shape[1])
    if not m:
        return np.full(shape, len(code) if whole else 0, np.int32)
    plus, minus, top = np.full(shape, ~kind(0)), np.zeros(shape, kind), kind(m - 1)
    score = np.full(shape, m, np.int32)
    best = score.copy()
    for c in code:
        eq = masks[c].T
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | x
        up, down = minus | ~(d | plus), plus & d
        score += ((up >> top) & one).astype(np.int32) - ((down >> top) & one).astype(np.int32)
        if not whole:
            np.minimum(best, score, out=best)
        up = up << one | one if whole else up << one
        plus, minus = (down << one) | ~(x | up), up & x
    return score if whole else best


def _vector(value: list | None) -> np.ndarray | None:
    return None if value is None or None in value else np.array(value, np.float64)


def vector_matrix(asked: list[np.ndarray | None], others: list[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    """Euclidean distances [asked, other], summed component by component, and where they are null: of no vector, or of vectors of two sizes."""
    out, null = np.zeros((len(asked), len(others))), np.ones((len(asked), len(others)), bool)
    a_size, b_size = ([-1 if v is None else len(v) for v in x] for x in (asked, others))
    for n in set(a_size) & set(b_size) - {-1}:
        rows, cols = [i for i, k in enumerate(a_size) if k == n], [i for i, k in enumerate(b_size) if k == n]
        a, b = (np.array([v[i] for i in at]).reshape(len(at), n).T.copy() for v, at in ((asked, rows), (others, cols)))
        total = np.zeros((len(rows), len(cols)))
        for x, y in zip(a, b, strict=True):
            d = x[:, None] - y
            total += d * d
        out[np.ix_(rows, cols)], null[np.ix_(rows, cols)] = np.sqrt(total), False
    return out, null


def _dealt(rows: DataFrame, by: list[str], n: int, pairs: Callable[..., pa.RecordBatch], schema: str, ready: Callable = lambda x: x) -> DataFrame:
    """rows (by, kind: 0 asked and 1 others, id, value) in n partitions; a task holds the asked ones of a `by` and streams the others past them, PAIRS at a time.

    pairs(ids, values, ids of others, values of others) makes the rows of a stretch of pairs, of values as ready() gives them.
    """

    def tables(held: list[tuple], some: list[tuple]) -> Iterator[pa.RecordBatch]:
        wide = min(len(some), 1 << 10)
        for b in range(0, len(some), wide):
            other = list(zip(*some[b : b + wide], strict=True))
            step = max(1, PAIRS // len(other[0]))
            for a in range(0, len(held), step):
                yield pairs(*zip(*held[a : a + step], strict=True), *other)

    def made(held: list[tuple], some: list[tuple]) -> Iterator[pa.RecordBatch]:
        ready: list[pa.RecordBatch] = []
        for t in tables(held, some) if held and some else ():
            ready.append(t)
            if sum(x.num_rows for x in ready) >= SENT:
                yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                ready = []
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            some: list[tuple] = []
            for *key, kind, i, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    yield from made(held, some)
                    now, held, some = key, [], []
                (some if kind else held).append((i, ready(value)))
            yield from made(held, some)

    return rows.repartition(n, *by).sortWithinPartitions(*by, "kind").select(*by, "kind", "id", "value").mapInArrow(run, schema)


def edit_distances(asked: DataFrame, others: DataFrame, by: list[str], whole: bool) -> DataFrame:
    """(a, b, distance) of asked (by, id, value) and others (by, id, value) with equal `by` and different ids: edits of the strings, or of a against the best stretch of b. Null strings have no distance.

    There may be few values of `by`, so others are dealt out by a salt and the asked ones sent to every salt.
    """
    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pairs(ids, a, other_ids, b) -> pa.RecordBatch:
        i, j = np.nonzero(np.array(ids)[:, None] != np.array(other_ids))
        strings = lambda x, at: pa.array(x, pa.string()).take(pa.array(at))
        return pa.RecordBatch.from_arrays([strings(a, i), strings(b, j), pa.array(edit_matrix(list(a), list(b), whole)[i, j])], names=["a", "b", "distance"])

    first = asked.where("value is not null").select(*by, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("salt"), F.lit(0).alias("kind"), "id", "value")
    rest = others.where("value is not null").select(*by, F.pmod(F.xxhash64("id", "value"), F.lit(n)).cast("int").alias("salt"), F.lit(1).alias("kind"), "id", "value")
    return _dealt(first.union(rest), [*by, "salt"], n, pairs, "a string, b string, distance int")


def vector_distances(asked: DataFrame, others: DataFrame) -> DataFrame:
    """(query_id, vec_id, distance) of asked (id: long, value) and others (id: long, value): Euclidean distances of arrays of numbers; a block of VECTORS asked ones and a salt of the others a task."""
    n = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = asked.count() // VECTORS + 1
    salts = max(1, n // blocks)
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))

    def pairs(ids, a, other_ids, b) -> pa.RecordBatch:
        d, null = vector_matrix(a, b)
        i, j = np.repeat(np.arange(len(ids)), len(other_ids)), np.tile(np.arange(len(other_ids)), len(ids))
        own = lambda x, at: pa.array(x, pa.int64()).take(pa.array(at))
        return pa.RecordBatch.from_arrays([own(ids, i), own(other_ids, j), pa.array(d.ravel(), mask=null.ravel())], names=["query_id", "vec_id", "distance"])

    first = asked.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), every(salts).alias("salt"), F.lit(0).alias("kind"), "id", "value")
    rest = others.select(every(blocks).alias("block"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "id", "value")
    return _dealt(first.union(rest), ["block", "salt"], max(n, blocks * salts), pairs, "query_id long, vec_id long, distance double", _vector)
