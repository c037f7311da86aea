"""Toxicity: a factorization machine over hashed terms, learned from a bounded sample of labelled rows."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, checkpointed, pieces, ragged
from .tokens import WordTable, _per_text, _split

#: Labelled rows that are learned from, at most: those of smallest hash of doc_id. The driver holds about 4 kB of terms of each.
SAMPLE_ROWS = 16_000
FACTORS = 4
BUCKETS = 1 << 30
#: Standard errors of its gradient, were the term without meaning, above which a term has a weight.
WEIGHT_ERRORS = 5.0
#: Least gain that lets a group of terms have a factor.
FACTOR_GAIN = 3.0
#: Parts in which the driver fetches the sample's terms.
PARTS = 8
#: Learning rate of weights; factors learn at a fifth of it.
RATE = 0.5
#: Lengths of word beginnings that are terms besides whole words (inflected and compound words).
PREFIXES = (4, 5, 6)

_LETTERS = re.compile(r"[^\W\d_]+")


def word_terms(word: bytes) -> list[int]:
    """Buckets of the terms of one word between white space: each run of letters in lower case, and its beginnings."""
    out = []
    for run in _LETTERS.findall(word.decode("utf-8", "replace").lower()):
        out.append(zlib.crc32(b"w:" + run.encode()) % BUCKETS)
        out.extend(zlib.crc32(f"p{k}:{run[:k]}".encode()) % BUCKETS for k in PREFIXES if len(run) > k)
    return out


def _encoder(known: np.ndarray | None):
    """Words to ragged terms: buckets, or with `known` (sorted buckets) places in it, of known terms only."""

    def encode(words):
        each = [word_terms(w) for w in words]
        n = np.fromiter(map(len, each), np.int64, len(each))
        flat = np.fromiter((t for x in each for t in x), np.int64, int(n.sum()))
        if known is None:
            return n, flat
        at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
        held = known[at] == flat if len(known) else np.zeros(len(flat), bool)
        return _per_text(held.astype(np.int64), n), at[held]

    return encode


def _distinct_words(batches, table: WordTable) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, text, row of table) of slices of batches: each pair of a text and a word in it once, by text."""
    for batch in batches:
        for part in pieces(batch, "text", 1 << 20):
            words, per = _split(byte_values(part.column("text")))
            rows = table.rows(words)
            if not len(rows):
                yield part, np.zeros(0, np.int64), np.zeros(0, np.int64)
                continue
            k = len(table.length)
            pair = np.unique(np.repeat(np.arange(len(per)), per) * k + rows)
            yield part, pair // k, pair % k


class FactorizationMachine:
    """bias + sum of weights of the terms of a text + sum over pairs of terms of the product of their factors.

    The terms of a text are those of its distinct words. terms: the buckets that have a weight or factors, sorted.
    """

    def __init__(self, terms: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray) -> None:
        self.terms, self.bias, self.weight, self.factor = terms, bias, weight, factor

    def of_words(self, n: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Per word (n terms each, places in self.terms): its weight, the sum of squares of its factors, the sums of its factors."""
        word = np.repeat(np.arange(len(n)), n)
        cols = [self.weight[term], (self.factor[term] ** 2).sum(axis=1), *self.factor[term].T]
        return np.stack([np.bincount(word, c, len(n)) for c in cols], axis=1)

    def score(self, text: np.ndarray, word: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        """Scores of n texts from pairs of a text and one of its distinct words, a row of words (see of_words)."""
        sums = np.stack([np.bincount(text, c[word], n) for c in words.T], axis=1)
        raw = self.bias + sums[:, 0] + 0.5 * ((sums[:, 2:] ** 2).sum(axis=1) - sums[:, 1])
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    @classmethod
    def learn(cls, terms: np.ndarray, rows: list[np.ndarray], label: np.ndarray, steps: int = 2000, seed: int = 3) -> FactorizationMachine:
        """rows: places in terms, of each text, repeats included.

        Weights come first: a log loss over all terms with a penalty that leaves those without gain at zero. What they do not explain is
        searched for pairs: leading directions of the sum of residual * (terms x terms) over the texts are where factors
        can gain, whether or not their terms gain alone. Weights and factors of the terms that are left are then learned together.
        One text in two hundred is blank and not toxic, so that the bias says what nothing but the absence of terms tells.
        """
        return cls._learn(terms, np.concatenate([*rows, np.zeros(0, np.int32)]), np.fromiter(map(len, rows), np.int64, len(rows)), label, steps, seed)

    @classmethod
    def _learn(cls, terms: np.ndarray, flat: np.ndarray, size: np.ndarray, label: np.ndarray, steps: int = 2000, seed: int = 3) -> FactorizationMachine:
        """As learn(), of the terms of all texts in one array and how many each text has."""
        rng = np.random.default_rng(seed)
        blank = 1 + len(size) // 200
        label = np.append(label, np.zeros(blank, label.dtype))
        x = _Terms(flat, np.append(size, np.zeros(blank, np.int64)), len(terms))
        del flat
        n = x.n
        w, b = _weights(x, label.astype(np.float64))
        residual = label - _sigmoid(b + x.dot(w))
        v = _directions(x, residual, rng)
        live = np.flatnonzero((w != 0) | (np.abs(v).sum(axis=1) > 0))
        w, v = w[live], 0.3 * v[live] + rng.normal(0, 0.01, (len(live), FACTORS))
        to = np.full(len(terms), -1, np.int32)
        to[live] = np.arange(len(live))
        flat, text = [], []
        for a, z in x.blocks:
            at = to[x.block(a, z)]
            flat.append(at[at >= 0].astype(np.int64))
            text.append(np.repeat(np.arange(a, z), x.size[a:z])[at >= 0])
        flat, text = np.concatenate(flat), np.concatenate(text)
        del x
        size = np.bincount(text, minlength=n)
        start = np.cumsum(size) - size
        gw, gv, gb = np.full(len(live), 1e-3), np.full(v.shape, 1e-3), 1e-3
        for _ in range(max(1, steps * 256 // n)):
            order = rng.permutation(n)
            for cut in range(0, n, 256):
                some = order[cut : cut + 256]
                m = len(some)
                x, of = flat[ragged(start[some], size[some])], np.repeat(np.arange(m), size[some])
                s = np.stack([np.bincount(of, c[x], m) for c in v.T], axis=1)
                raw = b + np.bincount(of, w[x], m) + 0.5 * ((s * s).sum(axis=1) - np.bincount(of, (v * v).sum(axis=1)[x], m))
                g = (_sigmoid(raw) - label[some]) / m
                each = g[of]
                dw = np.bincount(x, each, len(live))
                dv = np.stack([np.bincount(x, each * s[:, c][of], len(live)) for c in range(v.shape[1])], axis=1) - v * dw[:, None] + 1e-4 * v
                dw += 1e-5 * w
                db = g.sum()
                gw, gv, gb = gw + dw * dw, gv + dv * dv, gb + db * db
                w, v, b = w - RATE * dw / np.sqrt(gw), v - RATE / 5 * dv / np.sqrt(gv), b - RATE * db / np.sqrt(gb)
        s = np.stack([np.bincount(text, c[flat], n) for c in v.T], axis=1)
        raw = b + np.bincount(text, w[flat], n) + 0.5 * ((s * s).sum(axis=1) - np.bincount(text, (v * v).sum(axis=1)[flat], n))
        slope, shift = _calibrated(raw, label)
        return cls(terms[live], float(slope * b + shift), slope * w, np.sqrt(slope) * v)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _calibrated(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of raw scores that minimise the log loss, with a small pull to a slope of 1: Newton steps, halved while they do not help."""
    at = np.array([1.0, 0.0])
    x = np.stack([raw, np.ones(len(raw))], axis=1)

    def loss(q):
        z = x @ q
        return np.logaddexp(0, z).sum() - (label * z).sum() + 0.5 * (q[0] - 1) ** 2

    for _ in range(20):
        p = _sigmoid(x @ at)
        g = x.T @ (p - label) + [at[0] - 1, 0]
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag([1.0, 1e-6])
        step = np.linalg.solve(h, g)
        while np.abs(step).max() > 1e-6 and (loss(at - step) > loss(at) or at[0] - step[0] <= 0.1):
            step = step / 2
        at = at - step
    return float(at[0]), float(at[1])


class _Terms:
    """Terms of texts as one flat array; sums over the terms of texts, and over the texts of terms, in blocks of bounded size."""

    def __init__(self, flat: np.ndarray, size: np.ndarray, k: int, block: int = 1 << 20) -> None:
        self.n, self.k = len(size), k
        self.size = size.astype(np.int64)
        self.flat = flat.astype(np.int32, copy=False)
        end = np.cumsum(self.size)
        self.start = end - self.size
        cut = np.flatnonzero(np.diff(end // block)) + 1
        self.blocks = list(zip([0, *cut.tolist()], [*cut.tolist(), self.n], strict=True))

    def block(self, a: int, z: int) -> np.ndarray:
        return self.flat[self.start[a] : self.start[z - 1] + self.size[z - 1]].astype(np.int64)

    def dot(self, v: np.ndarray) -> np.ndarray:
        out = []
        for a, z in self.blocks:
            sums = np.concatenate([[0.0], np.cumsum(v[self.block(a, z)])])
            at = self.start[a:z] - self.start[a]
            out.append(sums[at + self.size[a:z]] - sums[at])
        return np.concatenate(out)

    def back(self, g: np.ndarray) -> np.ndarray:
        return sum((np.bincount(self.block(a, z), np.repeat(g[a:z], self.size[a:z]), self.k) for a, z in self.blocks), np.zeros(self.k))


def _weights(x: _Terms, label: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the log loss plus a penalty on |weight|, by accelerated proximal steps on all texts.

    A term's penalty is WEIGHT_ERRORS standard errors of its gradient at the mean label: terms of few texts and of many meet the same test, so a rare
    term that only toxic texts hold has a weight (where a tenth of labels is 1, one of five texts).
    Steps are scaled per term by how often it occurs times the terms of its texts, which bounds the curvature.
    """
    n, p = len(label), float(label.mean())
    penalty = WEIGHT_ERRORS * np.sqrt(p * (1 - p) * x.back(np.ones(n)))
    curve = np.maximum(x.back(x.size + 1.0) / 4, 1e-9)
    curve_b = max((x.size + 1).sum() / 4, 1.0)
    w, b = np.zeros(x.k), float(np.log((label.sum() + 0.5) / (n - label.sum() + 0.5)))
    y, yb, t = w, b, 1.0
    for _ in range(rounds):
        g = _sigmoid(yb + x.dot(y)) - label
        z = y - x.back(g) / curve
        new = np.sign(z) * np.maximum(np.abs(z) - penalty / curve, 0)
        new_b = yb - g.sum() / curve_b
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, yb = new + (t - 1) / after * (new - w), new_b + (t - 1) / after * (new_b - b)
        w, b, t = new, new_b, after
    return w, b


def _directions(x: _Terms, residual: np.ndarray, rng, rounds: int = 24) -> np.ndarray:
    """terms x FACTORS: sparse leading directions of the residuals' pairs of terms, by truncated power steps; those of too little gain are zero.

    A text counts by 1 / its terms, so that one long text is no direction of its own.
    """
    part = residual / np.maximum(x.size, 1)
    own = x.back(part)
    out = np.zeros((x.k, FACTORS))
    if not len(x.flat):
        return out
    gains: list[float] = []
    for c in range(FACTORS):
        v = rng.normal(0, 1, x.k)
        v /= np.linalg.norm(v)
        gain = 0.0
        for step in range(rounds):
            u = x.back(part * x.dot(v)) - own * v
            for d, was in enumerate(gains):
                u -= was * (out[:, d] @ v) * out[:, d]
            gain = float(v @ u)
            z = u + max(np.linalg.norm(u), 1e-9) * v  # shifted, so that the largest positive gain leads
            if step >= rounds // 4:
                z[np.abs(z) < 0.2 * np.abs(z).max()] = 0
            v = z / max(np.linalg.norm(z), 1e-12)
        if gain < FACTOR_GAIN:
            break
        gains.append(gain)
        out[:, c] = v
    return out


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """A model of labels.toxic from rows of docs whose crc32(doc_id as text) mod 5 is not 0.

    The sample is bounded (sample_rows), and nothing else is: all terms of its texts are learned from, but for those that
    only one of them holds, which tell nothing about another text. The driver gets the terms of the sample's texts.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    ids = ids.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = checkpointed(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    texts = checkpointed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id").select("toxic", "text"))

    def counted(batches):
        table = WordTable(_encoder(None))
        for part, text, word in _distinct_words(batches, table):
            n = table.length[word]
            pair = np.unique(np.repeat(text, n) * BUCKETS + table.flat[ragged(table.start[word], n)])
            term, many = np.unique(pair % BUCKETS, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(many)], names=["term", "n"])

    shared = texts.mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).where("n > 1").select("term").toArrow()
    terms = np.sort(shared.column("term").to_numpy())
    sent = docs.sparkSession.sparkContext.broadcast(terms)  # bounded by the sample

    def found(batches):
        table = WordTable(_encoder(sent.value))
        for part, text, word in _distinct_words(batches, table):
            n = table.length[word]
            cut = np.concatenate([[0], np.cumsum(np.bincount(text, n, part.num_rows))]).astype(np.int32)
            flat = table.flat[ragged(table.start[word], n)].astype(np.int32)
            flat = flat[np.lexsort((flat, np.repeat(text, n)))]
            key = [xxhash.xxh64_intdigest(flat[a:z].tobytes()) >> 1 for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("toxic"), pa.array(key, pa.int64()), pa.ListArray.from_arrays(pa.array(cut), pa.array(flat))], names=["toxic", "key", "terms"])

    # fetched in parts, each in the order of a hash of its terms: the order of tasks does not matter
    encoded = checkpointed(texts.mapInArrow(found, "toxic int, key long, terms array<int>"))
    total = int(encoded.agg(F.sum(F.size("terms"))).first()[0] or 0)
    flat, at, size, label = np.empty(total, np.int32), 0, [], []
    for part in range(PARTS):
        got = encoded.where(F.pmod("key", F.lit(PARTS)) == part).toArrow()
        order = pa.compute.sort_indices(got, [("toxic", "ascending"), ("key", "ascending")])
        lists = got.column("terms").take(order)
        size.append(pa.compute.list_value_length(lists).to_numpy())
        for chunk in lists.chunks:
            own = chunk.flatten().to_numpy()
            flat[at : at + len(own)] = own
            at += len(own)
        label.append(got.column("toxic").take(order).to_numpy())
        del got, lists
        pa.default_memory_pool().release_unused()
    label = np.concatenate(label)
    if not 0 < label.sum() < len(label):
        return FactorizationMachine(np.zeros(0, np.int64), 20.0 if label.sum() else -20.0, np.zeros(0), np.zeros((0, FACTORS)))
    return FactorizationMachine._learn(terms, flat, np.concatenate(size), label)


def _scorer(spark, model: FactorizationMachine):
    """For batches of rows with a text: (rows, their scores). The model goes to the workers once; its size is that of the sample's terms."""
    sent = spark.sparkContext.broadcast(model)

    def scores(batches):
        m = sent.value
        table = WordTable(_encoder(m.terms))
        words, done = np.zeros((0, 2 + FACTORS)), 0
        for part, text, word in _distinct_words(batches, table):
            if len(table.length) < done:  # the table was emptied
                words, done = words[:0], 0
            if len(table.length) > done:
                words = np.concatenate([words, m.of_words(table.length[done:], table.flat[int(table.start[done]) :])])
                done = len(table.length)
            yield part, m.score(text, word, words, part.num_rows)

    return scores


def scored(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted of each row of docs; null and empty texts get the score of a text without known terms. No shuffle."""
    scores = _scorer(docs.sparkSession, model)

    def run(batches):
        for part, s in scores(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """train() and scored(). Without usable labels, or with one label only, every score is close to 0 or 1."""
    return scored(docs, train(docs, labels))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, with its columns, without the rows that are predicted toxic."""
    scores = _scorer(docs.sparkSession, train(docs, labels))
    names, schema = docs.columns, docs.schema

    def run(batches):
        for part, s in scores(batches):
            yield part.filter(pa.array(s < 0.5))

    return docs.select(*[docs[c] for c in names]).mapInArrow(run, schema)
