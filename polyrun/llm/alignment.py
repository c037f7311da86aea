"""Cross-tokenizer alignment: which ids of two vocabularies cover the same bytes, how often in the corpus, and each document's score."""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, checkpointed, pieces, ragged, width
from .tokens import _BYTES

#: Pairs are dealt by A id modulo STRIPES; inside a stripe a dense matrix holds BLOCK_IDS of its A ids at a time, against all B ids.
STRIPES = 32
BLOCK_IDS = 64
#: Bytes of a stripe's links that one scoring task reads; a stripe with more is salted.
SALT_BYTES = 8 << 20
#: A worker's table of aligned words holds so many words and pairs; it is only a table of results and is emptied when it is full.
WORDS_HELD, PAIRS_HELD = 300_000, 8_000_000

#: Single spaces between characters that are not white space: both tokenizers end a token before each of them.
_CUT = re.compile(r"(?<=[^\s\u180e]) (?=[^\s\u180e])")


@lru_cache(maxsize=2)
def _byte_level(path: str):
    """The tokenizer of vocabulary A, which takes special strings as plain text, and the bytes of each id."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    entries = json.load(open(path))["model"]["vocab"]
    text = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        text[i] = bytes(_BYTES[ord(c)] for c in entry) if all(ord(c) in _BYTES for c in entry) else entry.encode()
    return tok, text


@lru_cache(maxsize=2)
def _piece_level(path: str):
    """The processor of vocabulary B and the bytes of each id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return model, [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace("\u2581", " ").encode() for i, x in enumerate(names)]


def words_of(text: str) -> list[str]:
    """The stretches of text between the cuts; each, after one space, is tokenized as it is inside the whole text."""
    parts = text.split(" ")
    return parts if parts == text.split() and "\u180e" not in text else [x[i == 0 :] for i, x in enumerate(_CUT.split(" " + text))]


class Aligned:
    """Words to their alignment, each computed once while it is held: counts, pairs of ids that share a group, the groups as text.

    No token of either vocabulary spans a cut, and both end a token there, so a text's groups are those of its words.
    """

    def __init__(self, path_a: str, path_b: str) -> None:
        self.paths = path_a, path_b
        (self.tok, self.text_a), (self.model, self.text_b) = _byte_level(path_a), _piece_level(path_b)
        self.size_b = len(self.text_b)
        self.bytes_a, self.bytes_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.text_a, self.text_b))
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.text: list[str | None] = []  # groups as text; None: bytes differ
        self.counts = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links
        self.start = np.zeros(0, np.int64)
        self.pairs = np.zeros(0, np.int64)

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.index) > WORDS_HELD or len(self.pairs) > PAIRS_HELD:
            self._clear()
        out = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(out < 0)
        if len(at):
            missed = [words[i] for i in at.tolist()]
            new = list(dict.fromkeys(missed))
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self._add(new)
            out[at] = np.fromiter(map(self.index.__getitem__, missed), np.int64, len(missed))
        return out

    def _add(self, words: list[str]) -> None:
        spaced = [" " + w for w in words]
        ids_a = [x.ids for x in self.tok.encode_batch_fast(spaced, add_special_tokens=False)]
        ids_b = self.model.encode(words, num_threads=1)
        raw = [x.encode() for x in spaced]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        same = np.ones(len(words), bool)
        flat, counts = [], np.zeros((len(words), 4), np.int64)
        for k, (ids, text, length) in enumerate(((ids_a, self.text_a, self.bytes_a), (ids_b, self.text_b, self.bytes_b))):
            counts[:, k] = np.fromiter(map(len, ids), np.int64, len(ids))
            flat.append(np.fromiter(chain.from_iterable(ids), np.int64, counts[:, k].sum()))
            got = np.bincount(np.repeat(np.arange(len(ids)), counts[:, k]), length[flat[k]], len(ids)).astype(np.int64)
            if (got != size).any() or b"".join(map(text.__getitem__, flat[k].tolist())) != b"".join(raw):
                same &= np.fromiter((b"".join(map(text.__getitem__, x)) == r for x, r in zip(ids, raw, strict=True)), bool, len(words))
        a, b = (x[np.repeat(same, n)] for x, n in zip(flat, counts[:, :2].T, strict=True))
        counts[~same] = 0
        good = np.flatnonzero(same).tolist()
        n_a, n_b, size = counts[same, 0], counts[same, 1], size[same]
        end_a, end_b = np.cumsum(self.bytes_a[a]), np.cumsum(self.bytes_b[b])
        at = np.minimum(np.searchsorted(end_b, end_a), len(end_b) - 1)
        cut = end_a[end_b[at] == end_a]  # ends of groups; each word's end is one
        in_a, in_b = np.searchsorted(cut, end_a), np.searchsorted(cut, end_b)
        each_a, each_b = np.bincount(in_a, minlength=len(cut)), np.bincount(in_b, minlength=len(cut))
        n_groups = np.diff(np.searchsorted(cut, np.cumsum(size), side="right"), prepend=0)
        first_b = np.cumsum(each_b) - each_b
        pairs = np.repeat(a, each_b[in_a]) * self.size_b + b[ragged(first_b[in_a], each_b[in_a])]
        links = each_a * each_b
        n_links = np.add.reduceat(links, np.cumsum(n_groups) - n_groups) if len(good) else np.zeros(0, np.int64)

        # groups as text: ids of A then of B in each group, each followed by what parts it from the next
        group, kind = np.concatenate([in_a, in_b]), np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((kind, group))
        group, kind = group[order], kind[order]
        parts = np.where(group[1:] != group[:-1], 2, kind[1:] != kind[:-1])
        marks = [",|;"[i] for i in parts.tolist()] + [""]
        texts = list(map("".join, zip(map(str, np.concatenate([a, b])[order].tolist()), marks, strict=True))) if len(order) else []
        stop = np.cumsum(n_a + n_b).tolist()
        full = ["".join(texts[x:y])[: None if y == len(texts) else -1] for x, y in zip([0, *stop], stop, strict=False)]
        text: list[str | None] = [None] * len(words)
        for i, t in zip(good, full, strict=True):
            text[i] = t
        counts[same, 2], counts[same, 3] = n_groups, n_links
        self.text += text
        self.start = np.concatenate([self.start, len(self.pairs) + np.cumsum(counts[:, 3]) - counts[:, 3]])
        self.counts = np.concatenate([self.counts, counts])
        self.pairs = np.concatenate([self.pairs, pairs])


@lru_cache(maxsize=1)
def _aligned(path_a: str, path_b: str) -> Aligned:
    return Aligned(path_a, path_b)


_LINKS = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("stripe", pa.int32())]
    + [(c, pa.binary()) for c in ("rows", "pairs", "n", "docs", "times")]
)
_LINKS_DDL = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stripe int, rows binary, pairs binary, n binary, docs binary, times binary"


def _batch(columns: dict, schema: pa.Schema = _LINKS) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def _links(path_a: str, path_b: str):
    """Texts to a row per document (stripe null) and, for each slice of texts and stripe, its links: pairs (distinct), of each the
    number n of documents that hold it, those documents as places in rows, and how many times each holds it."""

    def run(batches):
        held = _aligned(path_a, path_b)
        for batch in batches:
            for part in pieces(batch, "text"):
                split = [words_of(t.decode()) if t else [] for t in byte_values(part.column("text"))]
                n = np.fromiter(map(len, split), np.int64, len(split))
                at = held.rows([w for x in split for w in x])
                owner = np.repeat(np.arange(len(split)), n)
                counts = np.zeros((len(split), 4), np.int64)
                np.add.at(counts, owner, held.counts[at])
                sha, bad, stop = [], np.zeros(len(split), bool), np.cumsum(n).tolist()
                for i, (x, y) in enumerate(zip([0, *stop], stop, strict=False)):
                    texts = list(map(held.text.__getitem__, at[x:y].tolist()))
                    bad[i] = x == y or None in texts
                    sha.append("" if bad[i] else hashlib.sha256(";".join(texts).encode()).hexdigest())
                counts[bad] = 0
                row = part.column("row").to_numpy()
                yield _batch({"row": row, "doc_id": part.column("doc_id"), **{c: counts[:, k] for k, c in enumerate(("n_a", "n_b", "n_groups", "n_links"))}, "groups_sha256": sha})
                keep = ~bad[owner]
                at, owner = at[keep], owner[keep]
                each = held.counts[at, 3]
                pair = held.pairs[ragged(held.start[at], each)]
                doc = np.repeat(owner, each)
                a = pair // held.size_b
                key, times = np.unique(((a % STRIPES) * len(held.text_a) + a) * held.size_b * len(split) + (pair % held.size_b) * len(split) + doc, return_counts=True)
                if not len(key):
                    continue
                key, doc = key // len(split), key % len(split)
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                many = np.diff(np.append(first, len(key)))
                pair = key[first] % (len(held.text_a) * held.size_b)
                stripe = key[first] // (len(held.text_a) * held.size_b)
                at = np.flatnonzero(np.concatenate([[True], stripe[1:] != stripe[:-1]]))
                out = {c: [] for c in ("rows", "pairs", "n", "docs", "times")}
                for x, y in zip(at.tolist(), [*at[1:].tolist(), len(stripe)], strict=True):
                    lo, hi = first[x], first[y] if y < len(first) else len(key)
                    docs, place = np.unique(doc[lo:hi], return_inverse=True)
                    for c, v in (("rows", row[docs]), ("pairs", pair[x:y]), ("n", many[x:y].astype(np.int32)), ("docs", place.astype(np.int32)), ("times", times[lo:hi].astype(np.int32))):
                        out[c].append(v.tobytes())
                yield _batch({"stripe": stripe[at].astype(np.int32), **out})

    return run


def _summed(pair: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, place = np.unique(np.concatenate(pair), return_inverse=True)
    total = np.zeros(len(code), np.int64)
    np.add.at(total, place, np.concatenate(n))
    return code, total


_COUNTS = pa.schema([("stripe", pa.int32()), ("block", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary()), ("best", pa.binary())])
_COUNTS_DDL = "stripe int, block int, pairs binary, counts binary, best binary"


def _partial(size_b: int, limit: int = 2_000_000):
    """Documents of each pair in this partition, by stripe and block; best is null."""

    def emit(code, n):
        a = code // size_b
        key = (a % STRIPES) << 32 | a // STRIPES // BLOCK_IDS
        order = np.argsort(key, kind="stable")
        key, code, n = key[order], code[order], n[order]
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        cuts = list(zip(at.tolist(), [*at[1:].tolist(), len(key)], strict=True))
        yield _batch({"stripe": (key[at] >> 32).astype(np.int32), "block": (key[at] & 0xFFFFFFFF).astype(np.int32), "pairs": [code[x:y].tobytes() for x, y in cuts], "counts": [n[x:y].tobytes() for x, y in cuts]}, _COUNTS)

    def run(batches):
        pair: list[np.ndarray] = []
        n: list[np.ndarray] = []
        for batch in batches:
            pair += [np.frombuffer(x, np.int64) for x in batch.column("pairs").to_pylist()]
            n += [np.frombuffer(x, np.int32).astype(np.int64) for x in batch.column("n").to_pylist()]
            if sum(map(len, pair)) > limit:
                code, total = _summed(pair, n)
                pair, n = [code], [total]
                if len(code) > limit // 2:
                    yield from emit(code, total)
                    pair, n = [], []
        if pair:
            yield from emit(*_summed(pair, n))

    return run


def _dense(size_b: int):
    """Rows sorted by stripe and block to one row for each block: its pairs with their counts, and which are the highest of their A id.

    A block is a dense matrix of BLOCK_IDS ids of A by all ids of B; counts are added into it in place, and a row's maximum is the best.
    """

    def run(batches):
        cells = np.zeros((BLOCK_IDS, size_b), np.int64)
        now, touched = None, False

        def closed():
            i, b = np.nonzero(cells)
            stripe, block = now
            a = (block * BLOCK_IDS + i) * STRIPES + stripe
            n = cells[i, b]
            best = n == cells.max(axis=1)[i]
            cells[i, b] = 0
            return _batch({"stripe": [stripe], "block": [block], "pairs": [(a * size_b + b).tobytes()], "counts": [n.tobytes()], "best": [best.tobytes()]}, _COUNTS)

        for batch in batches:
            for stripe, block, pairs, counts in zip(*(batch.column(c).to_pylist() for c in ("stripe", "block", "pairs", "counts")), strict=True):
                if touched and now != (stripe, block):
                    yield closed()
                now, touched = (stripe, block), True
                code = np.frombuffer(pairs, np.int64)
                np.add.at(cells, (code // size_b // STRIPES - block * BLOCK_IDS, code % size_b), np.frombuffer(counts, np.int64))
        if touched:
            yield closed()

    return run


def _scored(batches):
    """Rows of one stripe and salt, counts before links, to (row, n_best, count_sum) of each document in each slice of links."""
    kinds = pa.schema([("row", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64())])
    now = table = None
    held: list[tuple] = []
    for batch in batches:
        names = ("stripe", "salt", "kind", "pairs", "counts", "best", "rows", "n", "docs", "times")
        for stripe, salt, kind, pairs, counts, best, rows, n, docs, times in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if now != (stripe, salt):
                now, held, table = (stripe, salt), [], None
            if kind == 0:
                held.append((np.frombuffer(pairs, np.int64), np.frombuffer(counts, np.int64), np.frombuffer(best, bool)))
                continue
            if table is None:
                table = [np.concatenate(x) for x in zip(*held, strict=True)]
                order = np.argsort(table[0])
                table, held = [x[order] for x in table], []
            at = np.searchsorted(table[0], np.frombuffer(pairs, np.int64))
            at = np.repeat(at, np.frombuffer(n, np.int32))
            row, doc, many = np.frombuffer(rows, np.int64), np.frombuffer(docs, np.int32), np.frombuffer(times, np.int32).astype(np.int64)
            n_best, total = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            np.add.at(n_best, doc, many * table[2][at])
            np.add.at(total, doc, many * table[1][at])
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(n_best), pa.array(total)], schema=kinds)


def alignment_links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The checkpointed rows of _links(): documents (stripe null) and their links by stripe. Each row of docs is told apart by a number of its own."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return checkpointed(rows.mapInArrow(_links(path_a, path_b), _LINKS_DDL))


def pair_counts(links: DataFrame, path_b: str) -> DataFrame:
    """stripe, block, and pairs (A id times the size of B, plus B id), counts and best as packed arrays: how many documents hold each pair linked."""
    size_b = len(_piece_level(path_b)[1])
    part = links.where("stripe is not null").select("pairs", "n").mapInArrow(_partial(size_b), _COUNTS_DDL)
    return checkpointed(part.repartition(width(links.sparkSession), "stripe", "block").sortWithinPartitions("stripe", "block").mapInArrow(_dense(size_b), _COUNTS_DDL))


def aligned_ids(counts: DataFrame, path_b: str) -> DataFrame:
    """a, b, count, best of pair_counts() as plain rows."""
    size_b = len(_piece_level(path_b)[1])

    def run(batches):
        for batch in batches:
            for pairs, n, best in zip(*(batch.column(c).to_pylist() for c in ("pairs", "counts", "best")), strict=True):
                code = np.frombuffer(pairs, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (code // size_b, code % size_b, np.frombuffer(n, np.int64), np.frombuffer(best, bool))], names=["a", "b", "count", "best"])

    return counts.mapInArrow(run, "a long, b long, count long, best boolean")


def alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (see below).

    A is a byte-level vocabulary of the tokenizers library, which gets a space and the text; B a sentencepiece model,
    which adds the space itself; neither adds special tokens, and their strings inside a text are plain text. Byte offsets where both end a token cut the
    tokens into groups; all pairs of an A and a B token in one group are links. A pair's count is the number of rows of docs that hold it linked;
    n_best are the links whose count is the highest of their A id, ties included, count_sum is the sum over links. groups_sha256 is the SHA-256 of
    `a1,a2|b1;a3|b2,b3`, ids in order.

    Texts that are null or empty, or that the tokens of A or B do not give back byte by byte, have no tokens: zeros and ''.
    Copies and rows with one doc_id or none each count for themselves; an empty table gives an empty result. Other columns are not read.

    Links are dealt by A id modulo STRIPES. Each partition sums its own before anything moves; dense matrices then hold a block
    of a stripe each. An id that a large part of all documents holds makes one stripe large: links are dealt by stripe and a salt, and each salt gets the counts of its stripe.
    """
    spark = docs.sparkSession
    links = alignment_links(docs, path_a, path_b)
    counts = pair_counts(links, path_b)
    load = {r.stripe: r.b for r in links.where("stripe is not null").groupBy("stripe").agg(F.sum(F.octet_length("docs")).alias("b")).collect()}  # STRIPES rows
    salts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for s, b in load.items() for x in (s, b // SALT_BYTES + 1)]), F.col("stripe")), F.lit(1)) if load else F.lit(1)
    empty = F.lit(None).cast("binary")
    of_counts = counts.select("stripe", F.explode(F.sequence(F.lit(0).cast("long"), (salts - 1).cast("long"))).alias("salt"), F.lit(0).alias("kind"), "pairs", "counts", "best", *[empty.alias(c) for c in ("rows", "n", "docs", "times")])
    of_links = links.where("stripe is not null").select("stripe", F.pmod(F.xxhash64("rows"), salts).cast("long").alias("salt"), F.lit(1).alias("kind"), "pairs", empty.alias("counts"), empty.alias("best"), "rows", "n", "docs", "times")
    dealt = of_counts.union(of_links).repartition(width(spark), "stripe", "salt").sortWithinPartitions("stripe", "salt", "kind")
    parts = dealt.mapInArrow(_scored, "row long, n_best long, count_sum long")
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    base = links.where("stripe is null").select("row", *names, F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    both = base.unionByName(parts, allowMissingColumns=True)
    total = both.groupBy("row").agg(*[F.max(c).alias(c) for c in names], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return total.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
