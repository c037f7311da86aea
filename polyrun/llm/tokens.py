"""Token counts and token ids of whole texts by a public word-end BPE vocabulary."""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import byte_values, fresh_path, pieces, ragged, width

#: Entries of a worker's table of words; it is only a table of results and is emptied when it is full.
WORDS_HELD = 400_000


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordTable:
    """Words (between ASCII white space) to values, each computed once while it is held.

    The vocabulary drops white space and no token crosses it, so a text's tokens are those of its words.
    """

    def __init__(self, encode) -> None:
        self.encode, self.index = encode, {}
        self.length = self.start = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int64)

    def rows(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > WORDS_HELD:
            self.__init__(self.encode)
        out = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero(out < 0)
        if len(at):
            missed = [words[i] for i in at.tolist()]
            new = list(set(missed))
            length, flat = self.encode(new)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.length = np.concatenate([self.length, length])
            self.flat = np.concatenate([self.flat, flat])
            self.start = np.cumsum(self.length) - self.length
            out[at] = np.fromiter(map(self.index.__getitem__, missed), np.int64, len(missed))
        return out


def _split(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    split = [x.split() for x in texts]
    return [w for x in split for w in x], np.fromiter(map(len, split), np.int64, len(split))


def _per_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    end = np.cumsum(counts)
    return total[end] - total[end - counts]


#: Byte to printable character of byte-level vocabularies (printable Latin-1 as it is, the others from U+0100 on).
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_CHARS = dict(zip([*_PLAIN, *sorted(set(range(256)) - set(_PLAIN))], [*_PLAIN, *range(0x100, 0x200)], strict=False))
_BYTES = {c: b for b, c in _CHARS.items()}


class RankMerger:
    """Byte-pair merges of many pre-tokens at once.

    Symbols of all pre-tokens lie in one ragged array. Each round finds for every pre-token the lowest rank among
    its neighbouring pairs and merges the pairs of that rank, leftmost first, in all pre-tokens at the same time;
    pre-tokens without a known pair are done. The count of the symbols that are left is the number of tokens.
    """

    def __init__(self, path: str) -> None:
        model = json.load(open(path))["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"]
        n = self.size = len(self.vocab)
        pairs = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in model["merges"]]
        left, right, to = (np.array(x, np.int64) for x in zip(*((self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs), strict=True))
        key = left * n + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.merged = key[order], order, to[order]
        chars = {c: chr(c) for c in _BYTES}
        self.inner, self.last = np.zeros(0x200, np.int64), np.zeros(0x200, np.int64)
        for c, text in chars.items():
            self.inner[c], self.last[c] = self.vocab[text], self.vocab[text + self.suffix]

    def counts(self, tokens: list[str]) -> np.ndarray:
        """tokens: pre-tokens as byte-level characters."""
        size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        raw = np.frombuffer("".join(tokens).encode("utf-16-le"), np.uint16)
        symbol = self.inner[raw]
        end = np.cumsum(size)
        symbol[end - 1] = self.last[raw[end - 1]]
        out = size.copy()
        at = np.flatnonzero(size > 1)
        symbol, owner = symbol[ragged((end - size)[at], size[at])], np.repeat(np.arange(len(at)), size[at])
        none = len(self.keys)
        while len(symbol) > 1:
            same = owner[1:] == owner[:-1]
            key = np.where(same, symbol[:-1] * self.size + symbol[1:], -1)
            found = np.minimum(np.searchsorted(self.keys, key), none - 1)
            rank = np.where(self.keys[found] == key, self.ranks[found], none)
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            lowest = np.minimum.reduceat(np.append(rank, none), starts)
            best = np.repeat(lowest, np.diff(np.append(starts, len(symbol))))[:-1]
            hit = (rank == best) & (rank < none)
            # of overlapping pairs (x x x) the leftmost, then every other one
            where = np.flatnonzero(hit)
            if len(where):
                head = np.concatenate([[True], np.diff(where) > 1])
                run = np.maximum.accumulate(np.where(head, np.arange(len(where)), 0))
                where = where[(np.arange(len(where)) - run) % 2 == 0]
                symbol[where] = self.merged[found[where]]
                gone = np.zeros(len(symbol), bool)
                gone[where + 1] = True
                np.subtract.at(out, at[owner[where]], 1)
            else:
                gone = np.zeros(len(symbol), bool)
            live = np.repeat(lowest < none, np.diff(np.append(starts, len(symbol)))) & ~gone
            symbol, owner = symbol[live], owner[live]
        return out


@lru_cache(maxsize=2)
def _merger(path: str) -> RankMerger:
    return RankMerger(path)


#: What a pre-token of this vocabulary is, in words of Latin letters below U+0250, where composing changes nothing;
#: words with other characters or special strings are left to the library.
_LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f"
_NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
_LATIN_TOKEN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_LETTER}{_NUMBER}]+")
_OTHER = re.compile("[^\x21-\x7e\xa1-\u012f\u0131-\u024f]|<\\|")


def _is_other(word: str) -> bool:
    """Whether _OTHER is in word; most words are told without a search."""
    if word.isascii() and (word.isalpha() or word.isprintable() and " " not in word and "<|" not in word):
        return False
    return bool(_OTHER.search(word))


def _latin_tokens(words: list[str]) -> tuple[list[str], np.ndarray]:
    """Pre-tokens of words without _OTHER as byte-level characters, and how many each has."""
    out, n = [], []
    for word in words:
        if not word.isascii():
            found = [x if x.isascii() else x.encode().decode("latin-1").translate(_CHARS) for x in _LATIN_TOKEN.findall(word.lower())]
        elif word.isalpha():
            out.append(word.lower())
            n.append(1)
            continue
        else:
            found = _LATIN_TOKEN.findall(word.lower())
        out += found
        n.append(len(found))
    return out, np.array(n, np.int64)


def _pre_tokens(path: str, words: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pre-tokens of all words as byte-level characters, how many each word has, and how many special strings it holds."""
    tok = _tokenizer(path)
    special = [re.escape(x.content) for x in tok.get_added_tokens_decoder().values()]
    marks = re.compile("(" + "|".join(special) + ")") if special else None
    out, n, extra = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    for i, raw in enumerate(words):
        before, word = len(out), raw.decode()
        if not _OTHER.search(word):
            out += [x if x.isascii() else x.encode().decode("latin-1").translate(_CHARS) for x in _LATIN_TOKEN.findall(word.lower())]
        else:
            parts = marks.split(word) if marks else [word]
            extra[i] = len(parts) // 2
            for part in parts[::2]:
                if part:
                    out += [x for x, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(part))]
        n[i] = len(out) - before
    return out, n, extra


@lru_cache(maxsize=2)
def _plain_tokenizer(path: str):
    """The library's tokenizer for pre-tokens between spaces: the same vocabulary and merges, nothing before them."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import WhitespaceSplit

    tok = Tokenizer(_tokenizer(path).model)
    tok.pre_tokenizer = WhitespaceSplit()
    return tok


@lru_cache(maxsize=2)
def _word_ends(path: str) -> np.ndarray:
    """Of each id, whether it ends a pre-token: the last symbol of each carries the vocabulary's suffix, no other does."""
    tok = _tokenizer(path)
    ends = np.zeros(tok.get_vocab_size(), bool)
    suffix = tok.model.end_of_word_suffix
    for token, i in tok.get_vocab(with_added_tokens=False).items():
        ends[i] = token.endswith(suffix)
    return ends


def _word_ids(path: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Length and ids of each word, as the library encodes it."""
    whole, tok = _tokenizer(path), _plain_tokenizer(path)
    texts = [w.decode() for w in words]
    other = np.fromiter(map(_is_other, texts), bool, len(texts))
    pre, n = _latin_tokens([t for t, o in zip(texts, other.tolist(), strict=True) if not o])
    known = list(set(pre))
    flat = [np.array(x.ids, np.int64) for x in tok.encode_batch_fast([" ".join(known[i : i + 200]) for i in range(0, len(known), 200)], add_special_tokens=False)]
    last = np.flatnonzero(_word_ends(path)[np.concatenate(flat)]) if flat else np.zeros(0, np.int64)
    size = [np.diff(last, prepend=-1)]
    for x in whole.encode_batch_fast([t for t, o in zip(texts, other.tolist(), strict=True) if o], add_special_tokens=False):
        size.append(np.array([len(x.ids)]))
        flat.append(np.array(x.ids, np.int64))
    size, flat = np.concatenate(size).astype(np.int64), np.concatenate([*flat, np.zeros(0, np.int64)])
    place = {x: i for i, x in enumerate(known)}
    per = np.ones(len(words), np.int64)
    per[~other] = n
    row = np.full(int(per.sum()), -1, np.int64)
    row[np.repeat(~other, per)] = np.fromiter(map(place.__getitem__, pre), np.int64, len(pre))
    row[row < 0] = len(known) + np.arange(int(other.sum()))
    start = np.cumsum(size) - size
    return _per_text(size[row], per), flat[ragged(start[row], size[row])]


@lru_cache(maxsize=2)
def _id_table(path: str) -> WordTable:
    return WordTable(lambda words: _word_ids(path, words))


@lru_cache(maxsize=2)
def _count_table(path: str) -> WordTable:
    def encode(words):
        out, n, extra = _pre_tokens(path, words)
        distinct = list(set(out))
        each = dict(zip(distinct, _merger(path).counts(distinct).tolist() if distinct else [], strict=True))
        return np.ones(len(words), np.int64), _per_text(np.fromiter(map(each.__getitem__, out), np.int64, len(out)), n) + extra

    return WordTable(encode)


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Counts are those of the library for the vocabulary file at path, without begin or end tokens; special strings
    inside a text count as one token each. Null and empty texts have 0 bytes and 0 tokens; long texts are not
    cut. Nothing is shuffled: a task holds the words of some megabytes of text and a table of words of bounded size.
    """

    def count(batches):
        known = _count_table(path)
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = byte_values(part.column("text"))
                words, per = _split(texts)
                n = _per_text(known.flat[rows], per) if len(rows := known.rows(words)) else np.zeros(len(texts), np.int64)
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def write_token_ids(docs: DataFrame, out: str, path: str, end_id: int = 1, parts: int | None = None) -> None:
    """Writes the ids of all texts to out as Parquet, in ascending doc_id order (nulls first; of equal ids the shorter text first).

    File format: part (int, the range that the row is in), doc_id, start_in_part, n_tokens, ids (list of int).
    Ranges of doc_id are encoded each by one task in order, and its file holds doc_id, start_in_part and n_tokens as
    delta-encoded, part and ids as dictionary-encoded columns, in row groups of 32 MB with page indexes, so that a
    reader of counts or of some documents fetches no other pages. Null and empty texts hold only the end id.
    """
    spark = docs.sparkSession

    def encode_part(batches):
        known, start, part_id = _id_table(path), 0, TaskContext.get().partitionId()
        for batch in batches:
            for part in pieces(batch, "text"):
                words, per = _split(byte_values(part.column("text")))
                rows = known.rows(words)
                length = known.length[rows] if len(rows) else np.zeros(0, np.int64)
                n = _per_text(length, per) + 1
                ids = np.full(int(n.sum()), end_id, np.int32)
                if len(rows):
                    body = np.ones(len(ids), bool)
                    body[np.cumsum(n) - 1] = False
                    ids[body] = known.flat[ragged(known.start[rows], length)]
                offsets = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), part_id, np.int32)), part.column("doc_id"), pa.array(start + offsets[:-1]), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))],
                    names=["part", "doc_id", "start_in_part", "n_tokens", "ids"],
                )
                start += int(offsets[-1])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = d.repartitionByRange(parts or width(spark), "doc_id").sortWithinPartitions("doc_id", F.length("text"), "text")
    (
        ranges.mapInArrow(encode_part, "part int, doc_id long, start_in_part long, n_tokens long, ids array<int>")
        .write.option("parquet.block.size", str(32 << 20))
        .option("parquet.page.size", str(256 << 10))
        .option("parquet.enable.dictionary", "true")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("compression", "zstd")
        .parquet(out)
    )


def read_token_ids(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids of the files at out. Only part and n_tokens are read for the starts."""
    files = spark.read.parquet(out)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # one row per range
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return files.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def with_crc32(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32: unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def crc(batches):
        for batch in batches:
            ids = batch.column("ids")
            values, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "ids").mapInArrow(crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_id_files(docs: DataFrame, path: str, end_id: int = 1) -> str:
    """Writes docs to a new folder in the shared one and returns its path."""
    out = fresh_path(docs.sparkSession, "ids")
    write_token_ids(docs, out, path, end_id)
    return out
