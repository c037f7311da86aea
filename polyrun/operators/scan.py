"""Tract scan: maximal runs of one base with both flanks, in canonical orientation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polyrun.functions.dna import clean, kmer_string, pack_safe, revcomp

#: Bases that are scanned at a time.
SCANNED = 4 << 20
HIT_COLUMNS = "base string, left_ctx string, right_ctx string, length int, read_offset int, canon_flag int"
_COMPLEMENT = str.maketrans("ACGTU", "TGCAA")
_NO_BASE = re.compile("[^ACGT]")


def _hit(seq: str, a: int, b: int, k: int) -> tuple:
    """The run seq[a:b] as (base, left, right, length, offset, flag): A and C as read (1), T and G reversed (2)."""
    left, right = seq[a - k : a], seq[b : b + k]
    flag = 1 if seq[a] in "AC" else 2
    if flag == 2:
        left, right = right.translate(_COMPLEMENT)[::-1], left.translate(_COMPLEMENT)[::-1]
    if not (left + right).isalpha() or _NO_BASE.search(left + right):
        left, right = _NO_BASE.sub("A", left), _NO_BASE.sub("A", right)
    return seq[a] if flag == 1 else seq[a].translate(_COMPLEMENT), left, right, b - a, a - k, flag


def sequence_hits(seq: str, k: int, least: int, fold: bool = True) -> list[tuple]:
    """Runs of at least `least` (2 or more) bases with k bases on both sides. fold: lower case counts as upper."""
    seq = seq.upper().replace("U", "T") if fold else seq
    return [_hit(seq, m.start(), m.end(), k) for m in re.finditer(r"([ACGT])\1{%d,}" % (max(least, 2) - 1), seq) if m.start() >= k and m.end() + k <= len(seq)]


def sequence_monomers(seq: str, k: int, fold: bool = True) -> list[tuple]:
    """Bases that differ from both neighbours, with k bases on both sides."""
    seq = seq.upper().replace("U", "T") if fold else seq
    return [_hit(seq, i, i + 1, k) for i in range(k, len(seq) - k) if seq[i] in "ACGT" and seq[i] != seq[i - 1] and seq[i] != seq[i + 1]]


#: Codes of bytes: A, C, G, T are 0 to 3, anything else 4; 5 parts sequences. FOLDED takes lower case, and U as T.
_PLAIN = np.full(256, 4, np.uint8)
_PLAIN[list(b"ACGT")] = range(4)
_PLAIN[0] = 5
_FOLDED = _PLAIN.copy()
_FOLDED[list(b"acgtUu")] = [0, 1, 2, 3, 3, 3]
_FORWARD, _REVERSE = (np.frombuffer(x, np.uint8) for x in (b"ACGTA", b"TGCAA"))


def _strings(chars: np.ndarray, width: int) -> pa.Array:
    """Strings of one width from their bytes in turn."""
    n = chars.size // width
    return pa.StringArray.from_buffers(n, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(chars)))


def array_hits(seqs: list[str], k: int, least: int, most: int | None, fold: bool) -> tuple[np.ndarray, list[pa.Array]]:
    """Runs of `least` to `most` bases with k bases on both sides, of all sequences (ASCII) at once: (sequence of each, hit columns).

    The sequences are one array of codes; a run ends where the next code differs. Flanks are gathered as a matrix of hits by k codes.
    """
    size = np.fromiter(map(len, seqs), np.int64, len(seqs))
    code = (_FOLDED if fold else _PLAIN)[np.frombuffer("\0".join(seqs).encode() + b"\0", np.uint8)]
    end_of = np.cumsum(size + 1) - 1
    start = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    stop = np.append(start[1:], len(code))
    keep = (code[start] < 4) & (stop - start >= least)
    if most is not None:
        keep &= stop - start <= most
    start, stop = start[keep], stop[keep]
    row = np.searchsorted(end_of, start)
    first = end_of[row] - size[row]
    keep = (start - first >= k) & (stop + k <= end_of[row])
    start, stop, row, first = start[keep], stop[keep], row[keep], first[keep]
    base = code[start]
    forward = base < 2
    before, after = code[start[:, None] + np.arange(-k, 0)], code[stop[:, None] + np.arange(k)]
    left = np.where(forward[:, None], _FORWARD[np.minimum(before, 4)], _REVERSE[np.minimum(after[:, ::-1], 4)])
    right = np.where(forward[:, None], _FORWARD[np.minimum(after, 4)], _REVERSE[np.minimum(before[:, ::-1], 4)])
    letter = np.where(forward, _FORWARD[base], _REVERSE[base])
    numbers = (stop - start, start - first - k, np.where(forward, 1, 2))
    return row, [_strings(letter, 1), _strings(left, k), _strings(right, k), *(pa.array(x.astype(np.int32)) for x in numbers)]


def _flat_map(df: DataFrame, seq: str, keep: list[str], k: int, least: int, most: int | None, fold: bool, then=None, kinds: str = "") -> DataFrame:
    """Hits with the columns keep; then: what a task makes of them before they leave it, with its schema."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in keep)
    types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())

    def by_row(seqs: list[str]) -> tuple[list[int], list[pa.Array]]:
        """For sequences with characters that are no bytes or end arrays."""
        found = [(i, h) for i, s in enumerate(seqs) for h in ([] if most == 1 else sequence_hits(s, k, least, fold)) + (sequence_monomers(s, k, fold) if least < 2 else [])]
        cols = list(zip(*(h for _, h in found), strict=True)) or [[]] * 6
        return [i for i, _ in found], [pa.array(c, t) for c, t in zip(cols, types, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = [s or "" for s in batch.column(seq).to_pylist()]
            step = max(1, len(seqs) * SCANNED // max(1, sum(map(len, seqs))))
            for a in range(0, len(seqs), step):
                some = seqs[a : a + step]
                plain = all(s.isascii() and "\0" not in s for s in some)
                rows, cols = array_hits(some, k, least, most, fold) if plain else by_row(some)
                own = batch.slice(a, len(some)).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in keep), *cols], names=[*keep, "base", "left_ctx", "right_ctx", "length", "read_offset", "canon_flag"])

    if then:
        return df.select(seq, *keep).mapInArrow(lambda batches: then(run(batches)), kinds)
    return df.select(seq, *keep).mapInArrow(run, f"{schema}, {HIT_COLUMNS}" if schema else HIT_COLUMNS)


def tract_hits(reads: DataFrame, k: int, min_tract: int, keep: list[str] | None = None, seq: str = "seq", compat: bool = False) -> DataFrame:
    """One row per tract in reads, with the columns `keep` (all but seq). A narrow flat map: nothing is shuffled."""
    keep = [c for c in reads.columns if c != seq] if keep is None else keep
    return _flat_map(reads, seq, keep, k, max(min_tract, 2), None, not compat)


def monomer_hits(reads: DataFrame, k: int, keep: list[str] | None = None, seq: str = "seq") -> DataFrame:
    keep = [c for c in reads.columns if c != seq] if keep is None else keep
    return _flat_map(reads, seq, keep, k, 1, 1, True)


def _packed(strings: pa.Array, k: int) -> np.ndarray:
    """Codes of k-mers, two bits a base, the first base lowest."""
    chars = _PLAIN[np.frombuffer(strings.buffers()[2], np.uint8, len(strings) * k)].reshape(-1, k)
    out = np.zeros(len(strings), np.int64)
    for j in range(k):
        out |= chars[:, j].astype(np.int64) << 2 * j
    return out


def monomer_counts(reads: DataFrame, k: int, by: list[str], seq: str = "seq") -> DataFrame:
    """monomer_hits() counted: by, base, left_ctx, right_ctx, n, canon_flag (strands seen, bits). A context of up to 15 bases a flank travels as one number."""
    hits = monomer_hits(reads, k, by, seq)
    counted = [F.count("*").alias("n"), F.bit_or("canon_flag").alias("canon_flag")]
    if k > 15:
        return hits.groupBy(*by, "base", "left_ctx", "right_ctx").agg(*counted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = (_packed(batch.column("base"), 1) << 2 * k | _packed(batch.column("left_ctx"), k)) << 2 * k | _packed(batch.column("right_ctx"), k)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), pa.array(code), batch.column("canon_flag")], names=[*by, "code", "canon_flag"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hits.schema if f.name in by)
    code, flank = F.col("code"), F.lit(4**k - 1)
    d = _flat_map(reads, seq, by, k, 1, 1, True, run, f"{kinds}, code long, canon_flag int" if kinds else "code long, canon_flag int").groupBy(*by, "code").agg(*counted)
    return d.select(*by, kmer_string(F.shiftright(code, 4 * k), 1).alias("base"), kmer_string(F.shiftright(code, 2 * k).bitwiseAND(flank), k).alias("left_ctx"), kmer_string(code.bitwiseAND(flank), k).alias("right_ctx"), "n", "canon_flag")


def run_hits(reads: DataFrame, k: int, keep: list[str], seq: str = "seq") -> DataFrame:
    """tract_hits() of two bases and more, and monomer_hits(), in one scan."""
    return _flat_map(reads, seq, keep, k, 1, None, True)


def tract_hits_columns(reads: DataFrame, k: int, min_tract: int, seq: str = "seq") -> DataFrame:
    """tract_hits() from Column expressions only."""
    m = max(min_tract, 2)
    d = reads.withColumn(seq, clean(seq))
    s, n = F.col(seq), F.length(seq)
    starts = F.filter(
        F.when(n >= 2 * k + m, F.sequence(F.lit(k + 1), n - k - m + 1)).otherwise(F.array().cast("array<int>")),
        lambda i: (F.substring(s, i, F.lit(1)) != F.substring(s, i - 1, F.lit(1))) & (F.substring(s, i, F.lit(m)) == F.repeat(F.substring(s, i, F.lit(1)), F.lit(m))) & F.substring(s, i, F.lit(1)).isin("A", "C", "G", "T"),
    )
    at = F.col("at")
    d = d.withColumn("at", F.explode(starts))
    d = d.withColumn("length", F.length(F.regexp_extract(F.substring(s, at, n), r"^(.)\1*", 0))).where(at + F.col("length") - 1 + k <= n)
    run, left, right = F.substring(s, at, F.lit(1)), F.substring(s, at - k, F.lit(k)), F.substring(s, at + F.col("length"), F.lit(k))
    forward = run.isin("A", "C")
    return d.select(
        *[c for c in reads.columns if c != seq],
        F.when(forward, run).otherwise(revcomp(run)).alias("base"),
        pack_safe(F.when(forward, left).otherwise(revcomp(right))).alias("left_ctx"),
        pack_safe(F.when(forward, right).otherwise(revcomp(left))).alias("right_ctx"),
        "length",
        (at - 1 - k).alias("read_offset"),
        F.when(forward, 1).otherwise(2).alias("canon_flag"),
    )
