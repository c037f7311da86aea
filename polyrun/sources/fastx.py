"""FASTA and FASTQ files, plain, gzip or blocked gzip, as a Spark data source: spark.read.format("fastx").load(path).

A file is one partition unless a plan of its splits is given; planned() makes one with a job over byte ranges. Each range looks for what
seems to be its first record and reads its records up to the first that starts in the next range. A quality line may begin like a record, so a guess can be wrong: a range is
right if it begins where the one before ends, and is read again from there if not. The plan then has exact starts, numbers of records and the
place of a record that ends the file, so that its rows are those of one sequential pass.
"""

from __future__ import annotations

import fnmatch
import glob
import json
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file_idx int, read_id long, name string, description string, seq string, qual string"
_ARROW = pa.schema([("file_idx", pa.int32()), ("read_id", pa.int64()), ("name", pa.string()), ("description", pa.string()), ("seq", pa.string()), ("qual", pa.string())])
#: Bytes of a file that one task reads; bytes that are parsed at a time; records of a batch.
SPLIT, CHUNK, BATCH = 64 << 20, 4 << 20, 20_000
_SPACE = b" \t\n\r\v\f"
#: Fixed values of blocked gzip: the first bytes of a block, and the place and length of its extra field with the block's size.
_BLOCK, _EXTRA = b"\x1f\x8b\x08\x04", b"BC\x02\x00"


def open_input(path: str):
    """A random-access file of any file system that Arrow knows; a path without a scheme is local."""
    if "://" not in path:
        return pafs.LocalFileSystem().open_input_file(path)
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs.open_input_file(inner)


def listed(pattern: str) -> list[str]:
    """Files that a path with wildcards names, sorted."""
    if "://" not in pattern:
        found = sorted(glob.glob(pattern))
    elif any(c in pattern for c in "*?["):
        fs, inner = pafs.FileSystem.from_uri(pattern[: min(pattern.index(c) for c in "*?[" if c in pattern)].rpartition("/")[0])
        scheme = pattern.partition("://")[0]
        found = sorted(f"{scheme}://{x.path}" for x in fs.get_file_info(pafs.FileSelector(inner)) if fnmatch.fnmatch(x.path.rpartition("/")[2], pattern.rpartition("/")[2]))
    else:
        found = [pattern]
    if not found:
        raise FileNotFoundError(pattern)
    return found


def _block_size(data: bytes, at: int) -> int | None:
    """Bytes of the gzip block at a place, None if there is none that tells its size."""
    if data[at : at + 4] != _BLOCK or data[at + 12 : at + 16] != _EXTRA or len(data) < at + 18:
        return None
    return int.from_bytes(data[at + 16 : at + 18], "little") + 1


def kind_of(f) -> str:
    """plain, gzip or blocked."""
    head = f.read_at(18, 0) if f.size() else b""
    return "plain" if head[:2] != b"\x1f\x8b" else "blocked" if _block_size(head, 0) else "gzip"


class _Text:
    """The text of a file from a place on. Places are byte offsets; in a blocked file the offset of a block times 65,536, plus a place in its text."""

    def __init__(self, f, kind: str, at: int) -> None:
        self.f, self.kind, self.buffer, self.eof = f, kind, b"", False
        self.marks: list[tuple[int, int]] = []  # (place in the buffer, place in the file) of what was read together
        self.next = at >> 16 if kind == "blocked" else at
        self.skip = at & 0xFFFF if kind == "blocked" else 0
        self.gunzip = zlib.decompressobj(31) if kind == "gzip" else None
        self.size = f.size()

    def more(self, least: int) -> None:
        """Reads on, about `least` bytes of text."""
        got, n = [], 0
        while n < least and not self.eof:
            self.marks.append((len(self.buffer) + n, self.next << 16 if self.kind == "blocked" else self.next))
            if self.kind == "blocked":
                head = self.f.read_at(18, self.next)
                size = _block_size(head, 0)
                if size is None:
                    self.eof = True
                    self.marks.pop()
                    break
                text = zlib.decompress(self.f.read_at(size, self.next), 31)
                self.next += size
                if self.skip:
                    self.marks[-1] = self.marks[-1][0], self.marks[-1][1] + self.skip
                    text, self.skip = text[self.skip :], 0
                self.eof = self.next >= self.size
            else:
                text = self.f.read_at(min(CHUNK, max(0, self.size - self.next)), self.next)
                self.next += len(text)
                self.eof = self.next >= self.size
                if self.gunzip is not None:
                    text = self._unzipped(text)
            got.append(text)
            n += len(text)
        self.buffer += b"".join(got)

    def _unzipped(self, data: bytes) -> bytes:
        """A gzip file may have several members, one after the other."""
        out = []
        while data:
            out.append(self.gunzip.decompress(data))
            data = self.gunzip.unused_data
            if data:
                self.gunzip = zlib.decompressobj(31)
                if data[:2] != b"\x1f\x8b":
                    break
        return b"".join(out)

    def drop(self, n: int) -> None:
        self.buffer = self.buffer[n:]
        before = [m for m in self.marks if m[0] <= n]
        kept = [(a - n, p) for a, p in self.marks if a > n]
        self.marks = ([(0, before[-1][1] + n - before[-1][0])] if before else []) + kept

    def place(self, i: int) -> int:
        """The place in the file of buffer[i]; the end of a block is the beginning of the next."""
        a, p = next(m for m in reversed(self.marks) if m[0] <= i) if self.marks else (0, 0)
        if i == len(self.buffer) and self.kind == "blocked":
            return self.next << 16
        return p + i - a


def parse(data: bytes, eof: bool, limit: int | None = None) -> tuple[list[tuple[int, bytes, bytes, bytes | None]], int, bool]:
    """(records as (start, header, sequence, quality), bytes used, whether a bad record ends the file) of text that begins with a line.

    A record starts with > or @; its sequence may take several lines, a quality is read up to the sequence's length. A
    record with a missing quality, or one of another length, ends the file. Records that are not complete in data are left, unless it ends there;
    those that start at limit or later are not read.
    """
    n = len(data)
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw == 10)
    if eof and n and data[-1] != 10:
        ends = np.append(ends, n)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    first = np.where(ends > starts, raw[np.minimum(starts, n - 1)], 10) if n else np.zeros(0, np.uint8)
    is_head = (first == 62) | (first == 64)
    marked = np.flatnonzero(is_head | (first == 43))
    width = ends - starts
    # a line that is the header of a record of four lines with one of sequence: then its length tells the quality's
    four = np.zeros(len(starts), bool)
    if len(starts) > 3:
        plain = first != 43
        plain &= ~is_head
        four[:-3] = is_head[:-3] & plain[1:-2] & (first[2:-1] == 43) & (width[1:-2] == width[3:]) & (width[1:-2] > 0)
        odd = np.flatnonzero(np.isin(raw, np.frombuffer(b" \t\r\v\f", np.uint8)))
        if len(odd):  # white space in a sequence or quality is left to the general rule
            has = np.zeros(len(starts), bool)
            has[np.searchsorted(ends, odd)] = True
            four[:-3] &= ~has[1:-2] & ~has[3:]
    s, e, good, head = starts.tolist(), ends.tolist(), four.tolist(), is_head.tolist()
    out: list[tuple[int, bytes, bytes, bytes | None]] = []
    i, lines = 0, len(s)
    stop = n + 1 if limit is None else limit
    while i < lines:
        if not head[i]:
            i += 1
            continue
        at = s[i]
        if at >= stop:
            return out, at, False
        if good[i]:
            out.append((at, data[at + 1 : e[i]], data[s[i + 1] : e[i + 1]], data[s[i + 3] : e[i + 3]]))
            i += 4
            continue
        k = int(np.searchsorted(marked, i + 1))
        if k == len(marked):
            if not eof:
                return out, at, False
            j = lines
        else:
            j = int(marked[k])
        seq = data[e[i] + 1 : s[j] if j < lines else n].translate(None, _SPACE)
        if j == lines or head[j]:
            out.append((at, data[at + 1 : e[i]], seq, None))
            i = j
            continue
        j += 1
        qual = b""
        while j < lines and len(qual) < len(seq):
            qual += data[s[j] : e[j]].rstrip(b"\r")
            j += 1
        if len(qual) < len(seq) and not eof:
            return out, at, False
        if len(qual) != len(seq):
            return out, at, True
        out.append((at, data[at + 1 : e[i]], seq, qual))
        i = j
    return out, (n if eof else e[-1] + 1 if lines else 0), False


def _guess(data: bytes, eof: bool, fastq: bool) -> int | None:
    """Where the first record in data (which begins with a line) seems to start; None: more is needed, len(data): none."""
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b">", b"@"):
            if not fastq:
                return at
            lines, p = [], at
            while p < len(data):
                q = data.find(b"\n", p)
                if q < 0:
                    break
                lines.append(data[p : p + 1])
                if len(lines) > 1 and lines[-1] in (b">", b"@", b"+"):
                    break
                p = q + 1
            if len(lines) > 2 and lines[-1] == b"+":
                return at
            if not eof and (len(lines) < 2 or lines[-1] not in (b">", b"@", b"+")):
                return None
        q = data.find(b"\n", at)
        if q < 0:
            break
        at = q + 1
    return len(data) if eof else None


def _first_block(f, at: int) -> int:
    """The first block of a blocked file at `at` or later: what looks like one and is followed by another or the end."""
    size, base = f.size(), at
    while base < size:
        data = f.read_at(1 << 17, base)
        i = data.find(_BLOCK)
        while i >= 0:
            n = _block_size(data if len(data) >= i + 18 else f.read_at(18, base + i), i if len(data) >= i + 18 else 0)
            if n and (base + i + n == size or _block_size(f.read_at(18, base + i + n), 0)):
                return base + i
            i = data.find(_BLOCK, i + 1)
        base += max(1, len(data) - 17)
    return size


def _limit(kind: str, stop: int | None) -> int | None:
    return None if stop is None else stop << 16 if kind == "blocked" else stop


def read_split(path: str, kind: str, start: int | None, lo: int, stop: int | None) -> Iterator[tuple[list, int, bool]]:
    """(records, place after them, whether the file ends with a bad record) of a range, in parts; the last place is that of the next range's first record.

    start: the place of the first record, None to look for it from byte lo on. stop: the byte where the next range begins, None: the file's end.
    """
    with open_input(path) as f:
        limit = _limit(kind, stop)
        if start is None:
            at = _first_block(f, lo) if kind == "blocked" else lo
            first = _Text(f, kind, 0)
            first.more(1)
            fastq = first.buffer.lstrip(_SPACE)[:1] == b"@"
            text = _Text(f, kind, at << 16 if kind == "blocked" else max(0, at - 1))
            text.more(CHUNK)
            if at and kind == "plain":  # to the next line; in a block, whether a line begins with it is not known, and the guess may be wrong
                while b"\n" not in text.buffer and not text.eof:
                    text.more(2 * len(text.buffer))
                text.drop(text.buffer.find(b"\n") + 1 or len(text.buffer))
            found = _guess(text.buffer, text.eof, fastq)
            while found is None:
                text.more(max(CHUNK, len(text.buffer)))
                found = _guess(text.buffer, text.eof, fastq)
            text.drop(found)
            yield [], text.place(0), False
        else:
            text = _Text(f, kind, start)
        while True:
            # a limit inside the buffer: the first place that is not before it
            inside = None
            if limit is not None and text.marks:
                inside = next((i + max(0, limit - p) for (i, p), (j, _) in zip(text.marks, [*text.marks[1:], (len(text.buffer), 0)], strict=True) if (limit <= p or (text.kind != "blocked" and limit < p + j - i))), None)
            records, used, bad = parse(text.buffer, text.eof, inside)
            done = bad or (inside is not None and used >= inside) or (text.eof and used >= len(text.buffer))
            held = len(text.buffer) - used
            place = text.place(used)
            yield records, place, bad
            if done or (text.eof and not records and used == 0):
                return
            text.drop(used)
            text.more(max(CHUNK, held))


def _batches(records: Iterator[list], file_idx: int, read_id: int) -> Iterator[pa.RecordBatch]:
    for part in records:
        for k in range(0, len(part), BATCH):
            some = part[k : k + BATCH]
            heads = [r[1].split(None, 1) for r in some]
            cols = [[h[0] if h else b"" for h in heads], [h[1].rstrip(b"\r\n") if len(h) > 1 else b"" for h in heads], [r[2] for r in some], [r[3] for r in some]]
            ids = np.arange(read_id, read_id + len(some))
            read_id += len(some)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), file_idx, np.int32)), pa.array(ids), *(pa.array(c, pa.binary()).cast(pa.string()) for c in cols)], schema=_ARROW)


class _Split(InputPartition):
    def __init__(self, file_idx: int, path: str, kind: str | None = None, start: int | None = 0, stop: int | None = None, read_id: int = 0) -> None:
        self.file_idx, self.path, self.kind, self.start, self.stop, self.read_id = file_idx, path, kind, start, stop, read_id


class _Reader(DataSourceReader):
    def __init__(self, splits: list[_Split]) -> None:
        self.splits = splits

    def partitions(self):
        return self.splits

    def read(self, partition):
        p = partition
        kind = p.kind
        if kind is None:
            with open_input(p.path) as f:
                kind = kind_of(f)
        parts = (records for records, _, _ in read_split(p.path, kind, p.start, 0, p.stop))
        yield from _batches(parts, p.file_idx, p.read_id)


class FastxSource(DataSource):
    """One partition per file, or as the option `plan` (of planned()) says; paths are separated by commas and may hold wildcards."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        if "plan" in self.options:
            return _Reader([_Split(**x) for x in json.loads(self.options["plan"])])
        return _Reader([_Split(i, p) for i, p in enumerate(x for p in self.options["path"].split(",") for x in listed(p))])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges to their first record's place, the place of the next range's first, the number of records, and whether a bad record ends the file."""
    for batch in batches:
        for r in batch.to_pylist():
            first, n, bad, place = r["start"], 0, False, r["start"]
            for k, (records, place, bad) in enumerate(read_split(r["path"], r["kind"], r["start"], r["lo"], r["stop"])):  # noqa: B007
                if k == 0 and first is None:
                    first = place
                n += len(records)
            yield pa.RecordBatch.from_pylist([{"file_idx": r["file_idx"], "split": r["split"], "first": first, "after": place, "records": n, "bad": bad}], schema=_INDEX)


_INDEX = pa.schema([("file_idx", pa.int32()), ("split", pa.int32()), ("first", pa.int64()), ("after", pa.int64()), ("records", pa.int64()), ("bad", pa.bool_())])


def planned(spark: SparkSession, paths: list[str], split: int | None = None, begin: int = 0) -> list[dict]:
    """Splits of files for the option `plan`: byte ranges of plain and blocked files, other gzip files whole. A row per range comes to the driver.

    begin: the byte where the records of plain files begin.
    """
    split = split or SPLIT
    plan: list[dict] = []
    ranges: list[dict] = []
    for i, path in enumerate(paths):
        with open_input(path) as f:
            kind, size = kind_of(f), f.size()
        if kind == "gzip" or size - begin <= split:
            plan.append({"file_idx": i, "path": path, "kind": kind, "start": begin})
            continue
        cuts = [*range(begin, size, split), None]
        ranges += [{"file_idx": i, "split": k, "path": path, "kind": kind, "lo": a, "stop": b, "start": begin if k == 0 else None} for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    if not ranges:
        return plan
    known: dict[tuple[int, int], dict] = {}
    todo = ranges
    while todo:
        # a range each task, by a seed in the rows: ranges are few and each takes long
        df = spark.createDataFrame([tuple(r[c] for c in ("file_idx", "split", "path", "kind", "lo", "stop", "start")) for r in todo], "file_idx int, split int, path string, kind string, lo long, stop long, start long")
        got = df.repartition(len(todo)).mapInArrow(_indexed, "file_idx int, split int, first long, after long, records long, bad boolean").collect()
        known |= {(r["file_idx"], r["split"]): r.asDict() for r in got}
        todo = []
        after: dict[int, int] = {}
        for r in ranges:
            x = known[r["file_idx"], r["split"]]
            began = after.get(r["file_idx"], begin)
            limit = _limit(r["kind"], r["stop"])
            if began < 0 or (r["split"] and limit is not None and began >= limit):
                x |= {"first": began, "after": began, "records": 0, "bad": False}  # a record covers the range, or the file has ended
            elif r["split"] and x["first"] != began:
                todo.append({**r, "start": began})
                break
            after[r["file_idx"]] = -1 if x["bad"] else x["after"]
    read_id: dict[int, int] = {}
    for r in ranges:
        x = known[r["file_idx"], r["split"]]
        if x["records"]:
            plan.append({"file_idx": r["file_idx"], "path": r["path"], "kind": r["kind"], "start": x["first"], "stop": r["stop"], "read_id": read_id.get(r["file_idx"], 0)})
        read_id[r["file_idx"]] = read_id.get(r["file_idx"], 0) + x["records"]
    return plan


def read_fastx(spark: SparkSession, paths: list[str], split: int | None = None) -> DataFrame:
    """file_idx, read_id (place in the file), name, description, seq, qual of files, large ones in splits."""
    spark.dataSource.register(FastxSource)
    every = [x for p in paths for x in listed(p)]
    return spark.read.format("fastx").option("plan", json.dumps(planned(spark, every, split))).load(",".join(every))


def sample_name(path: str) -> str:
    name = Path(path).name
    for end in (".gz", ".fastq", ".fq", ".fasta", ".fa"):
        name = name.removesuffix(end)
    return name


def read_samples(spark: SparkSession, paths: list[str], paired: bool = False) -> DataFrame:
    """Reads of all files with sample_idx: a sample per file, or per two consecutive ones (an odd last one is left out)."""
    paths = paths[: len(paths) // 2 * 2] if paired else paths
    d = read_fastx(spark, paths)
    return d.withColumn("sample_idx", F.floor(F.col("file_idx") / (2 if paired else 1)).cast("int"))


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """ref_id, contig, seq, len of a reference."""
    return read_fastx(spark, [path]).select(F.col("read_id").cast("int").alias("ref_id"), F.col("name").alias("contig"), F.upper("seq").alias("seq"), F.length("seq").alias("len"))


def simplified_names(names: list[str]) -> list[str]:
    """Sample names without the prefix and the suffix that all of them share; one character stays if a name would be empty."""
    if len(names) < 2:
        return list(names)
    low = min(map(len, names))
    pre = next((i for i in range(low) if len({n[i] for n in names}) > 1), low)
    suf = next((i for i in range(low) if len({n[-1 - i] for n in names}) > 1), low)
    if pre + suf >= low:
        pre = max(0, pre - 1) if pre >= low else pre
        suf = max(0, low - pre - 1)
    return [n[pre : len(n) - suf] for n in names]
