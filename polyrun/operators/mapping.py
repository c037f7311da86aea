"""Locating tracts on a reference: seeds, verification by edit distance, and the best match."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from polyrun.functions.dna import revcomp
from polyrun.sources.shared import shuffled, width

#: Bases of a tile, and of the next ones that it repeats: the longest segment that can be cut out. Spark counts characters from the start of a string, so tiles are short.
TILE, OVERLAP = 512, 2048
#: Bases whose stretches of an index are made at a time.
SPAN = 1 << 14


def with_offsets(contigs: DataFrame) -> DataFrame:
    """contigs with flat_offset: bases of all contigs before. A catalogue of contigs is small."""
    before = F.sum("len").over(Window.orderBy("ref_id").rowsBetween(Window.unboundedPreceding, -1))
    return contigs.withColumn("flat_offset", F.coalesce(before, F.lit(0)).cast("long"))


def tiles(contigs: DataFrame, size: int = TILE, overlap: int = OVERLAP) -> DataFrame:
    """ref_id, tile, tile_seq: overlapping pieces, so that segments are cut out of short strings and join on a key."""

    def run(batches):
        for batch in batches:
            for ref, seq in zip(batch.column("ref_id").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                n = range(-(-len(seq) // size) or 1)
                yield pa.RecordBatch.from_arrays([pa.array([ref] * len(n), pa.int32()), pa.array(list(n), pa.int32()), pa.array([seq[i * size : (i + 1) * size + overlap] for i in n], pa.string())], names=["ref_id", "tile", "tile_seq"])

    return contigs.select("ref_id", F.upper("seq").alias("seq")).mapInArrow(run, "ref_id int, tile int, tile_seq string")


def with_segment(df: DataFrame, contigs: DataFrame, start: Column, length: Column, name: str = "segment") -> DataFrame:
    """df (with ref_id) and the bases [start, start + length) of its contig; start counts from 0."""
    d = df.withColumn("_start", start.cast("int")).withColumn("tile", F.floor(F.col("_start") / TILE).cast("int"))
    d = d.join(shuffled(tiles(contigs)), ["ref_id", "tile"])
    return d.withColumn(name, F.substring(F.col("tile_seq"), F.col("_start") - F.col("tile") * TILE + 1, length.cast("int"))).drop("tile", "tile_seq", "_start")


def ref_qgrams(contigs: DataFrame, q: int) -> DataFrame:
    """qgram, ref_id, pos of every stretch of q bases. Spans of the contigs are dealt out first: a genome is few bytes for what its stretches cost."""
    spans = tiles(contigs, SPAN, q - 1)

    def run(batches):
        for batch in batches:
            for ref, tile, seq in zip(*(batch.column(c).to_pylist() for c in ("ref_id", "tile", "tile_seq")), strict=True):
                n = len(seq) - q + 1
                if n < 1:
                    continue
                if seq.isascii():
                    chars = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(np.frombuffer(seq.encode(), np.uint8), q))
                    grams = pa.StringArray.from_buffers(n, pa.py_buffer(np.arange(0, (n + 1) * q, q, dtype=np.int32)), pa.py_buffer(chars))
                else:
                    grams = pa.array([seq[i : i + q] for i in range(n)], pa.string())
                yield pa.RecordBatch.from_arrays([grams, pa.array(np.full(n, ref, np.int32)), pa.array(np.arange(n, dtype=np.int32) + tile * SPAN)], names=["qgram", "ref_id", "pos"])

    return spans.repartition(width(spans), "ref_id", "tile").mapInArrow(run, "qgram string, ref_id int, pos int")


#: A stretch that a HOT-th of all places hold or more is dealt out over slots of that size each; there are HOT such stretches at most.
HOT = 1_000


@dataclass(frozen=True)
class Index:
    """Stretches of q bases of a reference: positions (key, qgram, ref_id, pos), and how many of them each has, frequencies (qgram, n, slots).

    A key is a stretch and a slot; slots of a stretch of n places among `total` have about total / HOT of them.
    """

    q: int
    positions: DataFrame
    frequencies: DataFrame


def _key(qgram: Column | str, slot: Column) -> Column:
    return F.xxhash64(qgram, slot)


def build_index(contigs: DataFrame, q: int) -> Index:
    """The index as a plan. Frequencies are summed before the shuffle, and only those of hot stretches meet the places, by a broadcast of HOT rows at most."""
    grams = ref_qgrams(contigs, q)
    counted = grams.groupBy("qgram").agg(F.count("*").alias("n"))
    total = contigs.agg(F.sum(F.greatest(F.col("len") - q + 1, F.lit(0)))).first()[0] or 0
    slots = F.ceil(F.col("n") * HOT / F.lit(max(1, total))).cast("long")
    frequencies = counted.withColumn("slots", slots)
    hot = frequencies.where(F.col("n") * HOT >= total).select("qgram", "slots")
    own = F.pmod(F.xxhash64("ref_id", "pos"), F.coalesce("slots", F.lit(1)))
    positions = grams.join(F.broadcast(hot), "qgram", "left").select(_key("qgram", own).alias("key"), "qgram", "ref_id", "pos")
    return Index(q, positions, frequencies)


def digest(contigs: DataFrame) -> str:
    """Tells references apart by their contigs' numbers, names and sequences, in any order."""
    each = contigs.select(F.xxhash64("ref_id", "contig", F.sha2(F.upper("seq"), 256)).alias("h"), F.xxhash64(F.sha2(F.upper("seq"), 256), "ref_id").alias("g"))
    r = each.agg(F.count("*").alias("n"), F.sum(F.col("h").cast("decimal(38,0)")).alias("h"), F.sum(F.col("g").cast("decimal(38,0)")).alias("g")).first()
    return hashlib.sha256(f"{r.n} {r.h} {r.g}".encode()).hexdigest()[:24]


def stored_index(contigs: DataFrame, q: int, folder: str, buckets: int | None = None) -> Index:
    """The index of this reference in `folder`, written if it is not there: bucketed and sorted by what it is looked up by.

    Later runs, of other sessions too, find it by the digest of the contigs and read it without a shuffle; another reference has another digest. A table
    counts as written when its success marker is there.
    """
    spark = contigs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"q{q}_{digest(contigs)}"
    jvm = spark.sparkContext._jvm

    def there(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    # the number of buckets is part of what is found: a later run may have other settings
    root = f"{folder.rstrip('/')}/{name}"
    if not (there(f"{root}/positions") and there(f"{root}/frequencies")):
        index = build_index(contigs, q)
        tables = {"positions": (index.positions.repartition(buckets, "key"), "key"), "frequencies": (index.frequencies.repartition(buckets, "qgram"), "qgram")}
        for kind, (df, key) in tables.items():
            spark.sql(f"DROP TABLE IF EXISTS polyrun_{kind}_{name}")
            df.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").option("path", f"{root}/{kind}").saveAsTable(f"polyrun_{kind}_{name}")
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{root}/layout")
    elif not all(spark.catalog.tableExists(f"polyrun_{kind}_{name}") for kind in ("positions", "frequencies")):
        n = spark.read.parquet(f"{root}/layout").first()[0]
        spark.sql(f"CREATE TABLE IF NOT EXISTS polyrun_positions_{name} (key BIGINT, qgram STRING, ref_id INT, pos INT) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {n} BUCKETS LOCATION '{root}/positions'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS polyrun_frequencies_{name} (qgram STRING, n BIGINT, slots BIGINT) USING parquet CLUSTERED BY (qgram) SORTED BY (qgram) INTO {n} BUCKETS LOCATION '{root}/frequencies'")
    return Index(q, spark.table(f"polyrun_positions_{name}"), spark.table(f"polyrun_frequencies_{name}"))


def rarest_seeds(both: DataFrame, index: Index, edits: int) -> DataFrame:
    """query, s, neg_strand, off, qgram, slots: of each of the edits + 1 pieces of s the stretch that the reference holds least often (of equals the first).

    A piece that is unchanged in the reference holds all its stretches unchanged, so any of them finds it; one that is nowhere rules the piece out.
    """
    q, n = index.q, F.length("s")
    piece = F.floor(n / (edits + 1)).cast("int")
    last = F.when(F.col("i") == edits, n).otherwise((F.col("i") + 1) * piece) - q
    each = both.select("query", "s", "neg_strand", F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("i")).where(last >= F.col("i") * piece)
    each = each.select("query", "s", "neg_strand", "i", F.explode(F.sequence(F.col("i") * piece, last)).alias("off"))
    each = each.withColumn("qgram", F.substring(F.col("s"), F.col("off") + 1, F.lit(q)))
    asked = each.select("qgram").distinct().join(shuffled(index.frequencies), "qgram", "left")  # a stretch that many queries hold is looked up once
    each = each.join(shuffled(asked), "qgram").withColumn("n", F.coalesce("n", F.lit(0)))
    least = each.groupBy("query", "s", "neg_strand", "i").agg(F.min(F.struct("n", "off", "qgram", "slots")).alias("x"))
    return least.where("x.n > 0").select("query", "s", "neg_strand", "x.off", "x.qgram", "x.slots")


#: By what a seed fixes of its hits: their start, their end, or neither (then their start to one base).
START, END, MIDDLE = 0, 1, 2
#: Bases of a block of a reference; strings that meet a block in one task, and those of a packed row; bits of a gram that its places are found by;
#: strings whose seeds are made at a time, and places that are verified at a time.
BLOCK, STRINGS, PACKED, BITS, SEEDED, PLACES = 1 << 21, 1 << 19, 1 << 16, 22, 1 << 13, 1 << 15
#: What a character of a text and of a string is told by if it is not below them; a text has the first nowhere, a string not the second.
_FOREIGN, _FILLER = 254, 255


def _points(strings: list[str]) -> np.ndarray:
    return np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)


def _letters(points: np.ndarray) -> np.ndarray:
    """A number below 4 of each character, different for A, C, G and T. Equal numbers of different characters only give places that are refused when they are verified."""
    return (points >> 1 & 3).astype(np.uint64)


def _gram(letters: list[np.ndarray]) -> np.ndarray:
    """The letters, up to 32, as one number each; the first lowest."""
    out = np.zeros(len(letters[0]), np.uint64)
    for j, x in enumerate(letters):
        out |= x << np.uint64(2 * j)
    return out


def one_edit_prefixes(piece: list[np.ndarray]) -> list[list[np.ndarray]]:
    """What the text's first len(piece) - 1 letters can be where a piece stands with at most one edit, of many pieces at once."""
    n = len(piece) - 1
    head, letters = piece[:n], [np.full(len(piece[0]), v, np.uint64) for v in range(4)]
    out = [head, *(piece[:i] + piece[i + 1 :] for i in range(n))]
    return out + [head[:i] + [x] + rest for i in range(n) for x in letters for rest in (head[i + 1 :], head[i : n - 1])]


def pair_seeds(letters: list[np.ndarray], q: int) -> Iterator[tuple[tuple[int, int, int], np.ndarray, np.ndarray, int, int]]:
    """Seeds of all places of strings of one length within two edits: (kind, gram, string, lead, what it fixes); an unshifted hit starts at the gram's place less lead.

    letters: of each place those of all strings. A kind is the letters of two stretches and of the gap between them. A string is cut in three pieces of q letters at least, the middle one of q. Two edits leave
    the first or the last piece unchanged beside a middle one with one edit at most, or the middle one beside a first one with one at most, or both outer ones
    around a middle one with two. So one piece's q letters and q - 1 of the text beside them are known but for one edit, or two pieces' q letters at one of five distances.
    """
    a = (len(letters) - q) // 2
    first, middle, last = letters[a - q : a], letters[a : a + q], letters[a + q : a + 2 * q]
    suffixes = lambda piece: [x[::-1] for x in one_edit_prefixes(piece[::-1])]
    for near, known, before, lead, fixed in ((one_edit_prefixes(middle), first, False, a - q, START), (suffixes(middle), last, True, a + 1, END), (suffixes(first), middle, True, a - q + 1, MIDDLE)):
        some = np.sort(np.stack([_gram(x) for x in near]), axis=0)
        some = some | _gram(known) << np.uint64(2 * q - 2) if before else some << np.uint64(2 * q) | _gram(known)
        new, string = np.nonzero(np.concatenate([np.ones((1, some.shape[1]), bool), some[1:] != some[:-1]]))
        yield (2 * q - 1, 0, 0), some[new, string], string, lead, fixed
    for d in range(-2, 3):
        yield (q, q, q + d), _gram(first + last), np.arange(len(first[0])), a - q, START


def gap_seeds(letters: list[np.ndarray], q: int) -> Iterator[tuple[tuple[int, int, int], np.ndarray, np.ndarray, int, int]]:
    """As pair_seeds(), within one edit: it leaves two of three pieces unchanged, and changes the distance of the outer ones by a letter at most."""
    a = (len(letters) - q) // 2
    first, middle, last = letters[a - q : a], letters[a : a + q], letters[a + q : a + 2 * q]
    every = np.arange(len(first[0]))
    yield (2 * q, 0, 0), _gram(first + middle), every, a - q, START
    yield (2 * q, 0, 0), _gram(middle + last), every, a, END
    for d in (q - 1, q, q + 1):
        yield (q, q, d), _gram(first + last), every, a - q, START


def end_distances(s: np.ndarray, text: np.ndarray) -> np.ndarray:
    """[k + 2, i]: edits between the column s[:, i] and text[2 : 2 + len(s) + k, i], k from -2 to 2, where they are 2 at most. text: two rows more than of s on either side."""
    row = np.empty((5, s.shape[1]), np.uint8)
    row[:] = np.array([9, 9, 0, 1, 2], np.uint8)[:, None]
    for i, c in enumerate(s):
        new = row + (text[i : i + 5] != c)
        np.minimum(new[:4], row[1:] + np.uint8(1), out=new[:4])
        for k in range(1, 5):
            np.minimum(new[k], new[k - 1] + np.uint8(1), out=new[k])
        row = new
    return row


class Block:
    """A part of a reference: spans (ref_id, start, begin, size, span) with what lies on either side of them; places are flat ones of all spans in turn."""

    def __init__(self, spans: pa.Table) -> None:
        strings = spans.column("span").to_pylist()
        self.ref, self.start, begin, self.size = (spans.column(c).to_numpy().astype(np.int64) for c in ("ref_id", "start", "begin", "size"))
        n = np.fromiter(map(len, strings), np.int64, len(strings))
        points = _points(strings)
        self.wide = bool(points.max(initial=0) >= _FOREIGN)
        edge = np.full(OVERLAP, 2**32 - 1 if self.wide else _FILLER, np.uint32)
        self.text = np.concatenate([edge, points, edge]).astype(np.uint32 if self.wide else np.uint8)
        self.letters = _letters(self.text).astype(np.uint8)
        self.head = OVERLAP + np.cumsum(n) - n
        self.zero = self.head - begin  # where its contig's first base would be

    def codes(self, points: np.ndarray) -> np.ndarray:
        return points if self.wide else np.minimum(points, _FOREIGN).astype(np.uint8)

    def index(self, kind: tuple[int, int, int]) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """(bits, first, place, gram): places by the low bits of their grams; those of the low bits b are from first[b] on."""
        one, two, gap = kind
        many = np.maximum(0, np.minimum(self.start + SPAN, self.size - (one + gap + two) + 1) - self.start)
        place = np.repeat(self.zero + self.start - (np.cumsum(many) - many), many) + np.arange(many.sum())
        gram, n = np.zeros(len(self.letters), np.uint64), len(self.letters)
        for j, x in enumerate([*range(one), *range(one + gap, one + gap + two)]):
            gram[: n - x] |= self.letters[x:].astype(np.uint64) << np.uint64(2 * j)
        gram = gram[place]
        bits = min(BITS, 2 * (one + two), len(place).bit_length() + 1)
        low = gram & np.uint64((1 << bits) - 1)
        order = np.sort(low << np.uint64(32) | np.arange(len(low), dtype=np.uint64))  # numbers are sorted far faster than their places
        first = np.searchsorted(order, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(32)).astype(np.int32)
        order = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
        return bits, first, place[order].astype(np.int32), gram[order]

    def met(self, index: tuple, gram: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(seed, place) of all places of each gram, PLACES at most at a time."""
        bits, first, place, grams = index
        low = (gram & np.uint64((1 << bits) - 1)).astype(np.int64)
        low, n = first[low].astype(np.int64), first[low + 1] - first[low]
        end = np.cumsum(n, dtype=np.int64)
        for at in range(0, int(end[-1]) if len(end) else 0, PLACES):
            to = min(at + PLACES, int(end[-1]))
            x, y = np.searchsorted(end, at, "right"), np.searchsorted(end, to, "left") + 1
            seed = np.repeat(np.arange(x, y), np.minimum(end[x:y], to) - np.maximum(end[x:y] - n[x:y], at))
            hit = low[seed] + np.arange(at, to) - (end[seed] - n[seed])
            same = grams[hit] == gram[seed]
            yield seed[same], place[hit[same]].astype(np.int64)

    def ends(self, s: np.ndarray, start: np.ndarray, fixed: int, edits: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(column of s, first place, last place, edits) of hits of the columns s that start, or end, as fixed says, where an unshifted one starts at start."""
        n = len(s)
        for moved in (-1, 0, 1) if fixed == MIDDLE else (0,):
            text = self.text[start + moved + np.arange(-2, n + 2)[:, None]]
            found = end_distances(s[::-1], text[::-1]) if fixed == END else end_distances(s, text)
            k, i = np.nonzero(found <= edits)
            head = start[i] + moved - (k - 2 if fixed == END else 0)
            yield i, head, head + n + k - 3, found[k, i]

    def located(self, place: np.ndarray, head: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        """(whether it lies on the contig, ref_id, loc_pos, loc_last) of hits whose seed has a place."""
        own = np.searchsorted(self.head, place, "right") - 1
        head, last = head - self.zero[own], last - self.zero[own]
        return (head >= 0) & (last < self.size[own]) & (last >= head), self.ref[own], head, last


_HITS = pa.schema([("query", pa.string()), ("ref_id", pa.int32()), ("loc_pos", pa.int32()), ("loc_last", pa.int32()), ("mismatches", pa.int32()), ("neg_strand", pa.bool_())])
_NEAR = pa.schema([("query", pa.string()), ("s", pa.string()), ("neg_strand", pa.bool_()), ("ref_id", pa.int32()), ("pos", pa.int32()), ("lead", pa.int32()), ("fixed", pa.int32())])


def _found(block: Block, strings: pa.Table, q: int, edits: int, check: bool) -> Iterator[pa.RecordBatch]:
    """Hits of strings (query, s, neg_strand) in a block, or the places that are verified for them; an index of a kind of gram is held at a time."""
    s = strings.column("s").to_pylist()
    size = np.fromiter(map(len, s), np.int64, len(s))
    seeds = pair_seeds if edits == 2 else gap_seeds
    kinds = [(2 * q - 1, 0, 0), *((q, q, q + d) for d in range(-2, 3))] if edits == 2 else [(2 * q, 0, 0), *((q, q, d) for d in (q - 1, q, q + 1))]
    for of in kinds:
        index = block.index(of)
        for n in np.unique(size).tolist():
            same = np.flatnonzero(size == n)
            for at in range(0, len(same), SEEDED):
                own = same[at : at + SEEDED]
                points = _points([s[i] for i in own.tolist()]).reshape(len(own), n).T
                letters, chars = list(_letters(points)), block.codes(points)
                rows: list[tuple[np.ndarray, ...]] = []
                for kind, gram, string, lead, fixed in seeds(letters, q):
                    if kind != of:
                        continue
                    for seed, place in block.met(index, gram):
                        row = string[seed]
                        if not check:
                            _, ref, pos, _ = block.located(place, place, place)
                            rows.append((own[row], ref, pos, np.full(len(row), lead), np.full(len(row), fixed)))
                            continue
                        for i, head, last, d in block.ends(chars[:, row], place - lead, fixed, edits):
                            keep, ref, head, last = block.located(place[i], head, last)
                            rows.append((own[row[i]][keep], ref[keep], head[keep], last[keep], d[keep]))
                if not sum(len(x[0]) for x in rows):
                    continue
                row, *values = (np.concatenate(x) for x in zip(*rows, strict=True))
                if check:  # a hit is found by several seeds
                    row, *values = np.unique(np.stack([row, *values]).astype(np.int64), axis=1)
                taken = strings.take(pa.array(row))
                column = lambda c: taken.column(c).combine_chunks()
                numbers = [pa.array(x.astype(np.int32)) for x in values]
                arrays = [column("query"), *numbers, column("neg_strand")] if check else [column("query"), column("s"), column("neg_strand"), *numbers]
                yield pa.RecordBatch.from_arrays(arrays, schema=_HITS if check else _NEAR)


def _spans(contigs: DataFrame) -> DataFrame:
    """ref_id, start, begin, size, span: SPAN bases of a contig of `size` bases from start on, with those on either side; the first is at begin."""

    def run(batches):
        for batch in batches:
            for ref, seq in zip(batch.column("ref_id").to_pylist(), batch.column("seq").to_pylist(), strict=True):
                start = np.arange(0, len(seq) or 1, SPAN)
                begin = np.maximum(0, start - OVERLAP)
                text = [seq[b : i + SPAN + OVERLAP] for i, b in zip(start.tolist(), begin.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), ref), pa.int32()), pa.array(start), pa.array(begin), pa.array(np.full(len(start), len(seq)), pa.int64()), pa.array(text, pa.string())], names=["ref_id", "start", "begin", "size", "span"])

    return contigs.select("ref_id", F.upper("seq").alias("seq")).mapInArrow(run, "ref_id int, start long, begin long, size long, span string")


def packed(df: DataFrame, n: int, by: list[str], name: str, rows: int = 1 << 62) -> DataFrame:
    """df in n partitions of packed rows of `rows` rows at most."""

    def pack(batches):
        held: list[pa.RecordBatch] = []

        def row() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as out:
                for x in held:
                    out.write_batch(x)
            return pa.RecordBatch.from_arrays([pa.array([held[0].column("_part")[0].as_py()], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["_part", name])

        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, rows - sum(x.num_rows for x in held))
                held.append(some)
                batch = batch.slice(some.num_rows)
                if sum(x.num_rows for x in held) >= rows:
                    yield row()
                    held = []
        if held:
            yield row()

    # dealt out again after packing, so that what meets it several times does not pack it several times
    dealt = df.repartition(n, *by).withColumn("_part", F.spark_partition_id())
    return dealt.mapInArrow(pack, f"_part int, {name} binary").repartitionById(n, "_part").drop("_part")


def spanning(both: DataFrame, contigs: DataFrame, q: int, edits: int, check: bool) -> DataFrame:
    """Hits of both (query, s, neg_strand) within one or two edits, some more than once; or, without check, the places that are verified for them.

    Places to verify grow as strings times genome, so none is stored or shuffled: every block of the genome meets every block of strings in a task that finds the places and verifies them at once. Of both
    only one copy is written, as a Cartesian product reads its sides again.
    """
    q = min(q, 16)
    blocks = -(-(contigs.agg(F.sum("len")).first()[0] or 0) // BLOCK) or 1
    n = max(-(-both.count() // STRINGS), -(-width(both) // blocks))
    too_long = F.raise_error(F.format_string("a query of %d bases is longer than %d", F.length("s"), F.lit(OVERLAP - 8)))
    strings = both.select(F.nullif(F.col("query"), F.col("s")).alias("query"), F.when(F.length("s") <= OVERLAP - 8, F.col("s")).otherwise(too_long).alias("s"), "neg_strand")
    sides = packed(_spans(contigs), blocks, ["ref_id", "start"], "spans").hint("shuffle_replicate_nl").crossJoin(packed(strings, n, ["s", "neg_strand"], "strings", PACKED))

    def met_by_gram(batches):
        spans, held = None, []

        def met():
            own = pa.concat_tables(held)
            own = own.set_column(own.schema.get_field_index("query"), "query", pc.coalesce(own.column("query"), own.column("s")))
            yield from _found(Block(pa.ipc.open_stream(spans).read_all()), own, q, edits, check)

        for batch in batches:
            for x, y in zip(batch.column("spans"), batch.column("strings"), strict=True):
                x = x.as_py()
                if spans is not None and (x != spans or sum(t.num_rows for t in held) >= STRINGS):
                    yield from met()
                    held = []
                spans = x
                held.append(pa.ipc.open_stream(y.as_py()).read_all().select(["query", "s", "neg_strand"]))
        if held:
            yield from met()

    hits = "query string, ref_id int, loc_pos int, loc_last int, mismatches int, neg_strand boolean"
    return sides.select("spans", "strings").mapInArrow(met_by_gram, hits if check else "query string, s string, neg_strand boolean, ref_id int, pos int, lead int, fixed int")


def near_pairs(both: DataFrame, contigs: DataFrame, q: int) -> DataFrame:
    """query, s, neg_strand, ref_id, pos, lead, fixed: the places that seeds of pair_seeds() point to."""
    return spanning(both, contigs, q, 2, False)


def near_gaps(both: DataFrame, contigs: DataFrame, q: int) -> DataFrame:
    """As near_pairs(), of gap_seeds()."""
    return spanning(both, contigs, q, 1, False)


#: A shorter stretch is found at so many places that one edit, too, is sought by seeds that span pieces.
SHORT = 12
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _stretches(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of every q characters in a row. Equal hashes of different bases only give places that are refused when they are verified."""
    out = np.zeros(max(0, len(codes) - q + 1), np.uint64)
    for j in range(q):
        out = out * _FACTOR + codes[j : j + len(out)]
    return out


def _joined(first: np.ndarray, second: np.ndarray, gap: int) -> np.ndarray:
    """What two stretches with gap bases between them are looked up by."""
    return ((first * _FACTOR + second) * _FACTOR + np.uint64(gap)).view(np.int64)


def gap_grams(contigs: DataFrame, q: int, only: list[int]) -> DataFrame:
    """Grams of a reference, of a kind that gap_seeds() looks up, that begin with a stretch of one of these hashes."""
    some = np.array(only, np.int64)

    def run(batches):
        for batch in batches:
            for seq in batch.column("tile_seq").to_pylist():
                h = _stretches(np.frombuffer(seq.encode("utf-32-le"), np.uint32), q)
                for gap in (0, q - 1, q, q + 1):
                    at = np.arange(max(0, min(SPAN, len(h) - q - gap)))
                    at = at[np.isin(h[at].view(np.int64), some)]
                    yield pa.RecordBatch.from_arrays([pa.array(_joined(h[at], h[at + q + gap], gap))], names=["gram"])

    spans = tiles(contigs, SPAN, 3 * q)
    return spans.repartition(width(spans), "ref_id", "tile").mapInArrow(run, "gram long")


def _frequent(contigs: DataFrame, q: int, least: float) -> list[int]:
    """Hashes of the stretches of q bases that `least` places or more begin."""

    def run(batches):
        for batch in batches:
            for seq in batch.column("tile_seq").to_pylist():
                h, n = np.unique(_stretches(np.frombuffer(seq.encode("utf-32-le"), np.uint32), q)[:SPAN].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    counted = tiles(contigs, SPAN, q - 1).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    return [r.h for r in counted.where(F.col("n") >= least).collect()]


def hot_gaps(contigs: DataFrame, q: int) -> dict[int, int]:
    """How many parts of HOT-th of all places each the hot grams of gap_seeds() have, 4 * HOT grams at most: what verification meets most often. A gram is as frequent as the stretch that begins it at most, so only grams of frequent stretches, HOT at most, are counted."""
    total = contigs.agg(F.sum("len")).first()[0] or 0
    frequent = _frequent(contigs, q, total / HOT)
    if not frequent:
        return {}
    counted = gap_grams(contigs, q, frequent).groupBy("gram").agg(F.count("*").alias("n"))
    return {r.gram: -(-r.n * HOT // total) for r in counted.where(F.col("n") * HOT >= total).collect()}


def locate_spanning(both: DataFrame, contigs: DataFrame, q: int, edits: int) -> DataFrame:
    """locate() within one or two edits of strings s of 3 q bases or more, by seeds that span pieces."""
    return spanning(both, contigs, q, edits, True).distinct()


def locate(queries: DataFrame, contigs: DataFrame, q: int, edits: int = 0, index: Index | None = None) -> DataFrame:
    """All hits of queries (query: string) within `edits` edits: query, ref_id, loc_pos, loc_last, mismatches, neg_strand.

    A query within e edits keeps one of its e + 1 pieces unchanged, so of each piece, on either strand, the rarest stretch of q bases
    is looked up in the index by an equi-join; only what it points to is verified. No hit is dropped: places of a stretch that is
    frequent everywhere are met slot by slot. A query whose pieces are shorter than q is refused. Two edits, and one with short pieces, are sought without a stored index by seeds that span two pieces, in blocks of the reference.
    """
    spanning = index is None and (edits == 2 and q > 2 or edits == 1 and 5 < q < SHORT)
    if not spanning:
        index = index or build_index(contigs, q)
        q = index.q
    both = queries.select("query").distinct().select("query", F.explode(F.array(F.struct(F.col("query").alias("s"), F.lit(False).alias("neg_strand")), F.struct(revcomp("query").alias("s"), F.lit(True).alias("neg_strand")))).alias("x")).select("query", "x.*")
    n = F.length("s")
    both = both.withColumn("s", F.when(F.floor(n / (edits + 1)) >= q, F.col("s")).otherwise(F.raise_error(F.format_string("a query of %d bases has no piece of %d for %d edits", n, F.lit(q), F.lit(edits)))))
    if spanning:
        return locate_spanning(both, contigs, q if edits == 2 else 2 * q // 3, edits)
    seeds = rarest_seeds(both, index, edits).select("query", "s", "neg_strand", "off", "qgram", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1)).alias("slot")).withColumn("key", _key("qgram", F.col("slot")))
    # joined on the key alone, by which a stored index is bucketed; equal keys of different stretches are told apart after it (an equality would become a key)
    near = seeds.join(shuffled(index.positions.withColumnRenamed("qgram", "found")), "key").where("instr(found, qgram) = 1").select("query", "s", "neg_strand", "ref_id", (F.col("pos") - F.col("off")).alias("at")).distinct()
    near = near.select("query", "s", "neg_strand", "ref_id", F.explode(F.sequence(F.lit(-edits), F.lit(edits))).alias("d"), "at")
    near = near.select("query", "s", "neg_strand", "ref_id", (F.col("at") + F.col("d")).alias("loc_pos")).where("loc_pos >= 0").distinct()
    cut = with_segment(near, contigs, F.col("loc_pos"), n + edits)
    cut = cut.withColumn("d", F.explode(F.sequence(F.lit(-edits), F.lit(edits)))).withColumn("segment", F.substring(F.col("segment"), F.lit(1), n + F.col("d"))).where(F.length("segment") == n + F.col("d"))
    nm = F.when(F.col("s") == F.col("segment"), 0).when(F.lit(edits) > 0, F.levenshtein("s", "segment", edits)).otherwise(-1)
    return cut.withColumn("mismatches", nm).where("mismatches >= 0").select("query", "ref_id", "loc_pos", (F.col("loc_pos") + F.length("segment") - 1).alias("loc_last"), "mismatches", "neg_strand")


def best_match(hits: DataFrame, contigs: DataFrame) -> DataFrame:
    """Of each query the hit with the fewest mismatches, then leftmost on the flattened genome; multi: another place is as good."""
    h = hits.join(with_offsets(contigs).select("ref_id", "flat_offset"), "ref_id").withColumn("location", F.col("flat_offset") + F.col("loc_pos"))
    order = F.struct("mismatches", "location", F.col("neg_strand").cast("int"), "loc_last")
    # equally good places are counted by their extremes, so a query with many hits costs a task no more than one row
    each = h.groupBy("query", "mismatches").agg(F.min(F.struct(order.alias("o"), "ref_id", "loc_pos", "loc_last", "neg_strand", "location")).alias("b"), F.max("location").alias("far"))
    kept = each.groupBy("query").agg(F.min_by(F.struct("b", "far", "mismatches"), "mismatches").alias("x"))
    return kept.select("query", "x.b.ref_id", "x.b.loc_pos", "x.b.loc_last", "x.mismatches", "x.b.neg_strand", "x.b.location", (F.col("x.far") > F.col("x.b.location")).alias("multi"))


def leftmost_match(hits: DataFrame, contigs: DataFrame) -> DataFrame:
    """best_match() in compat: hits come best first, and one replaces the last accepted if it has fewer mismatches or lies more to the left, whatever its mismatches.

    Coming best first, a later hit never has fewer mismatches, so the one that stays is the leftmost of all, of those at one place the best;
    multi: it is not the first that was accepted. Both are minima, so hits are combined before the shuffle.
    """
    h = hits.join(with_offsets(contigs).select("ref_id", "flat_offset"), "ref_id").withColumn("location", F.col("flat_offset") + F.col("loc_pos"))
    rest = [F.col("neg_strand").cast("int").alias("neg"), F.col("loc_last"), F.col("ref_id"), F.col("loc_pos")]
    each = h.groupBy("query").agg(F.min(F.struct("location", "mismatches", *rest)).alias("x"), F.min(F.struct("mismatches", "location")).alias("first"))
    return each.select("query", "x.ref_id", "x.loc_pos", "x.loc_last", "x.mismatches", (F.col("x.neg") == 1).alias("neg_strand"), "x.location", (F.col("first.location") != F.col("x.location")).alias("multi"))


def located_elements(elements: DataFrame, contigs: DataFrame, q: int, edits: int = 0, index: Index | None = None, compat: bool = False) -> DataFrame:
    """Elements of contexts that map, with their place. One string per context is looked up (that of its longest tract), its place holds for all lengths."""
    context = ["sample_idx", "base", "left_ctx", "right_ctx"]
    longest = elements.groupBy(*context).agg(F.max("length").alias("longest"))
    text = F.concat("left_ctx", F.repeat("base", F.col("longest")), "right_ctx")
    asked = longest.withColumn("query", text)
    found = (leftmost_match if compat else best_match)(locate(asked, contigs, q, edits, index), contigs)
    return elements.join(shuffled(asked.join(shuffled(found), "query").drop("query", "longest")), context)


def mapping_counts(elements: DataFrame, located: DataFrame) -> DataFrame:
    """Per sample: distinct contexts and elements (contexts with a length) that are found on the reference, and those that are not."""
    context = ["sample_idx", "base", "left_ctx", "right_ctx"]
    found = located.select(*context, F.lit(True).alias("found")).distinct()
    e = elements.join(shuffled(found), context, "left").groupBy(*context).agg(F.count("*").alias("n"), F.coalesce(F.first("found"), F.lit(False)).alias("found"))
    count = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    return e.groupBy("sample_idx").agg(
        count(F.col("found").cast("int")).alias("contexts_found"), count((~F.col("found")).cast("int")).alias("contexts_not_found"), count(F.when(F.col("found"), F.col("n"))).alias("elements_found"), count(F.when(~F.col("found"), F.col("n"))).alias("elements_not_found")
    )
