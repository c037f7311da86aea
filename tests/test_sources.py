import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from polyrun.options import Options
from polyrun.plans.pipeline import TractPipeline
from polyrun.sources import fastx, gff, sinks
from polyrun.sources.fastx import read_contigs, read_samples, sample_name, simplified_names


def records(text):
    """(name, description, sequence, quality) of all records, a line at a time."""
    lines = iter(text.split("\n"))
    line = next(lines, None)
    out = []
    while line is not None:
        if line[:1] not in (">", "@"):
            line = next(lines, None)
            continue
        head = line[1:].rstrip("\r").split(None, 1)
        seq, qual = "", None
        line = next(lines, None)
        while line is not None and line[:1] not in (">", "@", "+"):
            seq += "".join(line.split())
            line = next(lines, None)
        if line is not None and line[:1] == "+":
            qual, line = "", next(lines, None)
            while line is not None and len(qual) < len(seq):
                qual += line.rstrip("\r")
                line = next(lines, None)
            if len(qual) != len(seq):
                break
        out.append((head[0] if head else "", head[1] if len(head) > 1 else "", seq, qual))
    return out


ODD = ">a first one\nACGT\nAC GT\n\n@b\nAC\nGT\n+\nII\nII\n>c\nA\n@d\nACGT\n+\nIII\n@e\nA\n+\nI\n"


def test_records():
    assert records(ODD) == [("a", "first one", "ACGTACGT", None), ("b", "", "ACGT", "IIII"), ("c", "", "A", None)]
    for text in (ODD, "", "\n\n", "x\n>a\nAC", "@a\r\nAC\r\n+\r\nII\r\n", "@a\n\n+\n@b\nA\n+\nI"):
        got = [(h.split(None, 1), s, q) for _, h, s, q in fastx.parse(text.encode(), True)[0]]
        assert [((h[0] if h else b"").decode(), s.decode(), None if q is None else q.decode()) for h, s, q in got] == [(n, s, q) for n, _, s, q in records(text)]


def made(kind, seed, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 5, 40, 400]) if kind != "four" else rng.randint(1, 60)
        seq, qual = ("".join(rng.choice(x) for _ in range(size)) for x in ("ACGT", "@>+IF#"))
        head = f"{rng.choice('@>') if kind == 'mixed' else '@' if kind != 'fasta' else '>'}r{i} d {i}"
        fold = lambda s: "\n".join(s[j : j + 7] for j in range(0, len(s), 7))
        if kind == "fasta":
            out.append(f"{head}\n{fold(seq)}\n")
        elif kind == "four":
            out.append(f"{head}\n{seq}\n+\n{qual}\n")
        elif kind == "bad" and i == n // 2:
            out.append(f"{head}\n{seq}A\n+\n{qual}II\n")
        else:
            out.append(f"{head}\r\n{seq}\r\n+r{i}\r\n{qual}\r\n" if i % 3 else f"{head}\n{fold(seq)}\n+\n{fold(qual)}\n")
    return "".join(out)[: -1 if seed % 2 else None]


def blocked(data, rng, at_records=False):
    """data as gzip blocks that tell their size, and the empty block that ends such files."""
    out, cut = [], 0
    while cut < len(data):
        to = min(len(data), cut + rng.randint(1, 900))
        if at_records:
            to = min(x for x in (data.find(b"\n@", to) + 1, data.find(b"\n>", to) + 1, len(data)) if x)
        z = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = z.compress(data[cut:to]) + z.flush()
        out.append(b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data[cut:to]), to - cut))
        cut = to
    return b"".join(out) + bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


@pytest.mark.parametrize("kind", ["four", "fasta", "multi", "mixed", "bad"])
def test_splits_give_what_one_pass_gives(spark, tmp_path, monkeypatch, kind):
    """Random cuts, inside lines, qualities that look like records and blocks; small chunks, so that records cross them."""
    monkeypatch.setattr(fastx, "CHUNK", 700)
    for seed in range(2):
        text = made(kind, seed)
        want = [(i, *r) for i, r in enumerate(records(text))]
        rng = random.Random(seed)
        for name, data in (("x.fq", text.encode()), ("x.fq.gz", blocked(text.encode(), rng, seed == 1)), ("y.fq.gz", gzip.compress(text[:5000].encode()) + gzip.compress(text[5000:].encode()))):
            (tmp_path / name).write_bytes(data)
            d = fastx.read_fastx(spark, [str(tmp_path / name)], split=len(data) // rng.randint(4, 9))
            assert d.rdd.getNumPartitions() > 1 or name != "x.fq" or kind == "bad"
            assert sorted(tuple(r)[1:] for r in d.collect()) == want, (kind, seed, name)


def test_one_record_over_many_splits(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fastx, "CHUNK", 1 << 12)
    p = tmp_path / "long.fa"
    p.write_text(">small\nAC\n>long\n" + "ACGTACGTAC\n" * 20_000 + ">last\nG\n")
    got = fastx.read_fastx(spark, [p.as_uri()], split=30_000).select("read_id", "name", F.length("seq")).collect()
    assert sorted(map(tuple, got)) == [(0, "small", 2), (1, "long", 200_000), (2, "last", 1)]


def test_files_and_pairs(spark, tmp_path):
    paths = []
    for i in range(3):
        p = tmp_path / f"s{i}.fq.gz"
        with gzip.open(p, "wt") as f:
            f.write("".join(f"@r{j}\nACGT\n+\nIIII\n" for j in range(i + 1)))
        paths.append(str(p))
    assert {(r.sample_idx, r.n) for r in read_samples(spark, paths).groupBy("sample_idx").agg(F.count("*").alias("n")).collect()} == {(0, 1), (1, 2), (2, 3)}
    assert {(r.sample_idx, r.n) for r in read_samples(spark, paths, paired=True).groupBy("sample_idx").agg(F.count("*").alias("n")).collect()} == {(0, 3)}
    assert sample_name("/x/abc.fastq.gz") == "abc"
    assert simplified_names(["run_a1_x", "run_b22_x"]) == ["a1", "b22"] and simplified_names(["same", "same"])[0] and simplified_names(["only"]) == ["only"]


def test_annotation(spark, tmp_path):
    p = tmp_path / "a.gff3"
    p.write_text("##gff-version 3\n##sequence-region c1 1 8\nc1\tsrc\tCDS\t2\t6\t.\t+\t0\tID=g1;Name=x\nc1\tsrc\tgene\t1\t8\t.\t+\t.\tName=y\n##FASTA\n>c1 desc\nACGT\nacgt\n>c2\nTT\n")
    f = gff.read_features(spark, str(p)).collect()
    assert [(r.contig, r.type, r.start, r.end, r.feature_id, r.attributes["Name"]) for r in f] == [("c1", "CDS", 2, 6, "g1", "x"), ("c1", "gene", 1, 8, None, "y")]
    s = gff.read_sequences(spark, str(p))
    assert {(r.contig, r.seq) for r in s.collect()} == {("c1", "ACGTACGT"), ("c2", "TT")}
    fa = tmp_path / "r.fa"
    fa.write_text(">c1\nGGGG\n")
    both = gff.with_reference(s, read_contigs(spark, str(fa)))
    assert [tuple(r) for r in both.orderBy("ref_id").collect()] == [(0, "c1", "GGGG", 4), (1, "c2", "TT", 2)]
    fa.write_text(">z9\nAA\n>c2\nGG\n>a1\nT\n")  # numbers follow the files, not the names
    assert [r.contig for r in gff.with_reference(s, read_contigs(spark, str(fa))).orderBy("ref_id").collect()] == ["z9", "c2", "a1", "c1"]


@pytest.mark.parametrize("split", [37, 150, 100_000])
def test_annotation_in_splits(spark, tmp_path, monkeypatch, split):
    """Rows and sequences of one file in ranges, whatever they cut, plain and zipped."""
    monkeypatch.setattr(fastx, "CHUNK", 64)
    rng = random.Random(split)
    rows = [f"c{i % 3}\tx\tCDS\t{i}\t{i + 5}\t.\t+\t0\tID=g{i};Note=##FASTA>" for i in range(40)]
    seqs = {f"c{i}": "".join(rng.choice("ACGT") for _ in range(rng.choice([1, 90, 700]))) for i in range(5)}
    fasta = "".join(f">{n} d\n" + "".join(f"{s[j : j + 60]}\n" for j in range(0, len(s), 60)) for n, s in seqs.items())
    head = "##gff-version 3\n" + "\n".join(rows[:20]) + "\n# a remark\n\n" + "\r\n".join(rows[20:]) + "\n"
    for name, text in (("a.gff3", head + "##FASTA\n" + fasta), ("b.gff3", head), ("c.gff3", "##FASTA\n" + fasta), ("d.gff3", head.rstrip("\n"))):
        for path, data in ((tmp_path / name, text.encode()), (tmp_path / f"{name}.gz", gzip.compress(text.encode()))):
            if split > 37 and path.suffix == ".gz":
                continue
            path.write_bytes(data)
            got = sorted(r.feature_id for r in gff.read_features(spark, str(path), split).collect())
            assert got == (sorted(f"g{i}" for i in range(40)) if name != "c.gff3" else []), (name, path)
            assert {(r.contig, r.seq) for r in gff.read_sequences(spark, str(path), split).collect()} == (set(seqs.items()) if name in ("a.gff3", "c.gff3") else set()), (name, path)


def test_command_line(spark, tmp_path):
    """Two samples from files, one with a longer tract; the reports are there and say so."""
    import random

    from polyrun.__main__ import main

    rng = random.Random(8)
    left, right = ("".join(rng.choice("ACGT") for _ in range(60)) + "C" for _ in range(2))
    rc = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    genome = left + "AAAA" + "G" + right
    for name, g in (("run_a.fq", genome), ("run_b.fq", left + "AAAAA" + "G" + right)):
        (tmp_path / name).write_text("".join(f"@r{j}\n{s}\n+\n{'I' * len(s)}\n" for j, s in enumerate([g, rc(g)] * 4)))
    (tmp_path / "a.gff3").write_text(f"##gff-version 3\nc0\tx\tCDS\t1\t120\t.\t+\t0\tID=gene1\n##FASTA\n>c0\n{genome}\n")
    out = f"{tmp_path}/out"
    main(["-k", "10", "-i", "2", "-e", "1", "-V", "-g", str(tmp_path / "a.gff3"), "-o", out, str(tmp_path / "run_a.fq"), str(tmp_path / "run_b.fq")])
    table = spark.read.csv(f"{out}/per_sample_average_length.tsv", sep="\t", header=True)
    assert table.columns == ["tract_id", "location", "feature", "reference", "a", "b"]
    assert ("61", "gene1", "4", "4.00", "5.00") in {tuple(r)[1:] for r in table.collect()}
    assert spark.read.csv(f"{out}/variable_tracts.bed", sep="\t").count() == table.count()
    assert spark.read.csv(f"{out}/tract_list.tsv", sep="\t", header=True).columns[0] == "tract_id"
    assert spark.read.text(f"{out}/vcf/b.vcf.gz").where("value like 'c0%'").count() == 1


def test_whole_run(spark, tmp_path):
    """Two samples of error-free reads; one has a longer tract."""
    import random

    rng = random.Random(8)
    left, right = ("".join(rng.choice("ACGT") for _ in range(60)) + "C" for _ in range(2))
    genome = left + "AAAA" + "G" + right
    other = left + "AAAAA" + "G" + right
    rc = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    rows = [(s, x) for s, g in ((0, genome), (1, other)) for x in [g, rc(g)] * 4]
    reads = spark.createDataFrame(rows, "sample_idx int, seq string")
    contigs = spark.createDataFrame([(0, "c0", genome, len(genome))], "ref_id int, contig string, seq string, len int")
    features = spark.createDataFrame([("c0", "CDS", 1, 200, "gene1")], "contig string, type string, start int, end int, feature_id string")
    run = TractPipeline(reads, contigs, features, Options(kmer=10, min_tract=4, min_reads=2, max_edits=1))
    assert [tuple(r) for r in run.vcf.select("sample_idx", "pos", "ref", "alt").collect()] == [(1, 65, "A", "AA")]
    t = run.tract_list.where("location_in_contig = 61").first()
    assert (t.feature, t.max_tract_length, t.ref_tract_length) == ("gene1", 5, 4) and t.tract.endswith(t.ref_tract[-3:])
    assert run.matrix().where("sample_0 <> sample_1").count() == 1
    out = sinks.output_dir(str(tmp_path / "out"))
    sinks.write_tsv(run.matrix(), out + "average", {"sample_0": 2, "sample_1": 2})
    sinks.write_vcf(run.vcf, contigs, {0: "s/0", 1: "s1"}, out + "vcf")
    names = {p.name: gzip.open(p, "rt").read().splitlines() for p in (tmp_path / "out" / "vcf").iterdir()}
    assert sorted(names) == ["s1.vcf.gz", "s_0.vcf.gz"]  # one whole file each, that without variants too, and nothing else
    assert names["s1.vcf.gz"][0] == "##fileformat=VCFv4.2" and names["s1.vcf.gz"][-1].startswith("c0\t65\t.\tA\tAA\t") and names["s_0.vcf.gz"][-1].endswith("FORMAT\ts_0")
    assert sum(x.startswith("#CHROM") for x in names["s1.vcf.gz"]) == 1
    assert spark.read.text(out + "average").count() >= 2
    assert sinks.output_dir(None) == "./" and sinks.output_dir("random").startswith("out")


def test_variant_files_of_many_samples_and_of_a_job_that_fails(spark, tmp_path):
    contigs = spark.createDataFrame([(0, "c0", "A", 900), (1, "c1", "A", 90)], "ref_id int, contig string, seq string, len int")
    rows = [(s, f"c{p % 2}", p, "A", "AC", f"tid_{p:06d}") for s in range(5) for p in random.Random(s).sample(range(1000), 60 * s)]
    df = spark.createDataFrame(rows, "sample_idx int, chrom string, pos int, ref string, alt string, tid string").repartition(7)
    out = str(tmp_path / "vcf")
    sinks.write_vcf(df, contigs, {0: "none", 1: "x", 2: "y z", 3: "x", 4: "w"}, out)
    got = {p.name: gzip.open(p, "rt").read().splitlines() for p in (tmp_path / "vcf").iterdir()}
    assert sorted(got) == ["none.vcf.gz", "w.vcf.gz", "x_1.vcf.gz", "x_3.vcf.gz", "y_z.vcf.gz"]
    for s, name in enumerate(["none", "x_1", "y_z", "x_3", "w"]):
        body = [x.split("\t") for x in got[f"{name}.vcf.gz"] if x[0] != "#"]
        assert [(x[0], int(x[1])) for x in body] == sorted((r[1], r[2]) for r in rows if r[0] == s)
        assert got[f"{name}.vcf.gz"][3:5] == ["##contig=<ID=c0,length=900>", "##contig=<ID=c1,length=90>"]
    bad = df.withColumn("ref", F.when((F.col("sample_idx") == 4) & (F.col("pos") > 500), F.raise_error(F.lit("lost"))).otherwise(F.col("ref")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_vcf(bad, contigs, {s: f"s{s}" for s in range(5)}, str(tmp_path / "other"))
    assert not (tmp_path / "other").exists() or list((tmp_path / "other").iterdir()) == []
