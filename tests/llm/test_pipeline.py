import random
import zlib

import public_tokenizers
import pytest

import corpus_pipeline
from polyrun.llm.simhash import near_duplicates, shingle_hashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def jaccard(a, b):
    return len(a & b) / len(a | b)


@pytest.fixture(scope="module")
def made(spark, words, tmp_path_factory):
    """Tables with toxic texts, near and exact copies, benchmark passages, nulls, empties, ties and repeated rows."""
    d = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(9)
    text, toxic, gone = {}, {}, {"near": set(), "leak": set()}
    for i in range(700):
        text[i], toxic[i] = words(80, i), 0
    for i in range(700, 1000):
        w = words(60, i).split()
        for mark in rng.sample(["dreadful", "horrid", "vile", "rotten"], 3):
            w.insert(rng.randrange(len(w)), mark)
        text[i], toxic[i] = " ".join(w), 1
    item = {k: words(50, 9000 + k) for k in range(5)}
    for k in range(5):
        text[1000 + k] = f"{words(30, 70 + k)} {item[k]} {words(30, 80 + k)}"
        gone["leak"].add(1000 + k)
    for k in range(40):  # near copies: one word of eighty changed
        w = text[k].split()
        w[40] = "changed"
        text[1100 + k] = " ".join(w)
        gone["near"].add(1100 + k)
    text |= {1200: None, 1201: "", 1202: " \n", 1203: text[5], 1204: "short"}
    gone["near"].add(1203)
    source = {i: rng.choice(["a", "b", "c", None]) for i in text}
    rows = [(i, t, "en", source[i], len(t or "")) for i, t in text.items()] + [(650, text[650], "en", source[650], len(text[650])), (None, words(80, 4000), "en", "a", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(k, t) for k, t in item.items()] + [(9, None), (10, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, text, toxic, gone


def test_stages_one_by_one(spark, made):
    d, rows, text, toxic, gone = made
    docs = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_dedup", "decontamination", "mixing", "token_files"]
    ids = lambda df: [r.doc_id for r in df.select("doc_id").collect()]
    clean = stages["toxicity"](spark, docs, d)
    assert clean.columns == docs.columns
    want = {r[0] for r in rows if not toxic.get(r[0], 0)}
    assert set(ids(clean)) - want == set() and want - set(ids(clean)) == set()
    unique = stages["near_dedup"](spark, docs, d)
    want = {r[0] for r in rows} - gone["near"]
    assert unique.columns == docs.columns and set(ids(unique)) == want and ids(unique).count(650) == 2
    apart = stages["decontamination"](spark, docs, d)
    assert apart.columns == docs.columns and set(ids(apart)) == {r[0] for r in rows} - gone["leak"]
    mixed = stages["mixing"](spark, docs, d)
    assert mixed.columns == docs.columns and {1200, 1201, 1202}.isdisjoint(ids(mixed))


def test_the_whole_run(spark, made):
    d, rows, text, toxic, gone = made
    got = sorted(corpus_pipeline.run(spark, d).collect(), key=lambda r: r.start)
    kept = {r.doc_id for r in got}
    assert kept <= {r[0] for r in rows if not toxic.get(r[0], 0)} - gone["near"] - gone["leak"] - {1200, 1201, 1202}
    assert len(kept) > 500
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        if r.doc_id is not None:
            ids = [*tok.encode(text[r.doc_id], add_special_tokens=False).ids, 1]
            assert r.n_tokens == len(ids) and r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


def test_empty_tables(spark, made, tmp_path):
    d = made[0]
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_duplicates_of_a_whole_table_are_found(spark):
    """All pairs of the table by brute force; components may only lack what the sampled masks miss."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: frozenset(shingle_hashes((r.text or "").encode(), 5).tolist()) for r in docs.collect()}
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    by = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    links = [(a, b) for x, a in enumerate(by) for b in by[x + 1 :] if len(sets[a]) >= 0.8 * len(sets[b]) and jaccard(sets[a], sets[b]) >= 0.8]
    found = [(a, b) for a, b in links if got.get(a, a) == got.get(b, b)]
    assert len(links) > 100 and len(found) >= 0.9 * len(links)
    root = {i: i for i in by}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        root[top(a)] = top(b)
    assert all(top(i) == top(c) for i, c in got.items())  # no false link
