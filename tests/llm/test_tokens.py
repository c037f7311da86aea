import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from polyrun.llm.tokens import read_token_ids, token_counts, token_id_files, with_crc32

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello, world's BEST café ﬁne naïve 12345 it'll they've &'s 's'S",
    "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|> x<|endoftext|><|endoftext|>",
    "",
    None,
    " \t\n\r\v\f ",
    "日本語のテキスト ΣΑΣ. ΣΑΣ'Σ é  nb sp \x1cctl\x1d \x85nel 🙂🙂 ́lone",
    "###$$$%%% aaaaaaaaaaaaaaaaaaaaaaaa hahahahahahahahaha !!!!!!!!!!!!!!!!",
    "supercalifragilistic " * 900,
    "x" * 70_000,
    "Größe ñandú ça và l'été d'où",
]


def expected():
    tok = Tokenizer.from_file(PATH)
    return [tok.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def test_counts_are_those_of_the_library(corpus):
    got = {r.doc_id: r for r in token_counts(corpus(list(enumerate(TEXTS))), PATH).collect()}
    for i, ids in enumerate(expected()):
        assert got[i].n_tokens == len(ids), (i, TEXTS[i])
        assert got[i].n_bytes == len((TEXTS[i] or "").encode())
        assert got[i].over_limit == (len(ids) > 2048)


def test_counts_of_the_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tok = Tokenizer.from_file(PATH)
    want = {r.doc_id: len(tok.encode(r.text, add_special_tokens=False).ids) for r in rows.collect()}
    assert {r.doc_id: r.n_tokens for r in token_counts(rows, PATH).collect()} == want


def test_files_hold_the_ids_in_order(spark, corpus):
    docs = corpus([*((50 - 3 * i, t) for i, t in enumerate(TEXTS)), (50, "again"), (None, "no id")])
    out = token_id_files(docs, PATH)
    got = read_token_ids(spark, out).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        assert (r.start, r.n_tokens, r.ids[-1]) == (at, len(r.ids), 1)
        at += r.n_tokens
    by = {r.doc_id: r.ids for r in got if r.doc_id not in (50, None)}
    assert by == {50 - 3 * i: [*ids, 1] for i, ids in enumerate(expected()) if i}
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in with_crc32(read_token_ids(spark, out)).collect()}
    assert crc == {(r.doc_id, r.start): zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}


def test_file_columns_are_encoded(spark, corpus):
    import glob

    import pyarrow.parquet as pq

    out = token_id_files(corpus([(i, "some words here " * 50) for i in range(200)]), PATH)
    f = next(x for x in glob.glob(out.removeprefix("file://") + "/*.parquet"))
    meta = pq.ParquetFile(f).metadata.row_group(0)
    by = {meta.column(i).path_in_schema.split(".")[0]: meta.column(i) for i in range(meta.num_columns)}
    assert "RLE_DICTIONARY" in by["ids"].encodings and by["ids"].has_offset_index and by["ids"].has_column_index


def test_empty_table(spark, corpus):
    docs = corpus([(1, "x")]).limit(0)
    assert token_counts(docs, PATH).count() == 0
    out = token_id_files(docs, PATH)
    assert with_crc32(read_token_ids(spark, out)).count() == 0


@pytest.mark.parametrize("clash", ["part", "ids", "n_tokens"])
def test_clashing_columns(corpus, clash):
    docs = corpus([(1, "x y")]).withColumnRenamed("lang", clash)
    assert token_counts(docs, PATH).first().n_tokens == 2
    assert token_id_files(docs, PATH)


def test_words_told_apart_without_a_search():
    """_is_other() answers as the pattern does, for control characters and special strings too."""
    from polyrun.llm import tokens

    words = [a + b + c for a in ("", "a", "Z9", "<") for b in ("|", "\x00", "\x1c", "\x7f", "\xa0", "\xad", "\xe9", "İ", "一", "'s", " ") for c in ("", "x", "|>")]
    assert [tokens._is_other(w) for w in words] == [bool(tokens._OTHER.search(w)) for w in words]
