import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from polyrun.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Hello, world's BEST café ﬁne naïve 12345 it'll they've",
    "a<|endoftext|>b <s> x </s><unk> <|endoftext|>",
    "",
    None,
    " \t\n\r\v\f ",
    "  two  spaces\n\nand lines \n tab\tend  ",
    "日本語のテキスト ΣΑΣ. é\xa0nb sp \x1cctl\x1d \x85nel 🙂🙂 x\u180e y z\u180e",
    "low ▁ bar",
    "x" * 20_000,
    "the the the of the",
    "the the the of the",
    "supercalifragilistic " * 300,
    "a\x00b",
    "ends \n",
    "a\xa0 b\x1c c \xa0d\n\xa0 e\u3000 f",
    "tab\tx\ny\r\nz\n\n w \n v\n ",
]


def brute(rows):
    """Rows as alignment() returns them, from the libraries on whole texts, one document at a time."""
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    chars = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in chars]
    decode = {chr(c): c for c in chars} | {chr(0x100 + i): b for i, b in enumerate(other)}
    each, count = [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            whole = (" " + text).encode()
            ids_a, ids_b = tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            by_a = [bytes(decode[c] for c in tok.id_to_token(i)) for i in ids_a]
            pieces = [model.id_to_piece(i) for i in ids_b]
            by_b = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces, strict=True)]
            if b"".join(by_a) == whole and b"".join(by_b) == whole:
                ends = []
                for parts in (by_a, by_b):
                    at, out = 0, []
                    for p in parts:
                        at += len(p)
                        out.append(at)
                    ends.append(out)
                cuts = sorted(set(ends[0]) & set(ends[1]))
                lo = 0
                for c in cuts:
                    groups.append(([i for i, e in zip(ids_a, ends[0], strict=True) if lo < e <= c], [i for i, e in zip(ids_b, ends[1], strict=True) if lo < e <= c])) if len(whole) < 2500 else None
                    lo = c
                if len(whole) >= 2500:
                    i = j = 0
                    for c in cuts:
                        ga, gb = [], []
                        while i < len(ids_a) and ends[0][i] <= c:
                            ga.append(ids_a[i])
                            i += 1
                        while j < len(ids_b) and ends[1][j] <= c:
                            gb.append(ids_b[j])
                            j += 1
                        groups.append((ga, gb))
        links = Counter((a, b) for ga, gb in groups for a in ga for b in gb)
        count.update(links.keys())
        each.append((doc_id, groups, links))
    top = defaultdict(int)
    for (a, _), n in count.items():
        top[a] = max(top[a], n)
    out = []
    for doc_id, groups, links in each:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append(
            (
                doc_id,
                sum(len(x) for x, _ in groups),
                sum(len(y) for _, y in groups),
                len(groups),
                sum(links.values()),
                sum(n for p, n in links.items() if count[p] == top[p[0]]),
                sum(n * count[p] for p, n in links.items()),
                hashlib.sha256(text.encode()).hexdigest() if groups else "",
            )
        )
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_the_libraries_on_odd_texts(corpus):
    docs = [*enumerate(TEXTS), (None, "no id"), (9, "the the")]
    assert rows(al.alignment(corpus(docs), A, B)) == sorted(brute(docs), key=str)


def test_equals_the_libraries_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = al.alignment(docs, A, B)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert rows(got) == sorted(brute([tuple(r) for r in docs.collect()]), key=str)


def test_salts_small_tables_and_blocks_change_nothing(spark, corpus, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("doc_id < 60").repartition(5)
    want = rows(al.alignment(docs, A, B))
    monkeypatch.setattr(al, "SALT_BYTES", 300)
    assert rows(al.alignment(docs, A, B)) == want


def test_counts_by_id(spark, corpus):
    docs = corpus([(1, "the cat"), (2, "the the cat"), (3, "The dog"), (4, None)])
    got = {(r.a, r.b): (r["count"], r.best) for r in al.aligned_ids(al.pair_counts(al.alignment_links(docs, A, B), B), B).collect()}
    tok, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a, b = tok.encode(" the", add_special_tokens=False).ids, model.encode("the")
    assert got[(a[0], b[0])] == (2, True) and len(a) == len(b) == 1


def test_empty_tables_and_clashing_columns(spark, corpus):
    assert al.alignment(corpus([]), A, B).collect() == []
    assert rows(al.alignment(corpus([(1, None), (2, "")]), A, B)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    odd = spark.createDataFrame([(1, "a b", 5, "x", b"z")], "doc_id int, text string, row int, stripe string, pairs binary")
    assert rows(al.alignment(odd, A, B)) == brute([(1, "a b")])


@pytest.mark.parametrize("text", ["a b", " a", " \t ", "a ", "a\n\n b\tc \n", "a  b c", "", "x\n y z", "a\u180e b c d", "\u3000 a b"])
def test_words_join_to_the_text(text):
    assert " " + " ".join(al.words_of(text)) == " " + text


def test_empty_parts_that_make_up_for_other_white_space(corpus):
    """As many parts by spaces as by all white space, but not the same ones."""
    docs = list(enumerate(["a  b\nc", " the \n", "a\nb ", "x  y\tz w", "a b　c ", "two\r\n words  and  more\n\nlines\n"]))
    assert rows(al.alignment(corpus(docs), A, B)) == sorted(brute(docs), key=str)
