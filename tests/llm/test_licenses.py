import random
import re
import time
from pathlib import Path

import numpy as np
import pytest

from polyrun.llm import licenses
from polyrun.llm.licenses import TEMPLATES, Templates, align, license_spans


def spans(docs, **k):
    return sorted((r.doc_id, r.template, round(r.coverage, 3), r.start, r.end) for r in license_spans(docs, **k).collect())


def test_notices_are_found_where_they_are(corpus, words):
    rows = [(i, words(50, i)) for i in range(30)]
    rows += [
        (100, words(50, 1) + "\n" + TEMPLATES["MIT"]),
        (101, TEMPLATES["GPL-3.0"] + " " + words(40, 2)),
        (102, words(10, 3) + " LICENSED under the   Apache license version 2.0 " + words(10, 4) + " Released under the MIT License. " + words(5, 5) + " Released under the MIT License."),
        (103, "Released under the Apache"),
        (104, None),
        (105, ""),
        (106, "All rights reserved."),
        (107, words(60_000, 6) + " Licensed under CC BY-NC 4.0."),
        (108, "This program is free software and you can redistribute it or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License, or at your option any later version"),
    ]
    got = spans(corpus(rows).withColumnRenamed("lang", "template").withColumnRenamed("source", "start"))
    by = {i: [g[1:] for g in got if g[0] == i] for i in range(120)}
    assert not any(by[i] for i in [*range(30), 103, 104, 105])
    assert by[100] == [("MIT", 1.0, 50, 55)]
    assert by[101] == [("GPL-3.0", 1.0, 0, 12)]
    assert by[102] == [("Apache-2.0", 1.0, 10, 18), ("MIT", 1.0, 28, 33), ("MIT", 1.0, 38, 43)]
    assert by[106] == [("all-rights-reserved", 1.0, 0, 3)]
    assert by[107] == [("CC-BY-NC-4.0", 1.0, 60_000, 60_007)]
    assert [x[0] for x in by[108]] == ["GPL-3.0-header"] and by[108][0][1] >= 0.8


def test_whole_lines_of_a_table_are_all_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {"Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "All rights reserved.": "all-rights-reserved"}
    want = sorted((r.doc_id, lines[m]) for r in docs.collect() for m in re.findall("|".join(map(re.escape, lines)), r.text))
    assert sorted((g[0], g[1]) for g in spans(docs)) == want and want


def test_copies_in_a_row_are_all_found(corpus):
    lines = {"all-rights-reserved": 3, "MIT": 5, "CC-BY-NC-4.0": 7}
    rows = [(100 * i + n, " ".join([TEMPLATES[name]] * n)) for i, name in enumerate(lines) for n in (1, 2, 3, 60)]
    want = sorted((100 * i + n, name, 1.0, size * k, size * (k + 1)) for i, (name, size) in enumerate(lines.items()) for n in (1, 2, 3, 60) for k in range(n))
    assert spans(corpus(rows)) == want


def test_chance_hits_do_not_hide_a_match(corpus):
    """Chance hits lead, in steps of the band, to a whole match farther on."""
    template = " ".join(f"w{i}" for i in range(30))
    got = spans(corpus([(1, "w0 w1 w2 w3 y z " * 3 + template)]), templates={"t": template})
    assert got == [(1, "t", 1.0, 18, 48)]


def test_the_query_finds_whole_licences(spark, corpus, words, tmp_path):
    from pathlib import Path

    import polyrun.llm
    from polyrun.llm.queries import op3_licenses

    texts = {p.stem: p.read_text() for p in sorted((Path(polyrun.llm.__file__).parent / "license_texts").glob("*.txt"))}
    assert len(texts) >= 13
    corpus([(i, words(30, i) + "\n" + t + "\n" + words(20, i)) for i, t in enumerate(texts.values())]).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.template) for r in op3_licenses(spark, str(tmp_path)).where("coverage > 0.99 and start = 30").collect()}
    assert {(i, f"{n}-text") for i, n in enumerate(texts)} <= got


def test_alignment_in_a_band():
    a = np.array([9, 9, 1, 2, 3, 8, 4, 6, 7, 9], np.uint64)
    b = np.array([1, 2, 3, 4, 5, 6, 7], np.uint64)
    assert align(a, b, 2) == (6, 2, 9)
    assert align(a, b[:3], 2) == (3, 2, 5)
    assert align(np.array([5], np.uint64), b, 0, 6)[0] == 1


def test_empty(corpus):
    assert license_spans(corpus([(1, "a")]).limit(0)).count() == 0
    assert license_spans(corpus([(1, TEMPLATES["MIT"])]), templates={}).count() == 0


def whole_alignment(a, b):
    """Equal words of the best local alignment of b in a, of equal scores the most, without any band."""
    row, best = [(0, 0)] * (len(a) + 1), (0, 0)
    for y in b:
        last, row = row, [(0, 0)]
        for i, x in enumerate(a, 1):
            cell = max((last[i - 1][0] + (2 if x == y else -1), last[i - 1][1] + (x == y)), (last[i][0] - 1, last[i][1]), (row[-1][0] - 1, row[-1][1]), (0, 0))
            row.append(cell if cell[0] > 0 else (0, 0))
        best = max(best, *row)
    return best[1]


@pytest.mark.parametrize("seed", range(8))
def test_edited_copies_equal_whole_alignments(seed):
    """Words changed, taken out and put in, a whole stretch of each too: the coverage of a match is that of an alignment without a band."""
    rng = random.Random(seed)
    template = [f"w{rng.randrange(120)}" for _ in range(300)]
    text = [w for w in template for w in ([], [w, "new"], ["other"], *[[w]] * 33)[rng.randrange(36)]]
    cut = rng.randrange(60, 240)
    text = text[:cut] + [f"put{i}" for i in range(rng.randrange(40))] + text[cut + rng.randrange(20) :]
    text = ["before"] * 20 + text + ["after"] * 20
    got = Templates({"t": " ".join(template)}).found([" ".join(text).encode()], 0.8)
    want = whole_alignment(text, template) / 300
    assert want > 0.8 and [(x[1], round(x[2], 6)) for x in got] == [("t", round(want, 6))]


def test_two_edited_copies_are_both_found():
    mit = (Path(licenses.__file__).parent / "license_texts" / "MIT.txt").read_text().split()
    for seed in range(5):
        rng = random.Random(seed)
        first, second = ([w for w in mit if rng.random() > 0.1] for _ in range(2))
        got = [x for x in Templates({"t": " ".join(mit)}).found([" ".join(first + second).encode()], 0.8)]
        assert len(got) == 2 and got[0][4] <= got[1][3]


def test_related_licences_take_little_time():
    """A text of a family of licences that share most of their wording."""
    index = Templates(licenses.all_templates())
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-2.1"):
        text = (Path(licenses.__file__).parent / "license_texts" / f"{name}.txt").read_bytes()
        started = time.process_time()
        assert (f"{name}-text", 1.0) in {(x[1], x[2]) for x in index.found([text], 0.8)}
        assert time.process_time() - started < 5  # seconds; about 0.5 where nothing else runs
