"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers

from .alignment import alignment
from .common import table
from .decontaminate import contamination
from .exact_dedup import owners
from .licenses import all_templates, license_spans
from .mixing import mix
from .ngram_join import ngram_components
from .simhash import simhash_components
from .substrings import parsed
from .suffixes import repeats
from .tokens import read_token_ids, token_counts, token_id_files, with_crc32
from .toxicity import toxicity
from .vector_codes import vector_codes

#: The vocabulary of the token queries.
VOCABULARY = "word_bpe_49k.json"
#: Those of the aligned tokenizers.
ALIGNED = ("byte_bpe_50k.json", "piece_bpe_32k.model")


def op1_simhash(spark, sf_dir):
    return simhash_components(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark, sf_dir):
    return parsed(table(spark, sf_dir, "documents")).drop("n_factors")


def op3_licenses(spark, sf_dir):
    return license_spans(table(spark, sf_dir, "documents"), all_templates())


def op4_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op8_token_ids(spark, sf_dir):
    return with_crc32(read_token_ids(spark, token_id_files(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))))


def op9_exact_dedup(spark, sf_dir):
    return owners(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark, sf_dir):
    return repeats(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark, sf_dir):
    return vector_codes(table(spark, sf_dir, "embeddings"))


def op12_ngram_join(spark, sf_dir):
    return ngram_components(table(spark, sf_dir, "documents"))


def op13_alignment(spark, sf_dir):
    return alignment(table(spark, sf_dir, "documents"), *map(public_tokenizers.path, ALIGNED))


def queries():
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def _vector_codes_sql(rounds=2):
    """Vectors of 64 components: p has a row per part, c0, c1, ... are the codebooks, a0, a1, ... the nearest entries."""
    x = ("a", "b", "c", "d")
    near = "min(({}) * 64 + entry)".format(" + ".join(f"(p.{k} - c.{k}) * (p.{k} - c.{k})" for k in x))
    sql = f"""
            WITH k AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, v FROM (
                    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256.0::DOUBLE * x) AS BIGINT)) AS v FROM embeddings
                    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
            p AS (SELECT r, vec_id, label, part, {", ".join(f"v[4 * part + {i + 1}] AS {k}" for i, k in enumerate(x))} FROM k, range(16) AS t(part)),
            c0 AS (SELECT part, r - 1 AS entry, a, b, c, d FROM p WHERE r <= 64)"""
    for i in range(rounds + 1):
        sql += f""",
            a{i} AS (SELECT p.r, p.part, {near} AS x FROM p JOIN c{i} c USING (part) GROUP BY ALL)"""
        if i < rounds:
            sql += f""",
            m{i} AS (SELECT part, x % 64 AS entry, {", ".join(f"CAST(floor(sum({k}) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS {k}" for k in x)} FROM a{i} JOIN p USING (r, part) GROUP BY 1, 2),
            c{i + 1} AS (SELECT part, entry, {", ".join(f"coalesce(m.{k}, c.{k}) AS {k}" for k in x)} FROM c{i} c LEFT JOIN m{i} m USING (part, entry))"""
    return f"""{sql},
            e AS (SELECT r, string_agg(printf('%02x', x % 64), '' ORDER BY part) AS code, CAST(sum(x // 64) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
            SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
                   (SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256
            FROM e JOIN k USING (r)"""


def oracle_sql():
    return {
        "op2_substring_dedup": r"""
            WITH l AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
            g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM l)),
            m AS (SELECT doc_id, i, doc_id > min(doc_id) OVER (PARTITION BY s) AS dup FROM g),
            c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM m WHERE dup),
            k AS (SELECT l.doc_id, list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: NOT list_contains(coalesce(d.gone, []), x[2])) AS kept, len(w) AS n
                  FROM l LEFT JOIN (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id) d USING (doc_id))
            SELECT doc_id, n AS n_words, n - len(kept) AS n_removed, sha256(array_to_string(list_transform(kept, lambda x: x[1]), ' ')) AS kept_sha256 FROM k""",
        "op4_mixing": r"""
            WITH d AS (
                SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                       md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k FROM documents),
            s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
            w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
            x AS (SELECT *, 2.0::DOUBLE * source_size AS cap, (SELECT 1.5::DOUBLE * sum(source_size) FROM s) AS budget, (SELECT sum(weight) FROM w) AS all_w FROM w),
            y AS (SELECT *, budget - (sum(cap) OVER o - cap) AS lb, all_w - (sum(weight) OVER o - weight) AS lw FROM x
                  WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
            z AS (SELECT *, lb / lw AS lev, cap <= weight * (lb / lw) AS stopped FROM y),
            t AS (SELECT source, source_size, weight, CASE WHEN stopped THEN cap ELSE weight * (SELECT arg_min(lev, cap / weight) FROM z WHERE NOT stopped) END AS target FROM z),
            q AS (SELECT row_number() OVER () AS r, d.doc_id, d.source, d.size, t.source_size, t.target, t.weight,
                         sum(d.size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) - d.size AS st
                  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
            i AS (SELECT *, unnest(range(0, CAST(ceil(size / 512.0) AS BIGINT))) AS n FROM (SELECT *, unnest([0, 1]) AS p FROM q)),
            f AS (SELECT r, source, least(size, (n + 1) * 512) - n * 512 AS words, CAST(st + p * source_size + least(size, (n + 1) * 512) AS DOUBLE) / weight AS finish FROM i),
            g AS (SELECT r, words, sum(words) OVER (ORDER BY finish, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS until FROM f),
            k AS (SELECT r, sum(greatest(0, least(words, (SELECT floor(1.5 * sum(size)) FROM d) - until + words))) AS taken FROM g GROUP BY r)
            SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN k USING (r)""",
        "op9_exact_dedup": r"""
            WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
            FROM n WINDOW w AS (PARTITION BY t)""",
        "op10_suffix_dedup": r"""
            WITH b AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
            w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS s FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM b)),
            d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY s) AS n FROM w) WHERE n > 1),
            e AS (SELECT r, i, sum(CASE WHEN p IS NULL OR i > p + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g
                  FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM d)),
            x AS (SELECT r, g, min(i) AS a, max(i) + 400 AS z FROM e GROUP BY 1, 2),
            y AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS f FROM x),
            k AS (SELECT r, sum(z - a) AS gone, count(*) AS spans, max(z) AS last, string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) AS kept FROM y JOIN b USING (r) GROUP BY r)
            SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
                   sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256 FROM b LEFT JOIN k USING (r)""",
        "op11_vector_codes": _vector_codes_sql(),
        "op12_ngram_join": r"""
            WITH RECURSIVE l AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
            s AS (SELECT DISTINCT r, md5(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 2 ELSE 1 END))) AS i FROM l)),
            n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
            p AS (SELECT a.r AS u, b.r AS v, count(*) AS c FROM s a JOIN s b USING (g) GROUP BY 1, 2),
            k AS (SELECT u, v FROM p JOIN n a ON u = a.r JOIN n b ON v = b.r WHERE 100 * c >= 80 * (a.n + b.n - c)),
            t AS (SELECT r AS u, r AS v FROM l UNION SELECT t.u, k.v FROM t JOIN k ON t.v = k.u)
            SELECT l.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(m.doc_id) AS component_id
            FROM l JOIN t ON l.r = t.u JOIN l m ON m.r = t.v LEFT JOIN n ON n.r = l.r GROUP BY l.r, l.doc_id""",
    }
