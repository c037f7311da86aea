"""SQL of the clustering queries: each fold is a recursion that takes one row of every island a step, so steps are as many as an island is long."""

from __future__ import annotations

from polyrun.options import Options


def _revcomp(x: str) -> str:
    return f"reverse(translate({x}, 'ACGT', 'TGCA'))"


def _differences(a: str, b: str, k: int) -> str:
    return " + ".join(f"CASE WHEN substr({a}, {i}, 1) = substr({b}, {i}, 1) THEN 0 ELSE 1 END" for i in range(1, k + 1))


def located(depth: int) -> str:
    """located1: deep elements with the best place of their context within one edit. Needs depths, asked, places_, firsts and offsets."""
    return f"""
fresh AS (SELECT DISTINCT query FROM asked WHERE query NOT IN (SELECT query FROM places_)),
sides AS (SELECT query, query AS s, false AS neg FROM fresh UNION ALL SELECT query, {_revcomp("query")}, true FROM fresh),
spots AS (SELECT query, s, neg, ref_id, p, m, flat_offset + p AS location, substr(seq, p + 1, m) AS g FROM (
  SELECT *, unnest(range(0, len - m + 1)) AS p FROM (SELECT query, s, neg, ref_id, flat_offset, seq, len, unnest([length(s) - 1, length(s), length(s) + 1]) AS m FROM sides, offsets))),
edited AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY location, neg, p + m) AS nth FROM spots WHERE levenshtein(s, g) = 1),
placed AS (
  SELECT query, ref_id, loc_pos, loc_last, mismatches, neg_strand, location FROM firsts WHERE nth = 1
  UNION ALL SELECT query, ref_id, CAST(p AS INT), CAST(p + m - 1 AS INT), 1, neg, location FROM edited WHERE nth = 1),
located1 AS (SELECT d.sample_idx, d.base, left_ctx, right_ctx, length, count, ref_id, loc_pos, loc_last, mismatches, neg_strand, location FROM depths d JOIN asked USING (sample_idx, base, left_ctx, right_ctx) JOIN placed USING (query) WHERE depth >= {depth})"""


def contexts(k: int, o: Options) -> str:
    """hist1: histograms of contexts of a sample, one element after the other compared with the last histogram."""
    cap = 2 * o.max_dist
    key = "PARTITION BY sample_idx ORDER BY location, length DESC, base, reverse(left_ctx), reverse(right_ctx)"
    apart = f"least({cap}, {_differences('c', 'e_left', k)} + {_differences(f'substr(c, {k + 2})', 'e_right', k)})"
    return f"""
el1 AS (SELECT *, CASE WHEN neg_strand THEN {_revcomp("right_ctx")} || '.' || translate(base, 'ACGT', 'TGCA') || '.' || {_revcomp("left_ctx")} ELSE left_ctx || '.' || base || '.' || right_ctx END AS name,
  row_number() OVER w AS n, CASE WHEN location - lag(location) OVER w > {o.min_tract} THEN 1 ELSE 0 END AS gap FROM located1 WINDOW w AS ({key})),
el2 AS (SELECT *, sum(gap) OVER (PARTITION BY sample_idx ORDER BY n) AS island FROM el1),
el3 AS (SELECT *, row_number() OVER (PARTITION BY sample_idx, island ORDER BY n) AS step FROM el2),
fold1 AS (
  SELECT sample_idx, island, step, 1 AS h, [left_ctx || '.' || right_ctx] AS ctx, base, ref_id, location, loc_pos, loc_last, mismatches, neg_strand, name, left_ctx AS mode_left, right_ctx AS mode_right,
         length AS mode_length, count AS mode_count, count AS integral, false AS indel, [{{'l': length, 'n': count}}] AS lens FROM el3 WHERE step = 1
  UNION ALL
  SELECT sample_idx, island, step + 1, CASE WHEN joined THEN h ELSE h + 1 END, CASE WHEN NOT joined THEN [context] WHEN known THEN ctx ELSE list_append(ctx, context) END, CASE WHEN joined THEN base ELSE e_base END,
         CASE WHEN lead THEN e_ref ELSE ref_id END, CASE WHEN lead THEN e_location ELSE location END, CASE WHEN lead THEN e_pos ELSE loc_pos END, CASE WHEN lead THEN e_last ELSE loc_last END,
         CASE WHEN lead THEN e_nm ELSE mismatches END, CASE WHEN lead THEN e_neg ELSE neg_strand END, CASE WHEN lead THEN e_name ELSE name END, CASE WHEN lead THEN e_left ELSE mode_left END, CASE WHEN lead THEN e_right ELSE mode_right END,
         CASE WHEN lead THEN e_length ELSE mode_length END, CASE WHEN lead THEN e_count ELSE mode_count END, CASE WHEN joined THEN integral + e_count ELSE e_count END, joined AND (indel OR NOT close),
         CASE WHEN joined THEN list_append(lens, {{'l': e_length, 'n': e_count}}) ELSE [{{'l': e_length, 'n': e_count}}] END
  FROM (SELECT *, NOT joined OR mode_count < e_count AS lead, coalesce(stop = 0, false) AS known FROM (
    SELECT *, coalesce(near AND (close OR levenshtein(name, e_name) < {o.leven}), false) AS joined FROM (
      SELECT *, coalesce(stop, list_max(ds)) < {o.max_dist} AS close FROM (
        SELECT *, list_filter(ds, lambda d: d = 0 OR d >= {cap})[1] AS stop FROM (
          SELECT *, list_transform(ctx, lambda c: {apart}) AS ds, e_base = base AND e_ref = ref_id AND abs(e_location - location) <= {o.min_tract} AS near FROM (
            SELECT s.*, e.base AS e_base, e.ref_id AS e_ref, e.location AS e_location, e.loc_pos AS e_pos, e.loc_last AS e_last, e.mismatches AS e_nm, e.neg_strand AS e_neg, e.name AS e_name, e.left_ctx AS e_left,
                   e.right_ctx AS e_right, e.length AS e_length, e.count AS e_count, e.left_ctx || '.' || e.right_ctx AS context
            FROM fold1 s JOIN el3 e ON e.sample_idx = s.sample_idx AND e.island = s.island AND e.step = s.step + 1))))))),
hist1 AS (SELECT * EXCLUDE (nth), len(ctx) AS n_context FROM (SELECT *, row_number() OVER (PARTITION BY sample_idx, island, h ORDER BY step DESC) AS nth FROM fold1) WHERE nth = 1)"""


def merged(o: Options) -> str:
    """hist2: histograms of a sample merged into the last one kept where they overlap."""
    pick = ", ".join(f"CASE WHEN joined AND NOT lead THEN {c} ELSE e_{c} END" for c in _PLACE)
    ours = ", ".join(f"e.{c} AS e_{c}" for c in (*_PLACE, "ctx", "integral", "indel", "lens"))
    return f"""
h1 AS (SELECT *, row_number() OVER w AS n, CASE WHEN location - lag(location) OVER w > (SELECT max(mode_length) - 1 FROM hist1) THEN 1 ELSE 0 END AS gap FROM hist1 WINDOW w AS (PARTITION BY sample_idx ORDER BY location, base, name)),
h2 AS (SELECT * EXCLUDE (island, step, h), sum(gap) OVER (PARTITION BY sample_idx ORDER BY n) AS island FROM h1),
h3 AS (SELECT *, row_number() OVER (PARTITION BY sample_idx, island ORDER BY n) AS step FROM h2),
fold2 AS (
  SELECT sample_idx, island, step, 1 AS h, {", ".join(_PLACE)}, ctx, integral, indel, lens FROM h3 WHERE step = 1
  UNION ALL
  SELECT sample_idx, island, step + 1, CASE WHEN joined THEN h ELSE h + 1 END, {pick}, CASE WHEN joined THEN list_distinct(list_concat(ctx, e_ctx)) ELSE e_ctx END,
         CASE WHEN joined THEN integral + e_integral ELSE e_integral END, (joined AND indel) OR e_indel, CASE WHEN joined THEN list_concat(lens, e_lens) ELSE e_lens END
  FROM (SELECT *, mode_count < e_mode_count AS lead,
               ref_id = e_ref_id AND (location = e_location OR (abs(location - e_location) <= least(mode_length, e_mode_length) - 1 AND base = e_base AND levenshtein(name, e_name) <= {o.leven})) AS joined
        FROM (SELECT s.*, {ours} FROM fold2 s JOIN h3 e ON e.sample_idx = s.sample_idx AND e.island = s.island AND e.step = s.step + 1))),
hist2 AS (SELECT * EXCLUDE (nth), len(ctx) AS n_context FROM (SELECT *, row_number() OVER (PARTITION BY sample_idx, island, h ORDER BY step DESC) AS nth FROM fold2) WHERE nth = 1)"""


_PLACE = ("base", "ref_id", "location", "loc_pos", "loc_last", "mismatches", "neg_strand", "name", "mode_left", "mode_right", "mode_length", "mode_count")


def tracts(o: Options) -> str:
    """assigned: histograms of all samples in order, each with its tract and its distance to the tract's leader."""
    return f"""
t1 AS (SELECT * EXCLUDE (island, step, h), row_number() OVER w AS n, CASE WHEN location - lag(location) OVER w > (SELECT max(mode_length) - 1 FROM hist2) THEN 1 ELSE 0 END AS gap FROM hist2 WINDOW w AS (ORDER BY location, sample_idx DESC, name)),
t2 AS (SELECT *, sum(gap) OVER (ORDER BY n) AS island FROM t1),
t3 AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY n) AS step FROM t2),
fold3 AS (
  SELECT n, island, step, ref_id, location, mode_length, base, name, 0 AS lev, 1 AS leads FROM t3 WHERE step = 1
  UNION ALL
  SELECT e_n, island, step + 1, CASE WHEN joined THEN ref_id ELSE e_ref END, CASE WHEN joined THEN location ELSE e_location END, CASE WHEN joined THEN mode_length ELSE e_length END, CASE WHEN joined THEN base ELSE e_base END,
         CASE WHEN joined THEN name ELSE e_name END, CASE WHEN joined AND location <> e_location THEN levenshtein(name, e_name) ELSE 0 END, CASE WHEN joined THEN 0 ELSE 1 END
  FROM (SELECT *, ref_id = e_ref AND (location = e_location OR (abs(location - e_location) <= least(mode_length, e_length) - 1 AND base = e_base AND levenshtein(name, e_name) <= {o.leven})) AS joined
        FROM (SELECT s.*, e.n AS e_n, e.ref_id AS e_ref, e.location AS e_location, e.mode_length AS e_length, e.base AS e_base, e.name AS e_name FROM fold3 s JOIN t3 e ON e.island = s.island AND e.step = s.step + 1))),
assigned AS (SELECT t.* EXCLUDE (gap, island, step, n), CAST(n - 1 AS INT) AS concat_idx, CAST(sum(leads) OVER (ORDER BY n) - 1 AS INT) AS tract_id, lev FROM t3 t JOIN (SELECT n, lev, leads FROM fold3) USING (n))"""


#: stat, as of exactly mapped contexts, from assigned: the statistics of merged histograms.
STAT = """
shares AS (SELECT concat_idx, l, sum(n) AS n FROM (SELECT concat_idx, unnest(lens, recursive := true) FROM assigned) GROUP BY 1, 2),
sums AS (SELECT concat_idx, sum(l * n) / sum(n) AS mean_length, max(n) / sum(n) AS modal_freq, list({'l': l, 'n': n} ORDER BY n DESC, l) AS modes FROM shares GROUP BY 1),
stat AS (
  SELECT a.*, mode_left AS left_ctx, mode_right AS right_ctx, mean_length, modal_freq, integral / coverage AS prop_coverage, CAST(integral / n_context AS DOUBLE) AS cov_per_context,
         -list_sum(list_transform(modes, lambda x: (x.n / integral) * ln(x.n / integral))) AS entropy
  FROM assigned a JOIN sums USING (concat_idx) JOIN coverage USING (sample_idx))"""


def run(n_samples: int) -> str:
    """ref_ht (windows without a candidate too), the last histogram of each sample in a tract, and variable tracts. Needs windows, chosen and stat."""
    spread = " + ".join(f"max({c}) - CASE WHEN count(*) < {n_samples} THEN least(0, min({c})) ELSE min({c}) END" for c in ("mean_length", "modal_freq", "entropy"))
    return f"""
ref_ht AS (
  SELECT w.tract_id, w.ref_id, w.border_lo, w.border_hi, CAST(coalesce(z - a, 0) AS INT) AS tract_length, CAST(coalesce(a, w.border_lo + (w.border_hi - w.border_lo) // 2) AS INT) AS ht_location,
         w.exemplar_concat_idx, coalesce(l || '.' || c || '.' || r, substr(o.seq, w.border_lo + 1, w.border_hi - w.border_lo)) AS ref_tract
  FROM windows w JOIN contigs o USING (ref_id) LEFT JOIN (SELECT tract_id, a, z, l, c, r FROM chosen WHERE nth = 1) USING (tract_id)),
of_sample AS (SELECT tract_id, sample_idx, count(*) AS c, arg_max(mean_length, location) AS mean_length, arg_max(modal_freq, location) AS modal_freq, arg_max(entropy, location) AS entropy FROM stat GROUP BY 1, 2),
outer_ AS (SELECT tract_id, min(mode_length) AS lo, max(mode_length) AS hi FROM stat GROUP BY 1),
moved AS (SELECT tract_id, sum(c) < {n_samples} OR {spread} > 1e-5 AS moves FROM of_sample GROUP BY 1),
variable AS (SELECT tract_id, moves OR lo <> tract_length OR hi <> tract_length AS variable FROM moved JOIN outer_ USING (tract_id) JOIN ref_ht USING (tract_id))"""


def variants(k: int, lcp) -> str:
    """variants: what differs from the reference after the last common base. lcp(a, b): SQL of the length of the common prefix."""
    return f"""
nexts AS (SELECT a.tract_id, arg_min(b.ht_location, b.tract_id) AS next_ht FROM ref_ht a LEFT JOIN ref_ht b ON a.ref_id = b.ref_id AND b.tract_id > a.tract_id AND b.ht_location <> a.ht_location GROUP BY 1),
v1 AS (
  SELECT s.sample_idx, tract_id, contig, loc_pos, loc_last, mode_length, r.tract_length, r.ht_location, greatest(0, loc_last + 1 - coalesce(next_ht, loc_last + 1)) AS over, substr(seq, loc_pos + 1, loc_last - loc_pos + 1) AS ref,
         CASE WHEN neg_strand THEN {_revcomp("mode_left || repeat(base, mode_length) || mode_right")} ELSE mode_left || repeat(base, mode_length) || mode_right END AS alt
  FROM stat s JOIN ref_ht r USING (tract_id) JOIN variable v USING (tract_id) LEFT JOIN nexts USING (tract_id) JOIN contigs c ON c.ref_id = s.ref_id WHERE variable),
v2 AS (SELECT *, substr(substr(ref, 1, greatest(length(ref) - over, 0)), ht_location - loc_pos + 1) AS r, substr(substr(alt, 1, greatest(length(alt) - over, 0)), {k + 1}) AS a FROM v1),
v3 AS (SELECT *, {lcp("r", "a")} AS l0, {lcp("reverse(r)", "reverse(a)")} AS back FROM v2 WHERE (substr(r, 1, 1) <> substr(a, 1, 1) OR tract_length <> mode_length) AND r <> a),
v4 AS (SELECT *, least(back, least(length(r), length(a)) - l0) AS l1 FROM v3 WHERE l0 > 0),
variants AS (
  SELECT sample_idx, contig AS chrom, CAST(ht_location + l0 AS INT) AS pos, substr(r, l0, greatest(length(r) - l1 - l0 + 1, 1)) AS ref, substr(a, l0, greatest(length(a) - l1 - l0 + 1, 1)) AS alt, printf('tid_%06d', tract_id) AS tid FROM v4)"""
