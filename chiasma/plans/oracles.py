"""The queries in DuckDB: plain formulations without the stretches, buckets and folds of the Spark side."""

from __future__ import annotations

import re

from .adapters import SQL
from .queries import EVENT_GAP, N_REGIONS, PROFILE, _found

_CLASSES = ("five_prime", "three_prime", "body")
_AB = "IN ('A', 'B')"
_W = "(PARTITION BY map, sample_idx, chromosome ORDER BY coordinate, snp_name)"


def _emission(state: int, x: str) -> str:
    own, other = ("A", "B") if state == 0 else ("B", "A")
    return f"ln((CASE {x} WHEN '{own}' THEN 0.98 WHEN '{other}' THEN 0.02 ELSE 0.5 END)::DOUBLE)"


def _probability(d: str) -> str:
    return f"least(greatest(1e-8::DOUBLE * greatest({d}, 1)::DOUBLE, 1e-6::DOUBLE), 0.05::DOUBLE)"


def _collapse(source: str, keys: str, pos: str, gap: int, columns: str) -> str:
    return f"""
      SELECT {columns} FROM (
        SELECT *, row_number() OVER (PARTITION BY {keys}, island ORDER BY {pos}) AS r, count(*) OVER (PARTITION BY {keys}, island) AS m FROM (
          SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY {pos} ROWS UNBOUNDED PRECEDING) AS island FROM (
            SELECT *, CASE WHEN {pos} - lag({pos}) OVER (PARTITION BY {keys} ORDER BY {pos}) <= {gap} THEN 0 ELSE 1 END AS fresh FROM {source})))
      WHERE r = m AND m % 2 = 1"""


def _merged(source: str, keys: str) -> str:
    return f"""
      SELECT {keys}, min(start) AS start, max("end") AS "end" FROM (
        SELECT *, sum(opens) OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM (
          SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS opens FROM {source}))
      GROUP BY {keys}, g"""


def _segments(source: str, classes: list[str]) -> str:
    sums = ", ".join(f"sum(sum(CASE WHEN class = '{c}' THEN d ELSE 0 END)) OVER w AS n_{c}" for c in classes)
    return f"""
      SELECT * FROM (SELECT chrom, pos AS start, lead(pos) OVER w AS "end", {sums} FROM (
        SELECT chrom, class, start AS pos, 1 AS d FROM {source} WHERE "end" > start UNION ALL SELECT chrom, class, "end", -1 FROM {source} WHERE "end" > start)
      GROUP BY chrom, pos WINDOW w AS (PARTITION BY chrom ORDER BY pos)) WHERE "end" IS NOT NULL"""


def _draw(idx: str, kind: str, n: int, total: str) -> str:
    return f"(('0x' || substr(md5({idx} || '|{kind}|{n}|25'), 1, 14))::BIGINT % {total})"


_P = PROFILE
_FB, _R, _B, _F = _P.flank_bins, _P.right_offset, _P.bin_size, _P.flanking_bp
_PARTS = (
    ("left", "nl", f"low + i * {_B}", f"{_FB} - nl + i", f"{_R} + nl - 1 - i"),
    ("right", "nr", f'"end" + i * {_B}', f"{_R} + i", f"{_FB} - 1 - i"),
    ("body_left", "k", f"start + i * {_B}", f"{_FB} + i", f"{_R} - 1 - i"),
    ("body_right", "k", f'"end" - (i + 1) * {_B}', f"{_R} - 1 - i", f"{_FB} + i"),
)
_SLOTS = " UNION ALL ".join(
    f"SELECT input_ord, chr, '{n}' AS part, i, (CASE WHEN strand = '+' THEN {up} ELSE {down} END)::INTEGER AS slot, {w} AS w_start, {w} + {_B} AS w_end FROM (SELECT *, unnest(range({c})) AS i FROM counted)"
    for n, c, w, up, down in _PARTS
)
_PROFILE = """
  SELECT s.slot::INTEGER AS slot, round(s1 / n, 9) AS mean, round(sqrt(greatest(s2 / n - (s1 / n) * (s1 / n), 0) / n), 9) AS se, coalesce(n, 0) AS n
  FROM range({total}) s(slot) LEFT JOIN (SELECT slot, sum(value) AS s1, sum(value * value) AS s2, count(*) AS n FROM {sums} GROUP BY slot) g ON g.slot = s.slot"""

CTES: dict[str, str] = SQL | {
    "counted_markers": "SELECT *, length(genotypes) - length(replace(genotypes, 'A', '')) AS n_a, length(genotypes) - length(replace(genotypes, 'B', '')) AS n_b FROM markers",
    "dedup": """SELECT map, chromosome, coordinate, snp_name, genotypes FROM (SELECT *, row_number() OVER (PARTITION BY map, chromosome, coordinate
      ORDER BY n_a + n_b DESC, length(genotypes) - n_a - n_b, snp_name DESC, input_ord) AS r FROM counted_markers) WHERE r = 1""",
    "missing": f"""SELECT map, j::INTEGER AS sample_idx, count(*) AS total, count(*) FILTER (substr(genotypes, j + 1, 1) NOT {_AB}) AS missing,
      (count(*) FILTER (substr(genotypes, j + 1, 1) NOT {_AB}))::DOUBLE / count(*) AS missingness FROM dedup, range(32) r(j) GROUP BY map, j""",
    "kept": "SELECT map, coalesce(list(sample_idx ORDER BY sample_idx) FILTER (missingness <= 0.3::DOUBLE), []) AS kept, count(*) AS n_samples FROM missing GROUP BY map",
    "owned": "SELECT d.*, array_to_string(list_transform(kept, lambda i: substr(genotypes, i + 1, 1)), '') AS own FROM dedup d JOIN kept USING (map)",
    "metrics": """SELECT *, CASE WHEN length(own) = 0 THEN 1.0::DOUBLE ELSE (length(own) - a - b)::DOUBLE / length(own) END AS missingness, CASE WHEN a + b > 0 THEN a::DOUBLE / (a + b)::DOUBLE END AS balance
      FROM (SELECT *, length(own) - length(replace(own, 'A', '')) AS a, length(own) - length(replace(own, 'B', '')) AS b FROM owned)""",
    "left_markers": "SELECT * FROM metrics WHERE missingness <= 0.2::DOUBLE AND balance BETWEEN 0.1::DOUBLE AND 0.9::DOUBLE",
    "clean": "SELECT map, chromosome, coordinate, snp_name, own AS genotypes FROM flips_left WHERE flip_rate <= 0.12::DOUBLE",
    "steps": f"""SELECT map, chromosome, coordinate, snp_name, genotypes, i, ln((1 - p)::DOUBLE) AS stay, ln(p::DOUBLE) AS go FROM (
      SELECT *, row_number() OVER w AS i, {_probability("coordinate - lag(coordinate) OVER w")} AS p FROM clean WINDOW w AS (PARTITION BY map, chromosome ORDER BY coordinate, snp_name))""",
    "v": f"""SELECT map, chromosome, d::INTEGER AS d, 1::BIGINT AS i, ln(0.5::DOUBLE) + {_emission(0, "substr(genotypes, d + 1, 1)")} AS s0, ln(0.5::DOUBLE) + {_emission(1, "substr(genotypes, d + 1, 1)")} AS s1, '' AS back
      FROM (SELECT *, unnest(range(length(genotypes))) AS d FROM steps WHERE i = 1)
      UNION ALL SELECT v.map, v.chromosome, v.d, s.i, greatest(v.s0 + s.stay, v.s1 + s.go) + {_emission(0, "substr(s.genotypes, v.d + 1, 1)")}, greatest(v.s0 + s.go, v.s1 + s.stay) + {_emission(1, "substr(s.genotypes, v.d + 1, 1)")},
        v.back || CASE WHEN v.s1 + s.go > v.s0 + s.stay THEN CASE WHEN v.s1 + s.stay > v.s0 + s.go THEN '3' ELSE '1' END ELSE CASE WHEN v.s1 + s.stay > v.s0 + s.go THEN '2' ELSE '0' END END
      FROM v JOIN steps s ON s.map = v.map AND s.chromosome = v.chromosome AND s.i = v.i + 1""",
    "final_v": "SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY map, chromosome, d ORDER BY i DESC) = 1",
    "b": """SELECT map, chromosome, d, i, back, CASE WHEN s1 > s0 THEN 1 ELSE 0 END AS state FROM final_v
      UNION ALL SELECT map, chromosome, d, i - 1, back, CASE WHEN state = 0 THEN CASE WHEN substr(back, i - 1, 1) IN ('1', '3') THEN 1 ELSE 0 END ELSE CASE WHEN substr(back, i - 1, 1) IN ('2', '3') THEN 1 ELSE 0 END END FROM b WHERE i > 1""",
    "changes": """SELECT map, chromosome, dense_idx, left_coordinate, coordinate AS right_coordinate, left_snp, snp_name AS right_snp, CASE left_s WHEN 0 THEN 'A' ELSE 'B' END AS left_state, CASE state WHEN 0 THEN 'A' ELSE 'B' END AS right_state, (left_coordinate + coordinate) // 2 AS event_bp FROM (
      SELECT b.map, b.chromosome, b.d AS dense_idx, s.coordinate, s.snp_name, state, lag(state) OVER w AS left_s, lag(s.coordinate) OVER w AS left_coordinate, lag(s.snp_name) OVER w AS left_snp
      FROM b JOIN steps s ON s.map = b.map AND s.chromosome = b.chromosome AND s.i = b.i WINDOW w AS (PARTITION BY b.map, b.chromosome, b.d ORDER BY b.i)) WHERE left_s <> state""",
    "co_events": """SELECT format('{}_ind{:03d}', map, dense_idx + 1) AS sample_id, map, chromosome, (row_number() OVER (PARTITION BY map, dense_idx ORDER BY chromosome, event_bp))::INTEGER AS event_index,
      event_bp, left_coordinate, right_coordinate, left_snp, right_snp, left_state, right_state FROM (""" + _collapse("changes", "map, dense_idx, chromosome", "event_bp", 2_000_000, "*") + ")",
    "informative": f"SELECT map, chromosome, coordinate, snp_name, j::INTEGER AS sample_idx, substr(genotypes, j + 1, 1) AS state FROM markers, range(32) r(j) WHERE substr(genotypes, j + 1, 1) {_AB}",
    "run_rows": f"SELECT *, sum(fresh) OVER {_W[:-1]} ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT *, CASE WHEN lag(state) OVER {_W} = state THEN 0 ELSE 1 END AS fresh FROM informative)",
    "runs": """SELECT map, sample_idx, chromosome, run::INTEGER AS run, min(state) AS state, count(*) AS n_markers, min(coordinate) AS first_coordinate, max(coordinate) AS last_coordinate,
      min({'c': coordinate, 's': snp_name})['s'] AS first_snp, max({'c': coordinate, 's': snp_name})['s'] AS last_snp, max(coordinate) - min(coordinate) AS span FROM run_rows GROUP BY ALL""",
    "run_calls": """SELECT map, sample_idx, chromosome, (left_coordinate + first_coordinate) // 2 AS event_bp, left_coordinate, first_coordinate AS right_coordinate, left_snp, first_snp AS right_snp, left_state, state AS right_state FROM (
      SELECT *, lag(last_coordinate) OVER w AS left_coordinate, lag(last_snp) OVER w AS left_snp, lag(state) OVER w AS left_state FROM runs WINDOW w AS (PARTITION BY map, sample_idx, chromosome ORDER BY run))
      WHERE left_state IS NOT NULL AND n_markers >= 2 AND span >= 1000000""",
    "class_rows": "SELECT *, CASE user_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS class FROM intervals",
    "both_rows": """SELECT chrom, start, "end", CASE event_id % 3 WHEN 0 THEN 'minus' ELSE 'base' END AS class FROM intervals""",
    "both_segments": _segments("both_rows", ["base", "minus"]),
    "left_over": "SELECT * FROM both_segments WHERE n_base > 0 AND n_minus = 0",
    "class_segments": _segments("class_rows", ["a", "b", "c"]),
    "alone": " UNION ALL ".join(f"""SELECT '{c}' AS class, chrom, start, "end" FROM class_segments WHERE n_{c} > 0 AND {" + ".join(f"n_{o}" for o in "abc" if o != c)} = 0""" for c in "abc"),
    "gene_classes": """SELECT chrom, s.* FROM (SELECT chrom, unnest([
        CASE WHEN strand = '+' THEN {'start': greatest(start - 5000, 0), 'end': least(start, length), 'class': 'five_prime'} ELSE {'start': greatest("end", 0), 'end': least("end" + 5000, length), 'class': 'five_prime'} END,
        CASE WHEN strand = '+' THEN {'start': greatest("end", 0), 'end': least("end" + 5000, length), 'class': 'three_prime'} ELSE {'start': greatest(start - 5000, 0), 'end': least(start, length), 'class': 'three_prime'} END,
        {'start': start + 5000, 'end': "end" - 5000, 'class': 'body'}]) AS s FROM region_genes g JOIN region_lengths l USING (chrom)) WHERE s."end" > s.start""",
    "gene_segments": _segments("gene_classes", ["five_prime", "three_prime", "body"]),
    "gene_alone": " UNION ALL ".join(f"""SELECT '{c}' AS class, chrom, start, "end" FROM gene_segments WHERE n_{c} > 0 AND {" + ".join(f"n_{o}" for o in ("five_prime", "three_prime", "body") if o != c)} = 0""" for c in ("five_prime", "three_prime", "body")),
    "gene_parts": _merged("gene_alone", "class, chrom"),
    "scattered": """SELECT CASE WHEN h = '1' AND start % 2 = 0 THEN 'other' ELSE chrom END AS chrom, start, "end", sample, id FROM (
      SELECT *, unnest(CASE WHEN h = '2' AND start % 2 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM (
        SELECT chrom, sample, marker AS id, substr(md5(marker), 1, 1) AS h, e.start AS start, e."end" AS "end" FROM (SELECT *, unnest([{'start': start, 'end': start + 1}, {'start': "end" - 1, 'end': "end"}]) AS e FROM map_intervals))
      WHERE NOT (h = '0' AND start % 2 = 0))""",
    "signal_ends": """SELECT chr AS chrom, id, e.start AS start, e."end" AS "end" FROM (SELECT *, unnest([{'start': start, 'end': start + 1}, {'start': "end" - 1, 'end': "end"}]) AS e FROM signal WHERE "end" > start)""",
    "lifted_ends": """SELECT p.id, t_chrom AS chrom, CASE t_strand WHEN '-' THEN t_start + w_end - 1 - start ELSE t_start + start - w_start END AS start, CASE t_strand WHEN '-' THEN t_start + w_end - 1 - start ELSE t_start + start - w_start END + 1 AS "end"
      FROM signal_ends p JOIN blocks b ON b.chrom = p.chrom AND p.start >= w_start AND p.start < w_end""",
    "bounded": f"""SELECT *, greatest(start - {_F}, prev_end) AS low, least("end" + {_F}, next_start) AS high FROM (
      SELECT *, coalesce(max("end") OVER (PARTITION BY chr ORDER BY start, "end", input_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS prev_end, lead(start) OVER (PARTITION BY chr ORDER BY start, "end", input_ord) AS next_start FROM stranded)""",
    "counted": f"""SELECT *, CASE WHEN start > low THEN (start - low) // {_B} ELSE 0 END AS nl, CASE WHEN high > "end" THEN (high - "end") // {_B} ELSE 0 END AS nr, least((("end" - start) // {_B}) // 2, {_P.body_bins}) AS k FROM bounded""",
    "slots": _SLOTS,
    "mids": 'SELECT chr, (start + "end") // 2 AS mid, value FROM signal',
    "knots": """SELECT chrom, bp, min(cm) AS cm FROM (
      SELECT m.chrom, bp, cm - least_cm AS cm FROM map_markers m JOIN (SELECT chrom, min(cm) AS least_cm FROM map_markers GROUP BY chrom) USING (chrom)
      UNION ALL SELECT chrom, 0, 0.0 FROM map_lengths UNION ALL SELECT l.chrom, length, span FROM map_lengths l JOIN (SELECT chrom, max(cm) - min(cm) AS span FROM map_markers GROUP BY chrom) USING (chrom)) GROUP BY chrom, bp""",
    "secants": """SELECT *, lag(h) OVER w AS h_, lag(s) OVER w AS s_, lead(h) OVER w AS hn, lead(s) OVER w AS sn, lag(h, 2) OVER w AS hp, lag(s, 2) OVER w AS sp FROM (
      SELECT *, (lead(bp) OVER u)::DOUBLE - bp::DOUBLE AS h, (lead(cm) OVER u - cm) / ((lead(bp) OVER u)::DOUBLE - bp::DOUBLE) AS s FROM knots WINDOW u AS (PARTITION BY chrom ORDER BY bp)) WINDOW w AS (PARTITION BY chrom ORDER BY bp)""",
    "sloped": """SELECT *, CASE WHEN s_ IS NULL THEN CASE WHEN sn IS NULL THEN s WHEN sign(e0) <> sign(s) THEN 0 WHEN sign(s) <> sign(sn) AND abs(e0) > 3 * abs(s) THEN 3 * s ELSE e0 END
        WHEN s IS NULL THEN CASE WHEN sp IS NULL THEN s_ WHEN sign(e1) <> sign(s_) THEN 0 WHEN sign(s_) <> sign(sp) AND abs(e1) > 3 * abs(s_) THEN 3 * s_ ELSE e1 END
        WHEN s * s_ <= 0 THEN 0 ELSE (3 * (h + h_)) / ((2 * h + h_) / s_ + (h + 2 * h_) / s) END AS d
      FROM (SELECT *, ((2 * h + hn) * s - h * sn) / (h + hn) AS e0, ((2 * h_ + hp) * s_ - h_ * sp) / (h_ + hp) AS e1 FROM secants)""",
    "pieces": """SELECT chrom, bp AS x0, lead(bp) OVER w AS x1, cm AS y0, lead(cm) OVER w AS y1, d AS d0, lead(d) OVER w AS d1, lead(bp, 2) OVER w IS NULL AS last FROM sloped WINDOW w AS (PARTITION BY chrom ORDER BY bp)""",
    "at_points": """SELECT chrom, bp, (1 + 2 * t) * (1 - t) * (1 - t) * y0 + t * (1 - t) * (1 - t) * h * d0 + t * t * (3 - 2 * t) * y1 + t * t * (t - 1) * h * d1 AS cm FROM (
      SELECT p.chrom, p.bp, (x1 - x0)::DOUBLE AS h, (p.bp - x0) / (x1 - x0)::DOUBLE AS t, y0, y1, d0, d1
      FROM (SELECT chrom, start AS bp FROM map_intervals UNION SELECT chrom, "end" FROM map_intervals) p JOIN pieces q ON q.chrom = p.chrom AND x1 IS NOT NULL AND p.bp >= x0 AND (p.bp < x1 OR (last AND p.bp = x1)))""",
    "annotated": """SELECT chrom, start, "end", sample, marker, start_cM, end_cM, (end_cM - start_cM) / (("end" - start) / 1e6::DOUBLE) AS cM_per_Mb FROM (
      SELECT i.chrom, start, "end", sample, marker, max(cm) FILTER (k = 0) AS start_cM, max(cm) FILTER (k = 1) AS end_cM
      FROM (SELECT *, unnest([0, 1]) AS k FROM map_intervals) i JOIN at_points a ON a.chrom = i.chrom AND a.bp = CASE k WHEN 0 THEN start ELSE "end" END GROUP BY ALL)""",
    "in_blocks": "SELECT *, bp // 20000 AS block, row_number() OVER (PARTITION BY chrom, bp // 20000 ORDER BY bp) AS u, row_number() OVER (PARTITION BY chrom, bp // 20000 ORDER BY bp DESC) AS v FROM map_markers WHERE bp % 7000 < 3000",
    "length_shares": """SELECT length, (sum(n) OVER (ORDER BY length) - n)::BIGINT AS lo, (sum(n) OVER (ORDER BY length))::BIGINT AS hi FROM (SELECT "end" - start AS length, count(*) AS n FROM signal WHERE "end" > start GROUP BY 1)""",
    "drawn": f"SELECT idx, length FROM (SELECT i AS idx, {_draw('i', 'length', 0, '(SELECT max(hi) FROM length_shares)')} AS pick FROM range(1, {N_REGIONS + 1}) r(i)) JOIN length_shares ON pick >= lo AND pick < hi",
    "rooms": "SELECT idx, d.length, chrom, greatest(l.length - d.length + 1, 0) AS room FROM drawn d, region_lengths l",
    "uniform_regions": f"SELECT idx, chrom, (pick - lo)::BIGINT AS start, (pick - lo + length)::BIGINT AS \"end\" FROM (SELECT *, {_draw('idx', 'uniform', 1, 'total::BIGINT')} AS pick FROM room_shares WHERE total > 0) WHERE pick >= lo AND pick < hi",
    "room_shares": "SELECT *, sum(room) OVER (PARTITION BY idx ORDER BY chrom) - room AS lo, sum(room) OVER (PARTITION BY idx ORDER BY chrom) AS hi, sum(room) OVER (PARTITION BY idx) AS total FROM rooms",
} | {
    f"{kind}_shares": f"""SELECT chrom, start, (sum("end" - start) OVER (ORDER BY chrom, start) - ("end" - start))::BIGINT AS lo, (sum("end" - start) OVER (ORDER BY chrom, start))::BIGINT AS hi FROM gene_parts WHERE class = '{kind}'"""
    for kind in ("five_prime", "three_prime", "body")
} | {
    f"{kind}_regions": f"""SELECT idx, chrom, start, least(start + len, size) AS "end" FROM (SELECT idx, p.chrom, p.length AS len, l.length AS size, greatest(least(greatest(point - {_draw('idx', kind, 2, 'p.length')}, 0), l.length - p.length), 0) AS start FROM {kind}_points p JOIN region_lengths l ON l.chrom = p.chrom)"""
    for kind in ("five_prime", "three_prime", "body")
} | {
    f"{kind}_points": f"SELECT idx, length, chrom, start + pick - lo AS point FROM (SELECT *, {_draw('idx', kind, 1, f'(SELECT max(hi) FROM {kind}_shares)')} AS pick FROM drawn) JOIN {kind}_shares ON pick >= lo AND pick < hi"
    for kind in ("five_prime", "three_prime", "body")
}


def _flip(source: str) -> str:
    ok = lambda s: f"substr({s}, j + 1, 1)"
    same = f"{ok('l')} = {ok('r')} AND {ok('l')} {_AB} AND {ok('genotypes')} {_AB}"
    return f"""SELECT *, CASE WHEN l IS NULL OR r IS NULL OR supported = 0 THEN 0.0::DOUBLE ELSE odd::DOUBLE / supported END AS flip_rate FROM (
      SELECT *, len(list_filter(range(32), lambda j: {same})) AS supported, len(list_filter(range(32), lambda j: {same} AND {ok('genotypes')} <> {ok('l')})) AS odd FROM (
        SELECT *, lag(genotypes) OVER w AS l, lead(genotypes) OVER w AS r FROM {source} WINDOW w AS (PARTITION BY map ORDER BY chromosome, coordinate, snp_name)))"""


CTES["flips"] = _flip("dedup")
CTES["flips_left"] = _flip("left_markers")


def _value(part: str, uniform: bool) -> str:
    if uniform:
        v, on = 's.value * (least(s."end", w.w_end) - greatest(s.start, w.w_start)) / greatest(s."end" - s.start, 1)', 's.chr = w.chr AND s."end" > s.start AND s.start < w.w_end AND s."end" > w.w_start'
        source = "signal"
    else:
        v, on, source = "s.value", "s.chr = w.chr AND s.mid >= w.w_start AND s.mid < w.w_end", "mids"
    return f"""SELECT w.input_ord, w.chr, w.part, w.i, w.slot, w.w_start, w.w_end, coalesce(sum({v}), 0) AS value FROM {part} w LEFT JOIN {source} s ON {on} GROUP BY ALL"""


CTES |= {"sums": _value("slots", False), "sums_uniform": _value("slots", True)}

FINAL: dict[str, str] = {
    "marker_required_filter": """SELECT map, input_ord, try_cast(try_cast(chromosome AS DOUBLE) AS INTEGER) AS chromosome, try_cast(coordinate AS BIGINT) AS coordinate, snp_name, genotypes FROM messy
      WHERE map <> '' AND snp_name <> '' AND genotypes IS NOT NULL AND try_cast(chromosome AS DOUBLE) <> 0 AND coordinate IS NOT NULL AND length(genotypes) > 6""",
    "informative_counts": "SELECT map, snp_name, n_a::INTEGER AS n_a, n_b::INTEGER AS n_b, (n_a + n_b)::INTEGER AS n_informative FROM counted_markers",
    "dedup_markers": "SELECT * FROM dedup",
    "sample_missingness": "SELECT * FROM missing",
    "sample_renumber": "SELECT map, sample_idx, dense_idx, format('{}_ind{:03d}', map, dense_idx + 1) AS sample_id FROM (SELECT map, unnest(kept) AS sample_idx, (generate_subscripts(kept, 1) - 1)::INTEGER AS dense_idx FROM kept)",
    "subset_markers": "SELECT map, chromosome, coordinate, snp_name, own AS genotypes FROM owned",
    "marker_missingness": "SELECT map, snp_name, missingness FROM metrics",
    "allele_balance": "SELECT map, snp_name, balance FROM metrics",
    "isolated_flip": "SELECT map, snp_name, flip_rate FROM flips",
    "clean_markers": "SELECT * FROM clean",
    "qc_summary": """SELECT t.map, t.n AS input_markers, d.n AS deduplicated_markers, t.n - d.n AS removed_duplicate_markers, n_samples::INTEGER AS input_samples, len(kept)::INTEGER AS kept_samples, (n_samples - len(kept))::INTEGER AS removed_samples_missingness,
      m.missing AS removed_markers_missingness, m.balance AS removed_markers_allele_balance, coalesce(f.flip, 0)::INTEGER AS removed_markers_isolated_flip, coalesce(f.final, 0)::INTEGER AS final_markers, coalesce(e.n, 0)::INTEGER AS hmm_events
      FROM (SELECT map, count(*)::INTEGER AS n FROM markers GROUP BY map) t JOIN (SELECT map, count(*)::INTEGER AS n FROM dedup GROUP BY map) d USING (map) JOIN kept USING (map)
      JOIN (SELECT map, (count(*) FILTER (missingness > 0.2::DOUBLE))::INTEGER AS missing, (count(*) FILTER (missingness <= 0.2::DOUBLE AND NOT coalesce(balance BETWEEN 0.1::DOUBLE AND 0.9::DOUBLE, false)))::INTEGER AS balance FROM metrics GROUP BY map) m USING (map)
      LEFT JOIN (SELECT map, count(*) FILTER (flip_rate > 0.12::DOUBLE) AS flip, count(*) FILTER (flip_rate <= 0.12::DOUBLE) AS final FROM flips_left GROUP BY map) f USING (map)
      LEFT JOIN (SELECT map, count(*) AS n FROM co_events GROUP BY map) e USING (map)""",
    "transition_prob": f"""SELECT map, snp_name, distance, {_probability("distance")} AS probability FROM (SELECT map, snp_name, coordinate - lag(coordinate) OVER (PARTITION BY map, chromosome ORDER BY coordinate) AS distance FROM dedup) WHERE distance IS NOT NULL""",
    "emission_log_prob": f"""SELECT observed, count(*) AS n, round({_emission(0, "observed")}, 12) AS in_a, round({_emission(1, "observed")}, 12) AS in_b FROM (SELECT substr(genotypes, j + 1, 1) AS observed FROM markers, range(32) r(j)) GROUP BY observed""",
    "viterbi_path": "SELECT map, chromosome, d AS dense_idx, string_agg(state::VARCHAR, '' ORDER BY i) AS path FROM b GROUP BY map, chromosome, d",
    "state_change_events": "SELECT * FROM changes",
    "hmm_co_events": "SELECT * FROM co_events",
    "collapse_close_pairs": _collapse("points", "sample, chrom", "bp", EVENT_GAP, "sample, chrom, bp, event_id"),
    "switch_calls_raw": f"""SELECT map, sample_idx, chromosome, (left_coordinate + coordinate) // 2 AS event_bp, left_coordinate, coordinate AS right_coordinate, left_snp, snp_name AS right_snp, left_state, state AS right_state FROM (
      SELECT *, lag(coordinate) OVER {_W} AS left_coordinate, lag(snp_name) OVER {_W} AS left_snp, lag(state) OVER {_W} AS left_state FROM informative) WHERE left_state <> state""",
    "switch_runs": "SELECT * FROM runs",
    "switch_calls_filtered": _collapse("run_calls", "map, sample_idx, chromosome", "event_bp", 2_000_000, "* EXCLUDE (r, m, island, fresh)"),
    "marey_curve": """SELECT e.chromosome, row_number() OVER (PARTITION BY e.chromosome ORDER BY event_bp, sample_id) AS rank, event_bp, row_number() OVER (PARTITION BY e.chromosome ORDER BY event_bp, sample_id) / n::DOUBLE AS cumulative
      FROM co_events e JOIN (SELECT chromosome, count(DISTINCT sample_id) AS n FROM co_events GROUP BY chromosome) USING (chromosome)""",
    "marey_samples": "SELECT chromosome, count(DISTINCT sample_id) AS n_samples FROM co_events GROUP BY chromosome",
    "merge_intervals": _merged("intervals", "chrom"),
    "subtract_intervals": _merged("left_over", "chrom"),
    "exclusive_partitions": _merged("alone", "class, chrom"),
    "gene_classes": "SELECT * FROM gene_classes",
    "gene_partitions": "SELECT * FROM gene_parts",
    "interval_clip": """SELECT chr, greatest(start, 1000000) AS start, least("end", 3000000) AS "end", value, id FROM signal WHERE least("end", 3000000) > greatest(start, 1000000)""",
    "endpoint_explode": """SELECT chr, value, id, e.start AS start, e."end" AS "end" FROM (SELECT *, unnest([{'start': start, 'end': start + 1}, {'start': "end" - 1, 'end': "end"}]) AS e FROM signal WHERE "end" > start)""",
    "rebuild_intervals": """SELECT min(chrom) AS chrom, min(start) AS start, max("end") AS "end", min(sample) AS sample, id FROM scattered GROUP BY id HAVING count(*) = 2 AND count(DISTINCT chrom) = 1""",
    "liftover_points": "SELECT * FROM lifted_ends",
    "gene_flank_bounds": "SELECT input_ord, chr, prev_end, next_start, low, high FROM bounded",
    "tumbling_bins": """SELECT input_ord, bin, start + bin * 1000 AS left_start, "end" - (bin + 1) * 1000 AS right_start FROM (SELECT *, unnest(range(("end" - start) // 1000)) AS bin FROM stranded)""",
    "metaplot_slots": "SELECT * FROM slots",
    "midpoint_range_join": _value("slots", False),
    "uniform_overlap_join": f"SELECT * REPLACE (round(value, 6) AS value) FROM ({_value('slots', True)})",
    "metaplot_profile": _PROFILE.format(total=_P.total, sums="sums"),
    "metaplot_profile_uniform": _PROFILE.format(total=_P.total, sums="sums_uniform"),
    "metaplot_ticks": """SELECT slot, label, mean, n FROM (VALUES (0, '-1 kb'), (2, '-0.75 kb'), (5, '-0.5 kb'), (7, '-0.25 kb'), (10, 'TSS'), (65, 'TTS'), (67, '+0.25 kb'), (70, '+0.5 kb'), (72, '+0.75 kb'), (74, '+1 kb')) t(slot, label) JOIN (""" + _PROFILE.format(total=_P.total, sums="sums") + ") USING (slot)",
    "normalize_chrom": "SELECT id, CASE WHEN lower(trim(name)) LIKE 'chr%' THEN 'chr' || substr(trim(name), 4) ELSE trim(name) END AS chrom FROM names",
    "normalize_chrom_sim": "SELECT id, CASE WHEN name LIKE 'Chr%' THEN 'chr' || substr(name, 4) WHEN regexp_full_match(name, '[0-9]+') THEN 'chr' || name ELSE name END AS chrom FROM names",
    "renamed_chroms": "SELECT DISTINCT trim(name) AS name, 'chr' || substr(trim(name), 4) AS chrom FROM names WHERE lower(trim(name)) LIKE 'chr%' AND trim(name) NOT LIKE 'chr%'",
    "kb_labels": """SELECT DISTINCT x, CASE WHEN x = floor(x) THEN floor(x)::BIGINT::VARCHAR ELSE format('{:g}', x) END || ' kb' AS label FROM (
      SELECT unnest([p_size / 4.0::DOUBLE, k * k * k / 7, k / 3, k / 70000, k * 1000]) AS x FROM (SELECT p_size, p_partkey::DOUBLE AS k FROM part))""",
    "chrom_lengths": "SELECT * FROM lengths",
    "interval_ids": """SELECT chromosome::VARCHAR AS chrom, left_coordinate AS start, right_coordinate AS "end", sample_id AS sample, format('EUROv2_{:06d}', row_number() OVER (ORDER BY map, sample_id, chromosome, event_bp)) AS id FROM co_events""",
    "cm_corrections": """SELECT chrom, bp, marker, cm FROM map_markers WHERE bp % 7000 >= 3000 UNION ALL SELECT a.chrom, a.bp, a.marker, z.cm FROM in_blocks a JOIN in_blocks z ON z.chrom = a.chrom AND z.block = a.block AND z.v = a.u""",
    "map_anchors": "SELECT * FROM knots",
    "pchip_eval": "SELECT chrom, bp, round(cm, 9) + 0.0::DOUBLE AS cm FROM at_points SEMI JOIN (SELECT chrom, start AS bp FROM map_intervals) USING (chrom, bp)",
    "annotated_intervals": 'SELECT chrom, start, "end", sample, marker, round(start_cM, 6) + 0.0::DOUBLE AS start_cM, round(end_cM, 6) + 0.0::DOUBLE AS end_cM, round(cM_per_Mb, 6) + 0.0::DOUBLE AS cM_per_Mb FROM annotated',
    "weighted_mean_rate": 'SELECT round(sum(end_cM - start_cM) / (sum("end" - start) / 1e6::DOUBLE), 6) AS cM_per_Mb FROM annotated',
    "length_distribution": "SELECT * FROM length_shares",
    "read_bed_lengths": "SELECT * FROM length_shares",
    "read_gff_genes": 'SELECT chr, start, "end", strand FROM stranded',
    "read_gff_spans": """SELECT chr AS chrom, start, "end", strand FROM genes WHERE chr <> 'chr3'""",
    "read_bed_signal": """SELECT chr, start, "end", CASE WHEN id % 5 < 2 THEN 1.0::DOUBLE ELSE value END AS value FROM signal WHERE id % 11 <> 0""",
    "read_sequence_index": "SELECT * FROM lengths",
    "read_event_table": "SELECT * FROM co_events",
    "read_marker_table": "SELECT * FROM dedup",
    "read_workbook": "SELECT map, chromosome::VARCHAR AS chromosome, coordinate::VARCHAR AS coordinate, snp_name, genotypes FROM markers",
    "read_genetic_map": "SELECT replace(chrom, 'Brand#', 'chr') AS chrom, bp AS start, bp + 1 AS \"end\", cm, marker FROM map_markers",
    "read_segment_tables": """SELECT chrom, start, "end", sample, format('RMv2_{:06d}', row_number() OVER (ORDER BY n, chrom, start, "end")) AS id FROM (
      SELECT replace(chr, 'chr', '') AS chrom, start, "end", 's' || (id % 50) AS sample, id AS n FROM signal WHERE id % 7 <> 0)""",
    "read_crossover_tables": """SELECT chrom, start, "end", sample, format('Pennyv2_{:06d}', row_number() OVER (ORDER BY n, chrom, start, "end")) AS id FROM (
      SELECT chr AS chrom, start, "end", 'p' || (id % 40) AS sample, id AS n FROM signal WHERE id % 9 <> 0)""",
    "read_chain_blocks": """SELECT chr AS chrom, start + k * 107 AS w_start, start + k * 107 + 100 + k * 50 AS w_end, 't' AS t_chrom,
      CASE WHEN input_ord % 2 = 0 THEN start + k * 111 ELSE 800000000 - (start + k * 111) - (100 + k * 50) END AS t_start, CASE WHEN input_ord % 2 = 0 THEN '+' ELSE '-' END AS t_strand FROM genes, range(2) r(k)""",
    "read_centromere_table": """SELECT 'L' AS line, chrom, length // 3 AS start, length // 3 + 1000 AS "end", length % 2 = 0 AS assembled FROM lengths""",
    "written_matrices": """SELECT map, value, row_number() OVER (PARTITION BY map ORDER BY chromosome NULLS FIRST, coordinate, snp_name) - 1 AS line FROM (
      SELECT map, concat_ws(chr(9), chromosome, coordinate, snp_name, array_to_string(string_split(genotypes, ''), chr(9))) AS value, chromosome, coordinate, snp_name FROM clean
      UNION ALL SELECT map, concat_ws(chr(9), 'chromosome', 'coordinate', 'snp_name', array_to_string(list_transform(range(n), lambda j: map || format('_ind{:03d}', j + 1)), chr(9))), NULL, NULL, NULL FROM (SELECT map, max(length(genotypes)) AS n FROM clean GROUP BY map))""",
    "lifted_intervals": """SELECT min(chrom) AS chrom, min(start) AS start, max("end") AS "end", id::VARCHAR AS sample, id FROM lifted_ends GROUP BY id HAVING count(*) = 2 AND count(DISTINCT chrom) = 1""",
    "sim_lengths": "SELECT * FROM drawn",
    "sim_uniform": "SELECT * FROM uniform_regions",
    "point_sample_lookup": " UNION ALL ".join(f"SELECT idx, chrom, point, '{c}' AS class FROM {c}_points" for c in _CLASSES),
    "sim_enriched": " UNION ALL ".join(f"SELECT *, '{c}' AS class FROM {c}_regions" for c in _CLASSES),
    "sim_regions": " UNION ALL ".join(f"""SELECT '{c}' AS "set", chrom, start, "end", format('{c}_{{:06d}}', idx) AS ident FROM {c}_regions""" for c in ("uniform", *_CLASSES)),
}

_same = ", ".join(f'"{c}"' for c in ("chrom", "start", "end", "sample", "id"))
FINAL["united_intervals"] = " UNION ALL ".join(f"SELECT {_same} FROM ({FINAL[n]})" for n in ("read_segment_tables", "read_crossover_tables", "interval_ids"))
FINAL["written_bed"] = """SELECT concat_ws(chr(9), chr, start, "end", id) AS value, row_number() OVER (ORDER BY chr, start, "end", id::VARCHAR) - 1 AS line FROM signal"""
FINAL["written_qc"] = FINAL["qc_summary"]


def _needed(body: str, seen: list[str]) -> None:
    """Names of the expressions that a body reads, each after those it reads itself."""
    for name in CTES:
        if name not in seen and re.search(rf"\b(FROM|JOIN)\s+{name}\b|,\s*{name}\s+[a-z]\b|\bFROM \w+ [a-z], {name}\b", body) and CTES[name] is not body:
            _needed(CTES[name], seen)
            if name not in seen:
                seen.append(name)


def oracle_sql() -> dict[str, str]:
    out = {}
    for key in _found:
        seen: list[str] = []
        _needed(FINAL[key], seen)
        ctes = ",\n".join(f"{name} AS ({CTES[name]})" for name in seen)
        out[key] = f"WITH RECURSIVE {ctes}\n{FINAL[key]}" if seen else FINAL[key]
    return out
