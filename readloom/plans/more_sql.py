"""SQL that DuckDB runs on the same tables for the queries of ``more``, written from what the operators promise."""

from readloom.plans.reference_sql import _COUNTS, _DIPLOID, _GENO, _MATRIX, _METH, _OBS, _PAIRS, _READS, _REGIONS, _SEQ, _STAT3, _day, _runs

_FILES = """files AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS source FROM lineitem)"""
_DEPTHS = f"""{_READS}, places AS (SELECT target, unnest(range(s, e)) AS p FROM reads), depth AS (SELECT target, p, count(*) AS d FROM places GROUP BY ALL),
    {_REGIONS}, inside AS (SELECT DISTINCT target, unnest(range(g, h)) AS p FROM regions)"""
_CAPTURED = f"""{_DEPTHS}, spans AS (SELECT target, min(lo) AS lo, max(hi) AS hi FROM (SELECT target, min(s) AS lo, max(e) AS hi FROM reads GROUP BY target UNION ALL SELECT target, min(g), max(h) FROM regions GROUP BY target) GROUP BY target),
    every AS (SELECT target, unnest(range(lo, hi)) AS p FROM spans),
    told AS (SELECT coalesce(d, 0) AS depth, inside.p IS NOT NULL AS i FROM every LEFT JOIN depth USING (target, p) LEFT JOIN inside USING (target, p)),
    tally AS (SELECT depth, count(*) FILTER (i) AS sites_in, count(*) FILTER (NOT i) AS sites_out, depth * count(*) FILTER (i) AS bases_in, depth * count(*) FILTER (NOT i) AS bases_out FROM told GROUP BY depth),
    upto AS (SELECT *, CAST(sum(sites_in) OVER w AS BIGINT) AS sites_in_upto, CAST(sum(sites_out) OVER w AS BIGINT) AS sites_out_upto,
        CAST(sum(bases_in) OVER w AS BIGINT) AS bases_in_upto, CAST(sum(bases_out) OVER w AS BIGINT) AS bases_out_upto FROM tally WINDOW w AS (ORDER BY depth DESC))"""


def _at(share: float, upto: str, sites: str, name: str) -> str:
    return f"least(coalesce(max(CASE WHEN {upto} > {sites} * {share} THEN depth END) + 1, 0), max(depth)) AS {name}"


_PERCENTILES = ", ".join(
    [_at(p, "sites_in_upto + sites_out_upto", "covered", f"depth_{round(p * 100)}") for p in (0.9, 0.75, 0.5)]
    + [_at(p, "sites_in_upto", "captured", f"captured_{round(p * 100)}") for p in (0.9, 0.75, 0.5)]
)
_SUMS = {c: f"sum({c}) FILTER (depth >= 1)" for c in ("bases_in", "bases_out", "sites_in", "sites_out")}
_FLAT = """{name} AS (SELECT DISTINCT target, unnest(range(s, e)) AS p FROM reads WHERE l_returnflag = '{flag}')"""
_SIDES = f"{_COUNTS}, sides AS (SELECT target, position, sample, CASE WHEN sample < 2 THEN 'A' ELSE 'B' END AS grp, sum(CASE WHEN is_ref THEN n ELSE 0 END) AS r, sum(CASE WHEN is_ref THEN 0 ELSE n END) AS v FROM counts GROUP BY ALL)"
_GROUPED = f"{_OBS}, o AS (SELECT *, CASE WHEN sample < 2 THEN 'A' ELSE 'B' END AS grp FROM obs)"
_NAMES = {"ASIA": [f"NATION_{i}" for i in range(2, 25, 5)], "EUROPE": [f"NATION_{i}" for i in range(3, 25, 5)]}
_SAMPLES = ", ".join(f"('{s}', '{g}')" for g, members in _NAMES.items() for s in members)
_CLEAN = r"""clean AS (SELECT read_index || '/' || strftime(loaded_at, '%Y%m%d%H%M%S') AS id, sample, regexp_replace(upper(trim(sequence, chr(32) || chr(9) || chr(13) || chr(10))), '[^ACGTN]', '', 'g') AS sequence,
    list_filter(quality_scores, lambda q: q BETWEEN 0 AND 60) AS scores FROM read_entries WHERE sequence IS NOT NULL)"""


def _position_of(table: str, where: str) -> str:
    return f"SELECT target, position FROM {table} WHERE {where}"


ORACLES = {
    "concatenated_queries": f"""WITH {_FILES}, n AS (SELECT source, max(l_orderkey) + 1 AS n FROM files GROUP BY source), s AS (SELECT source, coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM n)
        SELECT CAST(l_orderkey + shift AS BIGINT) AS query, l_linenumber, l_suppkey, CAST(source AS INTEGER) AS source FROM files JOIN s USING (source)""",
    "sorted_concatenation": f"WITH {_FILES} SELECT l_suppkey, {_day('l_shipdate')} AS day, l_orderkey, l_linenumber, source FROM files",
    "top_hits": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100",
    "top_hits_by_target": """SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3""",
    "capped_sites": f"SELECT l_suppkey AS target, {_day('l_shipdate')} AS start, least(count(*), 2) AS n FROM lineitem GROUP BY 1, 2",
    "merged_targets": """WITH t AS (SELECT n_name AS name, 10 AS length FROM nation UNION ALL SELECT r_name, 20 FROM region UNION ALL SELECT n_name, 10 + n_nationkey % 2 FROM nation)
        SELECT row_number() OVER (ORDER BY name) - 1 AS target_index, name, max(length) AS length, min(length) = max(length) AS lengths_agree FROM t GROUP BY name""",
    "position_slices": f"""WITH x AS (SELECT l_suppkey AS target, {_day('l_shipdate')} // 30 AS bin, count(*) AS m FROM lineitem GROUP BY 1, 2),
        c AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY target ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 200 AS slice FROM x)
        SELECT target, slice, min(bin) * 30 AS start, (max(bin) + 1) * 30 AS "end", CAST(sum(m) AS BIGINT) AS n FROM c GROUP BY target, slice""",
    "named_slice": f"""SELECT o_orderkey, o_orderstatus, {_day('o_orderdate')} AS day FROM orders
        WHERE o_orderstatus = 'O' AND {_day('o_orderdate')} >= 9000 OR o_orderstatus = 'P' AND {_day('o_orderdate')} <= 9500""",
    "alignment_header": """SELECT count(*) AS n_entries, count(DISTINCT l_orderkey) AS n_queries, count(DISTINCT l_suppkey) AS n_targets, min(l_orderkey) AS least_query, max(l_orderkey) AS greatest_query,
        min(l_quantity) AS shortest, max(l_quantity) AS longest FROM lineitem""",
    "compared_records": """WITH x AS (SELECT l_orderkey, l_linenumber, max({'a': l_suppkey, 'b': l_returnflag, 'c': l_linestatus}) AS r FROM lineitem WHERE l_linenumber <= 2 GROUP BY ALL),
        m AS (SELECT a.r AS a, b.r AS b FROM (SELECT * FROM x WHERE l_linenumber = 1) a FULL JOIN (SELECT * FROM x WHERE l_linenumber = 2) b USING (l_orderkey)),
        c AS (SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS met, count(*) FILTER (b IS NULL) AS f, count(*) FILTER (a IS NULL) AS s, count(*) FILTER (a.a <> b.a) AS x, count(*) FILTER (a.b <> b.b) AS y, count(*) FILTER (a.c <> b.c) AS z FROM m)
        SELECT unnest(['l_suppkey', 'l_returnflag', 'l_linestatus', '(only in first)', '(only in second)']) AS field, unnest([met, met, met, f, s]) AS n_compared, unnest([x, y, z, f, s]) AS n_different FROM c""",
    "compared_positions": f"""WITH {_READS}, a AS (SELECT target, s, e, l_returnflag AS f, count(*) AS n FROM reads WHERE l_linenumber <= 2 GROUP BY ALL), b AS (SELECT target, s, e, l_returnflag AS f, count(*) AS n FROM reads WHERE l_linenumber >= 2 GROUP BY ALL),
        m AS (SELECT target, s, coalesce(a.n, 0) AS x, coalesce(b.n, 0) AS y FROM a FULL JOIN b USING (target, s, e, f))
        SELECT target, s AS start, CAST(sum(x) AS BIGINT) AS n_first, CAST(sum(y) AS BIGINT) AS n_second, CAST(sum(least(x, y)) AS BIGINT) AS n_common FROM m GROUP BY 1, 2 HAVING sum(x) <> sum(least(x, y)) OR sum(y) <> sum(least(x, y))""",
    "read_index_variations": """WITH e AS (SELECT l_returnflag AS sample, CAST(l_quantity AS INTEGER) AS k, l_linenumber AS i, l_tax > 0.04 AS v FROM lineitem WHERE l_quantity >= 8),
        p AS (SELECT sample, unnest(range(1, k + 1)) AS read_index FROM e), n AS (SELECT sample, read_index, count(*) AS n FROM p GROUP BY ALL), v AS (SELECT sample, i AS read_index, count(*) AS m FROM e WHERE v GROUP BY ALL)
        SELECT sample, CAST(read_index AS INTEGER) AS read_index, coalesce(m, 0) AS n_variant, n - coalesce(m, 0) AS n_reference FROM n LEFT JOIN v USING (sample, read_index)""",
    "base_table": r"""WITH s AS (SELECT upper(trim(sequence, chr(32) || chr(9) || chr(13) || chr(10))) AS t FROM read_entries), c AS (SELECT unnest(range(0, length(t))) AS place, t FROM s), l AS (SELECT place, t[place + 1] AS b FROM c)
        SELECT CAST(place AS INTEGER) AS place, count(*) FILTER (b = 'A') AS a, count(*) FILTER (b = 'C') AS c, count(*) FILTER (b = 'G') AS g, count(*) FILTER (b = 'T') AS t, count(*) FILTER (b NOT IN ('A', 'C', 'G', 'T')) AS other FROM l GROUP BY place""",
    "splice_counts": f"WITH {_READS} SELECT target, e + 1 AS first_base, e + 5 AS last_base, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE '+' END AS strand, count(*) AS n FROM reads GROUP BY ALL",
    "depth_at_places": f"""WITH {_DEPTHS}, q AS (SELECT o_custkey % 10 + 1 AS target, {_day('o_orderdate')} AS position, o_orderkey FROM orders)
        SELECT q.target, position, o_orderkey, coalesce(d, 0) AS depth FROM q LEFT JOIN depth ON depth.target = q.target AND depth.p = position""",
    "range_of_reads": f"""WITH {_READS}, x AS (SELECT * FROM reads WHERE l_returnflag = 'R' AND l_linenumber = 1), o AS (SELECT *, max(e) OVER (PARTITION BY target ORDER BY s, e, l_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM x),
        i AS (SELECT *, sum(CASE WHEN u IS NULL OR s > u THEN 1 ELSE 0 END) OVER (PARTITION BY target ORDER BY s, e, l_orderkey ROWS UNBOUNDED PRECEDING) AS k FROM o), w AS (SELECT target, min(s) AS rs, max(e) AS re FROM i GROUP BY target, k)
        SELECT r.target, r.s AS start, r.e AS "end", l_orderkey, l_linenumber, CASE WHEN rs IS NOT NULL THEN r.target || '-' || rs END AS range_id FROM reads r LEFT JOIN w ON w.target = r.target AND rs <= s AND re >= e WHERE l_returnflag = 'A'""",
    "read_chunks": """WITH d AS (SELECT read_index, (row_number() OVER (ORDER BY read_index) - 1) // 1000 AS file FROM (SELECT DISTINCT read_index FROM read_entries WHERE read_index IS NOT NULL))
        SELECT file, count(*) AS n, min(read_index) AS first, max(read_index) AS last FROM d GROUP BY file""",
    "merged_runs": f"""WITH {_READS}, ev AS (SELECT target, p, sum(a) AS a, sum(r) AS r FROM (SELECT target, s AS p, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS a, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS r FROM reads
            UNION ALL SELECT target, e, CASE WHEN l_returnflag = 'A' THEN -1 ELSE 0 END, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 0 END FROM reads) GROUP BY target, p HAVING sum(a) <> 0 OR sum(r) <> 0)
        SELECT target, p AS position, length, CAST(d0 AS BIGINT) AS depth_0, CAST(d1 AS BIGINT) AS depth_1 FROM (SELECT target, p, lead(p) OVER w - p AS length, sum(a) OVER w AS d0, sum(r) OVER w AS d1 FROM ev WINDOW w AS (PARTITION BY target ORDER BY p)) WHERE length IS NOT NULL""",
    "captured_depths": f"WITH {_CAPTURED} SELECT * FROM upto",
    "capture_statistics": f"""WITH {_CAPTURED}, t AS (SELECT *, sum(CASE WHEN depth >= 1 THEN sites_in ELSE 0 END) OVER () AS captured, sum(CASE WHEN depth >= 1 THEN sites_in + sites_out ELSE 0 END) OVER () AS covered FROM upto)
        SELECT round({_SUMS['bases_in']} / ({_SUMS['bases_in']} + {_SUMS['bases_out']}), 8) AS enrichment_efficiency, round(({_SUMS['bases_in']} + {_SUMS['bases_out']}) / ({_SUMS['sites_in']} + {_SUMS['sites_out']}), 8) AS mean_depth,
            round({_SUMS['bases_in']} / {_SUMS['sites_in']}, 8) AS mean_depth_captured, round({_SUMS['bases_out']} / {_SUMS['sites_out']}, 8) AS mean_depth_outside, {_PERCENTILES} FROM t""",
    "adaptive_bins": f"""WITH {_runs()}, m AS (SELECT *, CASE WHEN lag(depth) OVER w IS NULL OR (lag(depth) OVER w = 0) <> (depth = 0) THEN 1 ELSE 0 END AS b FROM runs WINDOW w AS (PARTITION BY target ORDER BY position)),
        i AS (SELECT *, sum(b) OVER (PARTITION BY target ORDER BY position) AS island FROM m)
        SELECT target, min(position) AS start, CAST(sum(length) AS BIGINT) AS length, round(sum(depth * length) / sum(length), 6) AS average, CAST(max(depth) AS BIGINT) AS greatest FROM i GROUP BY target, island""",
    "differential_expression": f"""WITH {_MATRIX.replace('p_brand AS element', 'l_partkey AS element')}, s(sample, grp) AS (VALUES {_SAMPLES}), mine AS (SELECT element, m.sample, s.grp, c FROM matrix m JOIN s ON s.sample = m.sample),
        tot AS (SELECT sample, sum(c)::DOUBLE AS total FROM mine GROUP BY sample),
        v AS (SELECT e.element, s.sample, s.grp, coalesce(m.c, 0) AS c, (coalesce(m.c, 0) + 1.0::DOUBLE) / (greatest(coalesce(t.total, 1.0), 1.0) / 1e6) AS x
            FROM (SELECT DISTINCT element FROM mine) e CROSS JOIN s LEFT JOIN tot t ON t.sample = s.sample LEFT JOIN mine m ON m.element = e.element AND m.sample = s.sample),
        g AS (SELECT element, avg(x) FILTER (grp = 'ASIA') AS a, avg(x) FILTER (grp = 'EUROPE') AS b, avg(c) FILTER (grp = 'ASIA') AS ca, avg(c) FILTER (grp = 'EUROPE') AS cb, """
    + ", ".join(f"CAST(sum(c) FILTER (sample = '{s}') AS BIGINT) AS \"count sample {s} [{g}]\"" for g, members in _NAMES.items() for s in members)
    + """ FROM v GROUP BY element)
        SELECT * EXCLUDE (a, b, ca, cb), round(a, 5) AS "average RPKM group ASIA(AC)", round(log2(a), 5) AS "average log2_RPKM group ASIA(AC)", round(ca, 5) AS "average count group ASIA",
            round(b, 5) AS "average RPKM group EUROPE(AC)", round(log2(b), 5) AS "average log2_RPKM group EUROPE(AC)", round(cb, 5) AS "average count group EUROPE", round(a / b, 5) AS "fold-change ASIA/EUROPE(AC)",
            round(greatest((a + 1e-6) / (b + 1e-6), (b + 1e-6) / (a + 1e-6)), 5) AS "fold-change-magnitude ASIA/EUROPE(AC)", round((ln(1 + a) - ln(1 + b)) / ln(2), 5) AS "log2-fold-change ASIA/EUROPE(AC)" FROM g""",
    "allele_frequencies": f"""WITH {_SIDES}, q AS (SELECT *, r / (r + v) AS x FROM sides WHERE r + v > 0)
        SELECT target, position, CAST(sum(r + v) AS BIGINT) AS depth, round(avg(x) FILTER (grp = 'A'), 8) AS share_a, round(avg(x) FILTER (grp = 'B'), 8) AS share_b, round(abs(avg(x) FILTER (grp = 'A') - avg(x) FILTER (grp = 'B')), 8) AS effect
        FROM q GROUP BY target, position HAVING count(*) = 4 AND bool_or(r > 0 AND v > 0)""",
    "between_groups": f"""WITH {_GROUPED}, c AS (SELECT target, position, grp, allele, count(*) AS n FROM o GROUP BY ALL),
        t AS (SELECT target, position, grp, string_agg(n || ':view/' || allele, ',' ORDER BY n DESC, allele) AS variations FROM c WHERE allele <> 'view' GROUP BY ALL),
        g AS (SELECT target, position, grp, count(*) FILTER (allele = 'view') AS r, count(*) FILTER (allele <> 'view') AS v, count(DISTINCT read_index) FILTER (allele <> 'view') AS k, sum(quality) FILTER (allele <> 'view') AS q FROM o GROUP BY ALL),
        w AS (SELECT s.target, s.position, coalesce(a.r, 0) AS ra, coalesce(a.v, 0) AS va, coalesce(b.r, 0) AS rb, coalesce(b.v, 0) AS vb, coalesce(a.k, 0) AS ka, coalesce(b.k, 0) AS kb, coalesce(a.q, 0) AS qa, coalesce(b.q, 0) AS qb
            FROM (SELECT DISTINCT target, position FROM o) s LEFT JOIN g a ON a.target = s.target AND a.position = s.position AND a.grp = 'A' LEFT JOIN g b ON b.target = s.target AND b.position = s.position AND b.grp = 'B'),
        l AS (SELECT *, CASE WHEN ra * vb <> 0 AND rb * va <> 0 THEN log2((rb * va)::DOUBLE / (ra * vb)) END AS odds, CASE WHEN least(ra, va, rb, vb) >= 10 THEN sqrt(1.0 / ra + 1.0 / va + 1.0 / rb + 1.0 / vb) END AS error FROM w)
        SELECT l.target, l.position, round(odds, 7) AS log2_odds, round(error, 7) AS error, round(odds / error, 7) AS z, round(ra / nullif(ra + va, 0), 7) AS ref_share_a, ra AS ref_a, va AS var_a, ka AS indices_a, round(qa / nullif(va, 0), 7) AS mean_quality_a, coalesce(x.variations, '') AS variations_a,
            round(rb / nullif(rb + vb, 0), 7) AS ref_share_b, rb AS ref_b, vb AS var_b, kb AS indices_b, round(qb / nullif(vb, 0), 7) AS mean_quality_b, coalesce(y.variations, '') AS variations_b
        FROM l LEFT JOIN t x ON x.target = l.target AND x.position = l.position AND x.grp = 'A' LEFT JOIN t y ON y.target = l.target AND y.position = l.position AND y.grp = 'B'""",
    "within_group_discovery": f"""WITH {_GROUPED}, b AS (SELECT sample, read_index, count(*) FILTER (allele <> 'view') AS v, count(*) AS n FROM obs GROUP BY ALL)
        SELECT target, position, grp, count(*) FILTER (allele <> 'view') AS n_variant, count(*) FILTER (allele = 'view') AS n_reference, round(sum(b.v) / sum(b.n), 8) AS rate
        FROM o JOIN b ON b.sample = o.sample AND b.read_index = o.read_index GROUP BY target, position, grp""",
    "somatic_sites": f"""WITH {_COUNTS}, k(sample, control, kind) AS (VALUES (0, 1, 'germline'), (0, 2, 'parent'), (3, 1, 'germline')), f AS (SELECT *, sum(n) OVER (PARTITION BY target, position, sample) AS depth FROM counts),
        d AS (SELECT DISTINCT target, position, sample, depth FROM f),
        m AS (SELECT f.target, f.position, f.sample, f.allele, f.n, f.depth, kind, coalesce(c.n, 0) AS cn, coalesce(d.depth, 0) AS cd FROM f JOIN k USING (sample) LEFT JOIN d ON d.target = f.target AND d.position = f.position AND d.sample = control
            LEFT JOIN f c ON c.target = f.target AND c.position = f.position AND c.sample = control AND c.allele = f.allele),
        g AS (SELECT target, position, sample, allele, n, depth, bool_or(kind = 'parent' AND cn > 0) AS p, bool_or(kind = 'germline' AND cn >= 10) AS q, max(CASE WHEN cd > 0 THEN cn / cd ELSE 0 END) AS most, min(cd) AS covered,
            coalesce(min(CASE WHEN kind = 'parent' THEN n - cn END), 0) + coalesce(min(CASE WHEN kind = 'germline' THEN n - cn END), 0) AS priority, bool_and(CASE WHEN kind = 'parent' THEN cn <= 5 ELSE cn <= 10 END) AS strict FROM m GROUP BY ALL)
        SELECT target, position, sample, allele, n, round(100.0::DOUBLE * n / depth, 6) AS frequency, round(priority, 4)::DOUBLE AS priority, CASE WHEN strict THEN 'PASS' ELSE 'STRICT_SOMATIC' END AS filter FROM g
        WHERE NOT p AND NOT q AND covered >= depth // 2 AND n / depth > 3 * most""",
    "variation_lines": f"""WITH {_OBS} SELECT target, position, 'view' AS "from", allele AS "to", count(*) AS n, count(DISTINCT read_index) AS n_indices FROM obs WHERE allele <> 'view' GROUP BY ALL HAVING count(DISTINCT read_index) >= 3""",
    "annotation_penalty": f"""WITH {_READS}, {_FLAT.format(name='a', flag='A')}, {_FLAT.format(name='b', flag='R')}, k AS (SELECT target FROM a INTERSECT SELECT target FROM b)
        SELECT sum(CASE WHEN a.p IS NOT NULL AND b.p IS NOT NULL THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END) AS score FROM a FULL JOIN b USING (target, p) WHERE target IN (SELECT target FROM k)""",
    "close_peaks": f"""WITH {_runs()}, m AS (SELECT *, CASE WHEN lag(depth) OVER w > 8 THEN 0 ELSE 1 END AS b FROM runs WINDOW w AS (PARTITION BY target ORDER BY position)),
        i AS (SELECT *, sum(b) OVER (PARTITION BY target ORDER BY position) AS island FROM m WHERE depth > 8), p AS (SELECT target, min(position) AS s, min(position) + sum(length) AS e, sum(depth)::DOUBLE AS v FROM i GROUP BY target, island),
        x AS (SELECT *, CASE WHEN abs(v - lag(v) OVER (PARTITION BY target ORDER BY s)) <= 20 THEN 0 ELSE 1 END AS far FROM p), y AS (SELECT *, sum(far) OVER (PARTITION BY target ORDER BY s) AS k FROM x)
        SELECT target, min(s) AS start, CAST(max(e) AS BIGINT) AS "end", round(sum(v * (e - s)) / sum(e - s), 6) AS value, count(*) AS n FROM y GROUP BY target, k""",
    "pair_statistic_stat4": f"""WITH {_COUNTS}, {_METH}, {_PAIRS}, t AS (SELECT *, ma + ca + mb + cb AS total, {_STAT3} AS s FROM pairs)
        SELECT target, position, round(least(s / CASE WHEN total < 100 THEN 50 WHEN total < 1000 THEN 550 ELSE floor(total / 1000) * 1000 + 500 END, 20.0), 8) AS stat4 FROM t""",
    "empirical_fdr": f"""WITH {_COUNTS}, {_METH}, {_PAIRS}, r AS (SELECT target, position, target % 2 AS k, round({_STAT3} * 500) AS s FROM pairs), u AS (SELECT * FROM r WHERE position < 5), t AS (SELECT * FROM r WHERE position >= 5)
        SELECT t.target, t.position, round(1 - ((SELECT count(*) FROM t y WHERE y.k = t.k AND y.s >= t.s) + 1.0::DOUBLE) / ((SELECT count(*) FROM u WHERE u.k = t.k AND u.s >= t.s) + (SELECT count(*) FROM t y WHERE y.k = t.k AND y.s >= t.s) + 1), 8) AS empirical_fdr FROM t""",
    "density_p": f"""WITH {_COUNTS}, {_METH}, {_PAIRS}, r AS (SELECT target, position, CASE WHEN ma + ca + mb + cb < 10 THEN 0 ELSE 1 END AS k, round(least({_STAT3} / CASE WHEN ma + ca + mb + cb < 100 THEN 50 WHEN ma + ca + mb + cb < 1000 THEN 550 ELSE floor((ma + ca + mb + cb) / 1000) * 1000 + 500 END, 20.0) * 500) AS s FROM pairs),
        u AS (SELECT * FROM r WHERE position < 5), t AS (SELECT * FROM r WHERE position >= 5)
        SELECT t.target, t.position, round((1.0 + (SELECT count(*) FROM u WHERE u.k = t.k) - (SELECT count(*) FROM u WHERE u.k = t.k AND u.s < t.s)) / ((SELECT count(*) FROM u WHERE u.k = t.k) + 1), 8) AS density_p FROM t""",
    "group_rates": f"""WITH {_COUNTS}, {_METH} SELECT target, position, CASE WHEN sample < 2 THEN 'A' ELSE 'B' END AS grp, CAST(sum(c) AS BIGINT) AS c, CAST(sum(cm) AS BIGINT) AS cm,
        round(CASE WHEN sum(c) + sum(cm) > 0 THEN 100.0::DOUBLE * sum(cm) / (sum(c) + sum(cm)) ELSE 'NaN'::DOUBLE END, 6) AS rate FROM meth GROUP BY 1, 2, 3""",
    "depth_histogram": f"""WITH {_COUNTS}, {_METH} SELECT sample, CASE WHEN c + cm >= 1000 THEN 1000 WHEN c + cm >= 100 THEN 100 WHEN c + cm >= 50 THEN 50 WHEN c + cm >= 20 THEN 20 WHEN c + cm >= 10 THEN 10 WHEN c + cm >= 5 THEN 5 WHEN c + cm >= 1 THEN 1 ELSE 0 END AS least_depth,
        count(*) AS n FROM meth GROUP BY 1, 2""",
    "fastq_round_trip": f"""WITH {_CLEAN} SELECT concat_ws(' ', id, sample) AS header, sequence, CASE WHEN sequence = '' THEN 0 ELSE 33 + coalesce(scores[1], 40) END AS first_code FROM clean""",
    "fasta_round_trip": f"WITH {_CLEAN} SELECT replace(concat_ws(' ', id, sample), ' ', '_') AS header, sequence FROM clean WHERE sequence <> ''",
    "sam_round_trip": f"""WITH x AS (SELECT l_orderkey || '.' || l_linenumber AS name, 't' || l_suppkey AS target, {_day('l_shipdate')} AS p, CAST(l_quantity AS INTEGER) AS n, l_linenumber * 10 AS gap, l_linenumber % 2 = 0 AS reverse FROM lineitem WHERE l_quantity >= 3)
        SELECT name, target, 0 AS fragment_index, p AS position, n - 1 AS target_length, p + n - 1 + gap AS next_position, reverse FROM x UNION ALL SELECT name, target, 1, p + n - 1 + gap, 1, -1, reverse FROM x""",
    "vcf_round_trip": """SELECT chrom, pos, CAST(record_id AS VARCHAR) AS id, record_id AS rid, 'true' AS db, 2 AS n_alt, '0/1:3' AS first_sample FROM vcf_records WHERE pos IS NOT NULL AND chrom IS NOT NULL""",
    "archive_round_trip": f"WITH {_DEPTHS} SELECT target, CAST(sum(d) AS BIGINT) AS bases, count(*) AS sites FROM depth GROUP BY target",
    "coded_genotypes": """WITH p AS (SELECT ref_allele AS r, alt AS a, string_split_regex(concat_ws('/', ref_allele, alt), '[/|]') AS l FROM vcf_records WHERE ref_allele IS NOT NULL AND alt IS NOT NULL),
        c AS (SELECT list_transform(l, lambda x: CASE WHEN x = r THEN '0' WHEN x = a THEN '1' ELSE '.' END) AS c FROM p)
        SELECT CASE WHEN len(c) = 1 THEN c[1] || '/' || c[1] ELSE array_to_string(c, '/') END AS code, count(*) AS n FROM c GROUP BY 1""",
    "genotype_concordance": f"""WITH {_COUNTS}, {_DIPLOID}, {_GENO}, g AS (SELECT target, position, sample, string_split(replace(genotype, 'view', 'ref'), '/') AS l FROM geno),
        m AS (SELECT a.l AS x, b.l AS y, least(len(a.l), len(b.l)) AS k FROM g a JOIN g b USING (target, position) WHERE a.sample = 0 AND b.sample = 1),
        d AS (SELECT x, y, list_filter(range(1, k + 1), lambda i: x[i] <> y[i]) AS o FROM m), n AS (SELECT len(list_filter(o, lambda i: x[i] IN ('0', 'ref') OR y[i] IN ('0', 'ref'))) + abs(len(x) - len(y)) AS missed,
            len(list_filter(o, lambda i: NOT (x[i] IN ('0', 'ref') OR y[i] IN ('0', 'ref')))) AS other FROM d)
        SELECT CASE WHEN missed = 0 AND other = 0 THEN 'same' WHEN missed = 1 THEN 'missed_one' WHEN missed = 2 THEN 'missed_two' WHEN missed > 2 THEN 'missed_more' ELSE 'other' END AS kind, count(*) AS n FROM n GROUP BY 1""",
    "adapter_trim": f"""WITH {_SEQ}, x AS (SELECT t AS s, length(t) AS n, strpos(t, 'AGATCGGAAG') AS p,
            coalesce(list_max(list_filter([4, 5, 6, 7, 8, 9], lambda k: starts_with(t, right('AGATCGGAAG', k)))), 0) AS l, coalesce(list_max(list_filter([4, 5, 6, 7, 8, 9], lambda k: ends_with(t, left('AGATCGGAAG', k)))), 0) AS r FROM seqs WHERE t IS NOT NULL)
        SELECT s AS sequence, CASE WHEN p > 0 AND p - 1 >= n - p - 9 THEN substr(s, 1, p - 1) WHEN p > 0 THEN substr(s, p + 10, n - p - 9) ELSE substr(s, l + 1, greatest(n - l - r, 0)) END AS trimmed, count(*) AS n FROM x GROUP BY 1, 2""",
    "p1_attributes": r"""WITH w AS (SELECT chr(32) || chr(9) || chr(13) || chr(10) AS ws), k AS (SELECT lower(trim(attribute, ws)) AS k, trim(info_value, ws) AS t, info_value AS raw, ws FROM info_rows, w),
        v AS (SELECT trim(CASE WHEN starts_with(k, 'info/') THEN substr(k, 6) ELSE k END, ws) AS attribute_key, raw, t, coalesce(lower(t) IN ('', '.', '-', '?', 'na', 'n/a', 'null'), true) AS missing,
            coalesce(lower(t), '') IN ('', '1', 'true', 't', 'yes', 'y', '0', 'false', 'f', 'no', 'n') AS flag, coalesce(regexp_full_match(t, '[+-]?[0-9]+'), false) AS i,
            coalesce(regexp_full_match(t, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') OR regexp_full_match(lower(t), '[+-]?(nan|inf|infinity)'), false) AS f FROM k),
        c AS (SELECT attribute_key, count(*) AS n_rows, count(*) FILTER (missing) AS n_missing, count(*) FILTER (i AND NOT missing) AS n_integer, count(*) FILTER (f AND NOT missing) AS n_float,
            count(*) FILTER (flag) AS n_flag, count(*) FILTER (NOT missing AND contains(raw, ',')) AS n_list FROM v GROUP BY 1)
        SELECT *, CASE WHEN n_rows = n_missing THEN 'Flag' WHEN n_integer = n_rows - n_missing THEN 'Integer' WHEN n_float = n_rows - n_missing THEN 'Float' WHEN n_flag = n_rows THEN 'Flag' ELSE 'String' END AS inferred_type FROM c""",
}
