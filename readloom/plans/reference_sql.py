"""SQL that DuckDB runs on the same tables for the queries of the reference operators."""

_DAY = "date_diff('day', DATE '1970-01-01', CAST({} AS DATE))"


def _day(c: str) -> str:
    return _DAY.format(c)


_READS = f"""reads AS (SELECT l_suppkey AS target, {_day('l_shipdate')} AS s, {_day('l_shipdate')} + CAST(l_quantity AS BIGINT) AS e,
    l_returnflag, l_orderkey, l_linenumber, l_discount FROM lineitem WHERE CAST(l_quantity AS BIGINT) > 0)"""


def _runs(weight: str = "1") -> str:
    return f"""{_READS}, ev AS (
    SELECT target, p, sum(d) AS d FROM (SELECT target, s AS p, {weight} AS d FROM reads UNION ALL SELECT target, e, -({weight}) FROM reads)
    GROUP BY target, p HAVING sum(d) <> 0
), runs AS (SELECT * FROM (
    SELECT target, p AS position, lead(p) OVER (PARTITION BY target ORDER BY p) - p AS length,
        sum(d) OVER (PARTITION BY target ORDER BY p) AS depth FROM ev) WHERE length IS NOT NULL)"""


_REGIONS = "regions AS (SELECT DISTINCT target, s AS g, s + 30 AS h FROM reads WHERE l_returnflag = 'R')"
_SEQ = r"""seqs AS (SELECT *, upper(trim(sequence, chr(32) || chr(9) || chr(13) || chr(10))) AS t FROM read_entries)"""
_OBS = """obs AS (SELECT CAST(floor(user_id / 10) AS BIGINT) AS target, user_id % 10 AS position, event_id % 4 AS sample, event_type AS allele,
    event_id % 2 = 0 AS forward, event_id % 36 AS read_index, CAST(floor(value) AS BIGINT) % 42 AS quality FROM events)"""
_COUNTS = f"""{_OBS}, counts AS (SELECT target, position, sample, allele, count(*) AS n, count(*) FILTER (forward) AS n_forward,
    count(*) FILTER (NOT forward) AS n_reverse, allele = 'view' AS is_ref FROM obs GROUP BY target, position, sample, allele)"""
_SITE = "PARTITION BY target, position, sample"
_MATRIX = """matrix AS (SELECT p_brand AS element, n_name AS sample, r_name AS grp, sum(CAST(l_quantity AS BIGINT)) AS c
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)"""
_P = "pv AS (SELECT o_orderkey, o_custkey, o_orderstatus, ((o_orderkey * 7919) % 10007) / 10007.0::DOUBLE AS p FROM orders)"
_DIPLOID = f"""dip AS (SELECT target, position, sample, allele, n FROM (
    SELECT *, count(*) FILTER (d <= 2) OVER ({_SITE}) AS t FROM (SELECT *, dense_rank() OVER ({_SITE} ORDER BY n DESC) AS d FROM counts))
    WHERE d = 1 OR d = 2 AND t <= 2)"""
_GENO = """geno AS (SELECT target, position, sample, CASE WHEN count(*) = 1 THEN min(allele) || '/' || min(allele) ELSE string_agg(allele, '/' ORDER BY allele) END AS genotype,
    string_agg(allele || '=' || n, ',' ORDER BY allele) AS base_counts, CAST(sum(n) AS BIGINT) AS depth,
    CASE count(*) WHEN 1 THEN 'homozygous' WHEN 2 THEN 'heterozygous' ELSE 'Mixture' END AS zygosity FROM dip GROUP BY target, position, sample)"""
_METH = """meth AS (SELECT target, position, sample, CAST(sum(CASE WHEN allele = 'view' THEN n ELSE 0 END) AS BIGINT) AS c,
    CAST(sum(CASE WHEN allele <> 'view' THEN n ELSE 0 END) AS BIGINT) AS cm FROM counts GROUP BY target, position, sample)"""
_PAIRS = """pairs AS (SELECT target, position, a.cm::DOUBLE AS ma, a.c::DOUBLE AS ca, b.cm::DOUBLE AS mb, b.c::DOUBLE AS cb
    FROM meth a JOIN meth b USING (target, position) WHERE a.sample = 0 AND b.sample = 1)"""
_STAT3 = "CASE WHEN (ma - ca) * (mb - cb) > 0 THEN greatest(abs(ma - ca), abs(mb - cb)) ELSE abs(ma - ca) + abs(mb - cb) END"
_CELLS = """cells AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'R' AND l_discount > 0.05) AS a, count(*) FILTER (l_returnflag = 'R' AND l_discount <= 0.05) AS b,
    count(*) FILTER (l_returnflag <> 'R' AND l_discount > 0.05) AS c, count(*) FILTER (l_returnflag <> 'R' AND l_discount <= 0.05) AS d FROM lineitem GROUP BY l_suppkey)"""
_LOG_ODDS = "log2((a + 1.0) * (d + 1) / ((b + 1.0) * (c + 1)))"
_ERROR = "CASE WHEN least(a, b, c, d) >= 10 THEN sqrt(1.0 / a + 1.0 / b + 1.0 / c + 1.0 / d) END"


def _bh(rows: str, p: str) -> str:
    """Joint adjustment of a relation with column ``p``."""
    return f"""ranked AS (SELECT *, {p} * count(*) OVER () / count(*) OVER (ORDER BY {p}) AS raw FROM {rows}),
    adjusted AS (SELECT *, least(1.0, min(raw) OVER (ORDER BY {p} DESC)) AS q FROM ranked)"""


def _fold_change(matrix: str) -> str:
    """Means over all samples of a group: a sample in which nothing of an element was counted is one with a count of 0."""
    return f"""WITH {matrix}, tot AS (SELECT sample, grp, sum(c) AS total FROM matrix GROUP BY sample, grp),
        v AS (SELECT e.element, t.grp, (coalesce(m.c, 0) + 1.0::DOUBLE) / (t.total / 1e6) AS value
            FROM (SELECT DISTINCT element FROM matrix) e CROSS JOIN tot t LEFT JOIN matrix m ON m.element = e.element AND m.sample = t.sample),
        g AS (SELECT element, avg(value) FILTER (grp = 'ASIA') AS ma, avg(value) FILTER (grp = 'EUROPE') AS mb, count(*) FILTER (grp = 'ASIA') AS na, count(*) FILTER (grp = 'EUROPE') AS nb,
            avg(ln(1 + value)) FILTER (grp = 'ASIA') AS la, avg(ln(1 + value)) FILTER (grp = 'EUROPE') AS lb, var_samp(ln(1 + value)) FILTER (grp = 'ASIA') AS va, var_samp(ln(1 + value)) FILTER (grp = 'EUROPE') AS vb
            FROM v WHERE grp IN ('ASIA', 'EUROPE') GROUP BY element)
        SELECT element, round(ma, 5) AS mean_a, round(mb, 5) AS mean_b, round(ma / mb, 5) AS fold_change, round((ln(1 + ma) - ln(1 + mb)) / ln(2), 5) AS log2_fold_change,
            round(greatest((ma + 1e-6) / (mb + 1e-6), (mb + 1e-6) / (ma + 1e-6)), 5) AS fold_change_magnitude, round((la - lb) / sqrt(va / na + vb / nb), 5) AS t,
            round((la - lb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2) * (1.0 / na + 1.0 / nb)), 5) AS t_equal, na + nb - 2 AS df FROM g"""


ORACLES = {
    "coverage_runs": f"WITH {_runs()} SELECT target, position, length, CAST(depth AS BIGINT) AS depth FROM runs",
    "coverage_weighted": f"WITH {_runs('CAST(round(l_discount * 100) AS BIGINT)')} SELECT target, position, length, CAST(depth AS BIGINT) AS depth FROM runs",
    "coverage_peaks": f"""WITH {_runs()}, m AS (SELECT *, CASE WHEN lag(depth) OVER w > 8 THEN 0 ELSE 1 END AS b FROM runs WINDOW w AS (PARTITION BY target ORDER BY position)),
        i AS (SELECT *, sum(b) OVER (PARTITION BY target ORDER BY position) AS island FROM m WHERE depth > 8)
        SELECT target, min(position) AS start, CAST(sum(length) AS BIGINT) AS length, CAST(sum(depth) AS BIGINT) AS "count" FROM i GROUP BY target, island""",
    "coverage_depth_tally": f"""WITH {_runs()}, b AS (SELECT CAST(depth AS BIGINT) AS depth, CAST(sum(length) AS BIGINT) AS sites, CAST(sum(depth * length) AS BIGINT) AS bases FROM runs GROUP BY depth)
        SELECT *, CAST(sum(sites) OVER (ORDER BY depth DESC) AS BIGINT) AS sites_upto FROM b""",
    "coverage_wiggle": f"""WITH {_READS}, d AS (SELECT target, unnest(range(s, e)) AS p FROM reads)
        SELECT target, CAST(floor(p / 30.0) AS BIGINT) * 30 + 1 AS start, round(count(*) / 30.0, 6) AS average FROM d GROUP BY target, floor(p / 30.0)""",
    "start_counts": f"""SELECT o_orderstatus AS target, {_day('o_orderdate')} + CASE WHEN o_orderkey % 2 = 1 THEN 29 ELSE 0 END AS position, count(*) AS n FROM orders GROUP BY ALL""",
    "merged_intervals": f"""WITH {_READS}, o AS (SELECT *, max(e) OVER (PARTITION BY target ORDER BY s, e, l_orderkey, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
            FROM reads),
        i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY target ORDER BY s, e, l_orderkey, l_linenumber ROWS UNBOUNDED PRECEDING) AS island FROM o)
        SELECT target, min(s) AS start, max(e) AS "end", count(*) AS n FROM i GROUP BY target, island""",
    "overlap_counts": f"""WITH {_READS}, {_REGIONS} SELECT r.target, g AS start, h AS "end", count(x.s) AS n_overlapping FROM regions r
        LEFT JOIN reads x ON x.target = r.target AND x.l_returnflag = 'N' AND x.s < h AND x.e > g GROUP BY ALL""",
    "contained_counts": f"""WITH {_READS}, {_REGIONS} SELECT r.target, g AS r_start, h AS r_end, count(*) AS n FROM regions r
        JOIN reads x ON x.target = r.target AND x.l_returnflag = 'A' AND x.s >= g AND x.e <= h GROUP BY ALL""",
    "region_average_depth": f"""WITH {_READS}, {_REGIONS} SELECT r.target, g AS start, h AS "end", round(coalesce(sum(least(e, h) - greatest(s, g)), 0) / 30.0, 6) AS average_depth
        FROM regions r LEFT JOIN reads x ON x.target = r.target AND x.s < h AND x.e > g GROUP BY ALL""",
    "anchor_clusters": f"""WITH RECURSIVE {_READS}, p AS (SELECT DISTINCT target, s FROM reads),
        a(target, anchor) AS (SELECT target, min(s) FROM p GROUP BY target UNION ALL
            SELECT a.target, min(p.s) FROM a JOIN p ON p.target = a.target AND p.s > a.anchor + 5 GROUP BY a.target, a.anchor)
        SELECT p.target, p.s AS start, max(a.anchor) AS anchor FROM p JOIN a ON a.target = p.target AND a.anchor <= p.s GROUP BY ALL""",
    "pileup_depth": f"WITH {_READS} SELECT target, p AS position, count(*) AS depth FROM (SELECT target, unnest(range(s, e)) AS p FROM reads) GROUP BY ALL",
    "best_score": """SELECT l_orderkey, l_linenumber, l_partkey, l_discount FROM lineitem WHERE l_discount > 1.4e-45
        QUALIFY l_discount = max(l_discount) OVER (PARTITION BY l_orderkey)""",
    "best_score_ambiguity": """SELECT * FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_discount FROM lineitem WHERE l_discount > 1.4e-45
        QUALIFY l_discount = max(l_discount) OVER (PARTITION BY l_orderkey)) QUALIFY count(*) OVER (PARTITION BY l_orderkey) <= 1""",
    "gene_ambiguity": """SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey
        GROUP BY l_orderkey HAVING count(DISTINCT p_brand) <= 2)""",
    "without_ambiguous": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 4)",
    "mates": """WITH x AS (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS t, min(l_partkey) AS p FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2 HAVING count(*) = 1)
        SELECT l_orderkey, a.t AS target_a, a.p AS position_a, b.t AS target_b, b.p AS position_b FROM x a JOIN x b USING (l_orderkey) WHERE a.l_linenumber = 1 AND b.l_linenumber = 2""",
    "alignment_difference": """WITH a AS (SELECT l_orderkey, l_suppkey AS s, l_returnflag AS f FROM lineitem WHERE l_linenumber <= 3
            QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_suppkey DESC, l_returnflag DESC) = 1),
        b AS (SELECT l_orderkey, l_suppkey AS s, l_returnflag AS f FROM lineitem WHERE l_linenumber >= 3
            QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_suppkey DESC, l_returnflag DESC) = 1)
        SELECT * FROM (SELECT l_orderkey, CASE WHEN b.s IS NULL THEN 'first' WHEN a.s IS NULL THEN 'second' END AS only_in,
            CASE WHEN a.s IS NOT NULL AND b.s IS NOT NULL THEN concat_ws(',', CASE WHEN a.s <> b.s THEN 'l_suppkey' END, CASE WHEN a.f <> b.f THEN 'l_returnflag' END) END AS differs
            FROM a FULL JOIN b USING (l_orderkey)) WHERE only_in IS NOT NULL OR differs <> ''""",
    "slice_filter": f"""WITH {_READS} SELECT target, s AS start, e AS "end", l_orderkey, l_linenumber FROM reads WHERE (target > 3 OR target = 3 AND s >= 9000) AND (target < 20 OR target = 20 AND s <= 9500)""",
    "pair_flags": "SELECT o_orderkey % 2 = 1 AS paired, (o_orderkey // 16) % 2 = 1 AS reverse, (o_orderkey // 1024) % 2 = 1 AS duplicate, count(*) AS n FROM orders GROUP BY ALL",
    "duplicate_texts": "SELECT md5(text) AS digest, count(*) AS multiplicity, min(doc_id) AS first FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "base_counts": f"WITH {_SEQ} SELECT t[i] AS gram, count(*) AS n FROM (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM seqs) GROUP BY 1",
    "dinucleotides": f"WITH {_SEQ} SELECT t[i:i + 1] AS gram, count(*) AS n FROM (SELECT t, unnest(range(1, length(t))) AS i FROM seqs WHERE length(t) >= 2) GROUP BY 1",
    "kmer_counts": f"""WITH {_SEQ} SELECT k AS kmer, count(*) AS n FROM (SELECT t[i:i + 3] AS k FROM (SELECT t, unnest(range(1, length(t) - 2)) AS i FROM seqs WHERE length(t) >= 4))
        WHERE regexp_full_match(k, '[ACGT]+') GROUP BY 1""",
    "sequence_functions": f"""WITH {_SEQ}, g AS (SELECT t, length(t) - length(translate(t, 'GC', '')) AS gc, length(t) - length(translate(t, 'ACGT', '')) AS known FROM seqs WHERE regexp_full_match(t, '[ACGTN]+'))
        SELECT reverse(translate(t, 'ACGT', 'TGCA')) AS reversed, replace(t, 'C', 'T') AS converted, round(gc / length(t), 6) AS gc,
            round(CASE WHEN known > 0 THEN 10.4436::DOUBLE - 8.266972::DOUBLE * gc / known END, 6) AS weight, count(*) AS n FROM g GROUP BY ALL""",
    "quality_by_cycle": """WITH v AS (SELECT CAST(generate_subscripts(quality_scores, 1) - 1 AS INTEGER) AS cycle, unnest(quality_scores) AS q FROM read_entries)
        SELECT cycle, quantile_cont(q, 0.25)::DOUBLE AS q25, quantile_cont(q, 0.5)::DOUBLE AS q50, quantile_cont(q, 0.75)::DOUBLE AS q75, round(avg(q), 6) AS mean, count(*) AS n
        FROM v WHERE q BETWEEN 0 AND 93 GROUP BY cycle""",
    "file_statistics": f"""WITH {_SEQ} SELECT sample, count(*) AS n, min(read_length) AS shortest, max(read_length) AS longest, round(avg(read_length), 6) AS mean_length,
        CAST(sum(length(t)) AS BIGINT) AS bases, count(*) FILTER (quality_scores IS NULL) AS without_quality FROM seqs GROUP BY sample""",
    "name_index": 'SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS "index" FROM (SELECT DISTINCT c_name FROM customer)',
    "rolling_counts": """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS n
        FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events)""",
    "binned_totals": """WITH o AS (SELECT floor(o_totalprice) AS n FROM orders), b AS (SELECT CAST(round(n / 5) AS BIGINT) AS by5,
            CASE WHEN n < 100 THEN 0 ELSE CAST(trunc(n / 1000 + 1) AS INTEGER) END AS linear, CAST(trunc(log10(n + 2)) AS INTEGER) AS log10,
            CAST(trunc(ln(n + 2) / ln(2)) AS INTEGER) AS log2, CASE WHEN n < 100 THEN 0 ELSE CAST(trunc(log10(n) - 1) AS INTEGER) END AS small_log10 FROM o)
        SELECT linear, log10, log2, small_log10, count(*) AS n, CAST(sum(by5) AS BIGINT) AS sum_by5 FROM b GROUP BY ALL""",
    "group_fold_change": _fold_change(_MATRIX),
    "group_fold_change_sparse": _fold_change(_MATRIX.replace("p_brand AS element", "l_partkey AS element")),
    "upper_quartiles": f"""WITH {_MATRIX}, el AS (SELECT DISTINCT element FROM matrix WHERE c > 0), sm AS (SELECT DISTINCT sample FROM matrix),
        f AS (SELECT sample, element, coalesce(c, 0) AS c FROM sm CROSS JOIN el LEFT JOIN matrix USING (sample, element)),
        q AS (SELECT sample, list_sort(list(c))[CAST(floor(count(*) * 0.75) AS INTEGER) + 1] AS q, sum(c) AS t FROM f GROUP BY sample)
        SELECT sample, round(greatest(1.0, q * (sum(t) OVER ())::DOUBLE / sum(q) OVER ()), 4) AS factor FROM q""",
    "chi_square": f"""WITH {_MATRIX}, o AS (SELECT element, coalesce(sum(c) FILTER (grp = 'ASIA'), 0) AS a, coalesce(sum(c) FILTER (grp = 'EUROPE'), 0) AS b, coalesce(sum(c) FILTER (grp = 'AFRICA'), 0) AS f
            FROM matrix WHERE grp IN ('ASIA', 'EUROPE', 'AFRICA') GROUP BY element),
        e AS (SELECT *, (a + b + f)::DOUBLE * sum(a) OVER () / (sum(a) OVER () + sum(b) OVER () + sum(f) OVER ()) AS ea, (a + b + f)::DOUBLE * sum(b) OVER () / (sum(a) OVER () + sum(b) OVER () + sum(f) OVER ()) AS eb,
            (a + b + f)::DOUBLE * sum(f) OVER () / (sum(a) OVER () + sum(b) OVER () + sum(f) OVER ()) AS ef FROM o)
        SELECT element, round(CASE WHEN least(a, b, f) = 0 THEN 'NaN'::DOUBLE ELSE (a - ea) ** 2 / ea + (b - eb) ** 2 / eb + (f - ef) ** 2 / ef END, 6) AS chi_square, 2 AS df FROM e""",
    "adjusted_bh": f"WITH {_P}, {_bh('pv', 'p')} SELECT o_orderkey, round(q, 9) AS q FROM adjusted",
    "adjusted_bonferroni": f"WITH {_P} SELECT o_orderkey, round(least(1.0, p / 1000 * (SELECT count(*) FROM pv WHERE p > 0)), 9) AS q FROM pv",
    "combined_p": f"""WITH {_P}, g AS (SELECT o_custkey, count(*) AS n, max(p) AS p_max, min(p) AS p_min, list_sort(list(p))[count(*) // 2 + 1] AS p_median,
            coalesce(sum(-ln(p)) FILTER (p > 0), 0) AS x, count(*) FILTER (p <= 0) AS zeros FROM pv GROUP BY o_custkey)
        SELECT o_custkey, n, round(p_max, 8) AS p_max, round(p_min, 8) AS p_min, round(p_median, 8) AS p_median, round(CASE WHEN zeros > 0 THEN 0.0 WHEN x = 0 THEN 1.0
            ELSE exp(-x) + coalesce(list_sum(list_transform(range(1, n - 1), lambda i: exp(-x + i * ln(x) - lgamma(i + 1.0)))), 0) END, 8) AS p_product FROM g""",
    "fdr_combined": f"""WITH {_P}, c AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS source, p * p * p AS p FROM pv WHERE o_orderstatus IN ('O', 'F', 'P')),
        {_bh('c', 'p')} SELECT o_orderkey, source, round(q, 9) AS q FROM adjusted WHERE q <= 0.3""",
    "odds_ratios": f"WITH {_CELLS} SELECT l_suppkey, round({_LOG_ODDS}, 8) AS log2_odds, round({_ERROR}, 8) AS error FROM cells",
    "allele_counts": f"WITH {_COUNTS} SELECT * FROM counts",
    "site_gate": f"""WITH {_OBS} SELECT target, position, count(DISTINCT read_index) FILTER (allele <> 'view') AS n_indices, count(*) FILTER (allele <> 'view') AS n_variant
        FROM obs GROUP BY target, position HAVING n_indices >= 5 AND n_variant > 6""",
    "quality_left_over": f"""WITH {_OBS}, m AS (SELECT *, allele <> 'view' AND quality < 12 AS bad FROM obs), f AS (SELECT target, position, sample, count(*) FILTER (bad) AS k FROM m GROUP BY ALL)
        SELECT m.target, m.position, m.sample, allele, count(*) AS n FROM m JOIN f USING (target, position, sample) WHERE NOT bad GROUP BY m.target, m.position, m.sample, allele, k HAVING count(*) >= 2 * k""",
    "filter_quarter": f"WITH {_COUNTS} SELECT target, position, sample, allele, n FROM counts QUALIFY n >= max(n) OVER ({_SITE}) // 4",
    "filter_diploid": f"WITH {_COUNTS}, {_DIPLOID} SELECT * FROM dip",
    "filter_strand_bias": f"""WITH {_COUNTS} SELECT target, allele, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_forward) AS BIGINT) AS n_forward, CAST(sum(n_reverse) AS BIGINT) AS n_reverse
        FROM counts GROUP BY ALL HAVING NOT (sum(n) >= 3 AND least(sum(n_forward), sum(n_reverse)) = 0)""",
    "filter_chain": f"""WITH {_COUNTS}, q AS (SELECT * FROM counts QUALIFY n >= max(n) OVER ({_SITE}) // 4), r AS (SELECT *, dense_rank() OVER ({_SITE} ORDER BY n DESC) AS d FROM q),
        t AS (SELECT *, count(*) FILTER (d <= 2) OVER ({_SITE}) AS t FROM r), k AS (SELECT * FROM t WHERE (d = 1 OR d = 2 AND t <= 2) AND NOT (n >= 4 AND least(n_forward, n_reverse) = 0))
        SELECT target, position, sample, allele, n FROM counts SEMI JOIN k USING (target, position, allele)""",
    "genotype_calls": f"WITH {_COUNTS}, {_DIPLOID}, {_GENO} SELECT * FROM geno",
    "allele_groups": f"WITH {_COUNTS} SELECT target, position, CASE WHEN sample < 2 THEN 'A' ELSE 'B' END AS grp, allele, count(DISTINCT sample) AS n_samples, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY ALL",
    "compared_groups": f"""WITH {_COUNTS}, s AS (SELECT target, position, CAST(sum(CASE WHEN sample < 2 AND is_ref THEN n ELSE 0 END) AS BIGINT) AS c, CAST(sum(CASE WHEN sample < 2 AND NOT is_ref THEN n ELSE 0 END) AS BIGINT) AS a,
            CAST(sum(CASE WHEN sample >= 2 AND is_ref THEN n ELSE 0 END) AS BIGINT) AS d, CAST(sum(CASE WHEN sample >= 2 AND NOT is_ref THEN n ELSE 0 END) AS BIGINT) AS b FROM counts GROUP BY ALL)
        SELECT target, position, c AS ref_a, a AS var_a, d AS ref_b, b AS var_b, round({_LOG_ODDS}, 8) AS log2_odds, round({_ERROR}, 8) AS error, round({_LOG_ODDS} / ({_ERROR}), 8) AS z FROM s""",
    "somatic_candidates": f"""WITH {_COUNTS}, f AS (SELECT *, sum(n) OVER ({_SITE}) AS depth FROM counts), t AS (SELECT * FROM f WHERE sample = 0 AND depth >= 4), c AS (SELECT DISTINCT target, position FROM f WHERE sample = 1 AND depth >= 4)
        SELECT t.target, t.position, t.allele, t.n AS n_tumour, round(t.n / t.depth, 8) AS freq_tumour, round(coalesce(m.n / m.depth, 0.0), 8) AS freq_normal
        FROM t SEMI JOIN c USING (target, position) LEFT JOIN f m ON m.target = t.target AND m.position = t.position AND m.allele = t.allele AND m.sample = 1
        WHERE t.n / t.depth > 1.5 * coalesce(m.n / m.depth, 0.0)""",
    "indel_rates": f"""WITH {_COUNTS}, s AS (SELECT CAST(sample AS VARCHAR) AS sample, CASE WHEN sample < 2 THEN 'A' ELSE 'B' END AS grp, count(DISTINCT (target, position)) AS k,
            coalesce(sum(n) FILTER (allele = 'purchase'), 0) AS i FROM counts GROUP BY 1, 2)
        SELECT CASE WHEN sample IS NOT NULL THEN 'sample' ELSE 'group' END AS level, coalesce(sample, grp) AS name, CAST(sum(k) AS BIGINT) AS n_sites, CAST(sum(i) AS BIGINT) AS n_indels,
            round(sum(i) * 100000.0 / sum(k), 6) AS rate FROM s GROUP BY GROUPING SETS ((sample), (grp))""",
    "methylation_sites": f"WITH {_COUNTS}, {_METH} SELECT *, CASE WHEN c + cm > 0 THEN round(100.0::DOUBLE * cm / (c + cm)) END AS rate FROM meth",
    "methylation_regions": f"""WITH {_COUNTS}, {_METH} SELECT 'r-' || target || '-' || CASE WHEN position < 5 THEN 0 ELSE 1 END AS region, CASE WHEN sample < 2 THEN 'A' ELSE 'B' END AS grp,
        CAST(sum(c) AS BIGINT) AS c, CAST(sum(cm) AS BIGINT) AS cm, count(*) AS n_sites, round(100.0::DOUBLE * sum(cm) / (sum(c) + sum(cm)), 6) AS rate FROM meth WHERE c + cm > 0 GROUP BY 1, 2""",
    "pair_statistics": f"""WITH {_COUNTS}, {_METH}, {_PAIRS}, z AS (SELECT *, (ma + mb) / (ma + mb + ca + cb) AS h FROM pairs)
        SELECT target, position, abs(ma - ca) + abs(mb - cb) AS delta, round(abs(ma / (ma + ca) - mb / (mb + cb)) * 100, 8) AS dmr, {_STAT3} AS stat3,
            CASE WHEN (ma - ca) * (mb - cb) > 0 THEN greatest(abs(ma - mb), abs(ca - cb)) ELSE abs(ma - mb) + abs(ca - cb) END AS stat5,
            round(coalesce(abs((ma / (ma + ca) - mb / (mb + cb)) / sqrt(nullif(h * (1 - h) * (1 / (ma + ca) + 1 / (mb + cb)), 0))), 0.0), 8) AS ptest FROM z""",
    "empirical_p": f"""WITH {_COUNTS}, {_METH}, {_PAIRS}, r AS (SELECT target, position, target % 2 AS k, {_STAT3} AS s FROM pairs), u AS (SELECT * FROM r WHERE position < 5), t AS (SELECT * FROM r WHERE position >= 5)
        SELECT t.target, t.position, round((1.0 + (SELECT count(*) FROM u WHERE u.k = t.k) - (SELECT count(*) FROM u WHERE u.k = t.k AND u.s < t.s)) / ((SELECT count(*) FROM u WHERE u.k = t.k) + 1), 8) AS empirical_p FROM t""",
    "props_flat": "SELECT event_id, props ->> 'k' AS k FROM events WHERE coalesce(props ->> 'k', '') <> ''",
    "column_types": "SELECT * FROM (VALUES ('c_custkey', 'Integer'), ('c_name', 'String'), ('c_acctbal', 'Float'), ('c_mktsegment', 'String')) v(column_name, type)",
    "common_positions": """SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'
        INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""",
    "positions_only_in": "SELECT o_custkey FROM orders GROUP BY 1 HAVING min(o_orderstatus) = 'P' AND max(o_orderstatus) = 'P'",
    "transition_counts": """WITH p AS (SELECT upper(ref_allele) AS r, upper(alt) AS a, upper(ref_allele || alt) AS x FROM vcf_records)
        SELECT count(*) FILTER (x IN ('AG', 'GA', 'CT', 'TC')) AS transitions,
            count(*) FILTER (regexp_full_match(x, '[ACGT][ACGT]') AND r <> a AND x NOT IN ('AG', 'GA', 'CT', 'TC')) AS transversions FROM p""",
    "windows_tumbling": """SELECT event_type, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, window_start + INTERVAL 1 DAY AS window_end, count(*) AS n, round(sum(value), 4) AS total
        FROM events GROUP BY 1, 2""",
    "windows_sliding": """SELECT event_type, w AS window_start, w + INTERVAL 2 DAY AS window_end, count(*) AS n FROM (
        SELECT event_type, unnest([time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') - INTERVAL 1 DAY]) AS w FROM events) GROUP BY 1, 2""",
    "windows_session": """WITH m AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS b FROM events),
        s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM m)
        SELECT user_id, min(ts) AS window_start, max(ts) + INTERVAL 12 HOUR AS window_end, count(*) AS n FROM s GROUP BY user_id, k""",
    "read_set_kept": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "read_set_removed": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "gene_counts": f"""WITH {_READS}, seg AS (SELECT DISTINCT l_orderkey % 10 AS target, l_orderkey AS annotation_id, s, s + 5 AS e FROM reads WHERE l_linenumber <= 3),
        g AS (SELECT target, annotation_id, min(s) AS s, max(e) AS e FROM seg GROUP BY ALL), r AS (SELECT target % 10 AS target, s, s + 2 AS e FROM reads WHERE l_returnflag = 'A'),
        gaps AS (SELECT target, annotation_id, u AS s, s AS e FROM (SELECT *, max(e) OVER (PARTITION BY target, annotation_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM seg) WHERE s > u),
        o AS (SELECT g.target, g.annotation_id, count(r.s) AS n FROM g LEFT JOIN r ON r.target = g.target AND r.s < g.e AND r.e > g.s GROUP BY ALL),
        i AS (SELECT gaps.target, annotation_id, count(*) AS n FROM gaps JOIN r ON r.target = gaps.target AND r.s >= gaps.s AND r.e <= gaps.e GROUP BY ALL)
        SELECT o.target, o.annotation_id, o.n - coalesce(i.n, 0) AS n FROM o LEFT JOIN i USING (target, annotation_id)""",
    "constitutive_segments": f"""WITH {_READS}, seg AS (SELECT DISTINCT l_orderkey % 10 AS target, l_orderkey AS annotation_id, s, s + 5 AS e FROM reads WHERE l_linenumber <= 3)
        SELECT target, annotation_id, s AS start, e AS "end" FROM seg a WHERE NOT EXISTS (SELECT 1 FROM seg b WHERE b.target = a.target AND b.annotation_id <> a.annotation_id AND a.s < b.e AND b.s < a.e)""",
    "formula_counts": f"""WITH {_MATRIX}, x AS (SELECT element, sum(c)::DOUBLE AS raw, sum(c)::DOUBLE / 2 + count(*) AS g FROM matrix GROUP BY element)
        SELECT element, round(exp(-1.57361718748031::DOUBLE - 3.62887641327823::DOUBLE * ln(g / raw) + ln(raw)), 4) AS formula2,
            round(exp(-0.843924877396631::DOUBLE + 0.887303234304011::DOUBLE * ln(raw + 1) - 3.45874660923795::DOUBLE * ln((g + 1) / (raw + 1))), 4) AS formula3,
            round(exp(-1.4050204825287::DOUBLE - 3.5820783386146::DOUBLE * ln(g / raw) + ln(raw)), 4) AS formula4 FROM x""",
    "sample_pairs": f"""WITH {_MATRIX}, s AS (SELECT DISTINCT sample, grp FROM matrix)
        SELECT a.sample AS a, b.sample AS b, CASE WHEN a.grp = b.grp THEN 'within' ELSE 'between' END AS kind FROM s a, s b WHERE a.grp = b.grp AND a.sample < b.sample OR a.grp < b.grp""",
    "wide_counts": f"WITH {_MATRIX} SELECT element, " + ", ".join(
        f"CAST(sum(CASE WHEN sample = 'NATION_{i}' THEN c ELSE 0 END) AS BIGINT) AS \"NATION_{i}\"" for i in range(25)
    ) + " FROM matrix GROUP BY element",
    "site_spacing": f"""WITH {_READS}, p AS (SELECT DISTINCT target, s FROM reads), d AS (SELECT s - lag(s) OVER (PARTITION BY target ORDER BY s) AS distance FROM p)
        SELECT distance, count(*) AS n FROM d WHERE distance IS NOT NULL GROUP BY 1""",
    "kmer_successors": f"""WITH {_SEQ}, k AS (SELECT read_index, t[i:i + 5] AS m FROM (SELECT read_index, t, unnest(range(1, length(t) - 4)) AS i FROM seqs WHERE length(t) >= 6))
        SELECT m[1:5] AS kmer, CASE WHEN read_index % 2 = 0 THEN 'a' ELSE 'b' END AS grp, count(DISTINCT m[6:6]) AS n FROM k WHERE regexp_full_match(m, '[ACGT]+') GROUP BY 1, 2""",
    "heptamer_weights": f"""WITH {_SEQ}, k AS (SELECT p, t[p + 1:p + 7] AS kmer FROM (SELECT t, unnest([0, 1, 23, 24, 25, 26, 27, 28]) AS p FROM seqs)),
        c AS (SELECT kmer, p, count(*) AS n FROM k WHERE regexp_full_match(kmer, '[ACGT]{{7}}') GROUP BY 1, 2), s AS (SELECT kmer, p, n::DOUBLE / sum(n) OVER (PARTITION BY p) AS share FROM c)
        SELECT kmer, round(coalesce(sum(share) FILTER (p >= 2), 0) / 6 / (sum(share) FILTER (p < 2) / 2), 6) AS weight FROM s GROUP BY kmer HAVING sum(share) FILTER (p < 2) > 0""",
    "sex_of_samples": """WITH c AS (SELECT file_id % 3 AS sample, count(*) FILTER (chrom IN ('X', 'chrX')) AS hits_x, count(*) FILTER (chrom IN ('Y', 'chrY')) AS hits_y FROM vcf_records GROUP BY 1)
        SELECT *, CASE WHEN hits_x >= 100 * hits_y AND hits_x > 0 THEN 'female' ELSE 'male' END AS sex FROM c""",
    "length_filter": "SELECT read_length, count(*) AS n FROM read_entries WHERE read_length BETWEEN 40 AND 60 GROUP BY 1",
}
