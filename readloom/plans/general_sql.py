"""SQL that DuckDB runs on the same tables, by query name."""

_WS = "chr(32) || chr(9) || chr(13) || chr(10)"
_MISSING = "('', '.', '-', '?', 'na', 'n/a', 'null')"


def _trim(x: str) -> str:
    return f"trim({x}, {_WS})"


def _float(x: str) -> str:
    """Canonical float text of a trimmed value, null if invalid."""
    return f"""CASE WHEN regexp_full_match({x}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
            THEN printf('%.4f', CAST({x} AS DOUBLE))
        WHEN regexp_full_match(lower({x}), '[+-]?nan') THEN 'NaN'
        WHEN regexp_full_match(lower({x}), '[+]?inf(inity)?') THEN 'Inf'
        WHEN regexp_full_match(lower({x}), '-inf(inity)?') THEN '-Inf' END"""


def _integer(x: str) -> str:
    digits = f"ltrim(ltrim({x}, '+-'), '0')"
    return f"""CASE WHEN regexp_full_match({x}, '[+-]?[0-9]+')
            THEN CASE WHEN {digits} = '' THEN '0' WHEN {x} LIKE '-%' THEN '-' || {digits} ELSE {digits} END END"""


P1_FOUND = f"""
WITH cells AS (
    SELECT r.site_id, f.field_id, f.type, f.number_of_values AS n, r.loaded_at, r.row_id,
        {_trim('coalesce(r.info_value, chr(0))')} AS v, r.info_value IS NULL AS is_null
    FROM info_rows r JOIN column_fields f ON f.column_name = 'INFO' AND lower(f.field_id) =
        {_trim(f"regexp_replace(lower({_trim('r.attribute')}), '^info/', '')")}
), parts AS (
    SELECT *, CASE WHEN n > 1 THEN list_transform(string_split(v, ','), lambda x: {_trim('x')}) ELSE [v] END AS p FROM cells
), texts AS (
    SELECT site_id, field_id, loaded_at, row_id, n, type, CASE type
        WHEN 'Flag' THEN CASE WHEN is_null OR lower(v) IN ('', '1', 'true', 't', 'yes', 'y') THEN ['true']
            WHEN lower(v) IN ('0', 'false', 'f', 'no', 'n') THEN ['false'] ELSE [NULL] END
        WHEN 'Integer' THEN list_transform(p, lambda x: {_integer('x')})
        WHEN 'Float' THEN list_transform(p, lambda x: {_float('x')})
        WHEN 'Character' THEN list_transform(p, lambda x: CASE WHEN length(x) = 1 AND NOT is_null AND x NOT IN {_MISSING} THEN x END)
        ELSE list_transform(p, lambda x: CASE WHEN lower(x) NOT IN {_MISSING} AND NOT is_null THEN x END) END AS t
    FROM parts
), valid AS (
    SELECT *, array_to_string(t, ',') AS field_value FROM texts
    WHERE len(list_filter(t, lambda x: x IS NULL)) = 0 AND len(t) = greatest(n, 1)
)
SELECT site_id, field_id, field_value FROM valid
QUALIFY row_number() OVER (PARTITION BY site_id, field_id ORDER BY loaded_at DESC, row_id DESC) = 1
"""

_FIELDS = r"""
fields AS (
    SELECT file_id, column_name, field_id, arg_min(type, line_no) AS type, arg_min(about, line_no) AS about FROM (
        SELECT file_id, line_no, regexp_extract(line, '^##(INFO|FORMAT)=<', 1) AS column_name,
            trim(regexp_extract(line, '[<,]\s*ID\s*=\s*("?)([^,">]*)', 2)) AS field_id,
            lower(trim(regexp_extract(line, '[<,]\s*Type\s*=\s*("?)([^,">]*)', 2))) AS type,
            lower(regexp_replace(
                CASE WHEN regexp_matches(line, '[<,]\s*Description\s*=\s*"')
                    THEN regexp_extract(line, '[<,]\s*Description\s*=\s*"((?:[^"\\]|\\.)*)"', 1)
                    ELSE regexp_extract(line, '[<,]\s*Description\s*=\s*([^,>]*)', 1) END,
                '[^A-Za-z0-9]', '', 'g')) AS about
        FROM vcf_headers WHERE regexp_matches(line, '^##(INFO|FORMAT)=<')
    ) GROUP BY ALL
)"""

P2_FOUND = f"""
WITH {_FIELDS}, pairs AS (
    SELECT file_id, lag(file_id) OVER (PARTITION BY series_id ORDER BY created_at, file_id) AS previous_id FROM vcf_files
), now AS (SELECT p.file_id, p.previous_id, f.* EXCLUDE (file_id) FROM pairs p JOIN fields f USING (file_id) WHERE p.previous_id IS NOT NULL),
old AS (SELECT p.file_id, f.* EXCLUDE (file_id) FROM pairs p JOIN fields f ON f.file_id = p.previous_id),
gone AS (SELECT * FROM old o WHERE NOT EXISTS (SELECT 1 FROM now n WHERE n.file_id = o.file_id AND n.column_name = o.column_name AND n.field_id = o.field_id)),
new AS (SELECT * FROM now n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE n.file_id = o.file_id AND n.column_name = o.column_name AND n.field_id = o.field_id)),
renamed AS (SELECT g.file_id, g.column_name, g.field_id, n.field_id AS new_id, g.type AS old_type, n.type AS new_type
    FROM gone g JOIN new n ON g.file_id = n.file_id AND g.column_name = n.column_name AND g.about = n.about AND g.about <> '')
SELECT file_id, column_name, 'renamed' AS change_kind, field_id, new_id FROM renamed
UNION ALL SELECT file_id, column_name, 'removed', field_id, '' FROM gone g
    WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_id = g.file_id AND r.column_name = g.column_name AND r.field_id = g.field_id)
UNION ALL SELECT file_id, column_name, 'added', field_id, '' FROM new n
    WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.file_id = n.file_id AND r.column_name = n.column_name AND r.new_id = n.field_id)
UNION ALL SELECT file_id, column_name, 'type', new_id, '' FROM renamed WHERE old_type <> new_type
UNION ALL SELECT n.file_id, n.column_name, 'type', n.field_id, '' FROM now n JOIN old o
    ON n.file_id = o.file_id AND n.column_name = o.column_name AND n.field_id = o.field_id WHERE n.type <> o.type
"""


def _lines(name: str) -> str:
    field = r'("[^"]*("{2}[^"]*)*"|[^"\t]*)'
    return f"""
    SELECT '{name}' AS table_name, line_id, CASE
        WHEN NOT regexp_full_match(line, '{field}(\\t{field})*', 's') THEN 'quoting'
        WHEN len(f) <> len(cols) THEN 'column_count'
        WHEN list_bool_or(list_transform(list_zip(f, cols), lambda z: CASE
            WHEN lower({_trim('z[1]')}) IN {_MISSING} THEN z[2].required
            WHEN z[2].type = 'Integer' THEN NOT regexp_full_match({_trim('z[1]')}, '[+-]?[0-9]+')
            WHEN z[2].type = 'Float' THEN NOT (regexp_full_match({_trim('z[1]')}, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')
                OR regexp_full_match(lower({_trim('z[1]')}), '[+-]?(nan|inf|infinity)'))
            ELSE false END)) THEN 'invalid_value' END AS reason
    FROM (
        SELECT line_id, line, cols, list_transform(
            regexp_extract_all(chr(9) || line, '\\t{field}', 1),
            lambda x: CASE WHEN x LIKE '"%' THEN replace(x[2:-2], '""', '"') ELSE x END) AS f
        FROM (
            SELECT line_id, regexp_replace(c0, '\\r$', '') AS line,
                (SELECT list(struct_pack(type, required) ORDER BY ordinal) FROM tsv_columns WHERE table_name = '{name}') AS cols
            FROM {name} WHERE c0 IS NOT NULL AND {_trim('c0')} <> ''
                AND NOT starts_with(ltrim(c0, chr(65279)), '#')
                AND ltrim(regexp_replace(c0, '\\r$', ''), chr(65279)) <>
                    (SELECT string_agg(column_name, chr(9) ORDER BY ordinal) FROM tsv_columns WHERE table_name = '{name}')
        )
    )"""


P4_FOUND = f"SELECT * FROM ({_lines('tsv_with_header_spaces')} UNION ALL {_lines('no_format')}) WHERE reason IS NOT NULL"

ORACLES = {"p1_found": P1_FOUND, "p2_found": P2_FOUND, "p4_found": P4_FOUND}
