"""Reference SQL (DuckDB dialect) of the core data-quality queries."""

_REFS = """
refs AS (
  SELECT 'districts' AS table_name, district_id AS record_id, 'state_id' AS ref_column, assessment_year, loaded_at, 's' AS p, lower(trim(state_id)) AS k FROM districts
  UNION ALL SELECT 'assessment_units', unit_id, 'district_id', assessment_year, loaded_at, 'd', lower(trim(district_id)) FROM assessment_units
  UNION ALL SELECT 'assessment_units', unit_id, 'state_id', assessment_year, loaded_at, 's', lower(trim(state_id)) FROM assessment_units),
parents AS (
  SELECT 's' AS p, lower(trim(state_id)) AS k, loaded_at, deleted_at FROM states
  UNION ALL SELECT 'd', lower(trim(district_id)), loaded_at, deleted_at FROM districts),
orphans AS (
  SELECT DISTINCT table_name, record_id, ref_column, assessment_year FROM refs r
  WHERE k <> '' AND NOT EXISTS (SELECT 1 FROM parents q WHERE q.p = r.p AND q.k = r.k AND q.loaded_at <= r.loaded_at AND (q.deleted_at IS NULL OR q.deleted_at > r.loaded_at)))
"""

P1_FOUND = f"WITH {_REFS} SELECT * FROM orphans"

P1_COUNTS = f"WITH {_REFS} SELECT table_name, ref_column, assessment_year, count(*)::BIGINT AS n_orphans FROM orphans GROUP BY ALL"

P1_INTEGER = """
SELECT o_custkey AS orphan_key, count(*)::BIGINT AS n_refs FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey <> 3) GROUP BY 1
"""

_VERSIONS = r"""
seen AS (
  SELECT canonical_id AS entity, CASE WHEN regexp_matches(trim(assessment_year), '^\d{4}-\d{2}$') THEN left(trim(assessment_year), 5) || (left(trim(assessment_year), 4)::INT + 1)::VARCHAR ELSE trim(assessment_year) END AS period,
    lower(trim(regexp_replace(name_in_year, '\s+', ' ', 'g'))) AS payload, loaded_at, review_id
  FROM crosswalk_fuzzy_review_sample WHERE label IS DISTINCT FROM 'incorrect' AND trim(name_in_year) <> '' AND canonical_id IS NOT NULL),
snaps AS (SELECT entity, period, payload FROM seen QUALIFY row_number() OVER (PARTITION BY entity, period ORDER BY loaded_at DESC, review_id DESC, payload DESC) = 1),
starts AS (SELECT * FROM snaps QUALIFY payload IS DISTINCT FROM lag(payload) OVER (PARTITION BY entity ORDER BY period)),
versions AS (
  SELECT entity, row_number() OVER w AS seq, payload, period AS valid_from, coalesce(lead(period) OVER w, 'open') AS valid_to, count(*) OVER (PARTITION BY entity) AS n
  FROM starts WINDOW w AS (PARTITION BY entity ORDER BY period))
"""

P4_FOUND = f"WITH {_VERSIONS} SELECT entity AS canonical_id, valid_from, valid_to FROM versions WHERE n > 1"

P4_VERSIONS = f"WITH {_VERSIONS} SELECT entity, seq::INT AS seq, payload, valid_from, valid_to FROM versions"

_RECORDS = """
bodies AS (SELECT DISTINCT record_id, try_cast(body AS JSON) AS j FROM ingres_raw WHERE body IS NOT NULL),
counted AS (SELECT record_id, j, json_extract(j, '$.response') AS r, CASE json_type(j, '$.response') WHEN 'ARRAY' THEN json_array_length(j, '$.response')::BIGINT ELSE 1 END AS n FROM bodies WHERE coalesce(json_type(j, '$.response'), 'NULL') <> 'NULL'),
records AS (SELECT record_id, k AS loc_index, CASE json_type(r) WHEN 'ARRAY' THEN json_extract(r, '$[' || k || ']') ELSE r END AS rec FROM (SELECT record_id, r, unnest(range(n)) AS k FROM counted) u)
"""

_SECTIONS = ("rechargeData", "draftData", "stageOfExtraction", "currentAvailabilityForAllPurposes")

#: Leaves by a recursive walk of the JSON.
_LEAVES = f"""
named AS ({" UNION ALL ".join(f"SELECT record_id, loc_index, '{x}' AS section, json_extract(rec, '$.{x}') AS v FROM records" for x in _SECTIONS)}),
decoded AS (SELECT record_id, loc_index, section, CASE WHEN json_type(v) = 'VARCHAR' THEN coalesce(try_cast(json_extract_string(v, '$') AS JSON), v) ELSE v END AS v FROM named WHERE v IS NOT NULL),
walk AS (
  SELECT record_id, loc_index, section, section AS path, v FROM decoded
  UNION ALL
  SELECT record_id, loc_index, section, path || CASE json_type(v) WHEN 'ARRAY' THEN '[' || key || ']' ELSE '.' || key END, child
  FROM (SELECT record_id, loc_index, section, path, v,
    unnest(CASE json_type(v) WHEN 'OBJECT' THEN json_keys(v) WHEN 'ARRAY' THEN list_transform(range(json_array_length(v)::BIGINT), lambda i: i::VARCHAR) ELSE [] END) AS key,
    unnest(CASE json_type(v) WHEN 'OBJECT' THEN list_transform(json_keys(v), lambda k: json_extract(v, '$."' || k || '"')) WHEN 'ARRAY' THEN list_transform(range(json_array_length(v)::BIGINT), lambda i: json_extract(v, '$[' || i || ']')) ELSE [] END) AS child FROM walk) w),
leaves AS (SELECT DISTINCT record_id, loc_index, section, path AS leaf_path, json_extract_string(v, '$') AS value, json_type(v) AS kind FROM walk WHERE json_type(v) NOT IN ('OBJECT', 'ARRAY', 'NULL'))
"""

P2_FOUND = f"WITH RECURSIVE {_RECORDS}, {_LEAVES} SELECT DISTINCT record_id, loc_index, leaf_path FROM leaves"

#: Leaves per table and column of the merged schema; numbers are counted where they are no text.
P2_SCHEMA = f"""WITH RECURSIVE {_RECORDS}, {_LEAVES}
SELECT regexp_replace(CASE WHEN contains(leaf_path, '[') THEN regexp_extract(leaf_path, '^(.*\\])', 1) ELSE section END, '\\[[0-9]+\\]', '[]', 'g') AS table_path,
  CASE WHEN contains(leaf_path, '[') THEN ltrim(regexp_replace(leaf_path, '^.*\\]', ''), '.') ELSE ltrim(substr(leaf_path, len(section) + 1), '.') END AS column_path,
  count(*)::BIGINT AS n_values, count(try_cast(value AS DOUBLE))::BIGINT AS n_numbers FROM leaves GROUP BY 1, 2"""

#: Rows of the child tables: the path up to the last place in a list; its parent is the path up to the place before.
P2_TABLES = f"""WITH RECURSIVE {_RECORDS}, {_LEAVES},
keyed AS (SELECT record_id, loc_index, CASE WHEN contains(leaf_path, '[') THEN regexp_extract(leaf_path, '^(.*\\])', 1) ELSE section END AS row_key, section FROM leaves)
SELECT regexp_replace(row_key, '\\[[0-9]+\\]', '[]', 'g') AS table_path, record_id, loc_index, row_key,
  CASE WHEN contains(row_key, '[') THEN CASE WHEN regexp_matches(row_key, '\\].*\\]$') THEN regexp_extract(row_key, '^(.*\\])[^\\]]*\\]$', 1) ELSE section END END AS parent_key,
  coalesce(try_cast(regexp_extract(row_key, '\\[([0-9]+)\\]$', 1) AS BIGINT), -1) AS ordinal, count(*)::BIGINT AS n_values FROM keyed GROUP BY ALL"""

R14_CYCLES = r"""WITH p AS (SELECT row_number() OVER () AS r, id, regexp_extract_all(translate(question, '०१२३४५६७८९௦௧௨௩௪௫௬௭௮௯', '01234567890123456789'), '[\pL\pM_][\pL\pM\pN_.]*|\.[0-9]+|[0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?|[^\s]') AS t FROM ingres_bench_v1),
x AS (SELECT r, i, t[i] AS w, t[i + 1] AS a, t[i + 2] AS b, CASE WHEN i > 1 THEN t[i - 1] END AS c, CASE WHEN i > 2 THEN t[i - 2] END AS d FROM (SELECT r, t, unnest(range(1, len(t) + 1)) AS i FROM p) q),
y AS (SELECT r, i, w::INT AS y, a, b, lower(c) AS c, lower(d) AS d, a IN ('-', '–', '/') AND regexp_matches(b, '^[0-9]+$') AS ranged,
  CASE WHEN lower(a) IN ('के', 'की', 'का', 'ke', 'ki', 'ka') THEN lower(b) ELSE lower(a) END AS f, CASE WHEN lower(c) IN ('of', 'for', 'year') THEN lower(d) ELSE lower(c) END AS g
  FROM x WHERE regexp_matches(w, '^20[0-9][0-9]$')),
z AS (SELECT r, i, CASE WHEN coalesce(ranged, false) THEN CASE WHEN len(b) IN (2, 4) AND b::INT IN (y + 1, (y + 1) % 100) THEN y END
  WHEN (regexp_matches(coalesce(f, ''), '^(assessment|gwra|आकलन|akalan|aaklan|மதிப்பீட்ட|மதிப்பீடு)') AND NOT (coalesce(c, '') IN ('-', '–', '/') AND regexp_matches(coalesce(d, ''), '[0-9]$')))
    OR coalesce(g, '') IN ('assessment', 'gwra', 'आकलन', 'akalan', 'aaklan', 'மதிப்பீட்ட', 'மதிப்பீடு') THEN y - 1 END AS y FROM y),
l AS (SELECT r, min(i) AS i, y FROM z WHERE y IS NOT NULL GROUP BY r, y),
s AS (SELECT r, list(y::VARCHAR || '-' || (y + 1)::VARCHAR ORDER BY i) AS labels FROM l GROUP BY r)
SELECT id, coalesce(labels, []::VARCHAR[]) AS labels FROM p LEFT JOIN s USING (r)"""

E15_NUMBERS = r"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '०१२३४५६७८९௦௧௨௩௪௫௬௭௮௯', '01234567890123456789'), '[\pL\pM_][\pL\pM\pN_.]*|\.[0-9]+|[0-9]+(?:,[0-9]+)*(?:\.[0-9]+)?|[^\s]') AS t FROM documents WHERE text IS NOT NULL),
x AS (SELECT r, t[i] AS w, CASE WHEN i > 1 THEN t[i - 1] END AS c, CASE WHEN i > 2 THEN t[i - 2] END AS d FROM (SELECT r, t, unnest(range(1, len(t) + 1)) AS i FROM t) q),
n AS (SELECT r, count(*) AS n FROM x WHERE regexp_matches(w, '^[0-9]') AND NOT regexp_matches(w, '^(19|20)[0-9][0-9]$')
  AND NOT coalesce(c IN ('-', '–', '/') AND regexp_matches(d, '^(19|20)[0-9][0-9]$') AND regexp_matches(w, '^[0-9][0-9]$'), false) GROUP BY r)
SELECT doc_id, coalesce(n, 0)::INT AS n_numbers FROM t LEFT JOIN n USING (r)"""
