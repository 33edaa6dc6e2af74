"""DuckDB SQL that states the results of ``general``'s queries independently."""

from __future__ import annotations

_MESSAGES = """
raw AS (
  SELECT topic, kafka_partition, kafka_offset, kafka_ts, decode(msg_key) AS k, decode(msg_value) AS v
  FROM change_messages WHERE msg_value IS NOT NULL AND octet_length(msg_value) > 0
), parsed AS (
  SELECT * EXCLUDE (v), CAST(v AS JSON) AS j FROM raw WHERE json_valid(v)
), named AS (
  SELECT topic, kafka_partition, kafka_offset, kafka_ts,
    j->>'$.payload.source.db' AS db, j->>'$.payload.source.table' AS table_name, j->>'$.payload.op' AS op,
    j->'$.payload.after' AS after_row,
    CAST(CAST(json_extract_string(CAST(j->>'$.payload.source.sequence' AS JSON), '$[1]') AS DECIMAL(38, 0)) AS BIGINT) AS lsn,
    coalesce(j->>'$.payload.after.id', j->>'$.payload.before.id',
      CASE WHEN k LIKE 'Struct{%' THEN nullif(regexp_extract(k, '[{,]\\s*id=([^,}]*)', 1), '')
           WHEN json_valid(k) THEN coalesce(CAST(k AS JSON)->>'$.payload.id', CAST(k AS JSON)->>'$.id') END) AS id_text
  FROM parsed
), m AS (
  SELECT *, CAST(CAST(id_text AS DOUBLE) AS BIGINT) AS row_id FROM named
)
"""

P2_FOUND = f"""
WITH {_MESSAGES}
SELECT topic, kafka_partition, kafka_offset FROM m
WHERE db IS NOT NULL AND table_name IS NOT NULL AND row_id IS NOT NULL AND lsn IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY db, table_name, row_id, lsn ORDER BY kafka_ts, kafka_partition, kafka_offset, topic) > 1
"""

P2_RANGES = f"""
WITH {_MESSAGES}, n AS (
  SELECT DISTINCT db, table_name, row_id, lsn FROM m
  WHERE db IS NOT NULL AND table_name IS NOT NULL AND row_id IS NOT NULL AND lsn IS NOT NULL
), s AS (
  SELECT *, lag(lsn) OVER (PARTITION BY db, table_name, row_id, lsn // 1048576 ORDER BY lsn) AS prev FROM n
)
SELECT db AS src_db, table_name AS src_table,
  count(*) FILTER (prev IS NULL OR lsn > prev + 1) AS ranges, CAST(count(*) AS BIGINT) AS numbers
FROM s GROUP BY ALL
"""

_TOP = """
, every AS (
  SELECT db AS src_db, table_name AS src_table, row_id, lsn, op, after_row, 1 AS rank FROM m
  WHERE db IS NOT NULL AND table_name IS NOT NULL AND row_id IS NOT NULL AND lsn IS NOT NULL
  UNION ALL
  SELECT src_db, src_table, row_id, last_lsn, 'base', json_object('email', email), 0 FROM mirror_rows
), top AS (
  SELECT * FROM every
  QUALIFY row_number() OVER (PARTITION BY src_db, src_table, row_id ORDER BY lsn DESC, op = 'd' AND rank = 1 DESC, rank DESC) = 1
)
"""

P4_FOUND = f"""
WITH {_MESSAGES} {_TOP}
SELECT src_db, src_table, row_id, lsn AS last_lsn FROM top WHERE op <> 'd'
"""

P4_STATE = f"""
WITH {_MESSAGES} {_TOP}, gone AS (
  SELECT src_db, src_table, row_id, max(lsn) AS gone_lsn FROM every WHERE op = 'd' GROUP BY ALL
), sent AS (
  SELECT e.src_db, e.src_table, e.row_id, e.after_row->>'$.email' AS email
  FROM every e LEFT JOIN gone g ON e.src_db = g.src_db AND e.src_table = g.src_table AND e.row_id = g.row_id
  JOIN top t ON e.src_db = t.src_db AND e.src_table = t.src_table AND e.row_id = t.row_id
  WHERE e.op <> 'd' AND (g.gone_lsn IS NULL OR e.lsn > g.gone_lsn)
    AND (e.after_row->>'$.email') IS DISTINCT FROM '__debezium_unavailable_value'
  QUALIFY row_number() OVER (PARTITION BY e.src_db, e.src_table, e.row_id ORDER BY e.lsn DESC, e.rank DESC) = 1
)
SELECT t.src_db, t.src_table, t.row_id, s.email, t.lsn AS last_lsn
FROM top t LEFT JOIN sent s ON t.src_db = s.src_db AND t.src_table = s.src_table AND t.row_id = s.row_id
WHERE t.op <> 'd'
"""

P5_FOUND = f"""
WITH {_MESSAGES}, ended AS (
  SELECT * FROM sync_runs
  QUALIFY row_number() OVER (PARTITION BY run_id, attempt_no, topic, kafka_partition ORDER BY logged_at DESC, log_id DESC) = 1
), done AS (
  SELECT topic, kafka_partition, first_offset, next_offset FROM ended WHERE lower(trim(run_status)) = 'committed'
), marked AS (
  SELECT m.topic, m.row_id, m.lsn, d.topic IS NOT NULL AS processed
  FROM m LEFT JOIN done d ON m.topic = d.topic AND m.kafka_partition = d.kafka_partition
    AND m.kafka_offset >= d.first_offset AND m.kafka_offset < d.next_offset
  WHERE m.row_id IS NOT NULL AND m.lsn IS NOT NULL
)
SELECT topic, row_id, lsn FROM marked GROUP BY ALL HAVING NOT bool_or(processed)
"""

_CONTENTS = f"""
WITH {_MESSAGES}, c AS (
  SELECT m.*, hash_of FROM m JOIN (
    SELECT topic AS t, kafka_partition AS p, kafka_offset AS o,
      coalesce(j->>'$.payload.op', 'null') || chr(1) || coalesce(j->>'$.payload.before', 'null') || chr(1) || coalesce(j->>'$.payload.after', 'null') AS hash_of FROM parsed
  ) ON topic = t AND kafka_partition = p AND kafka_offset = o
  WHERE row_id IS NOT NULL AND lsn IS NOT NULL
)
"""

P5_CHANGED = f"""{_CONTENTS}, ended AS (
  SELECT * FROM sync_runs
  QUALIFY row_number() OVER (PARTITION BY run_id, attempt_no, topic, kafka_partition ORDER BY logged_at DESC, log_id DESC) = 1
), done AS (
  SELECT topic, kafka_partition, first_offset, next_offset FROM ended WHERE lower(trim(run_status)) = 'committed'
), marked AS (
  SELECT c.topic, c.row_id, c.lsn, c.hash_of, d.topic IS NOT NULL AS processed
  FROM c LEFT JOIN done d ON c.topic = d.topic AND c.kafka_partition = d.kafka_partition AND c.kafka_offset >= d.first_offset AND c.kafka_offset < d.next_offset
), by_content AS (
  SELECT topic, row_id, lsn, hash_of, bool_or(processed) AS processed FROM marked GROUP BY ALL
), changed AS (
  SELECT * FROM by_content b WHERE NOT processed AND EXISTS (SELECT 1 FROM by_content p WHERE p.processed AND p.topic = b.topic AND p.row_id = b.row_id AND p.lsn = b.lsn)
)
SELECT topic, count(*) AS contents, count(DISTINCT (row_id, lsn)) AS changes FROM changed GROUP BY topic
"""

P5_RERUN = f"""{_CONTENTS}, first AS (
  SELECT DISTINCT topic, row_id, lsn, hash_of FROM c WHERE kafka_partition % 2 = 0
), every AS (
  SELECT DISTINCT topic, row_id, lsn, hash_of FROM c
), second AS (
  SELECT topic, row_id, lsn, CASE WHEN EXISTS (SELECT 1 FROM first f WHERE f.topic = e.topic AND f.row_id = e.row_id AND f.lsn = e.lsn) THEN 'changed' ELSE 'new' END AS change_kind
  FROM every e WHERE NOT EXISTS (SELECT 1 FROM first f WHERE f.topic = e.topic AND f.row_id = e.row_id AND f.lsn = e.lsn AND f.hash_of = e.hash_of)
)
SELECT 'new' AS change_kind, count(*) AS contents, 1 AS run FROM first HAVING count(*) > 0
UNION ALL SELECT change_kind, count(*), 2 FROM second GROUP BY change_kind
"""

_PLACED = """
WITH RECURSIVE docs AS (
  SELECT rec_id, CAST(msg_value AS JSON) AS j FROM doc_messages WHERE json_valid(msg_value)
), plain AS (
  SELECT rec_id, j AS value, json_type(j) AS type, '' AS members, 0 AS in_list FROM docs
  UNION ALL
  SELECT rec_id, v, json_type(v), members, in_list FROM (
    SELECT n.rec_id, CASE WHEN n.type = 'OBJECT' THEN CASE WHEN n.members = '' THEN e.key ELSE n.members || '.' || e.key END ELSE n.members END AS members,
      CASE WHEN n.type = 'OBJECT' THEN 0 ELSE n.in_list + 1 END AS in_list,
      CASE WHEN n.type = 'OBJECT' AND n.members = 'payload' AND e.key = 'after' AND json_type(e.value) = 'VARCHAR' AND json_valid(e.value->>'$') THEN CAST(e.value->>'$' AS JSON) ELSE e.value END AS v
    FROM plain n, json_each(n.value) e
    WHERE n.type = 'ARRAY' OR (n.type = 'OBJECT' AND NOT list_bool_or(list_transform(json_keys(n.value), lambda k: k LIKE '$%')))
  ) WHERE json_type(v) IN ('OBJECT', 'ARRAY')
), objects AS (
  SELECT DISTINCT members, in_list FROM plain
  WHERE type = 'OBJECT' AND members <> '' AND NOT coalesce(list_bool_or(list_transform(json_keys(value), lambda k: k LIKE '$%')), false)
), mixed AS (
  SELECT members FROM objects WHERE in_list IN (0, 1) GROUP BY members HAVING count(DISTINCT in_list) = 2
), placed AS (
  SELECT rec_id, j AS value, json_type(j) AS type, '' AS members, '' AS path, false AS element, '$' AS holder FROM docs
  UNION ALL
  SELECT rec_id, v, json_type(v), members, CASE WHEN lone THEN path || '[0]' ELSE path END, listed OR lone, holder FROM (
    SELECT *, NOT listed AND json_type(v) = 'OBJECT' AND members IN (SELECT members FROM mixed) AS lone FROM (
      SELECT n.rec_id, CASE WHEN n.type = 'OBJECT' THEN CASE WHEN n.members = '' THEN e.key ELSE n.members || '.' || e.key END ELSE n.members END AS members,
        CASE WHEN n.type = 'OBJECT' THEN CASE WHEN n.path = '' THEN e.key ELSE n.path || '.' || e.key END ELSE n.path || '[' || e.key || ']' END AS path,
        n.type = 'ARRAY' AS listed, CASE WHEN n.element AND n.type = 'OBJECT' THEN n.path ELSE n.holder END AS holder,
        CASE WHEN n.type = 'OBJECT' AND n.members = 'payload' AND e.key = 'after' AND json_type(e.value) = 'VARCHAR' AND json_valid(e.value->>'$') THEN CAST(e.value->>'$' AS JSON) ELSE e.value END AS v
      FROM placed n, json_each(n.value) e
      WHERE n.type = 'ARRAY' OR (n.type = 'OBJECT' AND NOT list_bool_or(list_transform(json_keys(n.value), lambda k: k LIKE '$%')))
    ) WHERE json_type(v) IN ('OBJECT', 'ARRAY')
  )
)
"""
_ELEMENTS = "element AND type = 'OBJECT' AND NOT coalesce(list_bool_or(list_transform(json_keys(value), lambda k: k LIKE '$%')), false)"

P1_FOUND = f"{_PLACED} SELECT rec_id, holder AS parent_path, path AS child_path FROM placed WHERE {_ELEMENTS}"

P1_ORDER_LINES = f"""{_PLACED}
SELECT rec_id, holder AS parent_path, path AS child_path, value->>'$.sku' AS sku,
  TRY_CAST(coalesce(value->>'$.qty."$numberLong"', value->>'$.qty') AS BIGINT) AS qty
FROM placed WHERE members = 'payload.after.orders.lines' AND {_ELEMENTS}
"""

P1_VARIANTS = f"""{_PLACED}, kinds AS (
  SELECT p.rec_id, p.path, p.members, e.key, CASE json_type(e.value)
      WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'bool' WHEN 'VARCHAR' THEN 'text' WHEN 'ARRAY' THEN 'list' WHEN 'DOUBLE' THEN 'real'
      WHEN 'OBJECT' THEN coalesce('ext:' || list_min(list_filter(json_keys(e.value), lambda k: k LIKE '$%')), 'object') ELSE 'int' END AS kind
  FROM placed p, json_each(p.value) e WHERE {_ELEMENTS.replace("value", "p.value").replace("element AND type", "p.element AND p.type")}
), shapes AS (
  SELECT rec_id, path, members AS member_path, string_agg(key || '=' || kind, ',' ORDER BY key || '=' || kind) AS members FROM kinds GROUP BY ALL
  UNION ALL
  SELECT rec_id, path, members, '' FROM placed WHERE {_ELEMENTS} AND len(json_keys(value)) = 0
)
SELECT member_path, members, CAST(count(*) AS BIGINT) AS objects FROM shapes GROUP BY ALL
"""

P1_REJECTS = """
SELECT rec_id, CASE WHEN msg_value IS NULL THEN 'null' WHEN trim(msg_value) = '' THEN 'empty' WHEN json_valid(msg_value) THEN 'scalar' ELSE 'no JSON' END AS reason
FROM doc_messages WHERE msg_value IS NULL OR NOT json_valid(msg_value) OR json_type(CAST(CASE WHEN json_valid(msg_value) THEN msg_value END AS JSON)) NOT IN ('OBJECT', 'ARRAY')
"""

_P3 = """
WITH r AS (
  SELECT feed, file_no, rec_id, written_at, CAST(rec_value AS JSON) AS j FROM feed_records WHERE json_valid(rec_value)
), f AS (
  SELECT *, CASE WHEN json_type(j->'$.schema.fields') = 'ARRAY' THEN CAST(j->'$.schema.fields' AS JSON[]) END AS fields FROM r
), w AS (
  SELECT *, list_filter(fields, lambda x: (x->>'$.field') = 'after' AND json_type(x->'$.fields') = 'ARRAY') AS after_field FROM f
), c AS (
  SELECT feed, file_no, rec_id, written_at,
    CASE WHEN len(after_field) > 0 THEN CAST(after_field[1]->'$.fields' AS JSON[]) ELSE fields END AS cols,
    CASE WHEN len(after_field) > 0 OR (fields IS NULL AND json_type(j->'$.payload.after') = 'OBJECT') THEN j->'$.payload.after' ELSE j->'$.payload' END AS body
  FROM w
), s AS (
  SELECT *, CASE WHEN cols IS NOT NULL THEN list_sort(list_distinct(list_transform(cols, lambda x: lower(x->>'$.field') || chr(1) || coalesce(x->>'$.type', '')))) END AS sig FROM c
), counted AS (
  SELECT feed, file_no, sig, count(*) AS n, max(rec_id) AS last FROM s WHERE sig IS NOT NULL GROUP BY ALL
), files AS (
  SELECT feed, file_no, sig FROM counted QUALIFY row_number() OVER (PARTITION BY feed, file_no ORDER BY n DESC, last DESC) = 1
), steps AS (
  SELECT feed, file_no, sig, lag(file_no) OVER w AS prev_no, lag(sig) OVER w AS prev_sig FROM files WINDOW w AS (PARTITION BY feed ORDER BY file_no)
), now_cols AS (
  SELECT feed, file_no, prev_no, split_part(x, chr(1), 1) AS name, split_part(x, chr(1), 2) AS type FROM (SELECT feed, file_no, prev_no, unnest(sig) AS x FROM steps WHERE prev_no IS NOT NULL)
), old_cols AS (
  SELECT feed, file_no, prev_no, split_part(x, chr(1), 1) AS name, split_part(x, chr(1), 2) AS type FROM (SELECT feed, file_no, prev_no, unnest(prev_sig) AS x FROM steps WHERE prev_no IS NOT NULL)
), both_cols AS (
  SELECT coalesce(a.feed, b.feed) AS feed, coalesce(a.file_no, b.file_no) AS file_no, coalesce(a.prev_no, b.prev_no) AS prev_no, a.name AS old_name, a.type AS old_type, b.name AS new_name, b.type AS new_type
  FROM old_cols a FULL OUTER JOIN now_cols b ON a.feed = b.feed AND a.file_no = b.file_no AND a.name = b.name
), one AS (
  SELECT feed, file_no, rec_id, sig, body, body->>'$.id' AS id, len(json_keys(body)) AS width, written_at FROM s WHERE json_type(body) = 'OBJECT' AND (body->>'$.id') IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY feed, file_no, body->>'$.id' ORDER BY sig IS NOT NULL DESC, len(json_keys(body)) DESC, written_at DESC, rec_id DESC) = 1
), cells AS (
  SELECT o.feed, o.file_no, o.id, lower(e.key) AS name, CAST(e.value AS VARCHAR) AS v FROM one o, json_each(o.body) e WHERE json_type(e.value) <> 'NULL'
), pairs AS (
  SELECT a.feed, a.file_no, a.prev_no, a.old_name, b.new_name FROM both_cols a JOIN both_cols b ON a.feed = b.feed AND a.file_no = b.file_no AND a.old_type = b.new_type
  WHERE a.new_name IS NULL AND b.old_name IS NULL
), scores AS (
  SELECT p.feed, p.file_no, p.old_name, p.new_name, avg(CASE WHEN x.v = y.v THEN 1.0 ELSE 0 END) AS share
  FROM pairs p JOIN one a ON a.feed = p.feed AND a.file_no = p.prev_no JOIN one b ON b.feed = p.feed AND b.file_no = p.file_no AND b.id = a.id
    LEFT JOIN cells x ON x.feed = p.feed AND x.file_no = p.prev_no AND x.id = a.id AND x.name = p.old_name
    LEFT JOIN cells y ON y.feed = p.feed AND y.file_no = p.file_no AND y.id = a.id AND y.name = p.new_name
  WHERE x.v IS NOT NULL OR y.v IS NOT NULL GROUP BY ALL
), renamed AS (
  SELECT * FROM scores WHERE share > 0.5
  QUALIFY row_number() OVER (PARTITION BY feed, file_no, old_name ORDER BY share DESC, new_name) = 1 AND row_number() OVER (PARTITION BY feed, file_no, new_name ORDER BY share DESC, old_name) = 1
)
"""

P3_FOUND = f"""{_P3}
SELECT feed, file_no, 'renamed' AS change_kind, old_name AS field_from, new_name AS field_to FROM renamed
UNION ALL
SELECT feed, file_no, 'retyped', old_name, new_name FROM both_cols WHERE old_type <> new_type
UNION ALL
SELECT feed, file_no, 'removed', old_name, '' FROM both_cols a WHERE new_name IS NULL AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.feed = a.feed AND r.file_no = a.file_no AND r.old_name = a.old_name)
UNION ALL
SELECT feed, file_no, 'added', '', new_name FROM both_cols a WHERE old_name IS NULL AND NOT EXISTS (SELECT 1 FROM renamed r WHERE r.feed = a.feed AND r.file_no = a.file_no AND r.new_name = a.new_name)
"""

P3_TABLE = f"""{_P3.replace("WITH r AS", "WITH RECURSIVE r AS")}, cells0 AS (
  SELECT feed, file_no, rec_id, i, lower(k) AS name, body->>('$."' || k || '"') AS v
  FROM (SELECT feed, file_no, rec_id, body, unnest(json_keys(body)) AS k, generate_subscripts(json_keys(body), 1) AS i FROM s WHERE json_type(body) = 'OBJECT')
), moves AS (
  SELECT feed, file_no AS at_no, old_name, new_name, row_number() OVER (PARTITION BY feed ORDER BY file_no, old_name, new_name) AS n FROM renamed
), steps_of AS (
  SELECT DISTINCT feed, file_no, name AS first_name, name AS cur, CAST(0 AS BIGINT) AS n FROM cells0
  UNION ALL
  SELECT t.feed, t.file_no, t.first_name, CASE WHEN m.at_no > t.file_no AND m.old_name = t.cur THEN m.new_name ELSE t.cur END, m.n FROM steps_of t JOIN moves m ON m.feed = t.feed AND m.n = t.n + 1
), last_names AS (
  SELECT feed, file_no, first_name, arg_max(cur, n) AS name FROM steps_of GROUP BY ALL
), finals AS (
  SELECT feed, split_part(x, chr(1), 1) AS name, split_part(x, chr(1), 2) AS type FROM (SELECT feed, unnest(arg_max(sig, file_no)) AS x FROM files GROUP BY feed)
), cells1 AS (
  SELECT c.feed, c.file_no, c.rec_id, c.i, l.name, c.v, f.type FROM cells0 c JOIN last_names l ON l.feed = c.feed AND l.file_no = c.file_no AND l.first_name = c.name LEFT JOIN finals f ON f.feed = c.feed AND f.name = l.name
  QUALIFY row_number() OVER (PARTITION BY c.rec_id, l.name ORDER BY c.i) = 1
), judged AS (
  SELECT *, type IS NOT NULL AND (v IS NULL OR CASE
      WHEN type IN ('int8', 'int16', 'int32', 'int64') THEN regexp_full_match(v, '\\s*[+-]?\\d+\\s*') AND coalesce(TRY_CAST(v AS HUGEINT) BETWEEN -(2::HUGEINT ** CAST(substr(type, 4) AS INTEGER)) // 2 AND (2::HUGEINT ** CAST(substr(type, 4) AS INTEGER)) // 2 - 1, false)
      WHEN type IN ('float', 'float32', 'double', 'float64') THEN TRY_CAST(v AS DOUBLE) IS NOT NULL WHEN type = 'boolean' THEN TRY_CAST(v AS BOOLEAN) IS NOT NULL ELSE true END) AS fits FROM cells1
), made AS (
  SELECT rec_id, '{{' || coalesce(string_agg(to_json(name) || ':' || coalesce(to_json(v), 'null'), ',' ORDER BY name) FILTER (fits), '') || '}}' AS "row",
    '{{' || string_agg(to_json(name) || ':' || coalesce(to_json(v), 'null'), ',' ORDER BY i) FILTER (NOT fits) || '}}' AS rescued FROM judged GROUP BY rec_id
)
SELECT t.feed, t.file_no, t.rec_id, coalesce(m."row", CASE WHEN json_type(s.body) = 'OBJECT' THEN '{{}}' END) AS "row", m.rescued
FROM feed_records t LEFT JOIN s ON s.rec_id = t.rec_id LEFT JOIN made m ON m.rec_id = t.rec_id
"""

ORACLES = {"p1_found": P1_FOUND, "p1_variants": P1_VARIANTS, "p1_subtypes": P1_VARIANTS, "p1_rejects": P1_REJECTS, "p1_order_lines": P1_ORDER_LINES, "p3_found": P3_FOUND, "p3_table": P3_TABLE, "p2_found": P2_FOUND, "p2_ranges": P2_RANGES, "p4_found": P4_FOUND, "p4_state": P4_STATE, "p5_found": P5_FOUND, "p5_changed": P5_CHANGED, "p5_rerun": P5_RERUN}
