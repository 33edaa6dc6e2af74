"""DuckDB SQL that states the results of ``engine``'s queries independently."""

from __future__ import annotations

from .reference_sql import _PH, _WITH, _feed, _hard


_LITERALS = [
    ("snowflake", "bool", "TRUE", "UPDATE t SET \"c\" = TRUE WHERE \"c\" IS NULL"), ("snowflake", "int", "7", "UPDATE t SET \"c\" = 7 WHERE \"c\" IS NULL"), ("snowflake", "string", "'it''s'", "UPDATE t SET \"c\" = 'it''s' WHERE \"c\" IS NULL"),
    ("snowflake", "struct", "PARSE_JSON('{\"a\":1}')", "UPDATE t SET \"c\" = PARSE_JSON('{\"a\":1}') WHERE \"c\" IS NULL"), ("snowflake", "string", "NULL", None),
    ("bigquery", "bool", "TRUE", "UPDATE t SET `c` = TRUE WHERE `c` IS NULL"), ("bigquery", "int", "7", "UPDATE t SET `c` = 7 WHERE `c` IS NULL"), ("bigquery", "string", "'it''s'", "UPDATE t SET `c` = 'it''s' WHERE `c` IS NULL"),
    ("bigquery", "struct", "JSON '{\"a\":1}'", "UPDATE t SET `c` = JSON '{\"a\":1}' WHERE `c` IS NULL"), ("bigquery", "string", "NULL", None),
    ("mssql", "bool", "1", None), ("mssql", "int", "7", None), ("mssql", "string", "'it''s'", None), ("mssql", "struct", "'{\"a\":1}'", None), ("mssql", "string", "NULL", None),
    ("postgres", "bool", "TRUE", None), ("postgres", "int", "7", None), ("postgres", "string", "'it''s'", None), ("postgres", "struct", "'{\"a\":1}'", None), ("postgres", "string", "NULL", None),
]


def _values(rows: list[tuple], names: str) -> str:
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({names})"


_NUMBERS = [0, -1, 255, 2**63 - 1, -(2**63), 2**63, 10**37, -(10**37), 2**127 - 1, -(2**127), 2**200, -(2**200) - 1]


def _thousandths(n: int) -> str:
    s = str(abs(n)).rjust(4, "0")
    return f"{'-' if n < 0 else ''}{s[:-3]}.{s[-3:]}"


_WIDE = [(str(n), str(n) if abs(n) < 10**38 else None, str(n), str(n * 100) if n else "0", _thousandths(n)) for n in _NUMBERS] + [("junk", None, None, None, None), ("empty", None, None, None, None)]
_SPLIT = {"redshift": (["UPDATE", "INSERT", "DELETE"], ["UPDATE", "UPDATE", "INSERT"]), "mysql": (["UPDATE", "INSERT", "DELETE"], ["UPDATE", "UPDATE", "INSERT"]), "clickhouse": (["INSERT"], ["INSERT"])}
_TEXTS = [
    (d, soft, i, verb, verb == "MERGE" or (verb == "UPDATE" and i == 0))
    for d in ("bigquery", "clickhouse", "databricks", "duckdb", "mssql", "mysql", "postgres", "redshift", "snowflake", "spark")
    for soft in (False, True) for i, verb in enumerate(_SPLIT.get(d, (["MERGE"], ["MERGE"]))[soft])
]

ORACLES = {
    "table_merge": f"{_WITH} {_hard()}",
    "table_touched": "SELECT count(*) AS rows, true AS at_most_three FROM orders WHERE o_orderkey % 5 <> 0",
    "multi_step_merge": f"{_WITH} {_hard()}",
    "staging_new_column": f"""WITH {_feed()},
a AS (SELECT * FROM feed WHERE seq = 1), b AS (SELECT * FROM feed WHERE seq = 2)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, coalesce(b.o_orderstatus, a.o_orderstatus) AS o_orderstatus, a.o_totalprice,
  CASE WHEN b.o_orderkey IS NULL THEN a.o_orderpriority WHEN a.o_orderkey IS NOT NULL AND b.o_orderpriority = '{_PH}' THEN a.o_orderpriority ELSE b.o_orderpriority END AS o_orderpriority,
  CASE WHEN b.o_orderkey IS NOT NULL THEN 'new' END AS extra
FROM a FULL OUTER JOIN b ON a.o_orderkey = b.o_orderkey""",
    "merge_problems": f"""{_WITH} SELECT s.o_orderkey, CASE WHEN s.is_deleted THEN 'not deleted' ELSE 'lost' END AS problem
FROM staged s LEFT JOIN base b ON b.o_orderkey = s.o_orderkey WHERE s.is_deleted = (b.o_orderkey IS NOT NULL)""",
    "described_table": _values([
        ("o_orderkey", "bigint", False, True, True), ("o_orderstatus", "string", False, False, True), ("o_totalprice", "double", False, False, True), ("o_orderpriority", "string", False, False, True),
        ("o_orderdate", "timestamp_ntz", False, False, True), ("note", "string", True, False, True),
    ], "name, type, backfilled, in_key, same_in_session"),
    "drop_in_two_steps": "SELECT CAST(step AS INTEGER) AS step, columns FROM (" + _values([(i, "r_regionkey,r_name,old") for i in (1, 2, 3, 4)] + [(5, "r_regionkey,r_name")], "step, columns") + ")",
    "staging_names": _values([("orders_cf_abcde_21600", True), ("orders_cf_fghij_4000021600", False), ("orders_cf_msm", False), ("shop_orders_cf_reusable", False), ("orders", False)], "name, swept"),
    "reusable_staging": _values([(0, "created"), (1, "kept"), (2, "truncated"), (3, "created")], "step, done"),
    "widened_columns": "SELECT 'c_name' AS column_name, max(octet_length(encode(c_name))) AS bytes FROM customer UNION ALL SELECT 'c_mktsegment', 200",
    "counted_defaults": """SELECT dialect, strategy, value, coalesce(value IN ('x', '0'), false) AS counts FROM (VALUES
  ('bigquery', 'backfill'), ('clickhouse', 'native'), ('databricks', 'native'), ('duckdb', 'none'), ('mssql', 'native'), ('mysql', 'native'), ('postgres', 'none'), ('redshift', 'backfill'), ('snowflake', 'backfill'), ('spark', 'native')) d(dialect, strategy),
  (VALUES (NULL), ('1970-01-01'), ('1970-01-01T00:00:00Z'), ('00000000-0000-0000-0000-000000000000'), ('CURRENT_TIMESTAMP'), ('x'), ('0')) v(value)""",
    "default_literals": _values(_LITERALS, "dialect, kind, literal, statement"),
    "merge_texts": _values(_TEXTS, "dialect, soft, step, verb, keeps_unsent"),
    "parquet_sink": """SELECT o_orderkey, o_totalprice, o_orderdate, '{"o_orderstatus":"' || o_orderstatus || '"}' AS tags, true AS dated FROM orders""",
    "file_types": """SELECT event_id, CAST(value AS FLOAT) AS value, date_trunc('millisecond', ts) AS ts, '{"user_id":' || user_id || '}' AS who, CAST(NULL AS VARCHAR) AS nothing FROM events""",
    "delimited_sink": """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN c_name || chr(9) || '"x"' || chr(10) || 'y' ELSE c_name END AS c_name, c_acctbal FROM customer""",
    "message_sink": """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS message,
  least(10, count(*) OVER () - (row_number() OVER (ORDER BY n_nationkey) - 1) // 10 * 10) AS batch FROM nation""",
    "document_keys": "SELECT event_id, CAST(event_id AS VARCHAR) AS doc_key, true AS raw_kept FROM events",
    "number_keys": "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 'k' || event_id ELSE CAST(event_id AS VARCHAR) END AS key_text FROM events",
    "key_rules": _values([(0, "id"), (1, "at,id,region"), (2, "a,z"), (3, "only"), (4, "refused")], "rule, keys"),
    "name_hints": _values([("user_id", "string"), ("Created_At", "timestamp_tz"), ("job_started", "timestamp_tz"), ("id", None), ("plan", None)], "name, kind"),
    "encrypt_json": """SELECT c_custkey, c_name, '{"c_nationkey":' || c_nationkey || ',"c_mktsegment":"' || c_mktsegment || '"}' AS c_more, true AS sealed FROM customer""",
    "refused": _values([(n, True) for n in ("encrypt_missing_key", "encrypt_json_missing_key", "row_without_marker", "row_without_key", "no_table_name", "static_clash", "key_not_included", "unknown_setting", "stale_writer")], "name, refused"),
    "checked_rows": "SELECT * FROM nation",
    "approximate_size": """WITH n AS (SELECT n_nationkey, length('{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}') AS bytes FROM nation)
SELECT n_nationkey, bytes FROM n UNION ALL SELECT NULL, CAST(sum(bytes + length(',"op":"u"')) AS BIGINT) FROM n""",
    "gzip_decode": f"SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '{_PH}' WHEN event_id % 5 <> 1 THEN props END AS props FROM events",
    "more_decoders": """SELECT event_id, strftime(ts, '%H:%M:%S') || '.500000' AS clock, base64(encode(event_type)) AS bits, CAST(2024 AS BIGINT) AS year, event_id AS duration, CAST(event_id AS VARCHAR) AS uuid, 'a.b' AS ltree, event_type AS enum, 'a,b' AS enum_set, '<a/>' AS xml, 'P1Y2M' AS interval,
  '{"type":"Feature","geometry":{"type":"Point","coordinates":[1.5,' || event_id || ']},"properties":null}' AS point, '{"type":"Feature","geometry":{"type":"Point","coordinates":[1.0,2.0]},"properties":null}' AS geometry FROM events""",
    "decimal_wide": _values(_WIDE, "number, fixed, plain, hundreds, thousandths"),
    "decimal_encode": """WITH p AS (SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(18, 2)) AS price FROM orders)
SELECT o_orderkey, CAST(round(price, 1) AS DECIMAL(18, 1)) AS price FROM p""",
    "typed_arrays": "SELECT event_id, strftime(ts, '%Y-%m-%d') || '|-|1970-01-01' AS days, '[\"' || strftime(ts, '%Y-%m-%d') || '\"]|[]' AS nested FROM events",
    "force_utc": "SELECT event_id, epoch_us(ts) AS micros, 'timestamp' AS kind FROM events",
    "strict_numbers": """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN event_id END AS whole, CASE WHEN event_id % 4 = 3 AND event_id < 32768 THEN CAST(event_id AS SMALLINT) END AS small,
  CASE event_id % 4 WHEN 0 THEN CAST(7.5 AS FLOAT) WHEN 1 THEN CAST(9223372036854775808 AS FLOAT) WHEN 3 THEN CAST(event_id AS FLOAT) END AS single, CASE WHEN event_id % 4 <> 0 THEN false END AS flag FROM events""",
    "list_text": """SELECT event_id, '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS structs, '{"' || event_type || '":' || user_id || '}' AS maps, '[' || user_id || ']' AS lists, user_id || '|-' AS plain, event_type AS lone FROM events""",
    "repaired_text": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || chr(255) || 'é' || chr(195) ELSE event_type END AS repaired FROM events",
    "stream_merge": f"""WITH {_feed(placeholder=False)}, last AS (SELECT o_orderkey AS id, arg_max(o_orderstatus, seq) AS status, arg_max(o_totalprice, seq) AS price, arg_max(op, seq) AS op FROM feed GROUP BY o_orderkey)
SELECT id, status, price FROM last WHERE op <> 'd'""",
    "stream_history": f"WITH {_feed(placeholder=False)} SELECT o_orderkey * 10 + seq AS kafka_offset, op, o_orderkey AS row_id FROM feed",
    "partition_lag": """WITH ends AS (SELECT topic, kafka_partition, max(kafka_offset) AS last FROM change_messages GROUP BY ALL),
r AS (SELECT topic, kafka_partition, max(kafka_offset) AS last, arg_max(kafka_ts, kafka_offset) AS at FROM change_messages WHERE kafka_offset % 2 = 0 GROUP BY ALL)
SELECT e.topic, e.kafka_partition, e.last - coalesce(r.last, -1) AS row_lag, (epoch_us(TIMESTAMP '2030-01-01') - epoch_us(r.at)) / 1000000 AS ingestion_lag_seconds
FROM ends e LEFT JOIN r ON e.topic = r.topic AND e.kafka_partition = r.kafka_partition""",
    "topic_run": """SELECT event_id AS id, CAST(ts AS DATE) AS day, sha256(event_type) AS kind, CASE WHEN event_id % 10 <> 0 THEN value END AS value, 'erp' AS origin, CASE WHEN event_id % 4 = 0 THEN 'u' ELSE 'c' END AS operation, 'public.events' AS full_table_name,
  CASE WHEN event_id % 6 <> 0 THEN replace(props, ' ', '') END AS props FROM events WHERE event_id % 50 <> 49""",
    "topic_partitions": "SELECT count(*) AS rows, 'events_default' AS dest_table FROM events WHERE event_id % 50 <> 49",
}
