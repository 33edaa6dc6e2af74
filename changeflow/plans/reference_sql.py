"""DuckDB SQL that states the results of ``reference``'s queries independently."""

from __future__ import annotations

from .general_sql import _MESSAGES

_PH = "__debezium_unavailable_value"


def _feed(delete_seq: int = 3, placeholder: bool = True) -> str:
    hidden = f"CASE WHEN o_orderkey % 2 = 0 THEN '{_PH}' ELSE o_orderpriority END" if placeholder else "o_orderpriority"
    return f"""
base AS (SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate FROM orders WHERE o_orderkey % 5 <> 0),
feed AS (
  SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate, 'c' AS op, CAST(1 AS BIGINT) AS seq FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL
  SELECT o_orderkey, 'X', o_totalprice + 1, {hidden}, o_orderdate, 'u', CAST(2 AS BIGINT) FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL
  SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate, 'd', CAST({delete_seq} AS BIGINT) FROM orders WHERE o_orderkey % 7 = 0
)"""


def _fold(where: str = "true") -> str:
    def column(c: str, sent: str = "true") -> str:
        lead = f"CASE WHEN min(seq) < coalesce(min(seq) FILTER (op <> 'd'), max(seq)) OR NOT bool_or(op <> 'd') THEN arg_min({c}, seq) END"
        return f"CASE WHEN bool_or(op <> 'd') THEN coalesce(arg_max({c}, seq) FILTER (op <> 'd' AND {sent}), {lead}, arg_max({c}, seq) FILTER (op <> 'd')) ELSE arg_min({c}, seq) END AS {c}"

    return f"""
staged AS (
  SELECT o_orderkey, {column("o_orderstatus")}, {column("o_totalprice")}, {column("o_orderpriority", f"o_orderpriority <> '{_PH}'")}, {column("o_orderdate")},
    arg_max(op, seq) = 'd' AS is_deleted, NOT bool_or(op <> 'd') AS only_set_delete, max(seq) AS seq
  FROM feed WHERE {where} GROUP BY o_orderkey
)"""


_COLS = "o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate"
_AVAIL = f"(s.o_orderpriority IS NULL OR NOT contains(s.o_orderpriority, '{_PH}'))"


def _hard(staged: str = "staged", on: str = "b.o_orderkey = s.o_orderkey", base: str = "base") -> str:
    return f"""
SELECT coalesce(s.o_orderkey, b.o_orderkey) AS o_orderkey,
  CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_orderstatus ELSE b.o_orderstatus END AS o_orderstatus,
  CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_totalprice ELSE b.o_totalprice END AS o_totalprice,
  CASE WHEN s.o_orderkey IS NULL THEN b.o_orderpriority WHEN b.o_orderkey IS NOT NULL AND NOT {_AVAIL} THEN b.o_orderpriority ELSE s.o_orderpriority END AS o_orderpriority,
  CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_orderdate ELSE b.o_orderdate END AS o_orderdate
FROM {base} b FULL OUTER JOIN {staged} s ON {on}
WHERE NOT coalesce(s.is_deleted, false)"""


_REPEATED = """
copies AS (
  SELECT o_orderkey, o_custkey, o_totalprice + version AS o_totalprice, CAST(version AS INTEGER) AS version
  FROM orders, (SELECT unnest([0, 1, 2]) AS version) v
  WHERE version = 0 OR (version = 1 AND o_orderkey % 5 IN (0, 1)) OR (version = 2 AND o_orderkey % 5 = 0)
)"""
_WITH = f"WITH {_feed()}, {_fold()}"
_US = "epoch_us(ts)"
_HASH_COLS = "c_custkey, c_acctbal, c_mktsegment"

_SALT = b"pepper".ljust(64, b"\0")
_INNER, _OUTER = bytes(b ^ 0x36 for b in _SALT).hex(), bytes(b ^ 0x5C for b in _SALT).hex()

ORACLES = {
    "fold_last_wins": f"WITH {_feed(placeholder=False)}, {_fold("op <> 'd'")} SELECT * FROM staged",
    "fold_unavailable_carry": f"WITH {_feed()}, {_fold("op <> 'd'")} SELECT * FROM staged",
    "fold_delete_keeps_previous": f"{_WITH} SELECT * FROM staged",
    "fold_delete_first": f"WITH {_feed(0)}, {_fold()} SELECT * FROM staged",
    "fold_maps": f"{_WITH} SELECT * EXCLUDE (o_orderdate) FROM staged",
    "batch_flags": f"{_WITH} SELECT count(*) AS rows, bool_or(op <> 'd') AS other_operations, bool_or(op = 'd') AS hard_deletes FROM feed",
    "latest_event": "SELECT user_id, arg_max(ts, event_id) AS last_ts, count(*) AS events FROM events GROUP BY user_id",
    "merge_hard_delete": f"{_WITH} {_hard()}",
    "merge_soft_delete": f"""{_WITH}
SELECT coalesce(b.o_orderkey, s.o_orderkey) AS o_orderkey,
  CASE WHEN s.o_orderkey IS NULL OR (b.o_orderkey IS NOT NULL AND s.only_set_delete) THEN b.o_orderstatus ELSE s.o_orderstatus END AS o_orderstatus,
  CASE WHEN s.o_orderkey IS NULL OR (b.o_orderkey IS NOT NULL AND s.only_set_delete) THEN b.o_totalprice ELSE s.o_totalprice END AS o_totalprice,
  CASE WHEN s.o_orderkey IS NULL OR (b.o_orderkey IS NOT NULL AND (s.only_set_delete OR NOT {_AVAIL})) THEN b.o_orderpriority ELSE s.o_orderpriority END AS o_orderpriority,
  CASE WHEN s.o_orderkey IS NULL OR (b.o_orderkey IS NOT NULL AND s.only_set_delete) THEN b.o_orderdate ELSE s.o_orderdate END AS o_orderdate,
  coalesce(s.is_deleted, false) AS is_deleted
FROM base b FULL OUTER JOIN staged s ON b.o_orderkey = s.o_orderkey""",
    "merge_split_update": f"""{_WITH}
SELECT s.o_orderkey, s.o_orderstatus, s.o_totalprice, CASE WHEN {_AVAIL} THEN s.o_orderpriority ELSE b.o_orderpriority END AS o_orderpriority, s.o_orderdate
FROM base b JOIN staged s ON b.o_orderkey = s.o_orderkey WHERE NOT s.is_deleted""",
    "merge_split_insert": f"{_WITH} SELECT {_COLS} FROM staged s WHERE NOT is_deleted AND NOT EXISTS (SELECT 1 FROM base b WHERE b.o_orderkey = s.o_orderkey)",
    "merge_split_delete": f"{_WITH} SELECT {_COLS} FROM base b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM staged WHERE is_deleted)",
    "merge_null_safe_key": f"""
WITH b AS (SELECT CASE WHEN o_orderkey <> 11 THEN o_orderkey END AS o_orderkey, o_orderstatus, o_totalprice, o_orderpriority, o_orderdate, true AS here FROM orders WHERE o_orderkey % 5 <> 0),
s AS (SELECT CASE WHEN o_orderkey <> 11 THEN o_orderkey END AS o_orderkey, 'N' AS o_orderstatus, o_totalprice, o_orderpriority, o_orderdate, true AS here FROM orders WHERE o_orderkey = 11 OR o_orderkey % 13 = 0)
SELECT {", ".join(f"CASE WHEN s.here THEN s.{c} ELSE b.{c} END AS {c}" for c in _COLS.split(", "))}
FROM b FULL OUTER JOIN s ON b.o_orderkey IS NOT DISTINCT FROM s.o_orderkey""",
    "merge_partition_pruned": f"{_WITH}, early AS (SELECT * FROM staged WHERE o_orderdate < TIMESTAMP '1995-04-01') {_hard('early')}",
    "merge_extra_predicate": f"""{_WITH}, moved AS (SELECT * REPLACE (CASE WHEN o_orderkey % 9 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate END AS o_orderdate) FROM staged)
{_hard("moved", "b.o_orderkey = s.o_orderkey AND b.o_orderdate = s.o_orderdate")}""",
    "merge_counts": f"""{_WITH}
SELECT count(*) AS staged, count(b.o_orderkey) AS matched, count(*) FILTER (b.o_orderkey IS NULL AND NOT is_deleted) AS inserted,
  count(*) FILTER (b.o_orderkey IS NOT NULL AND is_deleted) AS deleted, CAST(count(*) FILTER (b.o_orderkey IS NULL AND s.o_orderpriority = '{_PH}') AS BIGINT) AS unavailable
FROM staged s LEFT JOIN base b ON b.o_orderkey = s.o_orderkey""",
    "staging_upsert": f"{_WITH} {_hard()}",
    "merge_moved_date": f"""{_WITH}, early AS (
  SELECT * REPLACE (CASE WHEN o_orderkey % 9 = 0 THEN o_orderdate + INTERVAL 40 DAY ELSE o_orderdate END AS o_orderdate) FROM staged WHERE o_orderdate < TIMESTAMP '1995-04-01'
) {_hard('early')}""",
    "dedupe_latest": f"WITH {_REPEATED} SELECT * FROM copies QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY version DESC) = 1",
    "dedupe_second": f"WITH {_REPEATED} SELECT * FROM copies QUALIFY count(*) OVER (PARTITION BY o_orderkey) = 1 OR row_number() OVER (PARTITION BY o_orderkey ORDER BY version) = 2",
    "dedupe_identity": f"WITH {_REPEATED}, top AS (SELECT o_orderkey, max(version) AS version FROM copies GROUP BY o_orderkey) SELECT c.* FROM copies c JOIN top USING (o_orderkey, version)",
    "history_append": f"{_WITH} SELECT {_COLS}, CAST(0 AS BIGINT) AS seq, 'r' AS operation FROM base UNION ALL SELECT {_COLS}, seq, op FROM feed",
    "append_only_fold": f"{_WITH} SELECT {_COLS}, CAST(NULL AS BOOLEAN) AS is_deleted FROM base UNION ALL SELECT {_COLS}, is_deleted FROM staged",
    "latest_view": f"""{_WITH}, every AS (SELECT {_COLS}, CAST(0 AS BIGINT) AS seq, false AS is_deleted FROM base UNION ALL SELECT {_COLS}, seq, is_deleted FROM staged)
SELECT {_COLS}, seq FROM (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) = 1) WHERE NOT is_deleted""",
    "soft_partition_route": "SELECT 'events' || CASE WHEN day(ts) % 2 = 1 OR ts > TIMESTAMP '2024-01-30' THEN strftime(ts, '_%Y_%m_%d') ELSE '_default' END AS dest_table, count(*) AS events FROM events GROUP BY 1",
    "partition_distance": f"""SELECT event_id, CAST((2024 - year(ts)) * 12 + 3 - month(ts) AS INTEGER) AS monthly,
  CAST((epoch_us(TIMESTAMP '2024-03-01 12:00:00') - {_US}) // 86400000000 AS INTEGER) AS daily, CAST((epoch_us(TIMESTAMP '2024-03-01 12:00:00') - {_US}) // 3600000000 AS INTEGER) AS hourly,
  strftime(ts, '_%Y_%m') AS monthly_suffix, strftime(ts, '_%Y_%m_%d_%H') AS hourly_suffix FROM events""",
    "distinct_dates": "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders",
    "batch_by_bytes": """
WITH RECURSIVE r AS (SELECT user_id, event_id, props, octet_length(encode(props)) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
g AS (
  SELECT user_id, event_id, props, i, n AS filled, CAST(0 AS BIGINT) AS batch_no FROM r WHERE i = 1
  UNION ALL
  SELECT r.user_id, r.event_id, r.props, r.i, CASE WHEN g.filled + r.n > 40 THEN r.n ELSE g.filled + r.n END, CASE WHEN g.filled + r.n > 40 THEN g.batch_no + 1 ELSE g.batch_no END
  FROM g JOIN r ON r.user_id = g.user_id AND r.i = g.i + 1
) SELECT user_id, event_id, props, batch_no FROM g""",
    "envelope_decode": f"""
SELECT event_id AS id, CAST(ts AS DATE) AS day, ts AS "at", strftime(ts, '%H:%M:%S.%f') AS clock, event_type AS kind, CASE WHEN event_id % 10 <> 0 THEN value END AS value,
  CASE WHEN event_id % 6 <> 0 THEN replace(props, ' ', '') END AS props, CASE WHEN event_id % 4 = 0 THEN 'u' ELSE 'c' END AS op, event_id % 6 = 0 AS props_unavailable
FROM events WHERE event_id % 50 <> 49""",
    "envelope_meta": """SELECT event_id AS kafka_offset, CASE WHEN event_id % 4 = 0 THEN 'u' ELSE 'c' END AS operation, TIMESTAMP '2023-11-14 22:13:20' AS db_updated_at, 'public.events' AS full_table_name, 'events__history' AS dest_table
FROM events WHERE event_id % 50 <> 49""",
    "decimal_decode": """SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(18, 2)) AS price,
  CAST(CAST(CASE WHEN o_orderkey % 2 = 0 THEN -o_totalprice ELSE o_totalprice END AS DECIMAL(18, 2)) AS VARCHAR) AS price_text FROM orders""",
    "scalar_decoders": """SELECT event_id, date_trunc('millisecond', ts) AS from_ms, CASE WHEN event_id % 9 <> 0 THEN ts END AS from_us, ts AS from_ns, strftime(date_trunc('millisecond', ts), '%H:%M:%S.%f') AS clock_ms,
  date_trunc('second', ts) - INTERVAL 2 HOUR AS zoned, CASE WHEN event_id % 3 <> 0 THEN value END AS number, event_type AS bytes_text FROM events""",
    "text_arrays": "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN event_type || '|' || user_id END AS items FROM events",
    "key_parse": """
WITH k AS (SELECT topic, kafka_partition, kafka_offset, decode(msg_key) AS k FROM change_messages WHERE msg_key IS NOT NULL)
SELECT topic, kafka_partition, kafka_offset, CAST(CAST(CASE WHEN k LIKE 'Struct{%' THEN regexp_extract(k, '[{,]\\s*id=([^,}]*)', 1)
  ELSE coalesce(CAST(k AS JSON)->>'$.payload.id', CAST(k AS JSON)->>'$.id') END AS DOUBLE) AS BIGINT) AS key_id FROM k""",
    "message_fold": f"""WITH {_MESSAGES}, u AS (SELECT db, table_name, row_id, lsn, after_row->>'$.email' AS email FROM m WHERE op IN ('c', 'u', 'r') AND row_id IS NOT NULL AND lsn IS NOT NULL),
sent AS (SELECT db, table_name, row_id, email FROM u WHERE email IS DISTINCT FROM '{_PH}' QUALIFY row_number() OVER (PARTITION BY db, table_name, row_id ORDER BY lsn DESC) = 1),
last AS (SELECT db, table_name, row_id, max(lsn) AS lsn FROM u GROUP BY ALL)
SELECT l.db, l.table_name, l.row_id, CASE WHEN s.row_id IS NULL THEN '{_PH}' ELSE s.email END AS email, l.lsn
FROM last l LEFT JOIN sent s ON l.db = s.db AND l.table_name = s.table_name AND l.row_id = s.row_id""",
    "skip_applied": """
WITH r AS (SELECT topic, kafka_partition, max(next_offset) AS nxt FROM sync_runs WHERE lower(trim(run_status)) = 'committed' GROUP BY ALL)
SELECT DISTINCT m.topic, m.kafka_partition, m.kafka_offset FROM change_messages m LEFT JOIN r ON m.topic = r.topic AND m.kafka_partition = r.kafka_partition
WHERE octet_length(m.msg_value) > 0 AND (r.nxt IS NULL OR m.kafka_offset >= r.nxt)""",
    "document_rows": """
WITH j AS (SELECT rec_id, CAST(msg_value AS JSON) AS j FROM doc_messages WHERE json_valid(msg_value)),
p AS (SELECT rec_id, j->>'$.payload.op' AS op, j->>'$.payload.source.collection' AS collection,
  CASE WHEN j->>'$.payload.op' = 'd' THEN j->>'$.payload.before' ELSE j->>'$.payload.after' END AS r FROM j WHERE json_type(j->'$.payload') = 'OBJECT'),
q AS (SELECT rec_id, op, collection, CAST(r AS JSON) AS r FROM p)
SELECT rec_id, op, collection, coalesce(r->>'$._id."$oid"', r->>'$._id."$numberLong"', r->>'$._id') AS doc_key,
  CASE WHEN json_type(r->'$.orders') = 'ARRAY' THEN CAST(json_array_length(r->'$.orders') AS BIGINT) END AS orders,
  CASE WHEN json_type(r->'$.orders') = 'ARRAY' THEN coalesce(r->>'$.orders[0].no."$numberLong"', r->>'$.orders[0].no') END AS first_no FROM q""",
    "tracking_rows": """SELECT event_type AS table_name, CAST(event_id AS VARCHAR) AS id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS "timestamp", event_type AS event, 'extra' AS user_id, 'free' AS plan FROM events WHERE event_id % 20 <> 0""",
    "row_images": f"""WITH {_MESSAGES}, b AS (SELECT topic, kafka_partition, kafka_offset, j->>'$.payload.before.email' AS before_email FROM parsed)
SELECT m.topic, m.kafka_partition, m.kafka_offset, CASE WHEN m.op = 'd' THEN b.before_email ELSE m.after_row->>'$.email' END AS email, m.op = 'd' AS is_deleted, m.op = 'd' AS only_set_delete
FROM m JOIN b ON m.topic = b.topic AND m.kafka_partition = b.kafka_partition AND m.kafka_offset = b.kafka_offset""",
    "schema_infer": """SELECT * FROM (VALUES ('event_id', 'float'), ('event_type', 'string'), ('value', 'float'), ('props_text', 'struct'), ('props', 'struct'), ('list', 'array'), ('nothing', 'invalid'), ('flag', 'bool')) t(field, kind)""",
    "schema_diff_add": "SELECT *, CAST(NULL AS VARCHAR) AS c_tier, CAST(NULL AS DOUBLE) AS c_score FROM customer",
    "cast_to_target": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS o_totalprice, CAST(o_custkey AS INTEGER) AS o_custkey FROM orders",
    "default_backfill": "SELECT * REPLACE (CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE 'UNKNOWN' END AS c_mktsegment) FROM customer",
    "mask_hash": f"SELECT {_HASH_COLS}, sha256(c_name) AS c_name, sha256(CAST(c_nationkey AS VARCHAR)) AS c_nationkey FROM customer",
    "mask_hmac": f"SELECT * REPLACE (sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(c_name)))) AS c_name) FROM customer",
    "mask_encrypt": "SELECT c_custkey, c_name, CAST(28 AS BIGINT) AS overhead FROM customer",
    "columns_include": "SELECT c_custkey, c_name FROM customer",
    "columns_exclude": "SELECT * EXCLUDE (c_acctbal) FROM customer",
    "static_columns": "SELECT *, 'world' AS region_group, 'erp' AS source_system FROM nation",
    "skip_operations": f"{_WITH} SELECT op, count(*) AS n FROM feed WHERE op NOT IN ('d', 'c') GROUP BY op",
    "overlength_marker": "SELECT doc_id, CASE WHEN octet_length(encode(title)) > 12 THEN '__cf_exceeded_value' ELSE title END AS title, rev_comment FROM documents",
    "overlength_truncate": "SELECT doc_id, CASE WHEN text IS NOT NULL THEN true END AS fits, octet_length(encode(text)) <= 200 AS whole, CASE WHEN text IS NOT NULL THEN true END AS is_prefix FROM documents",
    "redact_text": """SELECT event_id, 'postgres://app:[REDACTED]@db/x password=[REDACTED], mail [REDACTED] {"token": "[REDACTED]"} ssn [REDACTED] card [REDACTED]' AS clean FROM events""",
    "json_detect": "SELECT event_id, event_id % 4 = 3 AS is_json FROM events",
    "parse_timestamp": """
WITH e AS (SELECT event_id, ts, event_id % 6 AS k FROM events)
SELECT event_id, CASE WHEN k IN (0, 3) THEN date_trunc('second', ts) WHEN k = 1 THEN date_trunc('millisecond', ts) WHEN k = 2 THEN date_trunc('day', ts) END AS as_tz,
  CASE WHEN k = 5 THEN date_trunc('second', ts) END AS as_ntz, CASE WHEN k IN (0, 1, 2, 3) THEN CAST(ts AS DATE) END AS as_date FROM e""",
    "convert_kinds": """SELECT event_id, CASE WHEN value = floor(value) THEN CAST(value AS BIGINT) END AS as_int, CAST(value AS DECIMAL(10, 2)) AS as_decimal, event_id % 2 = 0 AS as_bool, CAST(NULL AS DOUBLE) AS as_float FROM events""",
    "value_texts": """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts_text, CASE WHEN value > 5 THEN '1' ELSE '0' END AS flag_text,
  '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS struct_text, event_type || chr(92) || chr(92) || 'x' AS escaped FROM events""",
    "type_texts": """
WITH t(dialect, "bool", "int", "float", "decimal", "string", "struct", "array", "bytes", "date", "time", "timestamp_ntz", "timestamp_tz", "uuid", "interval") AS (VALUES
  ('bigquery', 'bool', 'int64', 'float64', 'numeric', 'string', 'json', 'array<string>', 'bytes', 'date', 'time', 'datetime', 'timestamp', 'string', 'string'),
  ('clickhouse', 'Bool', 'Int64', 'Float64', 'String', 'String', 'JSON', 'Array(String)', 'String', 'Date', 'String', 'DateTime', 'DateTime', 'String', 'String'),
  ('databricks', 'BOOLEAN', 'BIGINT', 'DOUBLE', 'STRING', 'STRING', 'STRING', 'ARRAY<string>', 'BINARY', 'DATE', 'STRING', 'TIMESTAMP_NTZ', 'TIMESTAMP', 'STRING', 'STRING'),
  ('duckdb', 'boolean', 'bigint', 'double', 'decimal', 'text', 'json', 'text[]', 'blob', 'date', 'time', 'timestamp', 'timestamp with time zone', 'text', 'interval'),
  ('mssql', 'BIT', 'bigint', 'float', 'VARCHAR(MAX)', 'VARCHAR(MAX)', 'NVARCHAR(MAX)', 'NVARCHAR(MAX)', 'VARBINARY(MAX)', 'DATE', 'TIME', 'datetime2', 'datetimeoffset', 'VARCHAR(MAX)', 'NVARCHAR(MAX)'),
  ('mysql', 'BOOLEAN', 'BIGINT', 'DOUBLE', 'DECIMAL(65,30)', 'TEXT', 'JSON', 'JSON', 'BLOB', 'DATE', 'TIME(6)', 'DATETIME(6)', 'DATETIME(6)', 'TEXT', 'TEXT'),
  ('postgres', 'boolean', 'bigint', 'double precision', 'numeric', 'text', 'jsonb', 'text[]', 'bytea', 'date', 'time', 'timestamp without time zone', 'timestamp with time zone', 'uuid', 'interval'),
  ('redshift', 'BOOLEAN NULL', 'INT8', 'float', 'VARCHAR(MAX)', 'VARCHAR(MAX)', 'SUPER', 'VARCHAR(MAX)', 'VARBYTE', 'DATE', 'TIME', 'TIMESTAMP WITHOUT TIME ZONE', 'TIMESTAMP WITH TIME ZONE', 'VARCHAR(MAX)', 'VARCHAR(MAX)'),
  ('snowflake', 'boolean', 'int', 'float', 'string', 'string', 'variant', 'array', 'binary', 'date', 'time', 'timestamp_ntz', 'timestamp_tz', 'string', 'string'),
  ('spark', 'BOOLEAN', 'BIGINT', 'DOUBLE', 'STRING', 'STRING', 'STRING', 'STRING', 'BINARY', 'DATE', 'STRING', 'TIMESTAMP_NTZ', 'TIMESTAMP', 'STRING', 'STRING')
), every AS (
  FROM (UNPIVOT t ON "bool", "int", "float", "decimal", "string", "struct", "array", "bytes", "date", "time", "timestamp_ntz", "timestamp_tz", "uuid", "interval" INTO NAME kind VALUE type_text)
  UNION ALL SELECT dialect, 'invalid', "string" FROM t
)
SELECT dialect, kind, type_text, CASE WHEN kind = 'invalid' THEN 'string' ELSE CASE WHEN dialect = 'bigquery' AND kind = 'uuid' THEN 'string' WHEN dialect = 'bigquery' AND kind = 'interval' THEN 'string' WHEN dialect = 'clickhouse' AND kind = 'decimal' THEN 'string' WHEN dialect = 'clickhouse' AND kind = 'bytes' THEN 'string' WHEN dialect = 'clickhouse' AND kind = 'time' THEN 'string' WHEN dialect = 'clickhouse' AND kind = 'timestamp_ntz' THEN 'timestamp_tz' WHEN dialect = 'clickhouse' AND kind = 'uuid' THEN 'string' WHEN dialect = 'clickhouse' AND kind = 'interval' THEN 'string' WHEN dialect = 'databricks' AND kind = 'decimal' THEN 'string' WHEN dialect = 'databricks' AND kind = 'struct' THEN 'string' WHEN dialect = 'databricks' AND kind = 'time' THEN 'string' WHEN dialect = 'databricks' AND kind = 'uuid' THEN 'string' WHEN dialect = 'databricks' AND kind = 'interval' THEN 'string' WHEN dialect = 'duckdb' AND kind = 'uuid' THEN 'string' WHEN dialect = 'mssql' AND kind = 'decimal' THEN 'string' WHEN dialect = 'mssql' AND kind = 'struct' THEN 'string' WHEN dialect = 'mssql' AND kind = 'array' THEN 'string' WHEN dialect = 'mssql' AND kind = 'uuid' THEN 'string' WHEN dialect = 'mssql' AND kind = 'interval' THEN 'string' WHEN dialect = 'mysql' AND kind = 'array' THEN 'struct' WHEN dialect = 'mysql' AND kind = 'timestamp_tz' THEN 'timestamp_ntz' WHEN dialect = 'mysql' AND kind = 'uuid' THEN 'string' WHEN dialect = 'mysql' AND kind = 'interval' THEN 'string' WHEN dialect = 'redshift' AND kind = 'decimal' THEN 'string' WHEN dialect = 'redshift' AND kind = 'array' THEN 'string' WHEN dialect = 'redshift' AND kind = 'uuid' THEN 'string' WHEN dialect = 'redshift' AND kind = 'interval' THEN 'string' WHEN dialect = 'snowflake' AND kind = 'decimal' THEN 'string' WHEN dialect = 'snowflake' AND kind = 'uuid' THEN 'string' WHEN dialect = 'snowflake' AND kind = 'interval' THEN 'string' WHEN dialect = 'spark' AND kind = 'decimal' THEN 'string' WHEN dialect = 'spark' AND kind = 'struct' THEN 'string' WHEN dialect = 'spark' AND kind = 'array' THEN 'string' WHEN dialect = 'spark' AND kind = 'time' THEN 'string' WHEN dialect = 'spark' AND kind = 'uuid' THEN 'string' WHEN dialect = 'spark' AND kind = 'interval' THEN 'string' ELSE kind END END AS read_back, 'col_1st__order__' AS escaped_name FROM every""",
    "message_json": """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS message FROM nation""",
    "sample_scan": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 50",
}
