"""Queries of the engine's own operators, over change feeds built from the test tables by arithmetic on keys."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TopicConfig
from ..functions import decode, masking, redact, text
from ..kinds import TYPE_TEXT, Kind, decimal_kind, escape_name, kind_from_text, type_text
from ..operators import batch, dedupe, evolve, fold, merge, route, transform
from ..sinks import files
from ..sources import documents, frames, relational, tracking
from ..sources.frames import UNAVAILABLE, read_table
from ..streaming import apply

KEYS = ["o_orderkey"]
COLUMNS = ["o_orderstatus", "o_totalprice", "o_orderpriority", "o_orderdate"]
DELETE, ONLY = "__cf_delete", "__cf_only_set_delete"
SALT = "pepper"
KIND_NAMES = ("bool", "int", "float", "decimal", "string", "struct", "array", "bytes", "date", "time", "timestamp_ntz", "timestamp_tz", "uuid", "interval", "invalid")
KEY = masking.key_of("a passphrase for tests")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select(*KEYS, *COLUMNS)


def base(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d).where("o_orderkey % 5 <> 0")


def feed(spark: SparkSession, d: str, delete_seq: int = 3, placeholder: bool = True) -> DataFrame:
    """Creates (keys in fives), updates (in threes), deletes (in sevens); each order is read once."""
    key = F.col("o_orderkey")
    hidden = F.when(key % 2 == 0, F.lit(UNAVAILABLE)).otherwise(F.col("o_orderpriority")) if placeholder else F.col("o_orderpriority")
    row = lambda op, seq, status, price, priority: F.struct(F.lit(op).alias("op"), F.lit(seq).cast("bigint").alias("seq"), status.alias("s"), price.alias("p"), priority.alias("y"))
    s, p, y = F.col("o_orderstatus"), F.col("o_totalprice"), F.col("o_orderpriority")
    events = F.array(
        F.when(key % 5 == 0, row("c", 1, s, p, y)), F.when(key % 3 == 0, row("u", 2, F.lit("X"), p + 1, hidden)), F.when(key % 7 == 0, row("d", delete_seq, s, p, y))
    )
    e = _orders(spark, d).select("o_orderkey", "o_orderdate", F.explode(F.array_compact(events)).alias("e"))
    return e.select("o_orderkey", F.col("e.s").alias("o_orderstatus"), F.col("e.p").alias("o_totalprice"), F.col("e.y").alias("o_orderpriority"), "o_orderdate", F.col("e.op").alias("op"), F.col("e.seq").alias("seq"))


def _fold(changes: DataFrame) -> DataFrame:
    return fold.fold(changes, KEYS, ["seq"], "op", COLUMNS)


def _flags(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({DELETE: "is_deleted", ONLY: "only_set_delete"})


def fold_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return _flags(_fold(feed(spark, d, placeholder=False).where("op <> 'd'")))


def fold_unavailable_carry(spark: SparkSession, d: str) -> DataFrame:
    return _flags(_fold(feed(spark, d).where("op <> 'd'")))


def fold_delete_keeps_previous(spark: SparkSession, d: str) -> DataFrame:
    return _flags(_fold(feed(spark, d)))


def fold_delete_first(spark: SparkSession, d: str) -> DataFrame:
    return _flags(_fold(feed(spark, d, delete_seq=0)))


def fold_maps(spark: SparkSession, d: str) -> DataFrame:
    """The exact fold, rows as maps; the same result as the fast one on these changes."""
    e = feed(spark, d)
    as_map = F.create_map(F.lit("o_orderstatus"), F.col("o_orderstatus"), F.lit("o_totalprice"), F.col("o_totalprice").cast("string"), F.lit("o_orderpriority"), F.col("o_orderpriority"))
    out = fold.fold_maps(e.select(*KEYS, "seq", "op", as_map.alias("row")), KEYS, "seq", "op", "row", run=2)
    return _flags(out.select(*KEYS, F.col("row")["o_orderstatus"].alias("o_orderstatus"), F.col("row")["o_totalprice"].cast("double").alias("o_totalprice"), F.col("row")["o_orderpriority"].alias("o_orderpriority"), DELETE, ONLY, "seq"))


def batch_flags(spark: SparkSession, d: str) -> DataFrame:
    return fold.batch_flags(feed(spark, d), "op").drop("bytes")


def latest_event(spark: SparkSession, d: str) -> DataFrame:
    """The time of the last saved (not the latest) event of each user."""
    e = read_table(spark, d, "events")
    return fold.latest_event(e, ["user_id"], "ts", "event_id").withColumnRenamed("last_at", "last_ts")


def _staged(spark: SparkSession, d: str) -> DataFrame:
    return _fold(feed(spark, d)).drop("seq")


def merge_hard_delete(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge(base(spark, d), _staged(spark, d), KEYS, placeholder_columns=["o_orderpriority"])


def merge_soft_delete(spark: SparkSession, d: str) -> DataFrame:
    target = base(spark, d).withColumn(DELETE, F.lit(False))
    out = merge.merge(target, _staged(spark, d), KEYS, soft_delete=True, placeholder_columns=["o_orderpriority"])
    return out.withColumnRenamed(DELETE, "is_deleted")


def merge_split_update(spark: SparkSession, d: str) -> DataFrame:
    return merge.split_update(base(spark, d), _staged(spark, d), KEYS, ["o_orderpriority"])


def merge_split_insert(spark: SparkSession, d: str) -> DataFrame:
    return merge.split_insert(base(spark, d), _staged(spark, d), KEYS).drop(DELETE, ONLY)


def merge_split_delete(spark: SparkSession, d: str) -> DataFrame:
    return merge.split_delete(base(spark, d), _staged(spark, d), KEYS)


def merge_null_safe_key(spark: SparkSession, d: str) -> DataFrame:
    """The key 11 is null on both sides, one row on either: the two nulls match."""
    nulled = lambda df: df.withColumn("o_orderkey", F.when(F.col("o_orderkey") != 11, F.col("o_orderkey")))
    staged = nulled(_orders(spark, d).where("o_orderkey = 11 or o_orderkey % 13 = 0")).withColumns({"o_orderstatus": F.lit("N"), DELETE: F.lit(False), ONLY: F.lit(False)})
    return merge.merge(nulled(base(spark, d)), staged, KEYS, null_safe=True)


def merge_partition_pruned(spark: SparkSession, d: str) -> DataFrame:
    """A batch of one quarter: only the target's rows of its dates take part in the join."""
    of = F.col("o_orderdate") < "1995-04-01"
    staged = _staged(spark, d).where(of)
    return merge.merge_pruned(base(spark, d), staged, KEYS, "o_orderdate", placeholder_columns=["o_orderpriority"])


def merge_moved_date(spark: SparkSession, d: str) -> DataFrame:
    """The same with dates that move by forty days for every ninth key: each is found where it was, and no key is doubled."""
    days = F.when(F.col("o_orderkey") % 9 == 0, F.lit(40)).otherwise(F.lit(0))
    staged = _staged(spark, d).where(F.col("o_orderdate") < "1995-04-01").withColumn("o_orderdate", F.col("o_orderdate") + F.make_dt_interval(days))
    return merge.merge_pruned(base(spark, d), staged, KEYS, "o_orderdate", placeholder_columns=["o_orderpriority"])


def merge_extra_predicate(spark: SparkSession, d: str) -> DataFrame:
    """The date joins besides the key; a staged row with another date doesn't match and is inserted."""
    moved = _staged(spark, d).withColumn("o_orderdate", F.when(F.col("o_orderkey") % 9 == 0, F.col("o_orderdate") + F.expr("interval 1 day")).otherwise(F.col("o_orderdate")))
    return merge.merge(base(spark, d), moved, KEYS, placeholder_columns=["o_orderpriority"], extra=["o_orderdate"])


def merge_counts(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_counts(base(spark, d), _staged(spark, d), KEYS)


def staging_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Three flushes folded onto each other, then merged: the same as one."""
    e = feed(spark, d)
    step = [_fold(e.where(f"seq = {i}")).drop("seq") for i in (1, 2, 3)]
    pending = merge.upsert_staging(merge.upsert_staging(step[0], step[1], KEYS, ["o_orderpriority"]), step[2], KEYS, ["o_orderpriority"])
    return merge.merge(base(spark, d), pending, KEYS, placeholder_columns=["o_orderpriority"])


def _repeated(spark: SparkSession, d: str) -> DataFrame:
    """Orders, a fifth of them three times, with a version."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    copies = F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).when(F.col("o_orderkey") % 5 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return o.withColumn("version", F.explode(copies)).withColumn("o_totalprice", F.col("o_totalprice") + F.col("version"))


def dedupe_latest(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.dedupe(_repeated(spark, d), ["o_orderkey"], ["version"])


def dedupe_second(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.dedupe(_repeated(spark, d), ["o_orderkey"], ["version"], "second")


def dedupe_identity(spark: SparkSession, d: str) -> DataFrame:
    return dedupe.dedupe_by_identity(_repeated(spark, d), ["o_orderkey"], "version")


def history_append(spark: SparkSession, d: str) -> DataFrame:
    e = feed(spark, d)
    rows = route.history_rows(e).withColumnRenamed("__cf_operation", "operation").drop("op")
    return route.append(base(spark, d).withColumns({"seq": F.lit(0).cast("bigint"), "operation": F.lit("r")}), rows)


def append_only_fold(spark: SparkSession, d: str) -> DataFrame:
    rows = _staged(spark, d).drop(ONLY).withColumnRenamed(DELETE, "is_deleted")
    return route.append(base(spark, d), rows)


def latest_view(spark: SparkSession, d: str) -> DataFrame:
    every = base(spark, d).withColumns({"seq": F.lit(0).cast("bigint"), DELETE: F.lit(False)})
    rows = _fold(feed(spark, d)).drop(ONLY)
    return route.latest_view(route.append(every, rows), KEYS, "seq").drop(DELETE)


def soft_partition_route(spark: SparkSession, d: str) -> DataFrame:
    """Events by day; tables of odd days exist."""
    e = read_table(spark, d, "events")
    existing = e.where("day(ts) % 2 = 1").select(F.concat(F.lit("events"), route.partition_suffix(F.col("ts"), "daily")).alias("table_name")).distinct()
    now = F.lit(datetime(2024, 1, 31)).cast("timestamp_ntz")
    routed = route.soft_partition(e, "ts", "daily", now, "events", existing)
    return routed.groupBy("dest_table").agg(F.count("*").alias("events"))


def partition_distance(spark: SparkSession, d: str) -> DataFrame:
    now = F.lit(datetime(2024, 3, 1, 12)).cast("timestamp_ntz")
    e = read_table(spark, d, "events")
    return e.select("event_id", *[route.partition_distance(F.col("ts"), now, f).alias(f) for f in ("monthly", "daily", "hourly")], *[route.partition_suffix(F.col("ts"), f).alias(f"{f}_suffix") for f in ("monthly", "hourly")])


def distinct_dates(spark: SparkSession, d: str) -> DataFrame:
    return merge.distinct_dates(read_table(spark, d, "orders"), "o_orderdate")


def batch_by_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Events of a user in batches of at most 40 bytes of properties."""
    e = read_table(spark, d, "events").select("user_id", "event_id", "props")
    return batch.batch_by_bytes(e, ["user_id"], ["event_id"], "props", 40)


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Relational change messages, with the schema in each, made from events."""
    e = read_table(spark, d, "events")
    fields = [("id", "int64", None), ("day", "int32", "io.debezium.time.Date"), ("at", "int64", "io.debezium.time.MicroTimestamp"), ("clock", "int64", "io.debezium.time.MicroTime"), ("kind", "string", None), ("value", "double", None), ("props", "string", "io.debezium.data.Json")]
    schema = ",".join(f'{{"field":"{n}","type":"{t}"' + (f',"name":"{k}"' if k else "") + "}" for n, t, k in fields)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    row = F.to_json(F.struct(F.col("event_id").alias("id"), F.floor(micros / 86_400_000_000).alias("day"), micros.alias("at"), (micros % 86_400_000_000).alias("clock"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 10 == 0, F.lit("NaN")).otherwise(F.col("value").cast("string")).alias("value"), F.when(F.col("event_id") % 6 == 0, F.lit(UNAVAILABLE)).otherwise(F.col("props")).alias("props")))
    value = F.concat(F.lit('{"schema":{"type":"struct","fields":[{"field":"before","type":"struct"},{"field":"after","type":"struct","fields":[' + schema + ']}]},"payload":{"before":null,"after":'), row, F.lit(',"source":{"db":"shop","schema":"public","table":"events","ts_ms":1700000000000},"op":"'), F.when(F.col("event_id") % 4 == 0, F.lit("u")).otherwise(F.lit("c")), F.lit('","ts_ms":1700000000001}}'))
    value = F.when(F.col("event_id") % 50 == 49, F.lit("")).otherwise(value)
    return e.select(F.lit("shop.public.events").alias("topic"), (F.col("event_id") % 4).cast("int").alias("kafka_partition"), F.col("event_id").alias("kafka_offset"), value.cast("binary").alias("msg_value"))


def envelope_decode(spark: SparkSession, d: str) -> DataFrame:
    e = relational.with_image(relational.envelopes(_messages(spark, d)))
    t = relational.typed_rows(e)
    return t.select("id", "day", "at", "clock", "kind", "value", "props", "op", F.array_contains("unavailable", "props").alias("props_unavailable"))


def envelope_meta(spark: SparkSession, d: str) -> DataFrame:
    cfg = TopicConfig("t", "public", operation=True, db_updated_at=True, full_table_name=True)
    e = transform.meta_columns(relational.envelopes(_messages(spark, d)), cfg)
    return e.select("kafka_offset", F.col("__cf_operation").alias("operation"), F.col("__cf_db_updated_at").cast("timestamp_ntz").alias("db_updated_at"), F.col("__cf_full_table_name").alias("full_table_name"), transform.table_name(cfg, F.col("source.table"), history=True).alias("dest_table"))


def decimal_decode(spark: SparkSession, d: str) -> DataFrame:
    """Prices in cents as big-endian bytes in base64, some negative, back to decimals."""
    o = read_table(spark, d, "orders")
    cents = F.when(F.col("o_orderkey") % 2 == 0, -F.round(F.col("o_totalprice") * 100)).otherwise(F.round(F.col("o_totalprice") * 100)).cast("bigint")
    coded = F.base64(F.unhex(F.lpad(F.hex(cents), 16, "0")))
    return o.select("o_orderkey", decode.fixed_decimal(coded, 2, 18).alias("price"), decode.any_decimal(coded, F.lit(2)).alias("price_text"))


def scalar_decoders(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    far = F.when(F.col("event_id") % 9 == 0, us + F.lit(253402300800000000)).otherwise(us)
    return e.select(
        "event_id", decode.timestamp(F.floor(us / 1000), "ms").alias("from_ms"), decode.timestamp(far, "us").alias("from_us"), decode.timestamp(us * 1000, "ns").alias("from_ns"),
        decode.clock(F.floor(us / 1000) % 86_400_000, "ms").alias("clock_ms"), decode.zoned_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).cast("timestamp_ntz").alias("zoned"),
        decode.double(F.when(F.col("event_id") % 3 == 0, F.lit("NaN")).otherwise(F.col("value").cast("string"))).alias("number"), decode.binary(F.base64(F.col("event_type").cast("binary"))).cast("string").alias("bytes_text"),
    )


def text_arrays(spark: SparkSession, d: str) -> DataFrame:
    """JSON lists as lists of text, placeholders as null; as one text for comparing."""
    e = read_table(spark, d, "events")
    listed = F.when(F.col("event_id") % 4 == 0, F.lit(f'["{UNAVAILABLE}"]')).otherwise(F.concat(F.lit('["'), F.col("event_type"), F.lit('",'), F.col("user_id"), F.lit("]")))
    return e.select("event_id", F.array_join(decode.text_array(listed), "|").alias("items"))


def key_parse(spark: SparkSession, d: str) -> DataFrame:
    """The id in message keys of every form."""
    m = read_table(spark, d, "change_messages").where("msg_key is not null")
    k = F.col("msg_key").cast("string")
    return m.select("topic", "kafka_partition", "kafka_offset", frames.whole_number(frames.key_field(k, "id")).alias("key_id"))


def message_fold(spark: SparkSession, d: str) -> DataFrame:
    """Real change messages folded by row: last operation, and the e-mail that was last sent."""
    m = frames.parse_messages(read_table(spark, d, "change_messages")).where("row_id is not null and lsn is not null and op in ('c', 'u', 'r')")
    m = m.select("db", "table_name", "row_id", "lsn", "op", F.get_json_object("after", "$.email").alias("email"))
    f = fold.fold(m, ["db", "table_name", "row_id"], ["lsn"], "op", ["email"])
    return f.select("db", "table_name", "row_id", "email", "lsn")


def skip_applied(spark: SparkSession, d: str) -> DataFrame:
    """Frames above the last committed offset of their partition; tombstones are none."""
    m = read_table(spark, d, "change_messages").where("octet_length(msg_value) > 0").select("topic", "kafka_partition", "kafka_offset")
    return apply.skip_applied(m, read_table(spark, d, "sync_runs").where("lower(trim(run_status)) = 'committed'"))


def document_rows(spark: SparkSession, d: str) -> DataFrame:
    """Row images of document messages in plain JSON: the id, and how many keys are left wrapped."""
    m = read_table(spark, d, "doc_messages").select("rec_id", "msg_value")
    r = documents.document_rows(m)
    return r.select("rec_id", "op", "collection", F.get_json_object("row", "$._id").alias("doc_key"), F.json_array_length(F.get_json_object("row", "$.orders")).cast("bigint").alias("orders"), F.get_json_object("row", "$.orders[0].no").alias("first_no"))


def tracking_rows(spark: SparkSession, d: str) -> DataFrame:
    """Tracking messages made from events; every twentieth lacks its id and is invalid."""
    e = read_table(spark, d, "events")
    value = F.concat(F.lit('{"event":"'), F.col("event_type"), F.lit('","timestamp":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z","messageID":"'), F.when(F.col("event_id") % 20 == 0, F.lit("")).otherwise(F.col("event_id").cast("string")), F.lit('","properties":{"user_id":'), F.col("user_id"), F.lit(',"id":"p"},"extraFields":{"user_id":"extra","plan":"free"}}'))
    r = tracking.tracked_rows(e.select(value.alias("msg_value")))
    return r.select("table_name", F.col("row")["id"].alias("id"), F.col("row")["timestamp"].alias("timestamp"), F.col("row")["event"].alias("event"), F.col("row")["user_id"].alias("user_id"), F.col("row")["plan"].alias("plan"))


def schema_infer(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    rows = e.select(F.to_json(F.struct("event_id", "event_type", "value", F.col("props").alias("props_text"), F.from_json("props", "map<string,bigint>").alias("props"), F.array("user_id").alias("list"), F.lit(None).cast("string").alias("nothing"), (F.col("value") > 5).alias("flag")), {"ignoreNullFields": "false"}).alias("row"))
    return relational.infer_kinds(rows)


def schema_diff_add(spark: SparkSession, d: str) -> DataFrame:
    """Customers get the columns that a batch has and they lack."""
    c = read_table(spark, d, "customer")
    new = T.StructType([*c.schema.fields, T.StructField("c_tier", T.StringType()), T.StructField("c_score", T.DoubleType()), T.StructField("C_NAME", T.StringType())])
    return evolve.add_columns(c, new)


def cast_to_target(spark: SparkSession, d: str) -> DataFrame:
    """Staged text in the target's types; what doesn't fit is null."""
    staged = read_table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string")).alias("O_TOTALPRICE"), F.col("o_custkey").cast("string").alias("o_custkey"))
    target = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_custkey", T.IntegerType())])
    return evolve.cast_to_target(staged, target)


def default_backfill(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 3 != 0, F.col("c_mktsegment")))
    return evolve.backfill(c, {"c_mktsegment": "UNKNOWN", "c_name": None}, ["c_custkey"])[0]


def mask_hash(spark: SparkSession, d: str) -> DataFrame:
    return transform.hash_columns(read_table(spark, d, "customer"), ["c_name", "c_nationkey"])


def mask_hmac(spark: SparkSession, d: str) -> DataFrame:
    return transform.hash_columns(read_table(spark, d, "customer"), ["c_name"], SALT)


def mask_encrypt(spark: SparkSession, d: str) -> DataFrame:
    """Encrypted and decrypted again; the ciphertext, random each time, shows only its length."""
    c = transform.encrypt_columns(read_table(spark, d, "customer").withColumn("plain", F.col("c_name")), ["c_name"], KEY)
    return c.select("c_custkey", masking.decrypt(F.col("c_name"), KEY).alias("c_name"), (F.length(F.unbase64("c_name")) - F.length("plain")).cast("bigint").alias("overhead"))


def columns_include(spark: SparkSession, d: str) -> DataFrame:
    return transform.include_columns(read_table(spark, d, "customer"), ["c_custkey", "c_name"], ["c_custkey"])


def columns_exclude(spark: SparkSession, d: str) -> DataFrame:
    return transform.exclude_columns(read_table(spark, d, "customer"), ["c_acctbal", "no_such_column"])


def static_columns(spark: SparkSession, d: str) -> DataFrame:
    return transform.static_columns(read_table(spark, d, "nation"), {"region_group": "world", "source_system": "erp"})


def skip_operations(spark: SparkSession, d: str) -> DataFrame:
    cfg = TopicConfig("t", "s", skip_operations=" D, c")
    return transform.skip_operations(feed(spark, d), cfg.skipped()).groupBy("op").agg(F.count("*").alias("n"))


def row_images(spark: SparkSession, d: str) -> DataFrame:
    """Row image and markers of each real change message."""
    m = frames.parse_messages(read_table(spark, d, "change_messages")).select("topic", "kafka_partition", "kafka_offset", "op", "before", "after")
    i = relational.with_image(m)
    return i.select("topic", "kafka_partition", "kafka_offset", F.get_json_object("row", "$.email").alias("email"), F.col(DELETE).alias("is_deleted"), F.col(ONLY).alias("only_set_delete"))


def overlength_marker(spark: SparkSession, d: str) -> DataFrame:
    t = read_table(spark, d, "documents")
    return t.select("doc_id", text.overlong(F.col("title"), 12).alias("title"), text.overlong(F.col("rev_comment"), 10, "widen").alias("rev_comment"))


def overlength_truncate(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut to 200 bytes at most, whole characters."""
    t = read_table(spark, d, "documents")
    cut = text.overlong(F.col("text"), 200, "truncate")
    return t.select("doc_id", (F.octet_length(cut) <= 200).alias("fits"), (F.octet_length("text") <= 200).alias("whole"), F.startswith("text", cut).alias("is_prefix"))


def redact_text(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    raw = F.concat(F.lit("postgres://app:s3cret"), F.col("user_id"), F.lit("@db/x password="), F.col("event_type"), F.lit(", mail u"), F.col("event_id"), F.lit('@mail.example {"token": "t'), F.col("event_id"), F.lit('"} ssn 123-45-6789 card 4111 1111 1111 1111'))
    return e.select("event_id", redact.redact(raw).alias("clean"))


def json_detect(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    mixed = F.when(F.col("event_id") % 4 == 0, F.col("event_type")).when(F.col("event_id") % 4 == 1, F.lit("{broken")).when(F.col("event_id") % 4 == 2, F.lit("12")).otherwise(F.col("props"))
    return e.select("event_id", text.is_json(mixed).alias("is_json"))


def parse_timestamp(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    k = F.col("event_id") % 6
    s = (
        F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")).when(k == 2, F.date_format("ts", "yyyy-MM-dd"))
        .when(k == 3, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss +0000")).when(k == 4, F.date_format("ts", "dd.MM.yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    return e.select("event_id", text.parse_timestamp_tz(s).cast("timestamp_ntz").alias("as_tz"), text.parse_timestamp_ntz(s).alias("as_ntz"), text.parse_date(s).alias("as_date"))


def convert_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Text to values by kind; what doesn't fit is null."""
    e = read_table(spark, d, "events")
    return e.select(
        "event_id", text.convert(F.col("value").cast("string"), Kind("int")).alias("as_int"), text.convert(F.col("value").cast("string"), decimal_kind(10, 2)).alias("as_decimal"),
        text.convert(F.when(F.col("event_id") % 2 == 0, F.lit("TRUE")).otherwise(F.lit("0")), Kind("bool")).alias("as_bool"), text.convert(F.col("event_type"), Kind("float")).alias("as_float"),
    )


def value_texts(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    return e.select("event_id", text.to_text(F.col("ts"), Kind("timestamp_ntz")).alias("ts_text"), text.to_text(F.col("value") > 5, Kind("bool"), binary_bool=True).alias("flag_text"), text.to_text(F.struct("user_id", "event_type"), Kind("struct")).alias("struct_text"), text.escape_backslashes(F.concat(F.col("event_type"), F.lit("\\x"))).alias("escaped"))


def type_texts(spark: SparkSession, d: str) -> DataFrame:
    """Type text of kinds in each dialect, and the kind read back; names of columns as they are escaped."""
    rows = [(dialect, name, type_text(Kind(name), dialect), kind_from_text(type_text(Kind(name), dialect), dialect).name) for dialect in sorted(TYPE_TEXT) for name in KIND_NAMES]
    return spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("dialect"), F.lit(b).alias("kind"), F.lit(c).alias("type_text"), F.lit(e).alias("read_back")) for a, b, c, e in rows])).alias("r")).select("r.*", F.lit(escape_name("1st Order#")).alias("escaped_name"))


def message_json(spark: SparkSession, d: str) -> DataFrame:
    """Rows as the messages that a queue gets."""
    return files.messages(read_table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"))


def sample_scan(spark: SparkSession, d: str) -> DataFrame:
    """The first fifty orders by key: the sampling operator."""
    return frames.sample_rows(read_table(spark, d, "orders"), ["o_orderkey"])


QUERIES = {
    f.__name__: f
    for f in (
        fold_last_wins, fold_unavailable_carry, fold_delete_keeps_previous, fold_delete_first, fold_maps, batch_flags, latest_event,
        merge_hard_delete, merge_soft_delete, merge_split_update, merge_split_insert, merge_split_delete, merge_null_safe_key, merge_partition_pruned, merge_moved_date, merge_extra_predicate, merge_counts, staging_upsert,
        dedupe_latest, dedupe_second, dedupe_identity, history_append, append_only_fold, latest_view, soft_partition_route, partition_distance, distinct_dates, batch_by_bytes,
        envelope_decode, envelope_meta, decimal_decode, scalar_decoders, text_arrays, key_parse, message_fold, skip_applied, document_rows, tracking_rows, row_images,
        schema_infer, schema_diff_add, cast_to_target, default_backfill, mask_hash, mask_hmac, mask_encrypt, columns_include, columns_exclude, static_columns, skip_operations,
        overlength_marker, overlength_truncate, redact_text, json_detect, parse_timestamp, convert_kinds, value_texts, type_texts, message_json, sample_scan,
    )
}
