"""Queries of tables, sinks, streams, settings and the less common functions, over the same test tables."""

from __future__ import annotations

import json
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import table
from ..config import TopicConfig, from_text
from ..functions import decode, masking, text
from ..kinds import Kind
from ..operators import evolve, fold, merge, transform
from ..pipeline import Topic
from ..shared import fresh_path
from ..sinks import dialects, files
from ..sources import documents, frames, tracking
from ..sources.frames import UNAVAILABLE, read_table
from ..streaming import apply
from .reference import KEY, KEYS, _fold, _messages, _staged, base, feed


def _rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a plan without a job of Python's."""
    fields = [f.split() for f in schema.split(", ")]
    one = lambda r: F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(r, fields, strict=True)])
    return spark.range(1).select(F.explode(F.array(*[one(r) for r in rows])).alias("r")).select("r.*")


# ---------------------------------------------------------------- tables


def table_merge(spark: SparkSession, d: str) -> DataFrame:
    """The hard merge through a table: created by one batch, merged into by another, which is offered twice."""
    t = table.VersionedTable(spark, fresh_path(spark, "table"))
    table.merge_batch(t, base(spark, d).withColumns({"__cf_delete": F.lit(False), "__cf_only_set_delete": F.lit(False)}), KEYS, 1, buckets=16)
    for _ in range(2):
        table.merge_batch(t, _staged(spark, d), KEYS, 2, placeholder_columns=["o_orderpriority"])
    return t.read()


def table_touched(spark: SparkSession, d: str) -> DataFrame:
    """How many of 64 buckets a batch of three keys rewrites, at most three."""
    t = table.VersionedTable(spark, fresh_path(spark, "table"))
    marked = base(spark, d).withColumns({"__cf_delete": F.lit(False), "__cf_only_set_delete": F.lit(False)})
    table.merge_batch(t, marked, KEYS, 1)
    before = t.state()["parts"]
    table.merge_batch(t, marked.where("o_orderkey in (1, 2, 3)"), KEYS, 2)
    after = t.state()["parts"]
    changed = sum(before.get(b) != p for b, p in after.items())
    return t.read().agg(F.count("*").alias("rows")).withColumn("at_most_three", F.lit(1 <= changed <= 3))


def multi_step_merge(spark: SparkSession, d: str) -> DataFrame:
    """Three flushes gathered in a staging table by :class:`MultiStepMerge`, the third of which merges: the same as one."""
    target, staging = (table.VersionedTable(spark, fresh_path(spark, n)) for n in ("target", "staging"))
    target.commit(base(spark, d), keys=KEYS, buckets=16)
    steps = table.MultiStepMerge(target, staging, KEYS, 2, placeholder_columns=["o_orderpriority"])
    e = feed(spark, d)
    for i in (1, 2, 3):
        steps.add(_fold(e.where(f"seq = {i}")).drop("seq"), i)
    return target.read()


def staging_new_column(spark: SparkSession, d: str) -> DataFrame:
    """A later batch brings a column, and lacks another: staging keeps both."""
    first = _fold(feed(spark, d).where("seq = 1")).drop("seq", "o_orderdate")
    later = _fold(feed(spark, d).where("seq = 2")).drop("seq", "o_totalprice", "o_orderdate").withColumn("extra", F.lit("new"))
    return merge.upsert_staging(first, later, KEYS, ["o_orderpriority"]).drop("__cf_delete", "__cf_only_set_delete")


def merge_problems(spark: SparkSession, d: str) -> DataFrame:
    """What the merge's assertion finds if nothing was merged: live keys that the target lacks, deleted ones that it has."""
    return merge.unmerged(base(spark, d), _staged(spark, d), KEYS)


def described_table(spark: SparkSession, d: str) -> DataFrame:
    """A table's columns as its catalog has them, and as the session's catalog has the same rows."""
    t = table.VersionedTable(spark, fresh_path(spark, "table"))
    marked = base(spark, d).limit(1).withColumns({"__cf_delete": F.lit(False), "__cf_only_set_delete": F.lit(False)})
    table.merge_batch(t, marked, KEYS, 1, buckets=1)
    table.merge_batch(t, marked.withColumn("note", F.lit(None).cast("string")), KEYS, 2, defaults={"note": "none"})
    t.read().createOrReplaceTempView("changeflow_described")
    known = {c["name"]: c["type"] for c in frames.describe_table(spark, "changeflow_described")}
    spark.catalog.dropTempView("changeflow_described")
    return _rows(spark, [(c["name"], c["type"], c["backfilled"], c["in_key"], known[c["name"]] == c["type"]) for c in t.columns()], "name string, type string, backfilled boolean, in_key boolean, same_in_session boolean")


def drop_in_two_steps(spark: SparkSession, d: str) -> DataFrame:
    """Columns after each batch: deletes alone drop nothing, old events drop nothing, a later event drops after the time set."""
    t = table.VersionedTable(spark, fresh_path(spark, "table"))
    day, clock = datetime(2025, 1, 1), datetime(2025, 6, 1)
    staged = lambda op: fold.fold(read_table(spark, d, "region").select("r_regionkey", F.lit(1).alias("seq"), F.lit(op).alias("op"), "r_name"), ["r_regionkey"], ["seq"], "op", ["r_name"]).drop("seq")
    table.merge_batch(t, staged("c").withColumn("old", F.lit("o")), ["r_regionkey"], 1, buckets=1)
    out = []
    deletes = lambda: staged("d").where("r_regionkey < 0")
    for i, (rows, at) in enumerate([(deletes(), day), (deletes(), clock + timedelta(days=1)), (staged("u"), day), (staged("u"), clock + timedelta(hours=3)), (staged("u"), clock + timedelta(hours=5))]):
        table.merge_batch(t, rows, ["r_regionkey"], i + 2, drop_missing=True, event_time=at, now=clock)
        out.append((i + 1, ",".join(t.read().columns)))
    return _rows(spark, out, "step int, columns string")


def staging_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of staging tables, and which a sweep removes."""
    names = [
        table.staging_name("orders", suffix="abcde", now=0), table.staging_name("orders", suffix="fghij", now=4_000_000_000), table.staging_name("orders", multi_step=True), table.staging_name("orders", reusable=True, schema="shop"), "orders",
    ]
    root = fresh_path(spark, "stagings")
    for n in names:
        read_table(spark, d, "region").write.parquet(f"{root}/{n}")
    gone = {*table.sweep(spark, root)}
    return _rows(spark, [(n, n in gone) for n in names], "name string, swept boolean")


def reusable_staging(spark: SparkSession, d: str) -> DataFrame:
    """What is done to a reusable staging table before each load."""
    r = read_table(spark, d, "region")
    t = table.VersionedTable(spark, fresh_path(spark, "staging"))
    out = [table.reusable_staging(t, r.schema), table.reusable_staging(t, r.schema)]
    t.commit(r)
    out.append(table.reusable_staging(t, r.select("r_name", "r_regionkey").schema))
    out.append(table.reusable_staging(t, r.withColumn("more", F.lit(1)).schema))
    return _rows(spark, list(enumerate(out)), "step int, done string")


# ---------------------------------------------------------------- evolution


def widened_columns(spark: SparkSession, d: str) -> DataFrame:
    """The length that each limited text column needs for a batch: grown, or as it was."""
    c = read_table(spark, d, "customer")
    limits = {"c_name": 5, "c_mktsegment": 200}
    return _rows(spark, [(n, evolve.widen_length(c, n, limit)) for n, limit in limits.items()], "column_name string, bytes bigint")


def counted_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Which defaults are worth filling in, and how each dialect does it."""
    values = [None, "1970-01-01", "1970-01-01T00:00:00Z", "00000000-0000-0000-0000-000000000000", "CURRENT_TIMESTAMP", "x", "0"]
    return _rows(spark, [(d_, evolve.default_strategy(d_), v, evolve.default_counts(v)) for d_ in sorted(dialects.DIALECTS) for v in values], "dialect string, strategy string, value string, counts boolean")


def default_literals(spark: SparkSession, d: str) -> DataFrame:
    """A default as SQL text, and the statement that fills it in."""
    cases = [(True, "bool"), (7, "int"), ("it's", "string"), ('{"a":1}', "struct"), (None, "string")]
    return _rows(spark, [(x, k, dialects.literal(v, Kind(k), x), dialects.backfill_statement(x, "t", "c", v, Kind(k))) for x in ("snowflake", "bigquery", "mssql", "postgres") for v, k in cases], "dialect string, kind string, literal string, statement string")


_BATCH = dialects.Batch("target", "staged", ("o_orderkey",), {"o_orderkey": Kind("int"), "o_orderstatus": Kind("string"), "o_orderpriority": Kind("string")}, placeholders=("o_orderpriority",))


def merge_texts(spark: SparkSession, d: str) -> DataFrame:
    """The statements of each dialect's hard and soft merge: how each begins, and whether it keeps values that were not sent."""
    out = []
    for name in sorted(dialects.DIALECTS):
        for soft in (False, True):
            for i, s in enumerate(dialects.merge_statements(name, dialects.Batch(**{**_BATCH.__dict__, "soft": soft}))):
                out.append((name, soft, i, s.split()[0], "CASE WHEN (stg." in s))
    return _rows(spark, out, "dialect string, soft boolean, step int, verb string, keeps_unsent boolean")


# ---------------------------------------------------------------- sinks


def parquet_sink(spark: SparkSession, d: str) -> DataFrame:
    """Orders written by the file sink in two appends, one a merge, and read back."""
    sink = files.ParquetSink(fresh_path(spark, "sink"), "db.public.orders")
    o = read_table(spark, d, "orders").withColumn("tags", F.struct("o_orderstatus"))
    sink.append(o.where("o_orderkey % 2 = 0"))
    sink.merge(o.where("o_orderkey % 2 <> 0"), KEYS)
    return spark.read.parquet(sink.path).select("o_orderkey", "o_totalprice", "o_orderdate", "tags", (F.col("date") >= F.date_sub(F.current_date(), 1)).alias("dated"))


def file_types(spark: SparkSession, d: str) -> DataFrame:
    """Columns as narrow files hold them: 32-bit floats, milliseconds, structs as JSON."""
    e = read_table(spark, d, "events")
    return files.for_files(e.select("event_id", "value", "ts", F.struct("user_id").alias("who"), F.lit(None).alias("nothing")), narrow=True)


def delimited_sink(spark: SparkSession, d: str) -> DataFrame:
    """Customers as tab-separated text with awkward values, read back."""
    c = read_table(spark, d, "customer")
    odd = F.when(F.col("c_custkey") % 4 == 0, F.lit(None)).when(F.col("c_custkey") % 4 == 1, F.lit("")).when(F.col("c_custkey") % 4 == 2, F.concat("c_name", F.lit('\t"x"\ny'))).otherwise(F.col("c_name"))
    rows = c.select("c_custkey", odd.alias("c_name"), "c_acctbal")
    sink = files.DelimitedSink(fresh_path(spark, "delimited"))
    sink.append(rows)
    return sink.read(spark, rows.schema)


def message_sink(spark: SparkSession, d: str) -> DataFrame:
    """Nations sent as messages in batches of ten at most; what arrived, by batch size."""
    path = fresh_path(spark, "sent").removeprefix("file://")

    def connect():  # noqa: ANN202
        import os
        import uuid

        os.makedirs(path, exist_ok=True)

        def send(texts: list[str]) -> None:
            with open(f"{path}/{uuid.uuid4().hex}.json", "w") as f:
                f.writelines(json.dumps({"message": t, "batch": len(texts)}) + "\n" for t in texts)

        return send

    files.MessageSink(connect).append(read_table(spark, d, "nation").coalesce(1).orderBy("n_nationkey"))
    return spark.read.schema("message string, batch bigint").json(f"file://{path}")


# ---------------------------------------------------------------- rows and keys


def document_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of document messages in their forms."""
    e = read_table(spark, d, "events")
    k = F.col("event_id") % 4
    i = F.col("event_id").cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit('{"payload":{"id":"{\\"$oid\\": \\"'), i, F.lit('\\"}"}}'))).when(k == 1, F.concat(F.lit('{"id":"{\\"$numberLong\\": \\"'), i, F.lit('\\"}"}')))
        .when(k == 2, F.concat(F.lit('{"schema":{},"payload":{"id":"\\"'), i, F.lit('\\""}}'))).otherwise(F.concat(F.lit('{"id":"'), i, F.lit('"}')))
    )
    return e.select("event_id", documents.document_key(raw).alias("doc_key"), tracking.tracking_key(raw.cast("binary")).startswith("{").alias("raw_kept"))


def number_keys(spark: SparkSession, d: str) -> DataFrame:
    """One text for every form of a number in a key; other text stays."""
    e = read_table(spark, d, "events")
    k = F.col("event_id") % 4
    i = F.col("event_id").cast("string")
    form = F.when(k == 0, i).when(k == 1, F.concat(i, F.lit(".0"))).when(k == 2, F.concat(i, F.lit("e0"))).otherwise(F.concat(F.lit("k"), i))
    return e.select("event_id", transform.same_number(form).alias("key_text"))


def key_rules(spark: SparkSession, d: str) -> DataFrame:
    """Key columns by a topic's settings and the messages' own keys."""
    cases = [({}, ["id"]), ({"keys_include": ("region", "at")}, ["id"]), ({"keys_override": ("z", "a")}, ["id"]), ({"keys_include": ("only",)}, None), ({}, None)]
    out = []
    for i, (more, own) in enumerate(cases):
        try:
            got = ",".join(transform.key_columns(TopicConfig("t", "s", **more), own))
        except ValueError:
            got = "refused"
        out.append((i, got))
    return _rows(spark, out, "rule int, keys string")


def name_hints(spark: SparkSession, d: str) -> DataFrame:
    """Kinds that column names tell."""
    return _rows(spark, [(n, tracking.hinted_kind(n)) for n in ("user_id", "Created_At", "job_started", "id", "plan")], "name string, kind string")


def encrypt_json(spark: SparkSession, d: str) -> DataFrame:
    """Structured columns encrypted as JSON by the setting, and decrypted again; others stay."""
    c = read_table(spark, d, "customer").select("c_custkey", "c_name", F.struct("c_nationkey", "c_mktsegment").alias("c_more"))
    sealed = transform.apply_topic(c, TopicConfig("t", "s", encrypt_json=True), ["c_custkey"], KEY)
    return sealed.select("c_custkey", "c_name", masking.decrypt(F.col("c_more"), KEY).alias("c_more"), (~F.col("c_more").contains("mktsegment")).alias("sealed"))


def refused(spark: SparkSession, d: str) -> DataFrame:
    """What must be an error is one."""
    c = read_table(spark, d, "region")
    odd = c.withColumn("__cf_delete", F.lit(None).cast("boolean"))
    tries = {
        "encrypt_missing_key": lambda: transform.apply_topic(c, TopicConfig("t", "s", encrypt=("r_name",)), ["r_regionkey"]),
        "encrypt_json_missing_key": lambda: transform.apply_topic(c, TopicConfig("t", "s", encrypt_json=True), ["r_regionkey"]),
        "row_without_marker": lambda: transform.check_rows(odd, ["r_regionkey"], "t").collect(), "row_without_key": lambda: transform.check_rows(c.withColumn("r_regionkey", F.lit(None).cast("int")), ["r_regionkey"], "t", needs_marker=False).collect(),
        "no_table_name": lambda: transform.check_rows(c, ["r_regionkey"], ""), "static_clash": lambda: transform.static_columns(c, {"R_NAME": "x"}), "key_not_included": lambda: transform.include_columns(c, ["r_name"], ["r_regionkey"]),
        "unknown_setting": lambda: from_text('{"topics": [{"topic": "t", "schema": "s", "nonsense": 1}]}'),
        "stale_writer": lambda: _stale(spark, d),
    }
    out = []
    for name, run in tries.items():
        try:
            run()
            out.append((name, False))
        except Exception:  # noqa: BLE001
            out.append((name, True))
    return _rows(spark, out, "name string, refused boolean")


def _stale(spark: SparkSession, d: str) -> None:
    t = table.VersionedTable(spark, fresh_path(spark, "table"))
    r = read_table(spark, d, "region")
    t.commit(r)
    t.commit(r)
    t.commit(r, expect=1)


def checked_rows(spark: SparkSession, d: str) -> DataFrame:
    """Valid rows pass their check unchanged."""
    return transform.check_rows(read_table(spark, d, "nation").withColumn("__cf_delete", F.lit(False)), ["n_nationkey"], "nation").drop("__cf_delete")


def approximate_size(spark: SparkSession, d: str) -> DataFrame:
    """About how many bytes a row takes, and how many a batch."""
    n = read_table(spark, d, "nation").select("n_nationkey", "n_name", F.lit("u").alias("op"))
    total = fold.batch_flags(n, "op").select(F.lit(None).cast("int").alias("n_nationkey"), F.col("bytes").cast("bigint"))
    return n.select("n_nationkey", text.approximate_bytes("n_nationkey", "n_name").cast("bigint").alias("bytes")).unionByName(total)


# ---------------------------------------------------------------- functions


@F.pandas_udf(T.StringType())
def _gzip(values: pd.Series) -> pd.Series:
    import base64
    import gzip

    return pd.Series([base64.b64encode(gzip.compress(v.encode(), mtime=0)).decode() for v in values], dtype=object)


def gzip_decode(spark: SparkSession, d: str) -> DataFrame:
    """Compressed fields; values not sent and junk."""
    e = read_table(spark, d, "events")
    k = F.col("event_id") % 5
    packed = F.when(k == 0, F.lit(UNAVAILABLE)).when(k == 1, F.lit("junk")).otherwise(_gzip(F.col("props")))
    return e.select("event_id", decode.decode(packed, None, "string", compressed=True).alias("props"))


def more_decoders(spark: SparkSession, d: str) -> DataFrame:
    """Clock times with a zone, bits, years, durations, texts as they are, points and geometries."""
    e = read_table(spark, d, "events")
    of = lambda name, c, plain="string": decode.decode(c, f"io.debezium.{name}", plain)
    i = F.col("event_id").cast("string")
    point = F.lit('{"wkb":"AQEAAAAAAAAAAADwPwAAAAAAAABA"}')
    return e.select(
        "event_id", of("time.ZonedTime", F.concat(F.date_format("ts", "HH:mm:ss"), F.lit(".5+02:00"))).alias("clock"), of("data.Bits", F.base64(F.col("event_type").cast("binary"))).alias("bits"), of("time.Year", F.lit("2024")).alias("year"),
        of("time.MicroDuration", i).alias("duration"), of("data.Uuid", i).alias("uuid"), of("data.Ltree", F.lit("a.b")).alias("ltree"), of("data.Enum", F.col("event_type")).alias("enum"), of("data.EnumSet", F.lit("a,b")).alias("enum_set"), of("data.Xml", F.lit("<a/>")).alias("xml"), of("time.Interval", F.lit("P1Y2M")).alias("interval"),
        of("data.geometry.Point", F.concat(F.lit('{"x":1.5,"y":'), i, F.lit("}"))).alias("point"), of("data.geometry.Geometry", point).alias("geometry"),
    )


def decimal_wide(spark: SparkSession, d: str) -> DataFrame:
    """Numbers at and beyond the edges of 8 and 16 bytes, with every scale form; what doesn't fit is null."""
    numbers = [0, -1, 255, 2**63 - 1, -(2**63), 2**63, 10**37, -(10**37), 2**127 - 1, -(2**127), 2**200, -(2**200) - 1]
    import base64

    coded = [(str(n), base64.b64encode(n.to_bytes((n.bit_length() + 8) // 8, "big", signed=True)).decode()) for n in numbers] + [("junk", "!!"), ("empty", "")]
    df = _rows(spark, coded, "number string, coded string")
    c = F.col("coded")
    return df.select("number", decode.fixed_decimal(c, 0).cast("string").alias("fixed"), decode.any_decimal(c, F.lit(0)).alias("plain"), decode.any_decimal(c, F.lit(-2)).alias("hundreds"), decode.any_decimal(c, F.lit(3)).alias("thousandths"))


def decimal_encode(spark: SparkSession, d: str) -> DataFrame:
    """Prices rescaled to one decimal, encoded and decoded."""
    o = read_table(spark, d, "orders")
    price = F.when(F.col("o_orderkey") % 2 == 0, -F.col("o_totalprice")).otherwise(F.col("o_totalprice")).cast("decimal(18,2)")
    return o.select("o_orderkey", decode.fixed_decimal(decode.encode_decimal(price, 1), 1, 18).alias("price"))


def typed_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Lists whose elements are dates, and lists of such lists."""
    e = read_table(spark, d, "events")
    day = F.unix_date(F.col("ts").cast("date")).cast("string")
    days = {"type": "int32", "name": "io.debezium.time.Date"}
    one, two = F.concat(F.lit("["), day, F.lit(",null,0]")), F.concat(F.lit("[["), day, F.lit("],[]]"))
    return e.select("event_id", F.array_join(decode.decode(one, None, "array", items=days), "|", "-").alias("days"), F.array_join(decode.decode(two, None, "array", items={"type": "array", "items": days}), "|").alias("nested"))


def force_utc(spark: SparkSession, d: str) -> DataFrame:
    """Timestamps without a zone that get UTC."""
    e = read_table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp")).cast("string")
    t = e.select("event_id", decode.decode(us, "io.debezium.time.MicroTimestamp", "int64", force_utc=True).alias("at"))
    return t.select("event_id", F.unix_micros("at").alias("micros"), F.lit(t.schema["at"].dataType.simpleString()).alias("kind"))


def strict_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Whole numbers, booleans and 32-bit floats that fit, else null."""
    e = read_table(spark, d, "events")
    k = F.col("event_id") % 4
    n = F.when(k == 0, F.lit("7.5")).when(k == 1, F.lit("9223372036854775808")).when(k == 2, F.lit("1e39")).otherwise(F.col("event_id").cast("string"))
    return e.select("event_id", text.convert(n, Kind("int")).alias("whole"), text.convert(n, Kind("int", width="small")).alias("small"), text.float32(n).alias("single"), text.convert(F.when(k == 0, F.lit("yes")).otherwise(F.lit("False")), Kind("bool")).alias("flag"))


def list_text(spark: SparkSession, d: str) -> DataFrame:
    """Elements of lists as text: structs, maps and lists as JSON; a value that is no list as a list of one."""
    e = read_table(spark, d, "events").select("event_id", "user_id", "event_type")
    s = e.select("event_id", F.array(F.struct("user_id", "event_type")).alias("structs"), F.array(F.create_map("event_type", "user_id")).alias("maps"), F.array(F.array("user_id")).alias("lists"), F.array("user_id", F.lit(None)).alias("plain"), F.col("event_type").alias("lone"))
    return s.select("event_id", *[F.array_join(text.text_list(F.col(f.name), f.dataType), "|", "-").alias(f.name) for f in s.schema if f.name != "event_id"])


def repaired_text(spark: SparkSession, d: str) -> DataFrame:
    """Bytes that are no UTF-8 read as Latin-1, one by one; the rest as it is."""
    e = read_table(spark, d, "events")
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.encode("event_type", "utf-8"), F.lit(b"\xff\xc3\xa9\xc3"))).otherwise(F.encode("event_type", "utf-8"))
    return e.select("event_id", text.repair_utf8(raw).alias("repaired"))


# ---------------------------------------------------------------- streams and settings


def _frames(spark: SparkSession, d: str) -> DataFrame:
    """The orders' feed as message frames without a schema, a partition for each of four groups of keys."""
    e = feed(spark, d, placeholder=False)
    image = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")))
    gone = F.col("op") == "d"
    value = F.concat(F.lit('{"payload":{"before":'), F.when(gone, image).otherwise(F.lit("null")), F.lit(',"after":'), F.when(gone, F.lit("null")).otherwise(image), F.lit(',"op":"'), F.col("op"), F.lit('","source":{"db":"shop","table":"orders"}}}'))
    return e.select(
        F.lit("shop.public.orders").alias("topic"), (F.col("o_orderkey") % 4).cast("int").alias("kafka_partition"), (F.col("o_orderkey") * 10 + F.col("seq")).alias("kafka_offset"),
        (F.lit(datetime(2025, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("seq").cast("decimal(18,6)"))).alias("kafka_ts"), F.lit(None).cast("binary").alias("msg_key"), value.cast("binary").alias("msg_value"),
    )


def stream_merge(spark: SparkSession, d: str) -> DataFrame:
    """The feed as a stream of files, one file a micro-batch, some frames sent twice, merged batch by batch."""
    root = fresh_path(spark, "stream")
    f = _frames(spark, d)
    for seq in (1, 2, 3):
        part = f.where(F.col("kafka_offset") % 10 == seq)
        part.unionByName(part.where("kafka_offset % 20 < 10")).coalesce(1).write.mode("append").parquet(f"{root}/in")
    t = table.VersionedTable(spark, f"{root}/table")
    image = lambda c: F.get_json_object(F.coalesce("after", "before"), f"$.{c}")
    changes = lambda b: frames.parse_messages(b).select("kafka_partition", "kafka_offset", "op", F.col("row_id").alias("id"), image("status").alias("status"), image("price").cast("double").alias("price"))
    # Files of one batch come in any order; an order of keys by offset makes the result the same.
    apply.start_merge(apply.frame_stream(spark, f"{root}/in", max_files=3), changes, t, ["id"], ["status", "price"], f"{root}/check", trigger={"availableNow": True}, buckets=8).awaitTermination()
    return t.read()


def stream_history(spark: SparkSession, d: str) -> DataFrame:
    """Every change of the stream appended once, though it is started twice."""
    root = fresh_path(spark, "stream")
    _frames(spark, d).coalesce(2).write.parquet(f"{root}/in")
    rows = lambda b: frames.parse_messages(b).select("kafka_offset", "op", "row_id")
    for _ in range(2):
        apply.start_history(apply.frame_stream(spark, f"{root}/in"), rows, f"{root}/out", f"{root}/check").awaitTermination()
    return spark.read.parquet(f"{root}/out")


def partition_lag(spark: SparkSession, d: str) -> DataFrame:
    """How far the read of every second frame lags behind each partition."""
    m = read_table(spark, d, "change_messages")
    ends = m.groupBy("topic", "kafka_partition").agg((F.max("kafka_offset") + 1).alias("end_offset"))
    return apply.lag(m.where("kafka_offset % 2 = 0"), ends, F.lit(datetime(2030, 1, 1)).cast("timestamp_ntz"))


_SETTINGS = """
{"passphrase": "secret words", "topics": [{"topic": "shop.public.events", "schema": "public", "database": "shop", "keys_override": ["id"], "operation": true, "full_table_name": true,
  "exclude": ["clock"], "static": {"origin": "erp"}, "hash": ["kind"], "encrypt": ["props"], "skip_operations": "d", "merge_predicates": ["day"]}]}
"""


def topic_run(spark: SparkSession, d: str) -> DataFrame:
    """Event messages through a topic's settings into its table, two batches of which the second comes twice; an inserted row keeps the placeholder of what was never sent."""
    engine = from_text(_SETTINGS)
    m = _messages(spark, d).withColumns({"msg_key": F.lit(None).cast("binary"), "kafka_ts": F.lit(None).cast("timestamp_ntz")})
    topic = Topic(spark, engine, engine.topics[0], fresh_path(spark, "tables"))
    topic.apply(m.where("kafka_offset % 3 = 0"), 1)
    for _ in range(2):
        topic.apply(m.where("kafka_offset % 3 <> 0"), 2)
    t = topic.table("events").read()
    return t.select("id", "day", "kind", "value", "origin", F.col("__cf_operation").alias("operation"), F.col("__cf_full_table_name").alias("full_table_name"), F.when(F.col("props") != UNAVAILABLE, masking.decrypt(F.col("props"), topic.key)).alias("props"))


def topic_partitions(spark: SparkSession, d: str) -> DataFrame:
    """The same messages by month, to soft partitions; months without a table go to the default one."""
    engine = from_text(json.dumps({"topics": [{"topic": "shop.public.events", "schema": "public", "keys_override": ["id"], "append_only": False, "soft_partitions": {"column": "at", "frequency": "monthly", "max_partitions": 40}}]}))
    m = _messages(spark, d).withColumn("msg_key", F.lit(None).cast("binary"))
    topic = Topic(spark, engine, engine.topics[0], fresh_path(spark, "tables"))
    written = topic.apply(m, 1, F.lit(datetime(2030, 1, 1)).cast("timestamp_ntz"))
    out = None
    for t in written:
        one = topic.table(t).read().agg(F.count("*").alias("rows")).withColumn("dest_table", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {
    f.__name__: f
    for f in (
        table_merge, table_touched, multi_step_merge, staging_new_column, merge_problems, described_table, drop_in_two_steps, staging_names, reusable_staging,
        widened_columns, counted_defaults, default_literals, merge_texts, parquet_sink, file_types, delimited_sink, message_sink,
        document_keys, number_keys, key_rules, name_hints, encrypt_json, refused, checked_rows, approximate_size,
        gzip_decode, more_decoders, decimal_wide, decimal_encode, typed_arrays, force_utc, strict_numbers, list_text, repaired_text,
        stream_merge, stream_history, partition_lag, topic_run, topic_partitions,
    )
}

