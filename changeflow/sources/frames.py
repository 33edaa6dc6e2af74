"""Message frames of relational change topics: bytes to typed change columns.

All work stays in the JVM: one streaming JSON parse of each value (a value that
breaks off yields no message), one small parse of the row images.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value of the envelope protocol: the column's value was not sent.
UNAVAILABLE = "__debezium_unavailable_value"

_ENVELOPE = (
    "payload STRUCT<before: STRING, after: STRING, op: STRING, ts_ms: STRING, "
    "source: STRUCT<db: STRING, `schema`: STRING, `table`: STRING, ts_ms: STRING, sequence: STRING, lsn: STRING>>, "
    "_bad STRING"
)


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def sample_rows(df: DataFrame, keys: list[str], n: int = 50) -> DataFrame:
    """The first ``n`` rows in the order of ``keys``."""
    return df.orderBy(*keys).limit(n)


def describe_table(spark: SparkSession, name: str) -> list[dict] | None:
    """Columns of a table of the session's catalog, ``name, type``; None if there is no such table."""
    if not spark.catalog.tableExists(name):
        return None
    return [{"name": f.name, "type": f.dataType.simpleString()} for f in spark.table(name).schema]


def whole_number(c: Column) -> Column:
    """The bigint that a number's text stands for (``7``, ``7.0``, ``"7"``, ``7e0``); null for any other text."""
    text = F.trim(c)
    exact = text.try_cast("decimal(38,10)")
    return F.coalesce(text.try_cast("bigint"), F.when(exact == F.floor(exact), exact.try_cast("bigint")))


def position(sequence: Column) -> Column:
    """A change's own position: the second item of the JSON list in ``source.sequence``, as text."""
    return F.get_json_object(sequence, "$[1]")


def key_field(key: Column, name: str) -> Column:
    """Text of one field of a message key in any of its forms.

    ``{"id": 1}``, ``{"schema": ..., "payload": {"id": 1}}`` and
    ``Struct{id=1,other=2}``; null for a null, empty or unreadable key.
    """
    return F.when(
        key.startswith("Struct{"),
        F.nullif(F.regexp_extract(key, r"[{,]\s*" + name + r"=([^,}]*)", 1), F.lit("")),
    ).otherwise(F.coalesce(F.get_json_object(key, f"$.payload.{name}"), F.get_json_object(key, f"$.{name}")))


def parse_messages(frames: DataFrame, id_field: str = "id") -> DataFrame:
    """Messages of ``frames`` (topic, kafka_partition, kafka_offset, kafka_ts, msg_key, msg_value).

    A frame whose value is null, empty, blank, cut off or otherwise no complete
    JSON object is no message and leaves no row. Columns: the frame's address,
    ``db``, ``table_name``, ``op``, ``before``, ``after`` (JSON text), ``source_ts``,
    ``id_text`` (from ``after``, ``before``, else the key), ``row_id`` (bigint, null
    if the id is no whole number), ``position_text``, ``lsn`` (bigint, null if
    malformed). Extra columns of ``frames`` are left out, so their names can't clash.
    """
    value = F.col("msg_value").cast("string")
    # As a list of one or none: a filter on the parsed value would be pushed below and parse it again.
    whole = F.filter(F.array(F.from_json(value, _ENVELOPE, {"columnNameOfCorruptRecord": "_bad"})), lambda j: j.isNotNull() & j["_bad"].isNull())
    parsed = frames.where(F.rtrim(value).endswith("}")).select(
        "topic", "kafka_partition", "kafka_offset", "kafka_ts", F.col("msg_key").cast("string").alias("key_text"), F.explode(whole).alias("_j")
    )
    flat = parsed.select(
        "topic", "kafka_partition", "kafka_offset", "kafka_ts", "key_text",
        F.col("_j.payload.source.db").alias("db"),
        F.col("_j.payload.source.table").alias("table_name"),
        F.col("_j.payload.op").alias("op"),
        F.col("_j.payload.before").alias("before"),
        F.col("_j.payload.after").alias("after"),
        F.col("_j.payload.source.ts_ms").try_cast("bigint").alias("source_ts"),
        F.coalesce(position(F.col("_j.payload.source.sequence")), F.col("_j.payload.source.lsn")).alias("position_text"),
    )
    image = lambda c: F.get_json_object(c, f"$.{id_field}")
    named = flat.withColumn("id_text", F.coalesce(image(F.col("after")), image(F.col("before")), key_field(F.col("key_text"), id_field)))
    return named.withColumns({"row_id": whole_number(F.col("id_text")), "lsn": whole_number(F.col("position_text"))})
