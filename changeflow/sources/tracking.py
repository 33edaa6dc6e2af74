"""Event-tracking messages: an event's name, time, id, properties and extra fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EVENT = "event STRING, timestamp STRING, messageID STRING, properties MAP<STRING, STRING>, extraFields MAP<STRING, STRING>"


def tracked_rows(messages: DataFrame, value: str = "msg_value", prefix: str = "__cf_") -> DataFrame:
    """``table_name, row`` (map of text), and the markers, of each valid message.

    ``event``, ``properties``, ``timestamp`` and ``messageID`` are required; a message without
    one leaves no row (see :func:`invalid`). Extra fields win over properties, the message's
    own ``id``, ``timestamp`` and ``event`` over both.
    """
    df = messages.withColumn("_e", F.explode(F.filter(F.array(F.from_json(F.col(value).cast("string"), _EVENT)), _valid)))
    own = F.create_map(F.lit("id"), F.col("_e.messageID"), F.lit("timestamp"), F.col("_e.timestamp"), F.lit("event"), F.col("_e.event"))
    extra = F.coalesce("_e.extraFields", F.create_map().cast("map<string,string>"))
    lower = F.map_filter(extra, lambda k, _: ~F.map_contains_key(own, k))
    props = F.map_filter("_e.properties", lambda k, _: ~F.map_contains_key(own, k) & ~F.map_contains_key(lower, k))
    return df.select(
        *[c for c in messages.columns if c != value], F.col("_e.event").alias("table_name"), F.map_concat(props, lower, own).alias("row"),
        F.lit(False).alias(f"{prefix}delete"), F.lit(False).alias(f"{prefix}only_set_delete"),
    )


def _valid(e: Column) -> Column:
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    return e.isNotNull() & filled(e["event"]) & filled(e["messageID"]) & e["properties"].isNotNull() & F.coalesce(e["timestamp"].try_cast("timestamp").isNotNull(), F.lit(False))


def invalid(messages: DataFrame, value: str = "msg_value") -> DataFrame:
    """The messages that :func:`tracked_rows` leaves out."""
    return messages.where(~F.coalesce(_valid(F.from_json(F.col(value).cast("string"), _EVENT)), F.lit(False)))


def hinted_kind(column: str) -> str | None:
    """Kind that a name tells: ids are text, names of times are timestamps; else it is inferred."""
    low = column.lower()
    if low.endswith("_id"):
        return "string"
    return "timestamp_tz" if low.endswith(("_at", "_started")) else None


def tracking_key(key: Column) -> Column:
    """The whole key's text is the id."""
    return key.cast("string")
