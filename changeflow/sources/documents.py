"""Document-database envelopes: rows in extended JSON."""

from __future__ import annotations

import base64
import json
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_BARE = re.compile(r'"(?:[^"\\]|\\.)*"|-?\b(?:NaN|Infinity)\b')
_EPOCH = datetime(1970, 1, 1, tzinfo=UTC)


def _instant(ms: int) -> str | None:
    try:
        t = _EPOCH + timedelta(milliseconds=ms)
    except OverflowError:
        return None
    return t.strftime("%Y-%m-%dT%H:%M:%S") + (f".{t.microsecond // 1000:03d}" if t.microsecond else "") + "Z"


def unwrap(x: object) -> object:
    """An extended-JSON value as a plain one.

    Numbers lose their wrapper; object ids, decimals and UUIDs are text; dates and timestamps
    RFC 3339 text, null for years outside of 1 to 9999; numbers that aren't finite null;
    other binaries, code, and the least and greatest key stay objects.
    """
    if isinstance(x, list):
        return [unwrap(v) for v in x]
    if not isinstance(x, dict):
        return x
    if len(x) == 1:
        ((k, v),) = x.items()
        match k:
            case "$numberLong" | "$numberInt":
                return int(v)
            case "$numberDouble":
                f = float(v)
                return f if f == f and abs(f) != float("inf") else None
            case "$numberDecimal" | "$oid" | "$symbol":
                return str(v)
            case "$date":
                if isinstance(v, dict):
                    v = int(v.get("$numberLong", 0))
                if isinstance(v, str):
                    try:
                        t = datetime.fromisoformat(v.replace("Z", "+00:00"))
                    except ValueError:
                        return None
                    return _instant(round((t - _EPOCH) / timedelta(milliseconds=1)))
                return _instant(int(v))
            case "$timestamp":
                return _instant(int(v.get("t", 0)) * 1000)
            case "$uuid":
                return str(v)
            case "$binary" if isinstance(v, dict):
                data, kind = base64.b64decode(v.get("base64", "")), str(v.get("subType", "00")).rjust(2, "0")
                if kind in ("03", "04") and len(data) == 16:
                    return str(uuid.UUID(bytes=data))
                return {"$binary": {"base64": base64.b64encode(data).decode(), "subType": kind}}
            case "$minKey" | "$maxKey":
                return {k: 1}
            case "$undefined":
                return None
            case "$code":
                return x
    return {k: unwrap(v) for k, v in x.items()}


def plain(text: str | None) -> str | None:
    """Extended-JSON text as plain JSON text; bare NaN and infinities are null; null if it can't be read."""
    if text is None:
        return None
    text = _BARE.sub(lambda m: m[0] if m[0][0] == '"' else "null", text)
    try:
        return json.dumps(unwrap(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
    except (ValueError, TypeError, AttributeError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def _plain(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for v in values:
        yield pd.Series([plain(x) for x in v], dtype=object)


def plain_json(c: Column) -> Column:
    """:func:`plain` of a column; text without a ``$`` and without bare words never leaves the JVM."""
    odd = c.contains('"$') | c.rlike(r"\b(NaN|Infinity)\b")
    return F.when(odd, _plain(c)).otherwise(F.to_json(F.try_parse_json(c)))


def document_rows(messages: DataFrame, value: str = "msg_value") -> DataFrame:
    """``messages`` with ``op, collection, source_ts, row`` (plain JSON of the row image); unreadable messages leave no row."""
    j = F.from_json(F.col(value).cast("string"), "payload STRUCT<before: STRING, after: STRING, op: STRING, source: STRUCT<db: STRING, collection: STRING, ts_ms: BIGINT>>")
    df = messages.withColumn("_j", F.explode(F.filter(F.array(j), lambda x: x["payload"].isNotNull())))
    image = F.when(F.col("_j.payload.op") == "d", F.coalesce("_j.payload.before", F.lit("{}"))).otherwise(F.col("_j.payload.after"))
    return df.select(
        *[c for c in messages.columns if c != value], F.col("_j.payload.op").alias("op"), F.col("_j.payload.source.collection").alias("collection"),
        F.col("_j.payload.source.ts_ms").alias("source_ts"), plain_json(image).alias("row"),
    )


def document_key(key: Column) -> Column:
    """``_id`` of a message key, whose ``id`` may be (extended) JSON in a text."""
    raw = F.coalesce(F.get_json_object(key, "$.payload.id"), F.get_json_object(key, "$.id"))
    return F.when(raw.startswith("{"), F.coalesce(F.get_json_object(raw, "$['$oid']"), F.get_json_object(raw, "$['$numberLong']"), plain_json(raw))).otherwise(F.regexp_replace(raw, '^"|"$', ""))
