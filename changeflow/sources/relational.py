"""Relational change envelopes with a schema of their own: typed rows per distinct schema."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.decode import decode, is_unavailable
from ..kinds import escape_name

_FIELD = "STRUCT<field: STRING, type: STRING, name: STRING, fields: STRING>"
_ENVELOPE = f"`schema` STRUCT<fields: ARRAY<{_FIELD}>>, payload STRUCT<before: STRING, after: STRING, op: STRING, ts_ms: BIGINT, source: STRING>"
_SOURCE = "db STRING, `schema` STRING, `table` STRING, collection STRING, ts_ms BIGINT, connector STRING, lsn STRING"


def envelopes(frames: DataFrame, value: str = "msg_value") -> DataFrame:
    """``frames`` with ``op, before, after, source, source_ts, after_schema``; empty values (tombstones) and what is no JSON leave no row.

    ``before`` and ``after`` are JSON text, ``after_schema`` that of the row's fields,
    null where the message has none.
    """
    # As a list of one or none: a filter on the parsed value would be pushed below and parse it again.
    j = F.filter(F.array(F.from_json(F.col(value).cast("string"), _ENVELOPE)), lambda x: x["payload"].isNotNull())
    df = frames.where(F.octet_length(value) > 0).withColumn("_j", F.explode(j))
    rows = F.filter("_j.schema.fields", lambda f: f["field"].isin("after"))
    source = F.from_json("_j.payload.source", _SOURCE)
    return df.select(
        *[c for c in frames.columns if c != value], F.col("_j.payload.op").alias("op"), F.col("_j.payload.before").alias("before"), F.col("_j.payload.after").alias("after"),
        source.alias("source"), source["ts_ms"].alias("source_ts"), F.when(F.size(rows) > 0, rows[0]["fields"]).alias("after_schema"),
    )


def row_image(op: Column, before: Column, after: Column) -> Column:
    """The row that an operation stands for: ``before`` of a delete, else ``after``; any other operation is an error."""
    return F.when(op == "d", F.coalesce(before, F.lit("{}"))).when(op.isin("c", "u", "r"), after).otherwise(F.raise_error(F.concat(F.lit("unknown operation: "), F.coalesce(op, F.lit("null")))).cast("string"))


def with_image(df: DataFrame, prefix: str = "__cf_") -> DataFrame:
    """Adds ``row`` (JSON) and the two delete markers."""
    gone = F.col("op") == "d"
    return df.withColumns({"row": row_image(F.col("op"), F.col("before"), F.col("after")), f"{prefix}delete": gone, f"{prefix}only_set_delete": gone})


def schema_fields(df: DataFrame, schema: str = "after_schema") -> list[dict]:
    """Every different field that the messages' schemas have; their number grows with columns, not with schemas or messages."""
    # Different schemas first, map-side: only those are taken apart.
    each = df.select(schema).distinct().select(F.explode(F.from_json(schema, "array<string>")).alias("f")).distinct().orderBy("f")
    found = [json.loads(r.f) | {"_text": r.f} for r in each.collect()]
    return [f for f in found if f.get("field")]


def typed_rows(df: DataFrame, row: str = "row", schema: str = "after_schema", fields: list[dict] | None = None, force_utc: bool = False) -> DataFrame:
    """``row`` as typed columns, by the schema each message carries; the placeholder of a value not sent becomes null, its column's name is listed in ``unavailable``.

    The different fields of all schemas are looked up first (or given, as of
    :func:`schema_fields`); then one projection serves every message, whatever the number
    of schemas. A column that schemas define differently is decoded by the message's own
    schema, and is text if the types differ. Messages without a schema have no fields;
    infer them with :func:`infer_kinds` first.
    """
    fields = schema_fields(df, schema) if fields is None else fields
    keep = [c for c in df.columns if c not in (row, schema)]
    if not fields:
        return df.select(*keep, F.array().cast("array<string>").alias("unavailable"))
    by: dict[str, list[dict]] = {}
    for f in fields:
        by.setdefault(escape_name(f["field"]), []).append(f)
    # One parse of the row; numbers and nested values keep their JSON text.
    raw_names = sorted({f["field"] for f in fields})
    has_schema = F.col(schema).isNotNull()
    parsed = F.when(has_schema, F.from_json(row, T.StructType([T.StructField(n, T.StringType()) for n in raw_names])))
    several = any(len(v) > 1 for v in by.values())
    df = df.withColumn("_row", parsed)
    if several:
        df = df.withColumn("_own", F.from_json(schema, "array<string>"))
    value = lambda f: F.col("_row").getField(f["field"])
    decoded = lambda f: F.when(~is_unavailable(value(f)), decode(value(f), f.get("name"), f.get("type"), f.get("parameters"), f.get("items"), bool(f.get("compressed")), force_utc))
    cols, missing = [], []
    for name, variants in by.items():
        if len(variants) == 1:
            v = decoded(variants[0])
            lost = is_unavailable(value(variants[0]))
        else:
            kinds = {df.select(decoded(f).alias("v")).schema["v"].dataType.simpleString() for f in variants}
            own = [(F.array_contains("_own", f["_text"]), decoded(f).cast("string") if len(kinds) > 1 else decoded(f), is_unavailable(value(f))) for f in variants]
            v = F.coalesce(*[F.when(mine, x) for mine, x, _ in own])
            lost = F.greatest(F.lit(False), *[mine & gone for mine, _, gone in own])
        cols.append(v.alias(name))
        missing.append(F.when(lost, F.lit(name)))
    return df.select(*keep, *cols, F.array_compact(F.array(*missing)).alias("unavailable"))


def infer_kinds(rows: DataFrame, row: str = "row", whole_numbers: bool = False) -> DataFrame:
    """Kind of each field of schemaless rows: ``field, kind``, from its values that aren't null.

    Numbers are floats, whole ones too unless ``whole_numbers``; text that is valid JSON
    and begins with a brace or bracket is a struct; a field with only nulls is invalid.
    Kinds that disagree become string.
    """
    # Every value as variant keeps its JSON type; one row a field, combined map-side.
    each = rows.select(F.explode_outer(F.from_json(row, "map<string,variant>")).alias("field", "v")).where("field is not null")
    t = F.schema_of_variant("v")
    text = F.try_variant_get("v", "$", "string")
    kind = (
        F.when(F.col("v").isNull() | (t == "VOID"), F.lit(None))
        .when(t == "BOOLEAN", "bool")
        .when(t.rlike("^(BIGINT|INT|SMALLINT|TINYINT)"), "int" if whole_numbers else "float")
        .when(t.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "float")
        .when(t.startswith("ARRAY"), "array")
        .when(t.startswith("OBJECT"), "struct")
        .when(F.ltrim(text).rlike(r"^[\[{]") & F.try_parse_json(text).isNotNull(), "struct")
        .otherwise("string")
    )
    by = each.select("field", kind.alias("kind")).groupBy("field").agg(F.min("kind").alias("a"), F.max("kind").alias("b"))
    return by.select("field", F.coalesce(F.when(F.col("a") == F.col("b"), F.col("a")).when(F.col("a").isin("float", "int") & F.col("b").isin("float", "int"), "float").when(F.col("a").isNotNull(), "string"), F.lit("invalid")).alias("kind"))
