"""Parsing text to values and values to text, by kind."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kinds import Kind, spark_type

#: Fixed value: what stands for a value that is too long.
EXCEEDED = "__cf_exceeded_value"

#: The timestamp forms with a zone: RFC 3339 with up to nine decimals, and the mail, Unix and log forms.
_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"
_OFFSET = r"[+-]\d{4}"
#: (pattern the text must have, layout without its day name, part of the text that the layout reads)
_OTHERS = (
    (r"^[A-Z][a-z]{2} ([A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2} \d{4})$", "MMM d HH:mm:ss yyyy"),
    (r"^[A-Z][a-z]{2} ([A-Z][a-z]{2} \d{2} \d{2}:\d{2}:\d{2} " + _OFFSET + r" \d{4})$", "MMM dd HH:mm:ss xx yyyy"),
    (r"^(\d{2} [A-Z][a-z]{2} \d{2} \d{2}:\d{2} " + _OFFSET + ")$", "dd MMM yy HH:mm xx"),
    (r"^[A-Z][a-z]{2}, (\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} " + _OFFSET + ")$", "dd MMM yyyy HH:mm:ss xx"),
)
_UTC = (
    (r"^[A-Z][a-z]{2} ([A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2}) (?:UTC|GMT) (\d{4})$", "MMM d HH:mm:ss yyyy"),
    (r"^(\d{2} [A-Z][a-z]{2} \d{2} \d{2}:\d{2}) (?:UTC|GMT)()$", "dd MMM yy HH:mm"),
    (r"^[A-Z][a-z]+day, (\d{2}-[A-Z][a-z]{2}-\d{2} \d{2}:\d{2}:\d{2}) (?:UTC|GMT)()$", "dd-MMM-yy HH:mm:ss"),
    (r"^[A-Z][a-z]{2}, (\d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2}) (?:UTC|GMT)()$", "dd MMM yyyy HH:mm:ss"),
)


def parse_date(c: Column) -> Column:
    """``yyyy-MM-dd`` exactly, else the date of a timestamp with zone; null if neither."""
    exact = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))
    return F.coalesce(exact, parse_timestamp_tz(c).cast("date"))


def parse_timestamp_tz(c: Column) -> Column:
    """A timestamp in RFC 3339 or one of the older named forms, only if the text has exactly that form, else a date; null if none fits.

    A zone given by name is read if it is UTC or GMT.
    """
    found = [F.when(c.rlike(_ISO), c.try_cast("timestamp"))]
    found += [F.when(c.rlike(p), F.try_to_timestamp(F.regexp_replace(F.regexp_extract(c, p, 1), "  ", " "), F.lit(f))) for p, f in _OTHERS]
    for p, f in _UTC:
        body = F.rtrim(F.concat_ws(" ", F.regexp_replace(F.regexp_extract(c, p, 1), "  ", " "), F.regexp_extract(c, p, 2)))
        found.append(F.when(c.rlike(p), F.try_to_timestamp(body, F.lit(f))))
    found.append(F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date").cast("timestamp")))
    return F.coalesce(*found)


def parse_timestamp_ntz(c: Column) -> Column:
    """``yyyy-MM-dd`` ``T`` or blank ``HH:mm:ss`` with up to nine decimals that don't end in 0; null otherwise."""
    form = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{0,8}[1-9])?$"
    return F.when(c.rlike(form), c.try_cast("timestamp_ntz"))


def parse_time(c: Column) -> Column:
    """Time of day ``HH:mm:ss.SSSSSS``: a clock time with or without zone, else a timestamp's; null if neither."""
    clock = F.regexp_extract(c, r"^(\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?)(?:Z|[+-]\d{2}:\d{2})?$", 1)
    day = F.concat(F.lit("1970-01-01 "), clock).try_cast("timestamp_ntz")
    return F.date_format(F.coalesce(day, parse_timestamp_tz(c).cast("timestamp_ntz")), "HH:mm:ss.SSSSSS")


def from_millis(c: Column) -> Column:
    """Milliseconds since the epoch, whole or with decimals (kept to the microsecond)."""
    return F.timestamp_micros(F.round(c.cast("double") * 1000).cast("bigint"))


def is_json(c: Column) -> Column:
    """Whether text is a JSON object or list: begins with ``{`` or ``[``, blanks aside, and is valid."""
    return F.coalesce(F.ltrim(c).rlike(r"^[\[{]") & F.try_parse_json(c).isNotNull(), F.lit(False))


def overlong(c: Column, limit: int = 65_535, action: str = "mark", json_limit: int = 16 << 20) -> Column:
    """A value over ``limit`` bytes, marked (:data:`EXCEEDED`), cut to as many bytes as whole characters allow, or kept to be widened.

    ``action``: ``mark``, ``truncate``, ``widen`` (kept up to 65,535 bytes) or ``json``:
    a JSON value may have ``json_limit`` bytes and is replaced by an object that says so.
    """
    n = F.octet_length(c)
    if action == "json":
        return F.when(~is_json(c), overlong(c, limit)).when(n > json_limit, F.lit('{"key":"' + EXCEEDED + '"}')).otherwise(c)
    if action == "truncate":
        return F.when(n > limit, _cut(c, limit)).otherwise(c)
    return F.when(n > (65_535 if action == "widen" else limit), F.lit(EXCEEDED)).otherwise(c)


@F.pandas_udf(T.StringType())
def _cut_udf(values: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for v, n in values:
        yield pd.Series([None if a is None else a.encode()[:b].decode("utf8", "ignore") for a, b in zip(v, n, strict=True)], dtype=object)


def _cut(c: Column, limit: int) -> Column:
    # Text without multi-byte characters is cut in the JVM.
    return F.when(F.octet_length(c) == F.length(c), F.substring(c, 1, limit)).otherwise(_cut_udf(c, F.lit(limit)))


def escape_backslashes(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("\\\\"))


def repair_utf8(c: Column) -> Column:
    """Bytes as text; each byte that is no UTF-8 is read as Latin-1."""
    ok = F.try_validate_utf8(c.cast("string"))
    return F.coalesce(ok, _latin(c.cast("binary")))


@F.pandas_udf(T.StringType())
def _latin(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(b: bytes | None) -> str | None:
        out = []
        while b:
            try:
                out.append(b.decode())
                break
            except UnicodeDecodeError as e:
                out.append(b[: e.start].decode() + chr(b[e.start]))
                b = b[e.start + 1 :]
        return None if b is None else "".join(out)

    for v in values:
        yield pd.Series([one(x) for x in v], dtype=object)


def to_text(c: Column, kind: Kind, cut_scale: int | None = None, binary_bool: bool = False) -> Column:
    """A value as text: numbers plainly, lists and objects as JSON, times to the microsecond, timestamps in RFC 3339."""
    match kind.name:
        case "bool":
            return F.when(c, "1" if binary_bool else "true").otherwise(F.when(~c, "0" if binary_bool else "false"))
        case "decimal":
            return (F.bround(c, cut_scale) if cut_scale is not None else c).cast("string")
        case "float":
            plain = F.regexp_replace(F.regexp_replace(F.format_string("%.17f", c), r"(\.\d*?)0+$", "$1"), r"\.$", "")
            return F.when(c == c.try_cast("bigint"), c.try_cast("bigint").cast("string")).when(c.cast("string").contains("E"), plain).otherwise(c.cast("string"))
        case "struct" | "array":
            return F.to_json(c)
        case "date":
            return F.date_format(c, "yyyy-MM-dd")
        case "timestamp_ntz":
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        case "timestamp_tz":
            return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
        case "bytes":
            return F.base64(c)
    return c.cast("string")


def convert(c: Column, kind: Kind, bad: str = "null") -> Column:
    """Text as a value of a kind. ``bad``: what becomes of a value that doesn't fit: ``null`` or ``error``."""
    match kind.name:
        case "date":
            v = parse_date(c)
        case "time":
            v = parse_time(c)
        case "timestamp_ntz":
            v = parse_timestamp_ntz(c)
        case "timestamp_tz":
            v = parse_timestamp_tz(c)
        case "bool":
            v = F.when(F.lower(c).isin("true", "1"), F.lit(True)).when(F.lower(c).isin("false", "0"), F.lit(False))
        case "int":
            exact = c.try_cast("decimal(38,10)")
            v = F.when(exact == F.floor(exact), exact.try_cast(spark_type(kind)))
        case "array":
            v = F.from_json(c, "array<string>")
        case _:
            v = c.try_cast(spark_type(kind))
    if bad == "null":
        return v
    return F.when(c.isNotNull() & v.isNull(), F.raise_error(F.concat(F.lit(f"no {kind.name}: "), c)).cast(spark_type(kind))).otherwise(v)


def text_list(c: Column, kind: T.DataType | None = None) -> Column:
    """Each element of a list as text; maps, structs and lists as JSON; a value that is no list as a list of one.

    ``kind``: the column's type; without it a list of plain values.
    """
    if kind is not None and not isinstance(kind, T.ArrayType):
        return F.when(c.isNotNull(), F.array(_as_text(c, kind)))
    return F.transform(c, lambda x: _as_text(x, kind.elementType if kind is not None else None))


def _as_text(x: Column, kind: T.DataType | None) -> Column:
    return F.to_json(x) if isinstance(kind, T.StructType | T.MapType | T.ArrayType) or (kind is not None and kind.typeName() == "variant") else x.cast("string")


def float32(c: Column) -> Column:
    """A number as a 32-bit float; null if it is none or too large for one."""
    v = c.try_cast("double")
    return F.when(F.abs(v) <= F.lit(3.4028234663852886e38), v.cast("float"))


def approximate_bytes(*columns: str) -> Column:
    """About how many bytes a row's values take: the length of its JSON."""
    return F.octet_length(F.to_json(F.struct(*columns)))
