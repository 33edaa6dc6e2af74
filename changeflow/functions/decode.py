"""Decoders of the logical types in a change envelope, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.frames import UNAVAILABLE

_LAST_DAY = 2932896  # 9999-12-31, in days since 1970
_END_MICROS = 253402300800 * 1_000_000  # the start of the year 10000


def integer(c: Column) -> Column:
    """A whole number from its JSON text."""
    return c.try_cast("bigint")


def binary(c: Column) -> Column:
    """Bytes from base64 text; null for the unavailable value and for text that is no base64."""
    return F.when(~is_unavailable(c), F.try_to_binary(c, F.lit("base64")))


def is_unavailable(c: Column) -> Column:
    """Whether the value was not sent: the placeholder as such, in base64, or as a list's only item; a null was sent."""
    encoded = F.base64(F.lit(UNAVAILABLE).cast("binary"))
    return F.coalesce((c == UNAVAILABLE) | (c == encoded) | (c == f'["{UNAVAILABLE}"]'), F.lit(False))


def date(days: Column) -> Column:
    """Days since the epoch; null beyond the year 9999."""
    return F.when(days <= _LAST_DAY, F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")))


def _micros(c: Column, unit: str) -> Column:
    c = c.try_cast("bigint")
    return F.try_multiply(c, F.lit(1000).cast("bigint")) if unit == "ms" else c if unit == "us" else F.call_function("div", c, F.lit(1000)).cast("bigint")


def _wall_clock(micros: Column) -> Column:
    """Microseconds since the epoch as a timestamp without zone, that of UTC whatever the session's zone."""
    seconds = (micros.cast("decimal(18,0)") * F.lit(Decimal("0.000001"))).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds)


def clock(c: Column, unit: str) -> Column:
    """Time of day as ``HH:mm:ss.SSSSSS`` from ``ms``, ``us`` or ``ns`` since midnight; nanoseconds are cut."""
    return F.date_format(_wall_clock(_micros(c, unit)), "HH:mm:ss.SSSSSS")


def zoned_clock(c: Column) -> Column:
    """Time of day with a zone: the wall clock stays, the zone is dropped."""
    m = F.regexp_extract(c, r"^(\d{2}:\d{2}:\d{2})(?:\.(\d{1,9}))?(?:Z|[+-]\d{2}:?\d{2})?$", 1)
    part = F.regexp_extract(c, r"^\d{2}:\d{2}:\d{2}\.(\d{1,6})", 1)
    return F.when(m != "", F.concat(m, F.lit("."), F.rpad(part, 6, "0")))


def timestamp(c: Column, unit: str, utc: bool = False) -> Column:
    """Timestamp without zone (with ``utc`` one with it) from ``ms``, ``us`` or ``ns`` since the epoch; null beyond the year 9999 and for what 64 bits don't hold."""
    micros = _micros(c, unit)
    return F.when(micros < _END_MICROS, F.timestamp_micros(micros) if utc else _wall_clock(micros))


def zoned_timestamp(c: Column) -> Column:
    """RFC 3339 text; null for negative years, the year 0 and years of more than four digits."""
    odd = c.startswith("-") | c.rlike(r"^\d{5,}-") | c.startswith("0000-")
    return F.when(~odd & c.rlike(r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"), c.try_cast("timestamp"))


_BASE, _STEP = 1_000_000_000, 1 << 28


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``value`` is worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _limbs(bits: Column) -> Column:
    """A hexadecimal number of any length in limbs of nine decimal digits, the lowest first; seven hexadecimal digits are taken in at a time."""
    longs = F.array().cast("array<bigint>")
    # The first piece is the shorter one.
    pieces = _let(bits, lambda h: F.transform(F.sequence(F.floor((F.length(h) - 1) / 7).cast("int"), F.lit(0)), lambda i: F.conv(F.substring(h, F.greatest(F.length(h) - 7 * (i + 1), F.lit(0)) + 1, F.least(F.lit(7), F.length(h) - 7 * i)), 16, 10).cast("bigint")))

    def one(s: Column, limb: Column) -> Column:
        return _let(limb * _STEP + s["carry"], lambda t: F.struct(F.call_function("div", t, F.lit(_BASE)).cast("bigint").alias("carry"), F.concat(s["out"], F.array((t % _BASE).cast("bigint"))).alias("out")))

    def take(limbs: Column, piece: Column) -> Column:
        return _let(F.aggregate(limbs, F.struct(piece.alias("carry"), longs.alias("out")), one), lambda s: F.when(s["carry"] > 0, F.concat(s["out"], F.array(s["carry"]))).otherwise(s["out"]))

    return F.aggregate(pieces, longs, take)


def _digits_of(limbs: Column) -> Column:
    return _let(limbs, lambda l: F.when(F.size(l) == 0, F.lit("0")).otherwise(F.array_join(F.transform(F.reverse(l), lambda x, i: F.when(i == 0, x.cast("string")).otherwise(F.lpad(x.cast("string"), 9, "0"))), "")))


def _plus_one(limbs: Column) -> Column:
    """Limbs of the number after: the first one that isn't all nines goes up, those before it go to 0."""

    def step(s: Column, x: Column) -> Column:
        return F.when(s["up"] & (x == _BASE - 1), F.struct(F.lit(True).alias("up"), F.concat(s["out"], F.array(F.lit(0).cast("bigint"))).alias("out"))).otherwise(
            F.struct(F.lit(False).alias("up"), F.concat(s["out"], F.array(x + s["up"].cast("bigint"))).alias("out"))
        )

    done = F.aggregate(limbs, F.struct(F.lit(True).alias("up"), F.array().cast("array<bigint>").alias("out")), step)
    return _let(done, lambda s: F.when(s["up"], F.concat(s["out"], F.array(F.lit(1).cast("bigint")))).otherwise(s["out"]))


def _long_text(raw: Column) -> Column:
    """A two's complement number of more than eight bytes, in hexadecimal, as text."""
    # Minus n is the complement of n - 1.
    below = _digits_of(_plus_one(_limbs(F.translate(raw, "0123456789ABCDEF", "FEDCBA9876543210"))))
    return F.when(_negative(raw), F.concat(F.lit("-"), below)).otherwise(_digits_of(_limbs(raw)))


def _negative(raw: Column) -> Column:
    return F.substring(raw, 1, 1).isin(*"89ABCDEF")


def _short(raw: Column) -> Column:
    """A two's complement number of up to eight bytes, in hexadecimal, as bigint."""
    return F.conv(F.when(_negative(raw), F.lpad(raw, 16, "F")).otherwise(raw), 16, -10).try_cast("bigint")


def _whole_text(c: Column) -> Column:
    """A base64 big-endian two's complement number of any length as text; null for what is none."""
    raw = F.hex(F.try_to_binary(c, F.lit("base64")))
    n = F.length(raw)
    return F.when(n.between(2, 16), _short(raw).cast("string")).when(n > 16, _let(raw, _long_text))


def fixed_decimal(c: Column, scale: int, precision: int = 38) -> Column:
    """Base64 of a big-endian two's complement number of any length, as decimal(precision, scale).

    Null if the digits don't fit, or if the text is no base64 or empty.
    """
    kind = f"decimal({precision},{scale})"
    long_ = any_decimal(c, F.lit(scale)).try_cast(kind)
    if scale > 18:
        return long_
    # Up to eight bytes: a bigint and a shift of the point, no text.
    raw = F.hex(F.try_to_binary(c, F.lit("base64")))
    moved = (_short(raw).cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-scale)).cast(f"decimal({scale + 1},{scale})")).try_cast(kind)
    return F.when(F.length(raw).between(2, 16), moved).when(F.length(raw) > 16, long_)


def any_decimal(value: Column, scale: Column) -> Column:
    """Base64 number of any length with its scale, as plain text (never with an exponent); null without either or for what is no base64."""
    k = scale.try_cast("int")

    def pointed(whole: Column) -> Column:
        def place(digits: Column) -> Column:
            at = F.length(digits) - k
            text = (
                F.when(k > 0, F.concat(F.substring(digits, F.lit(1), at), F.lit("."), F.substring(digits, at + 1, k)))
                .when((k < 0) & (digits != "0"), F.concat(digits, F.repeat(F.lit("0"), -k))).otherwise(digits)
            )
            return F.when(whole.startswith("-"), F.concat(F.lit("-"), text)).otherwise(text)

        digits = F.ltrim(whole, F.lit("-"))
        return _let(F.lpad(digits, F.greatest(F.length(digits), k + 1), F.lit("0")), place)

    return F.when(k.isNotNull(), _let(_whole_text(value), pointed))


def encode_decimal(c: Column, scale: int) -> Column:
    """A decimal as :func:`fixed_decimal` reads it, eight bytes long, rescaled half up; null beyond 18 digits."""
    unscaled = F.round(c.cast("decimal(38,18)") * F.lit(10**scale).cast("decimal(19,0)"), 0).try_cast("decimal(18,0)").cast("bigint")
    return F.base64(F.unhex(F.lpad(F.hex(unscaled), 16, "0")))


def variable_decimal(c: Column) -> Column:
    """``{"scale": s, "value": base64}`` as plain text; null if either is missing."""
    return any_decimal(F.get_json_object(c, "$.value"), F.get_json_object(c, "$.scale"))


def double(c: Column) -> Column:
    """A number; the text ``NaN`` is null."""
    return F.nullif(c, F.lit("NaN")).try_cast("double")


def json_value(c: Column) -> Column:
    """JSON text in canonical form; empty text and the placeholder stay as they are; null if it is no JSON."""
    return F.when((c == "") | (c == UNAVAILABLE), c).otherwise(F.to_json(F.try_parse_json(c)))


def bits(c: Column) -> Column:
    """Bit fields stay base64 text."""
    return c


def text_array(c: Column, item: dict | None = None) -> Column:
    """A JSON list as list of text, objects in it as JSON; a lone value as a list of one; the lone placeholder is null.

    ``item``: the field of the elements as the envelope has it (``type, name, parameters,
    items``); each is decoded by it. A list in a list is a list in JSON.
    """
    items = F.from_json(c, "array<string>")
    if item and (item.get("name") in ELEMENT_DECODERS or item.get("type") in ELEMENT_DECODERS or item.get("name") == DECIMAL or item.get("type") == "array"):
        each = (lambda x: F.to_json(text_array(x, item.get("items")))) if item.get("type") == "array" else (lambda x: decode(x, item.get("name"), item.get("type"), item.get("parameters")).cast("string"))
        items = F.transform(items, each)
    return F.when(is_unavailable(c), F.lit(None)).when(F.ltrim(c).startswith("["), items).when(c.isNotNull(), F.array(c))


def point(c: Column) -> Column:
    """``{"x":..,"y":..}`` as a GeoJSON feature."""
    x, y = F.get_json_object(c, "$.x"), F.get_json_object(c, "$.y")
    return F.when(x.isNotNull() & y.isNotNull(), F.concat(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":['), x, F.lit(","), y, F.lit("]},\"properties\":null}")))


_SHAPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}


def read_wkb(data: bytes, at: int = 0) -> tuple[dict, int]:
    """A geometry in (extended) well-known binary, as GeoJSON, and where it ends."""
    import struct

    order = "<" if data[at] == 1 else ">"
    (code,) = struct.unpack_from(f"{order}I", data, at + 1)
    at += 5
    if code & 0x20000000:
        at += 4
    dims = 2 + bool(code & 0x80000000) + bool(code & 0x40000000)
    kind = code & 0xFF

    def numbers(at: int) -> tuple[list[float], int]:
        return list(struct.unpack_from(f"{order}{dims}d", data, at)), at + 8 * dims

    def many(at: int, read) -> tuple[list, int]:  # noqa: ANN001
        (n,) = struct.unpack_from(f"{order}I", data, at)
        at, out = at + 4, []
        for _ in range(n):
            x, at = read(at)
            out.append(x)
        return out, at

    inner = lambda at: read_wkb(data, at)
    if kind == 1:
        xy, at = numbers(at)
    elif kind == 2:
        xy, at = many(at, numbers)
    elif kind == 3:
        xy, at = many(at, lambda a: many(a, numbers))
    elif kind in (4, 5, 6):
        parts, at = many(at, inner)
        xy = [p["coordinates"] for p in parts]
    elif kind == 7:
        parts, at = many(at, inner)
        return {"type": "GeometryCollection", "geometries": parts}, at
    else:
        raise ValueError(f"unknown geometry {kind}")
    return {"type": _SHAPES[kind], "coordinates": xy}, at


@F.pandas_udf(T.StringType())
def _geometry(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import base64
    import json
    import struct

    def one(text: str | None) -> str | None:
        if not text:
            return None
        try:
            shape, _ = read_wkb(base64.b64decode(text))
        except (ValueError, IndexError, struct.error):
            return None
        return json.dumps({"type": "Feature", "geometry": shape, "properties": None}, separators=(",", ":"))

    for v in values:
        yield pd.Series([one(x) for x in v], dtype=object)


def geometry(c: Column) -> Column:
    """``{"wkb": base64}`` as a GeoJSON feature; null if it can't be read."""
    return _geometry(F.get_json_object(c, "$.wkb"))


@F.pandas_udf(T.BinaryType())
def _gunzip(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    import base64
    import gzip
    import zlib

    def one(text: str | None) -> bytes | None:
        try:
            return None if text is None else gzip.decompress(base64.b64decode(text))
        except (ValueError, OSError, EOFError, zlib.error):
            return None

    for v in values:
        yield pd.Series([one(x) for x in v], dtype=object)


def gunzip(c: Column) -> Column:
    """Bytes of a base64, gzip-compressed field; null if it can't be unpacked."""
    return _gunzip(c)


#: Decoder of each logical type (name in the envelope's schema) or plain type.
DECODERS = {
    "io.debezium.time.Date": lambda c: date(integer(c)), "org.apache.kafka.connect.data.Date": lambda c: date(integer(c)),
    "io.debezium.time.Time": lambda c: clock(integer(c), "ms"), "org.apache.kafka.connect.data.Time": lambda c: clock(integer(c), "ms"),
    "io.debezium.time.MicroTime": lambda c: clock(integer(c), "us"), "io.debezium.time.NanoTime": lambda c: clock(integer(c), "ns"),
    "io.debezium.time.ZonedTime": zoned_clock, "io.debezium.time.ZonedTimestamp": zoned_timestamp,
    "io.debezium.time.Timestamp": lambda c: timestamp(integer(c), "ms"), "org.apache.kafka.connect.data.Timestamp": lambda c: timestamp(integer(c), "ms"),
    "io.debezium.time.MicroTimestamp": lambda c: timestamp(integer(c), "us"), "io.debezium.time.NanoTimestamp": lambda c: timestamp(integer(c), "ns"),
    "io.debezium.time.Year": integer, "io.debezium.time.MicroDuration": integer, "io.debezium.time.Interval": lambda c: c,
    "io.debezium.data.VariableScaleDecimal": variable_decimal, "io.debezium.data.Json": json_value, "io.debezium.data.Bits": bits,
    "io.debezium.data.Uuid": lambda c: c, "io.debezium.data.Ltree": lambda c: c, "io.debezium.data.Enum": lambda c: c, "io.debezium.data.EnumSet": lambda c: c, "io.debezium.data.Xml": lambda c: c,
    "io.debezium.data.geometry.Point": point, "io.debezium.data.geometry.Geometry": geometry, "io.debezium.data.geometry.Geography": geometry,
    "int16": integer, "int32": integer, "int64": integer, "float": double, "double": double, "boolean": lambda c: c.try_cast("boolean"),
    "string": lambda c: c, "bytes": binary, "array": text_array, "struct": lambda c: c, "map": lambda c: c,
}


DECIMAL = "org.apache.kafka.connect.data.Decimal"
#: Logical types without a zone that ``force_utc`` gives one, with their units.
_WITHOUT_ZONE = {"io.debezium.time.Timestamp": "ms", "org.apache.kafka.connect.data.Timestamp": "ms", "io.debezium.time.MicroTimestamp": "us", "io.debezium.time.NanoTimestamp": "ns"}
#: Types whose elements in a list need decoding; the others' text is the value.
ELEMENT_DECODERS = {k for k in DECODERS if k.startswith(("io.debezium.time.", "org.apache.kafka.connect.data.")) and not k.endswith("Interval")} | {"io.debezium.data.VariableScaleDecimal", "io.debezium.data.Json", "io.debezium.data.geometry.Point"}


def decode(c: Column, logical: str | None, plain: str, parameters: dict[str, str] | None = None, items: dict | None = None, compressed: bool = False, force_utc: bool = False) -> Column:
    """A field's JSON text in its Spark type, by its logical type, else its plain type.

    ``items``: the field of a list's elements. ``compressed``: the value is base64 of
    gzip; the placeholder stays as it is. ``force_utc``: timestamps without a zone get UTC.
    """
    if compressed:
        packed = gunzip(c)
        if plain == "bytes" and not logical:
            return F.when(~is_unavailable(c), packed)
        c = F.when(is_unavailable(c), c).otherwise(packed.cast("string"))
    if logical == DECIMAL:
        p = parameters or {}
        digits = int(p.get("connect.decimal.precision", 38))
        if digits > 38:
            return any_decimal(c, F.lit(int(p.get("scale", 0))))
        return fixed_decimal(c, int(p.get("scale", 0)), digits)
    if plain == "array" and not logical:
        return text_array(c, items)
    if force_utc and logical in _WITHOUT_ZONE:
        return timestamp(integer(c), _WITHOUT_ZONE[logical], utc=True)
    return DECODERS.get(logical or plain, DECODERS.get(plain, lambda x: x))(c)
