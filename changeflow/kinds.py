"""Logical kinds, their Spark types, type texts of ten SQL dialects, and name rules."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import types as T

#: More digits than this can't be a Spark decimal; such numbers are text.
MAX_DIGITS = 38


@dataclass(frozen=True)
class Kind:
    """A logical type: ``name`` with the modifiers that apply to it."""

    name: str
    precision: int | None = None  # of a decimal; None: not specified
    scale: int | None = None
    width: str | None = None  # of an int: small, integer, big
    length: int | None = None  # of a string
    element: str | None = None  # of an array


INVALID, BOOL, INT, FLOAT, DECIMAL, STRING, STRUCT, ARRAY, BYTES, DATE, TIME, NTZ, TZ, UUID, INTERVAL = (
    Kind(n) for n in ("invalid", "bool", "int", "float", "decimal", "string", "struct", "array", "bytes", "date", "time", "timestamp_ntz", "timestamp_tz", "uuid", "interval")
)


def decimal_kind(precision: int | None, scale: int | None = None) -> Kind:
    """A decimal; a scale above the precision raises the precision to one more than the scale."""
    if precision is not None and scale is not None and scale > precision:
        precision = scale + 1
    return Kind("decimal", precision, scale)


def spark_type(kind: Kind) -> T.DataType:
    """The column type that stores a kind; structs are JSON text, decimals that don't fit are text."""
    if kind.name == "int":
        return {"small": T.ShortType(), "integer": T.IntegerType()}.get(kind.width, T.LongType())
    if kind.name == "decimal":
        if kind.precision is None or kind.precision > MAX_DIGITS or kind.precision < 1:
            return T.StringType()
        return T.DecimalType(kind.precision, kind.scale or 0)
    simple = {
        "invalid": T.NullType(), "bool": T.BooleanType(), "float": T.DoubleType(), "array": T.ArrayType(T.StringType()),
        "bytes": T.BinaryType(), "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(), "timestamp_tz": T.TimestampType(),
    }
    return simple.get(kind.name, T.StringType())


def kind_of(t: T.DataType) -> Kind:
    """The kind that a Spark type stands for."""
    if isinstance(t, T.DecimalType):
        return Kind("decimal", t.precision, t.scale)
    by = [
        (T.NullType, INVALID), (T.BooleanType, BOOL), (T.ByteType, Kind("int", width="small")), (T.ShortType, Kind("int", width="small")),
        (T.IntegerType, Kind("int", width="integer")), (T.LongType, Kind("int", width="big")), (T.FloatType, FLOAT), (T.DoubleType, FLOAT),
        (T.BinaryType, BYTES), (T.DateType, DATE), (T.TimestampNTZType, NTZ), (T.TimestampType, TZ),
        (T.ArrayType, ARRAY), (T.MapType, STRUCT), (T.StructType, STRUCT),
    ]
    return next((k for c, k in by if isinstance(t, c)), STRUCT if t.typeName() == "variant" else STRING)


#: The type text of each dialect for each kind (int widths and unspecified decimals apart).
TYPE_TEXT = {
    "spark": {"bool": "BOOLEAN", "int": "BIGINT", "float": "DOUBLE", "decimal": "STRING", "string": "STRING", "struct": "STRING", "array": "STRING", "bytes": "BINARY", "date": "DATE", "time": "STRING", "timestamp_ntz": "TIMESTAMP_NTZ", "timestamp_tz": "TIMESTAMP"},
    "databricks": {"bool": "BOOLEAN", "int": "BIGINT", "float": "DOUBLE", "decimal": "STRING", "string": "STRING", "struct": "STRING", "array": "ARRAY<string>", "bytes": "BINARY", "date": "DATE", "time": "STRING", "timestamp_ntz": "TIMESTAMP_NTZ", "timestamp_tz": "TIMESTAMP"},
    "snowflake": {"bool": "boolean", "int": "int", "float": "float", "decimal": "string", "string": "string", "struct": "variant", "array": "array", "bytes": "binary", "date": "date", "time": "time", "timestamp_ntz": "timestamp_ntz", "timestamp_tz": "timestamp_tz"},
    "bigquery": {"bool": "bool", "int": "int64", "float": "float64", "decimal": "numeric", "string": "string", "struct": "json", "array": "array<string>", "bytes": "bytes", "date": "date", "time": "time", "timestamp_ntz": "datetime", "timestamp_tz": "timestamp"},
    "redshift": {"bool": "BOOLEAN NULL", "int": "INT8", "float": "float", "decimal": "VARCHAR(MAX)", "string": "VARCHAR(MAX)", "struct": "SUPER", "array": "VARCHAR(MAX)", "bytes": "VARBYTE", "date": "DATE", "time": "TIME", "timestamp_ntz": "TIMESTAMP WITHOUT TIME ZONE", "timestamp_tz": "TIMESTAMP WITH TIME ZONE"},
    "postgres": {"bool": "boolean", "int": "bigint", "float": "double precision", "decimal": "numeric", "string": "text", "struct": "jsonb", "array": "text[]", "bytes": "bytea", "date": "date", "time": "time", "timestamp_ntz": "timestamp without time zone", "timestamp_tz": "timestamp with time zone", "uuid": "uuid", "interval": "interval"},
    "mysql": {"bool": "BOOLEAN", "int": "BIGINT", "float": "DOUBLE", "decimal": "DECIMAL(65,30)", "string": "TEXT", "struct": "JSON", "array": "JSON", "bytes": "BLOB", "date": "DATE", "time": "TIME(6)", "timestamp_ntz": "DATETIME(6)", "timestamp_tz": "DATETIME(6)"},
    "mssql": {"bool": "BIT", "int": "bigint", "float": "float", "decimal": "VARCHAR(MAX)", "string": "VARCHAR(MAX)", "struct": "NVARCHAR(MAX)", "array": "NVARCHAR(MAX)", "bytes": "VARBINARY(MAX)", "date": "DATE", "time": "TIME", "timestamp_ntz": "datetime2", "timestamp_tz": "datetimeoffset", "interval": "NVARCHAR(MAX)"},
    "duckdb": {"bool": "boolean", "int": "bigint", "float": "double", "decimal": "decimal", "string": "text", "struct": "json", "array": "text[]", "bytes": "blob", "date": "date", "time": "time", "timestamp_ntz": "timestamp", "timestamp_tz": "timestamp with time zone", "interval": "interval"},
    "clickhouse": {"bool": "Bool", "int": "Int64", "float": "Float64", "decimal": "String", "string": "String", "struct": "JSON", "array": "Array(String)", "bytes": "String", "date": "Date", "time": "String", "timestamp_ntz": "DateTime", "timestamp_tz": "DateTime"},
}
#: Type text of narrower integers, where a dialect has them.
WIDTHS = {
    "spark": {"small": "INTEGER", "integer": "INTEGER", "big": "BIGINT"},
    "redshift": {"small": "INT2", "integer": "INT4", "big": "INT8"},
    "postgres": {"small": "smallint", "integer": "integer", "big": "bigint"},
    "duckdb": {"small": "smallint", "integer": "integer", "big": "bigint"},
    "clickhouse": {"small": "Int16", "integer": "Int32", "big": "Int64"},
}
#: The longest text that may be a key.
KEY_LENGTHS = {"mssql": 900, "mysql": 255}
#: The most digits of a decimal where that isn't Spark's own limit.
_DIGITS = {"postgres": 10_000, "clickhouse": 76, "bigquery": 76, "mysql": 65}


def type_text(kind: Kind, dialect: str, key: bool = False) -> str:
    """A kind's type text in a dialect; a decimal with too many digits there has the unspecified form, a text ``key`` a bounded length."""
    words = TYPE_TEXT[dialect]
    if kind.name == "decimal" and kind.precision is not None and kind.precision <= _DIGITS.get(dialect, MAX_DIGITS):
        name = "NUMERIC" if dialect in ("snowflake", "bigquery", "redshift", "postgres", "mssql") else "DECIMAL"
        if dialect == "bigquery" and (kind.precision > MAX_DIGITS or (kind.scale or 0) > 9):
            name = "BIGNUMERIC"
        return f"{name}({kind.precision}, {kind.scale or 0})"
    if kind.name == "int" and kind.width:
        return WIDTHS.get(dialect, {}).get(kind.width, words["int"])
    if kind.name == "string" and dialect in ("redshift", "mssql", "mysql"):
        most = KEY_LENGTHS.get(dialect) if key else None
        length = min((n for n in (kind.length, most) if n), default=None)
        return f"VARCHAR({length})" if length else words["string"]
    return words.get(kind.name, words["string"])


_TYPE = re.compile(r"^\s*([a-z_0-9 ]+?)\s*(?:\(([^)]*)\)\s*([a-z ]*))?$")
#: Names that the dialects use for each kind.
_NAMES = {
    "bool": "bool boolean bit", "float": "float float4 float8 float32 float64 double real double_precision", "struct": "variant json jsonb super object struct map",
    "string": "string text varchar nvarchar char character char_varying character_varying longtext mediumtext tinytext bpchar", "bytes": "binary bytes bytea varbyte varbinary blob",
    "date": "date date32", "time": "time time_without_time_zone", "timestamp_ntz": "timestamp_ntz datetime datetime2 timestamp_without_time_zone",
    "timestamp_tz": "timestamp_tz timestamptz datetimeoffset timestamp_with_time_zone timestamp_ltz", "uuid": "uuid", "interval": "interval",
}
_BY_NAME = {w: k for k, words in _NAMES.items() for w in words.split()}
_INTS = {"smallint": "small", "int2": "small", "int16": "small", "int": None, "integer": "integer", "int4": "integer", "int32": "integer", "bigint": "big", "int8": "big", "int64": "big", "tinyint": "small", "mediumint": "integer"}


def kind_from_text(text: str, dialect: str = "spark") -> Kind:
    """The kind of a dialect's type text, such as ``NUMERIC(10, 2)`` or ``VARCHAR(64)``; invalid if unknown."""
    if dialect == "clickhouse" and (m := re.match(r"(?i)nullable\((.*)\)$", text.strip())):
        text = m[1]
    low = text.strip().lower()
    if low.startswith("array") or low.endswith("[]"):
        return Kind("array", element="string")
    m = _TYPE.match(low)
    if not m:
        return INVALID
    name = "_".join(f"{m[1]} {m[3] or ''}".split())
    args = [int(a) for a in re.findall(r"\d+", m[2] or "")]
    name = name.removesuffix("_null")
    if name in ("decimal", "numeric", "bignumeric", "number", "bigdecimal"):
        return decimal_kind(args[0], args[1] if len(args) > 1 else 0) if args else DECIMAL
    if name in _INTS:
        return Kind("int", width=None if dialect == "snowflake" else _INTS[name])
    if name == "timestamp":
        return TZ if dialect in ("spark", "databricks", "bigquery") else NTZ
    if name in ("datetime64", "datetime") and dialect == "clickhouse":
        return TZ
    kind = _BY_NAME.get(name)
    if kind == "string" and args:
        return Kind("string", length=args[0])
    return Kind(kind) if kind else INVALID


def escape_name(name: str, reserved: frozenset[str] = frozenset()) -> str:
    """A safe column name: lower case, blanks and ``#`` as ``__``, ``col_`` before a leading digit or a reserved word."""
    if not name:
        return ""
    name = name.lower().replace(" ", "__")
    if name[0].isascii() and name[0].isdigit():
        name = "col_" + name
    name = name.replace("#", "__")
    return "col_" + name if name in reserved else name
