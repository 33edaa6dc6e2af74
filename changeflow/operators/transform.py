"""Per-row steps: choosing, adding and masking columns, keys, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TopicConfig
from ..functions import masking


def exclude_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Without the named columns; names that aren't there are ignored."""
    return df.drop(*names)


def include_columns(df: DataFrame, names: list[str], keys: list[str], prefix: str = "__cf_") -> DataFrame:
    """Only the named columns, and the engine's own; the key must be among them."""
    lost = [k for k in keys if k not in names]
    if lost:
        raise ValueError(f"key columns must be included: {lost}")
    return df.select(*[c for c in df.columns if c in names or c.startswith(prefix)])


def static_columns(df: DataFrame, values: dict[str, str]) -> DataFrame:
    """With constant columns; a name that the data has is an error."""
    clash = [c for c in values if c.lower() in {x.lower() for x in df.columns}]
    if clash:
        raise ValueError(f"static columns are in the data: {clash}")
    return df.withColumns({c: F.lit(v) for c, v in values.items()})


def skip_operations(df: DataFrame, skipped: set[str], op: str = "op") -> DataFrame:
    """Without the rows of the named operations; a null operation stays."""
    return df.where(~F.coalesce(F.lower(F.trim(F.col(op))).isin(*skipped), F.lit(False))) if skipped else df


def hash_columns(df: DataFrame, names: list[str], salt: str = "") -> DataFrame:
    return df.withColumns({c: masking.hash_value(F.col(c), salt) for c in names})


def encrypt_columns(df: DataFrame, names: list[str], key: bytes, json_columns: list[str] | None = None) -> DataFrame:
    """Encrypts the named columns, and structured ones as JSON."""
    cols = {c: masking.encrypt(F.col(c), key) for c in names}
    cols |= {c: masking.encrypt(F.to_json(c), key) for c in json_columns or []}
    return df.withColumns(cols)


def meta_columns(df: DataFrame, cfg: TopicConfig, op: str = "op", source_ts: str = "source_ts", source: str = "source", prefix: str = "__cf_") -> DataFrame:
    """Adds the optional columns that a topic asks for."""
    cols: dict[str, Column] = {}
    if cfg.operation:
        cols[f"{prefix}operation"] = F.col(op)
    if cfg.db_updated_at:
        cols[f"{prefix}db_updated_at"] = F.timestamp_millis(source_ts)
    if cfg.updated_at:
        cols[f"{prefix}updated_at"] = F.current_timestamp()
    if cfg.source_metadata:
        cols[f"{prefix}source_metadata"] = F.to_json(source)
    if cfg.full_table_name:
        cols[f"{prefix}full_table_name"] = F.concat_ws(".", f"{source}.schema", f"{source}.table")
    return df.withColumns(cols) if cols else df


def key_columns(cfg: TopicConfig, from_key: list[str] | None) -> list[str]:
    """The key's names, in order: an override, else the message key's with the ones to include.

    A topic without message keys needs names of its own.
    """
    if not from_key and not cfg.keys_override and not cfg.keys_include:
        raise ValueError(f"messages of {cfg.topic} have no key, and no key columns are set")
    return sorted(cfg.keys_override or {*(from_key or []), *cfg.keys_include})


def same_number(c: Column) -> Column:
    """One text for all forms of a whole number (``7``, ``7.0``, ``7e0``); other text as it is."""
    n = c.try_cast("decimal(38,10)")
    return F.coalesce(F.when(n == F.floor(n), n.try_cast("decimal(28,0)").cast("string")), c)


def check_rows(df: DataFrame, keys: list[str], table: str, prefix: str = "__cf_", needs_marker: bool = True) -> DataFrame:
    """The same rows; a missing table name, key column or delete marker column is an error at once, a row without data,
    with a null key or a null delete marker one when it is read."""
    if not table:
        raise ValueError("the table has no name")
    if not keys:
        raise ValueError("there is no key")
    marker = f"{prefix}delete"
    absent = [c for c in [*keys, *([marker] if needs_marker else [])] if c not in df.columns]
    if absent:
        raise ValueError(f"columns are missing: {absent}")
    data = [c for c in df.columns if not c.startswith(prefix)]
    problem = F.when(~F.greatest(F.lit(False), *[F.col(c).isNotNull() for c in data]), F.lit("a row has no data"))
    for k in keys:
        problem = problem.when(F.col(k).isNull(), F.lit(f"the key {k} is null"))
    if needs_marker:
        problem = problem.when(F.col(marker).isNull(), F.lit(f"{marker} is null"))
    first = df.columns[0]
    checked = F.when(problem.isNotNull(), F.raise_error(F.concat(F.lit(f"{table}: "), problem)).cast(df.schema[first].dataType)).otherwise(F.col(first))
    return df.withColumn(first, checked)


def table_name(cfg: TopicConfig, table: Column, history: bool = False) -> Column:
    """Where a row goes: the configured table, else the message's own; history has a suffix."""
    name = F.lit(cfg.table) if cfg.table else table
    return F.concat(name, F.lit("__history")) if history else name


def apply_topic(df: DataFrame, cfg: TopicConfig, keys: list[str], key: bytes | None = None, prefix: str = "__cf_") -> DataFrame:
    """A topic's column settings in the engine's order: columns out, constants in, masks, skipped operations last."""
    if cfg.exclude:
        df = exclude_columns(df, list(cfg.exclude))
    if cfg.include:
        df = include_columns(df, [*cfg.include, "op"], keys, prefix)
    if cfg.static:
        df = static_columns(df, dict(cfg.static))
    if cfg.hash:
        df = hash_columns(df, [c for c in cfg.hash if c in df.columns], cfg.hash_salt)
    structured = [f.name for f in df.schema if isinstance(f.dataType, T.StructType | T.MapType) or f.dataType.typeName() == "variant"] if cfg.encrypt_json else []
    plain = [c for c in cfg.encrypt if c in df.columns and c not in structured]
    if cfg.encrypt or cfg.encrypt_json:
        if not key:
            raise ValueError("columns are to be encrypted and there is no key")
        df = encrypt_columns(df, plain, key, structured)
    return skip_operations(df, cfg.skipped())
