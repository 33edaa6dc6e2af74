"""Schema evolution: differences, adding, casting to the target, defaults, two-phase drops."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How long a column must be missing before it is dropped.
DROP_AFTER = timedelta(hours=4)


def schema_diff(source: T.StructType, target: T.StructType, keep: frozenset[str] = frozenset(), prefix: str = "__cf_") -> tuple[list[str], list[str]]:
    """Columns that the target lacks, and those that the source lacks, each in order; names match without case.

    Columns of the engine (by ``prefix``) don't count unless they are in ``keep``; a
    column of unknown type isn't missing from the target.
    """
    counts = lambda n: not n.startswith(prefix) or n in keep
    s, t = {n.lower() for n in source.names}, {n.lower() for n in target.names}
    add = [f.name for f in source if f.name.lower() not in t and counts(f.name) and not isinstance(f.dataType, T.NullType)]
    drop = [n for n in target.names if n.lower() not in s and counts(n)]
    return add, drop


def add_columns(target: DataFrame, source: T.StructType, prefix: str = "__cf_", keep: frozenset[str] = frozenset()) -> DataFrame:
    """The target with the source's new columns, null."""
    add, _ = schema_diff(source, target.schema, keep, prefix)
    return target.withColumns({n: F.lit(None).cast(source[n].dataType) for n in add}) if add else target


def cast_to_target(staged: DataFrame, target: T.StructType) -> DataFrame:
    """Staged columns in the target's names and types (matched without case); a value that doesn't fit is null, others stay."""
    by = {f.name.lower(): f for f in target}
    cols: list[Column] = []
    for f in staged.schema:
        to = by.get(f.name.lower())
        if to is None:
            if not isinstance(f.dataType, T.NullType):
                cols.append(F.col(f.name))
        elif to.dataType == f.dataType:
            cols.append(F.col(f.name).alias(to.name))
        elif isinstance(to.dataType, T.StringType) and isinstance(f.dataType, T.StructType | T.ArrayType | T.MapType):
            cols.append(F.to_json(f.name).alias(to.name))
        else:
            cols.append(F.col(f.name).try_cast(to.dataType).alias(to.name))
    return staged.select(*cols)


def widen_length(staged: DataFrame, column: str, limit: int | None) -> int | None:
    """The length that a limited text column needs for a batch, in bytes; never less than it has."""
    if limit is None:
        return None
    n = staged.agg(F.max(F.octet_length(column)).alias("n")).first().n
    return max(limit, n or 0)


#: Defaults that say nothing.
EMPTY_DEFAULTS = {"1970-01-01", "1970-01-01T00:00:00Z", "00000000-0000-0000-0000-000000000000", "CURRENT_TIMESTAMP"}


def default_counts(value: object) -> bool:
    """Whether a default is worth filling in: not null, the epoch, the nil UUID, or computed."""
    return value is not None and str(value) not in EMPTY_DEFAULTS


def backfill(df: DataFrame, defaults: dict[str, object], keys: list[str], done: frozenset[str] = frozenset()) -> tuple[DataFrame, list[str]]:
    """Nulls of new columns filled with their defaults, once; keys and columns already done are left.

    Returns the table and the names to remember as done.
    """
    todo = [c for c, v in defaults.items() if c in df.columns and c not in keys and c not in done and default_counts(v)]
    if not todo:
        return df, []
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(defaults[c]).cast(df.schema[c].dataType)) for c in todo}), todo


@dataclass
class PendingDrops:
    """Columns seen missing, and when they may be dropped."""

    due: dict[str, str] = field(default_factory=dict)

    def see(self, missing: list[str], event_time: datetime, has_other_operations: bool, enabled: bool = True, now: datetime | None = None) -> list[str]:
        """Takes note of a batch; returns the columns to drop at once.

        A batch of nothing but deletes says nothing about columns. Else a column is
        scheduled :data:`DROP_AFTER` from ``now`` (the clock's time, not the event's, so
        that a replay of old events drops nothing) when it is first missing, forgotten when
        it comes back, and dropped when an event later than the time set is still missing it.
        """
        if not enabled or not has_other_operations:
            return []
        self.due = {c: t for c, t in self.due.items() if c in missing}
        clock = now or datetime.now(UTC).replace(tzinfo=None)
        drop = [c for c in missing if c in self.due and event_time > datetime.fromisoformat(self.due[c])]
        for c in missing:
            self.due.setdefault(c, (clock + DROP_AFTER).isoformat())
        for c in drop:
            del self.due[c]
        return drop


#: How each dialect fills in the default of a new column: by an update, by the engine itself, or not at all.
DEFAULT_STRATEGIES = {
    "snowflake": "backfill", "bigquery": "backfill", "redshift": "backfill", "databricks": "native", "spark": "native", "clickhouse": "native", "mysql": "native", "mssql": "native",
    "postgres": "none", "duckdb": "none",
}


def default_strategy(dialect: str) -> str:
    """``backfill``, ``native`` or ``none``."""
    return DEFAULT_STRATEGIES[dialect]
