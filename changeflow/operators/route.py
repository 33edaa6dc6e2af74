"""Where rows go: history, append-only, and partition tables named by a time suffix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Suffix layout of each frequency.
SUFFIXES = {"monthly": "'_'yyyy'_'MM", "daily": "'_'yyyy'_'MM'_'dd", "hourly": "'_'yyyy'_'MM'_'dd'_'HH"}
DEFAULT_SUFFIX = "_default"


def partition_suffix(c: Column, frequency: str) -> Column:
    return F.date_format(c, SUFFIXES[frequency])


def partition_distance(value: Column, now: Column, frequency: str) -> Column:
    """How many partitions ``value`` lies behind ``now``: calendar months, or elapsed days or hours cut to whole ones."""
    if frequency == "monthly":
        return (F.year(now) - F.year(value)) * 12 + F.month(now) - F.month(value)
    seconds = F.unix_micros(now.cast("timestamp")) - F.unix_micros(value.cast("timestamp"))
    return (seconds / F.lit((86_400 if frequency == "daily" else 3_600) * 1_000_000)).cast("int")


def soft_partition(df: DataFrame, column: str, frequency: str, now: Column, table: str, existing: DataFrame, out: str = "dest_table") -> DataFrame:
    """``df`` with the partition table of each row.

    A partition of the past whose table isn't in ``existing`` (column ``table_name``) goes
    to the default table; a time after ``now`` is an error; a null time has no table.
    ``existing`` is a snapshot of the catalogue's names, taken once a batch.
    """
    named = df.withColumn("_suffix", partition_suffix(F.col(column), frequency)).withColumn("_distance", partition_distance(F.col(column), now, frequency))
    names = existing.select(F.col("table_name").alias("_known")).distinct()
    joined = named.join(names, F.concat(F.lit(table), F.col("_suffix")) == F.col("_known"), "left")
    late = F.raise_error(F.concat(F.lit(f"{column} lies in the future: "), F.col(column).cast("string"))).cast("string")
    suffix = F.when(F.col("_distance") < 0, late).when((F.col("_distance") > 0) & F.col("_known").isNull(), F.lit(DEFAULT_SUFFIX)).otherwise(F.col("_suffix"))
    return joined.withColumn(out, F.concat(F.lit(table), suffix)).drop("_suffix", "_distance", "_known")


def history_rows(df: DataFrame, op: str = "op", prefix: str = "__cf_") -> DataFrame:
    """Every change as a row of its own, with its operation, without delete markers; no shuffle."""
    return df.withColumn(f"{prefix}operation", F.col(op)).drop(f"{prefix}delete", f"{prefix}only_set_delete")


def append(target: DataFrame, rows: DataFrame) -> DataFrame:
    """The target with rows added; columns of either side that the other lacks are null."""
    return target.unionByName(rows, allowMissingColumns=True)


def latest_view(appended: DataFrame, keys: list[str], updated: str, prefix: str = "__cf_") -> DataFrame:
    """Current rows of a table that merges are appended to: each key's last row, unless it is a delete."""
    values = F.struct(*[c for c in appended.columns if c not in keys])
    top = appended.groupBy(*keys).agg(F.max_by(values, updated).alias("_v"))
    rows = top.select(*[F.col(c) if c in keys else F.col(f"_v.{c}").alias(c) for c in appended.columns])
    return rows.where(~F.coalesce(F.col(f"{prefix}delete"), F.lit(False)))
