"""Removing rows that repeat a key from a table. Null keys form one group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe(df: DataFrame, keys: list[str], updated: list[str] | None = None, strategy: str = "latest", slices: int = 64) -> DataFrame:
    """One row a key.

    ``latest``: the row with the highest ``updated`` columns (all its columns break ties);
    a maximum, combined map-side, so a hot key costs nothing.
    ``second``: of keys with several rows, the second oldest, as engines that delete and
    re-insert a key's second row do; with two rows that is the newer one. Each of
    ``slices`` slices keeps its two oldest first, so a hot key is no single task; equal
    rows are dealt to slices by the input split that they come from.
    """
    rest = [c for c, t in df.dtypes if c not in keys and "map<" not in t and "variant" not in t]
    order = [*(updated or []), *[c for c in rest if c not in (updated or [])]]
    if strategy == "latest":
        if not order:
            return df.dropDuplicates(keys)
        values = F.struct(*[c for c in df.columns if c not in keys])
        top = df.groupBy(*keys).agg(F.max_by(values, F.struct(*order)).alias("_v"))
        return top.select(*[F.col(c) if c in keys else F.col(f"_v.{c}").alias(c) for c in df.columns])
    if strategy != "second":
        raise ValueError(f"unknown strategy {strategy!r}")
    by = [F.col(c).asc_nulls_first() for c in order]
    spread = Window.partitionBy(*keys, "_slice").orderBy(*by)
    few = df.withColumn("_slice", F.pmod(F.xxhash64(*(rest or keys), F.spark_partition_id()), F.lit(slices))).withColumn("_n", F.row_number().over(spread)).where("_n <= 2")
    w = Window.partitionBy(*keys)
    ranked = few.withColumn("_rn", F.row_number().over(w.orderBy(*by))).withColumn("_count", F.count("*").over(w))
    return ranked.where("_count = 1 or _rn = 2").select(*df.columns)


def dedupe_by_identity(df: DataFrame, keys: list[str], identity: str | None = None) -> DataFrame:
    """One row a key, that with the highest row id; without ``identity`` ids are given in the order of reading."""
    name = identity or "_row_id"
    numbered = df if identity else df.withColumn(name, F.monotonically_increasing_id())
    values = F.struct(*[c for c in df.columns if c not in keys])
    top = numbered.groupBy(*keys).agg(F.max_by(values, F.col(name)).alias("_v"))
    return top.select(*[F.col(c) if c in keys else F.col(f"_v.{c}").alias(c) for c in df.columns])
