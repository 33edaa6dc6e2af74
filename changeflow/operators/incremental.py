"""Problem 5: only new or changed records, by persisted key and content-hash state.

A state is a folder of immutable Parquet folders and numbered markers; the highest
marker names the folders in force. A run reads the version, selects what it lacks,
and after its work writes what is new and takes the next number, which only one run can.
A run that fails before the swap leaves the old version in force: its records are
selected again, none is skipped and none of a finished run is repeated.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..pointer import Pointer
from ..shared import materialize


def with_hash(df: DataFrame, content: list[str], out: str = "content_hash") -> DataFrame:
    """Adds a 64-bit hash of ``content``; a null and an empty text differ, and so do ("ab","c") and ("a","bc")."""
    parts: list[Column] = []
    for c in content:
        parts += [F.col(c).isNull(), F.col(c)]
    return df.withColumn(out, F.xxhash64(*parts) if parts else F.lit(0).cast("bigint"))


class HashState:
    """Versioned key and content-hash state below ``path``."""

    def __init__(self, spark: SparkSession, path: str, columns: str):
        """``columns``: DDL of the state's rows."""
        self.spark, self.path, self.columns = spark, path.rstrip("/"), columns
        self.pointer = Pointer(spark, f"{self.path}/current")

    def version(self) -> int:
        """Number of the version in force; 0 before the first."""
        return self.pointer.number()

    def folders(self, version: int | None = None) -> list[str]:
        n = self.version() if version is None else version
        return self.pointer.read(n)["folders"] if n else []

    def read(self, version: int | None = None) -> DataFrame:
        found = self.folders(version)
        if not found:
            return self.spark.createDataFrame([], self.columns)
        return self.spark.read.schema(self.columns).parquet(*[f"{self.path}/versions/{f}" for f in found])

    def swap(self, rows: DataFrame, version: int | None = None, add: bool = False) -> int:
        """Put ``rows`` in force as the version after ``version`` (that in force, if not given); returns its number.

        With ``add`` the rows join those of the version before, whose folders stay as they
        are. The version is taken by its number, once: a run that began from a version
        which another run has replaced since fails with :class:`~changeflow.pointer.Conflict`,
        and its rows are in no version.
        """
        now = self.version() if version is None else version
        name = f"{now + 1}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/versions/{name}")
        self.pointer.put(now + 1, {"folders": [*(self.folders(now) if add else []), name]})
        return now + 1


def run_new(current: DataFrame, state: HashState, key: list[str], content: list[str]) -> tuple[DataFrame, Callable[[], int]]:
    """One run: the rows of ``current`` that are new or changed against ``state`` (as of :func:`select_new`), and what to call once they are processed.

    The state's columns are the key and ``content_hash``. Until the call succeeds it stays
    as it was, so a run that fails selects the same rows again; a call after another run's
    fails, and its rows are in no version.
    """
    return run_hashed(with_hash(current, content), state, key)


def run_hashed(hashed: DataFrame, state: HashState, key: list[str]) -> tuple[DataFrame, Callable[[], int]]:
    """:func:`run_new` of rows that have their ``content_hash``."""
    version = state.version()
    new = materialize(select_new(hashed, state.read(version), key), "new")
    return new, lambda: state.swap(new.select(*key, "content_hash"), version, add=True)


def select_new(current: DataFrame, state: DataFrame, key: list[str], hash_col: str = "content_hash") -> DataFrame:
    """Distinct (key, hash) of ``current`` that ``state`` doesn't have, with ``change_kind``: ``new`` if it has nothing of the key, else ``changed``.

    Keys may be null. A key must identify a record, so that its contents are few: all of
    them meet in one task. One shuffle by the key, after repeats are combined map-side.
    """
    mark = lambda df, n: df.select(*key, hash_col, F.lit(n).alias("_in"))
    # Bit 1: in the current rows; bit 2: in the state.
    by = mark(current, 1).unionByName(mark(state, 2)).groupBy(*key, hash_col).agg(F.bit_or("_in").alias("_in"))
    keyed = by.groupBy(*key).agg(F.bit_or("_in").alias("_key"), F.collect_list(F.when(F.col("_in") == 1, F.col(hash_col))).alias("_new"))
    kind = F.when(F.col("_key").bitwiseAND(F.lit(2)) == 0, F.lit("new")).otherwise(F.lit("changed"))
    return keyed.select(*key, F.explode("_new").alias(hash_col), kind.alias("change_kind"))


def committed_ranges(runs: DataFrame) -> DataFrame:
    """Offsets that ended-committed attempts processed: ``topic, kafka_partition, lo, hi`` (inclusive, disjoint).

    An attempt's last row by ``logged_at`` (at the same instant by ``log_id``) tells how it
    ended; statuses count without case and surrounding space. A committed row whose
    ``next_offset`` or ``first_offset`` is null proves no offset.
    """
    from .once import merge_ranges

    status = F.lower(F.trim(F.regexp_replace("run_status", r"[\s ]+", " ")))
    last = runs.groupBy("run_id", "attempt_no", "topic", "kafka_partition").agg(
        F.max_by(F.struct(status.alias("status"), "first_offset", "next_offset"), F.struct("logged_at", "log_id")).alias("r")
    )
    ranges = last.where((F.col("r.status") == "committed") & (F.col("r.next_offset") > F.col("r.first_offset"))).select(
        "topic", "kafka_partition", F.col("r.first_offset").alias("lo"), (F.col("r.next_offset") - 1).alias("hi")
    )
    return merge_ranges(ranges, ["topic", "kafka_partition"])


def mark_covered(rows: DataFrame, ranges: DataFrame, group: list[str], number: str, out: str = "covered", block_bits: int = 14) -> DataFrame:
    """``rows`` with ``out``: a range of the same group holds the number.

    Both sides meet in blocks of ``2**block_bits`` numbers (a range is entered in each
    block it touches), so no group is one task; ranges are disjoint, so no row doubles.
    """
    # A range is entered in blocks that rows lie in, not in all that it spans: one bad bound may span any number.
    held = rows.groupBy(*group).agg(F.min(number).alias("_least"), F.max(number).alias("_most"))
    within = ranges.join(held, group).select(*group, F.greatest("lo", "_least").alias("lo"), F.least("hi", "_most").alias("hi")).where("lo <= hi")
    cut = within.select(*[F.col(g).alias(f"_r_{g}") for g in group], "lo", "hi", F.explode(F.sequence(F.shiftright("lo", block_bits), F.shiftright("hi", block_bits))).alias("_r_block"))
    cond = F.shiftright(F.col(number), block_bits) == F.col("_r_block")
    for g in group:
        cond = cond & (F.col(g) == F.col(f"_r_{g}"))
    cond = cond & F.col(number).between(F.col("lo"), F.col("hi"))
    return rows.join(cut, cond, "left").withColumn(out, F.col("lo").isNotNull()).select(*rows.columns, out)
