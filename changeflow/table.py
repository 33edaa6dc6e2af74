"""A table of Parquet buckets and a pointer: atomic merges that rewrite only what they touch, without a table format."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators import evolve, merge
from .pointer import Conflict, Pointer

__all__ = ["Conflict", "MultiStepMerge", "VersionedTable", "expired", "merge_batch", "reusable_staging", "staging_name", "sweep"]

BUCKET = "__cf_bucket"


def bucket_of(keys: list[str], buckets: int) -> Column:
    """A row's bucket by the hash of its keys; null keys have one, too."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class VersionedTable:
    """Immutable folders ``data/<id>/__cf_bucket=<n>`` below ``path``; markers in ``_current`` say which make up a version.

    Rows lie in buckets by the hash of their keys. A commit writes new folders for some
    buckets, then takes the next number with a marker that names all buckets' folders,
    the schema and the properties: readers see the old version or the new one, never a
    part, and of two writers from one version one fails with :class:`Conflict`.
    Properties hold the last applied batch, pending drops, filled-in defaults.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.pointer = Pointer(spark, f"{self.path}/_current")

    def version(self) -> int:
        return self.pointer.number()

    def exists(self) -> bool:
        return self.version() > 0

    def state(self, version: int | None = None) -> dict:
        """What the marker of a version (else of the one in force) says."""
        n = self.version() if version is None else version
        return self.pointer.read(n) if n else {"properties": {}, "buckets": 0, "keys": [], "parts": {}, "schema": None}

    def properties(self) -> dict:
        return self.state()["properties"]

    def columns(self) -> list[dict]:
        """The catalog entry of each column: ``name, type, backfilled, in_key``."""
        s = self.state()
        if s["schema"] is None:
            raise FileNotFoundError(self.path)
        done = {*s["properties"].get("backfilled", [])}
        return [{"name": f.name, "type": f.dataType.simpleString(), "backfilled": f.name in done, "in_key": f.name in s["keys"]} for f in T.StructType.fromJson(s["schema"])]

    def read(self, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
        """The table, or those of its rows that lie in ``buckets``."""
        s = self.state(version)
        if s["schema"] is None:
            raise FileNotFoundError(self.path)
        schema = T.StructType.fromJson(s["schema"])
        wanted = s["parts"] if buckets is None else {b: s["parts"][str(b)] for b in buckets if str(b) in s["parts"]}
        paths = [f"{self.path}/data/{p}/{BUCKET}={b}" for b, p in wanted.items()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def commit(self, df: DataFrame, properties: dict | None = None, keys: list[str] | None = None, buckets: int = 64, touched: list[int] | None = None, expect: int | None = None, check: Callable[[DataFrame], None] | None = None) -> int:
        """Put ``df`` in force as the next version; returns its number.

        ``keys`` and ``buckets`` are settled by the first commit. ``touched``: ``df`` holds
        all rows of these buckets, the others stay as they are; else it is the whole table.
        ``expect``: the version that it was made from; another one in force is a conflict.
        ``check`` gets what was written before it is in force; if it raises, nothing is.
        """
        now = self.version()
        if expect is not None and now != expect:
            raise Conflict(f"{self.path} has changed since it was read")
        s = self.state(now)
        keys, buckets = (s["keys"], s["buckets"]) if now else (keys or [], buckets if keys else 1)
        name = uuid.uuid4().hex
        dealt = df.withColumn(BUCKET, bucket_of(keys, buckets) if keys else F.lit(0))
        # One file a bucket where rows come from a shuffle by other hashes.
        (dealt.repartition(BUCKET) if keys and buckets > 1 else dealt).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{name}")
        kept = {} if touched is None else {b: p for b, p in s["parts"].items() if int(b) not in set(touched)}
        folder = self.pointer._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{name}")
        made = [st.getPath().getName() for st in self.pointer._fs.listStatus(folder)]
        try:
            if check:
                check(self.spark.read.schema(df.schema).parquet(f"{self.path}/data/{name}"))
        except Exception:
            self.pointer._fs.delete(folder, True)
            raise
        parts = kept | {n.split("=")[1]: name for n in made if n.startswith(f"{BUCKET}=")}
        self.pointer.put(now + 1, {"properties": {**s["properties"], **(properties or {})}, "keys": keys, "buckets": buckets, "parts": parts, "schema": json.loads(df.schema.json())})
        return now + 1

    def append(self, df: DataFrame, properties: dict | None = None, expect: int | None = None) -> int:
        """Add the rows of ``df`` as a part of its own, for tables without keys; ``df`` has all the table's columns."""
        now = self.version() if expect is None else expect
        s = self.state(now)
        if s["keys"]:
            raise ValueError("a table with keys is merged into")
        name = uuid.uuid4().hex
        df.withColumn(BUCKET, F.lit(now)).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{name}")
        made = self.pointer._fs.exists(self.pointer._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{name}/{BUCKET}={now}"))
        parts = s["parts"] | ({str(now): name} if made else {})
        self.pointer.put(now + 1, {"properties": {**s["properties"], **(properties or {})}, "keys": [], "buckets": 1, "parts": parts, "schema": json.loads(df.schema.json())})
        return now + 1

    def touched(self, staged: DataFrame) -> list[int]:
        """The buckets that hold the keys of ``staged``, whose key columns have the table's types."""
        s = self.state()
        if not s["keys"]:
            return [0]
        return sorted(r[0] for r in staged.select(bucket_of(s["keys"], s["buckets"])).distinct().collect())

    def vacuum(self, keep: int = 2) -> list[int]:
        """Forget all but the last ``keep`` versions and delete what only they used; returns their numbers."""
        numbers = self.pointer.numbers()
        old = numbers[:-keep]
        live = {p for n in numbers[-keep:] for p in self.state(n)["parts"].values()}
        dead = {p for n in old for p in self.state(n)["parts"].values()} - live
        for n in old:
            self.pointer.forget(n)
        fs = self.pointer._fs
        for p in dead:
            fs.delete(self.pointer._jvm.org.apache.hadoop.fs.Path(f"{self.path}/data/{p}"), True)
        return old


def merge_batch(
    table: VersionedTable, staged: DataFrame, keys: list[str], batch_id: int | None = None, soft_delete: bool = False,
    defaults: dict[str, object] | None = None, placeholder_columns: list[str] | None = None, prefix: str = "__cf_", drop_missing: bool = False, event_time: datetime | None = None,
    buckets: int = 64, now: datetime | None = None, check: bool = True, extra: list[str] | None = None,
) -> int | None:
    """Merge a folded batch: diff, add columns, cast, fill defaults, join, check, commit. A batch id already applied does nothing.

    Only the buckets that hold keys of the batch are read and written, unless a default
    is filled in or a column dropped. ``extra`` columns join besides the keys. ``staged`` is read up to three times, so a
    written table serves best. With ``check`` the merged buckets must hold every key
    that the batch leaves alive and none that it deletes, else nothing is committed.
    """
    start = table.version()
    state = table.state(start)
    props = state["properties"]
    if batch_id is not None and props.get("batch_id") is not None and batch_id <= props["batch_id"]:
        return None
    hidden = [f"{prefix}only_set_delete"] + ([] if soft_delete else [f"{prefix}delete"])
    keep = frozenset([f"{prefix}delete"] if soft_delete else [])
    if not start:
        merged = merge.merge(staged.limit(0).drop(*hidden), staged, keys, soft_delete, [], prefix=prefix, null_safe=True)
        return table.commit(merged, {"batch_id": batch_id}, keys, buckets, expect=0)
    changed: dict = {"batch_id": batch_id}
    target = evolve.add_columns(table.read(version=start), staged.drop(*hidden).schema, prefix, keep)
    staged = evolve.cast_to_target(staged, target.schema)
    touched: list[int] | None = table.touched(staged)
    gone: list[str] = []
    if drop_missing and event_time is not None:
        pending = evolve.PendingDrops(dict(props.get("pending_drops", {})))
        _, missing = evolve.schema_diff(staged.schema, target.schema, keep, prefix)
        others = not staged.where(~F.coalesce(F.col(f"{prefix}delete"), F.lit(False))).isEmpty()
        gone = pending.see(missing, event_time, others, now=now)
        changed["pending_drops"] = pending.due
    filled: list[str] = []
    if defaults:
        done = frozenset(props.get("backfilled", []))
        target, filled = evolve.backfill(target, defaults, keys, done)
        changed["backfilled"] = sorted({*done, *filled})
    if gone or filled:
        touched = None
    else:
        target = evolve.add_columns(table.read(touched, start), staged.drop(*hidden).schema, prefix, keep)
    merged = merge.merge(target, staged, keys, soft_delete, placeholder_columns, null_safe=True, prefix=prefix, extra=extra, null_safe_extra=True).drop(*gone)
    test = (lambda written: merge.assert_merged(written, staged, [*keys, *(extra or [])], soft_delete, prefix)) if check else None
    return table.commit(merged, changed, touched=touched, expect=start, check=test)


def append_batch(table: VersionedTable, rows: DataFrame, batch_id: int | None = None, partition_keys: list[str] | None = None) -> int | None:
    """Add rows to a table, once a batch id; columns that either side lacks are null. Folders written before stay as they are."""
    start = table.version()
    props = table.properties()
    if batch_id is not None and props.get("batch_id") is not None and batch_id <= props["batch_id"]:
        return None
    if start:
        old = table.read(version=start).limit(0)
        rows = old.unionByName(evolve.cast_to_target(rows, old.schema), allowMissingColumns=True)
    return table.append(rows, {"batch_id": batch_id}, start)


class MultiStepMerge:
    """Gathers batches in a staging table; every ``flushes + 1``-th call merges them into the target."""

    def __init__(self, target: VersionedTable, staging: VersionedTable, keys: list[str], flushes: int, **options):  # noqa: ANN003
        self.target, self.staging, self.keys, self.flushes, self.options = target, staging, keys, flushes, options

    def add(self, staged: DataFrame, batch_id: int) -> bool:
        """Take a batch; True if the target was merged into. A batch taken before does nothing."""
        props = self.staging.properties()
        count = props.get("count", 0)
        fresh = props.get("batch_id") is None or batch_id > props["batch_id"]
        if fresh and count == 0:
            self.staging.commit(staged, {"count": 1, "batch_id": batch_id}, self.keys)
        elif fresh:
            pending = merge.upsert_staging(self.staging.read(), staged, self.keys, self.options.get("placeholder_columns"))
            self.staging.commit(pending, {"count": count + 1, "batch_id": batch_id})
        # A run that failed between gathering and merging merges when its batch comes again.
        count = self.staging.properties().get("count", 0)
        if count <= self.flushes:
            return False
        merge_batch(self.target, self.staging.read(), self.keys, self.staging.properties()["batch_id"], **self.options)
        self.staging.commit(self.staging.read().limit(0), {"count": 0})
        return True


def staging_name(table: str, prefix: str = "cf", suffix: str | None = None, ttl_hours: int = 6, now: float | None = None, reusable: bool = False, multi_step: bool = False, schema: str = "") -> str:
    """``<table>_<prefix>_<5 random letters>_<expiry>``: a name that says when it may be swept.

    A ``reusable`` or ``multi_step`` table keeps its name and is never swept:
    ``<table>_<prefix>_reusable`` and ``<table>_<prefix>_msm``, after ``<schema>_`` if one is given.
    """
    if reusable or multi_step:
        return f"{f'{schema}_' if schema else ''}{table}_{prefix}_{'msm' if multi_step else 'reusable'}"
    return f"{table}_{prefix}_{suffix or uuid.uuid4().hex[:5]}_{int((time.time() if now is None else now) + ttl_hours * 3600)}"


def expired(name: str, prefix: str = "cf", now: float | None = None) -> bool:
    """Whether a staging name's time is up; names of another form never are."""
    parts = name.rsplit("_", 3)
    return len(parts) == 4 and parts[1] == prefix and parts[3].isdigit() and int(parts[3]) < (time.time() if now is None else now)


def sweep(spark: SparkSession, folder: str, prefix: str = "cf") -> list[str]:
    """Delete the expired staging tables below a folder; returns their names."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    gone = [n for n in names if expired(n, prefix)]
    for n in gone:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}"), True)
    return gone


def reusable_staging(table: VersionedTable, schema: T.StructType) -> str:
    """Make a staging table ready for a batch: ``kept`` if it is empty and fits, ``truncated`` if it fits, ``created`` if not or absent.

    It fits if it has the same columns with the same types, in any order and case.
    """
    shape = lambda s: {f.name.lower(): f.dataType for f in s}
    spark = table.spark
    if table.exists():
        old = table.read()
        if shape(old.schema) == shape(schema):
            if old.isEmpty():
                return "kept"
            table.commit(old.limit(0), touched=None)
            return "truncated"
    table.commit(spark.createDataFrame([], schema))
    return "created"
