"""Sinks to files, messages and JDBC."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import repair_utf8
from ..kinds import kind_of
from ..operators.batch import greedy
from ..table import staging_name
from .dialects import Batch, merge_statements


class Sink(Protocol):
    """What a destination can do with a batch."""

    def merge(self, staged: DataFrame, keys: list[str]) -> None: ...

    def append(self, rows: DataFrame) -> None: ...


def for_files(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Columns as files hold them: structs and maps as JSON; ``narrow``: 32-bit floats and milliseconds."""
    cols = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StructType | T.MapType) or f.dataType.typeName() == "variant":
            c = F.to_json(c)
        elif isinstance(f.dataType, T.NullType):
            c = c.cast("string")
        elif narrow and isinstance(f.dataType, T.DoubleType):
            c = c.cast("float")
        elif narrow and isinstance(f.dataType, T.TimestampType | T.TimestampNTZType):
            c = F.date_trunc("millisecond", c).cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)


class ParquetSink:
    """Appends gzip Parquet below ``<root>/<table>/date=<day>``; a merge is an append, of rows with their delete marker."""

    def __init__(self, root: str, table: str, narrow: bool = False):
        self.path, self.narrow = f"{root.rstrip('/')}/{table}", narrow

    def append(self, rows: DataFrame) -> None:
        dated = for_files(rows, self.narrow).withColumn("date", F.current_date())
        dated.write.mode("append").partitionBy("date").option("compression", "gzip").parquet(self.path)

    def merge(self, staged: DataFrame, keys: list[str]) -> None:
        self.append(staged)


class MessageSink:
    """Sends each row as JSON, from the executors, in batches bounded in rows and bytes.

    ``connect`` makes a ``send(list of texts)`` in each task; what it sends is counted.
    """

    def __init__(self, connect: Callable[[], Callable[[list[str]], None]], rows: int = 10, most_bytes: int = 256 * 1024):
        self.connect, self.rows, self.most_bytes = connect, rows, most_bytes

    def append(self, rows: DataFrame) -> None:
        connect, most, limit = self.connect, self.rows, self.most_bytes

        def run(it: Iterator[Row]) -> None:
            send, held, filled = connect(), [], 0
            for r in it:
                n = len(r.m.encode())
                if n > limit:
                    raise ValueError(f"a message of {n} bytes is larger than {limit}")
                if held and (len(held) >= most or filled + n > limit):
                    send(held)
                    held, filled = [], 0
                held.append(r.m)
                filled += n
            if held:
                send(held)

        messages(rows, "m").foreachPartition(run)

    def merge(self, staged: DataFrame, keys: list[str]) -> None:
        self.append(staged)


class JdbcSink:
    """Appends to, or stages a batch in, a JDBC table; the dialect's merge statements run there."""

    def __init__(self, url: str, table: str, dialect: str, properties: dict[str, str] | None = None, run: Callable[[str], None] | None = None, soft_delete: bool = False, prefix: str = "__cf_"):
        self.url, self.table, self.dialect, self.properties, self.run, self.soft_delete, self.prefix = url, table, dialect, properties or {}, run, soft_delete, prefix

    def append(self, rows: DataFrame) -> None:
        for_files(rows).write.mode("append").jdbc(self.url, self.table, properties=self.properties)

    def merge(self, staged: DataFrame, keys: list[str], placeholder_columns: list[str] | None = None) -> None:
        """Each merge has a staging table of its own name, dropped afterwards; one that is left behind can be swept by its name."""
        if self.run is None:
            raise ValueError("a merge needs a way to run its statements")
        staging = staging_name(self.table, self.prefix.strip("_"))
        rows = for_files(staged)
        rows.write.mode("overwrite").jdbc(self.url, staging, properties=self.properties)
        batch = batch_of(rows, self.table, staging, keys, self.soft_delete, placeholder_columns, self.prefix)
        try:
            for statement in merge_statements(self.dialect, batch):
                self.run(statement)
        finally:
            self.run(f"DROP TABLE {staging}")


def batch_of(staged: DataFrame, table: str, staging: str, keys: list[str], soft_delete: bool = False, placeholder_columns: list[str] | None = None, prefix: str = "__cf_") -> Batch:
    """What the statements need to know of a staged DataFrame."""
    columns = {f.name: kind_of(f.dataType) for f in staged.schema if f.name not in (f"{prefix}delete", f"{prefix}only_set_delete")}
    return Batch(table, staging, tuple(keys), columns, soft_delete, tuple(placeholder_columns or ()), prefix=prefix)


class TableSink:
    """A table of a V2 catalog with row-level writes: the merge is Spark's own, only files that it touches are rewritten."""

    def __init__(self, table: str, soft_delete: bool = False, prefix: str = "__cf_"):
        self.table, self.soft_delete, self.prefix = table, soft_delete, prefix

    def append(self, rows: DataFrame) -> None:
        rows.writeTo(self.table).append()

    def statement(self, staged: DataFrame, view: str, keys: list[str], placeholder_columns: list[str] | None = None) -> str:
        return merge_statements("spark", batch_of(staged, self.table, view, keys, self.soft_delete, placeholder_columns, self.prefix))[0]

    def merge(self, staged: DataFrame, keys: list[str], placeholder_columns: list[str] | None = None) -> None:
        view = f"changeflow_{uuid.uuid4().hex}"
        staged.createOrReplaceTempView(view)
        try:
            staged.sparkSession.sql(self.statement(staged, view, keys, placeholder_columns))
        finally:
            staged.sparkSession.catalog.dropTempView(view)


class DelimitedSink:
    """Stages rows as gzip, tab-separated text for warehouses that load such files: a null marker, and bytes that are no UTF-8 repaired if asked."""

    def __init__(self, path: str, null: str = "\\\\N", repair: bool = False):
        self.path, self.null, self.repair = path, null, repair

    def append(self, rows: DataFrame) -> None:
        cols = []
        for f in for_files(rows).schema:
            c = F.col(f.name)
            if isinstance(f.dataType, T.ArrayType):
                c = F.to_json(c)
            elif isinstance(f.dataType, T.BinaryType):
                c = repair_utf8(c) if self.repair else F.base64(c)
            cols.append(c.alias(f.name))
        out = for_files(rows).select(*cols)
        out.write.mode("append").options(sep="\t", header=False, nullValue=self.null, quote='"', escape='"', compression="gzip").csv(self.path)

    def merge(self, staged: DataFrame, keys: list[str]) -> None:
        self.append(staged)

    def read(self, spark: SparkSession, schema: T.StructType) -> DataFrame:
        return spark.read.schema(schema).options(sep="\t", header=False, nullValue=self.null, quote='"', escape='"', multiLine=True).csv(self.path)


def messages(rows: DataFrame, out: str = "message") -> DataFrame:
    """Each row as the JSON message that a queue gets; nulls are kept."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(out))


def chunks(texts: list[str], limit: int) -> list[list[str]]:
    """Texts in batches of at most ``limit`` bytes, too large ones left out."""
    out: dict[int, list[str]] = {}
    for t, b in zip(texts, greedy((len(t.encode()) for t in texts), limit), strict=True):
        if b is not None:
            out.setdefault(b, []).append(t)
    return list(out.values())
