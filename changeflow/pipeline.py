"""A topic's messages to its tables, as the settings say."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import HISTORY, EngineConfig, TopicConfig
from .functions import masking
from .operators import fold, route, transform
from .shared import fresh_path, remove
from .sources import documents, relational, tracking
from .table import MultiStepMerge, VersionedTable, append_batch, merge_batch

#: A message's address, which orders the changes of a key.
ORDER = ["kafka_partition", "kafka_offset"]


def columns_of_map(df: DataFrame, row: str = "row") -> DataFrame:
    """A map of text as one column for each name that occurs."""
    names = sorted(r[0] for r in df.select(F.explode(F.map_keys(row))).distinct().collect())
    return df.select(*[c for c in df.columns if c != row], *[F.col(row)[n].alias(n) for n in names])


def key_names(frames: DataFrame, key: str = "msg_key") -> list[str]:
    """Names of the columns in the messages' keys, JSON with or without schema or ``Struct{...}``."""
    text = F.col(key).cast("string")
    plain = F.map_keys(F.from_json(F.coalesce(F.get_json_object(text, "$.payload"), text), "map<string,string>"))
    struct = F.regexp_extract_all(text, F.lit(r"[{,]\s*([^=,{}]+)="), F.lit(1))
    names = F.explode(F.when(text.startswith("Struct{"), struct).otherwise(plain))
    return sorted(r[0] for r in frames.where(text.isNotNull()).select(names.alias("n")).distinct().collect() if r[0] != "__dbz__physicalTableIdentifier")


class Topic:
    """One topic: what its messages become, and the tables below ``root`` that they go to."""

    def __init__(self, spark: SparkSession, engine: EngineConfig, topic: TopicConfig, root: str):
        self.spark, self.engine, self.topic, self.root = spark, engine, topic, root.rstrip("/")
        self.prefix = engine.prefix
        self.key = masking.key_of(engine.passphrase) if engine.passphrase else None
        self.history = engine.mode == HISTORY

    def rows(self, frames: DataFrame) -> DataFrame:
        """The messages as rows: typed columns, the address, ``op``, ``table_name``, meta columns and delete markers."""
        cfg, p = self.topic, self.prefix
        frames = frames.where((F.col("topic") == cfg.topic) & (F.octet_length("msg_value") > 0))
        keep = ["topic", *ORDER, "msg_value"]
        if cfg.format == "tracking":
            df = tracking.tracked_rows(frames.select(*keep), prefix=p)
            return transform.skip_operations(columns_of_map(df.withColumn("op", F.lit("c"))), cfg.skipped())
        if cfg.format == "document":
            d = documents.document_rows(frames.select(*keep)).withColumns({f"{p}delete": F.col("op") == "d", f"{p}only_set_delete": F.col("op") == "d"})
            df = columns_of_map(d.withColumn("row", F.from_json("row", "map<string,string>")).withColumnRenamed("collection", "table_name").withColumn("source", F.struct(F.lit(None).cast("string").alias("schema"), F.col("table_name").alias("table"))))
        else:
            e = relational.with_image(relational.envelopes(frames.select(*keep)), p)
            df = relational.typed_rows(e.withColumn("table_name", F.col("source.table"))).drop("before", "after")
        df = transform.meta_columns(df, cfg, prefix=p)
        data = [c for c in df.columns if c not in (*keep, "op", "table_name", "source", "source_ts", "unavailable") and not c.startswith(p)]
        fixed = [c for c in df.columns if c not in data]
        shaped = transform.apply_topic(df.select(*data, "op", *[c for c in fixed if c.startswith(p)], *[F.col(c).alias(f"{p}_{c}") for c in fixed if not c.startswith(p) and c != "op"]), cfg, self.keys(frames), self.key, p)
        return shaped.withColumnsRenamed({f"{p}_{c}": c for c in fixed})

    def keys(self, frames: DataFrame) -> list[str]:
        override = self.topic.keys_override
        return transform.key_columns(self.topic, None if override else key_names(frames))

    def apply(self, frames: DataFrame, batch_id: int, now: Column | None = None) -> dict[str, int | None]:
        """A batch of frames into the topic's tables; versions by table, None for a table that had the batch.

        History appends every change. Else the changes are folded and, as the topic says,
        appended or merged (with its predicates, in several steps, by soft partition).
        """
        cfg, p = self.topic, self.prefix
        keys = self.keys(frames.where(F.col("topic") == cfg.topic))
        path = fresh_path(self.spark, "rows")
        self.rows(frames).write.parquet(path)
        rows = self.spark.read.parquet(path)
        try:
            out: dict[str, int | None] = {}
            sources = [cfg.table] if cfg.table else sorted(r[0] for r in rows.select("table_name").distinct().collect())
            for source in sources:
                of = rows if cfg.table else rows.where(F.col("table_name") == source)
                out |= self._apply_table(source, of, keys, batch_id, now)
            return out
        finally:
            remove(self.spark, path)

    def table(self, name: str) -> VersionedTable:
        return VersionedTable(self.spark, f"{self.root}/{name}")

    def _apply_table(self, name: str, rows: DataFrame, keys: list[str], batch_id: int, now: Column | None) -> dict[str, int | None]:
        cfg, p = self.topic, self.prefix
        inner = {"topic", *ORDER, "table_name", "source", "source_ts", "unavailable", "op"}
        if self.history:
            history = route.history_rows(rows, prefix=p)
            t = f"{name}__history"
            return {t: append_batch(self.table(t), history.drop(*(inner - {p})), batch_id)}
        columns = [c for c in rows.columns if c not in inner and c not in keys and c not in (f"{p}delete", f"{p}only_set_delete")]
        meta = [c for c in columns if c.startswith(p)]
        # A value that wasn't sent is the placeholder again while changes are folded.
        hidden = [c for c in columns if c not in meta and dict(rows.dtypes)[c] == "string"] if "unavailable" in rows.columns else []
        from .sources.frames import UNAVAILABLE

        shown = rows.withColumns({c: F.when(F.array_contains("unavailable", c), F.lit(UNAVAILABLE)).otherwise(F.col(c)) for c in hidden}) if hidden else rows
        staged = fold.fold(shown, keys, ORDER, "op", [c for c in columns if c not in meta], meta, p).drop(*ORDER)
        if cfg.append_only:
            return {name: append_batch(self.table(name), staged.drop(f"{p}only_set_delete"), batch_id)}
        if cfg.soft_partitions is None:
            return {name: self._merge(name, staged, keys, hidden, batch_id)}
        soft = cfg.soft_partitions
        existing = self.spark.createDataFrame([(n,) for n in self._names()], "table_name string")
        clock = now if now is not None else F.lit(datetime.now(UTC).replace(tzinfo=None)).cast("timestamp_ntz")
        dealt = route.soft_partition(staged, soft.column, soft.frequency, clock, name, existing)
        tables = sorted(r[0] for r in dealt.where("dest_table is not null").select("dest_table").distinct().limit(soft.max_partitions + 2).collect())
        if len(tables) > soft.max_partitions + 1:
            raise ValueError(f"a batch of {name} goes to more than {soft.max_partitions} partitions")
        return {t: self._merge(t, dealt.where(F.col("dest_table") == t).drop("dest_table"), keys, hidden, batch_id) for t in tables}

    def _names(self) -> list[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def _merge(self, name: str, staged: DataFrame, keys: list[str], hidden: list[str], batch_id: int) -> int | None:
        cfg = self.topic
        options = {"soft_delete": cfg.soft_delete, "placeholder_columns": hidden, "prefix": self.prefix, "extra": list(cfg.merge_predicates)}
        if cfg.drop_deleted_columns:
            options |= {"drop_missing": True, "event_time": datetime.now(UTC).replace(tzinfo=None)}
        target = self.table(name)
        if cfg.multi_step_flushes:
            steps = MultiStepMerge(target, self.table(f"_{name}_msm"), keys, cfg.multi_step_flushes, **options)
            return target.version() if steps.add(staged, batch_id) else None
        return merge_batch(target, staged, keys, batch_id, **options)
