"""Structured Streaming: message frames to merged tables, batch by batch."""

from __future__ import annotations

import json
import logging
import random
import threading
import time
from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators.fold import fold
from ..shared import fresh_path, remove
from ..table import MultiStepMerge, VersionedTable, merge_batch

LOG = logging.getLogger("changeflow")
#: Columns of the message source, as files have them.
FRAMES = "topic string, kafka_partition int, kafka_offset bigint, kafka_ts timestamp_ntz, msg_key binary, msg_value binary"


def frame_stream(spark: SparkSession, path: str, max_files: int | None = None, max_bytes: str | None = None) -> DataFrame:
    """Frames that arrive as Parquet files in a folder."""
    r = spark.readStream.schema(FRAMES)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if max_bytes:
        r = r.option("maxBytesPerTrigger", max_bytes)
    return r.parquet(path)


def kafka_stream(spark: SparkSession, servers: str, topics: list[str], max_offsets: int | None = None, **options: str) -> DataFrame:
    """Frames of Kafka topics; needs Spark's Kafka package on the cluster."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
    if max_offsets:
        r = r.option("maxOffsetsPerTrigger", max_offsets)
    r = r.options(**options)
    return r.load().select("topic", F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), F.col("timestamp").cast("timestamp_ntz").alias("kafka_ts"), F.col("key").alias("msg_key"), F.col("value").alias("msg_value"))


def with_retries(run: Callable[[], object], tries: int = 15, least: float = 1.0, most: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """Calls until it succeeds, waiting longer each time, with jitter; the last error is raised."""
    for i in range(tries):
        try:
            return run()
        except Exception:
            if i + 1 == tries:
                raise
            LOG.warning("try %d of %d failed", i + 1, tries, exc_info=True)
            sleep(random.uniform(least, min(most, least * 2**i)))
    return None


def wait_for_topics(listed: Callable[[], Collection[str]], topics: list[str], every: float = 300.0, tries: int | None = None, sleep: Callable[[float], None] = time.sleep) -> None:
    """Returns when ``listed`` names all topics; asks again ``every`` so many seconds, ``tries`` times if that is given."""
    asked = 0
    while lost := sorted({*topics} - {*listed()}):
        asked += 1
        if tries is not None and asked >= tries:
            raise TimeoutError(f"there are no topics {lost}")
        LOG.info("waiting for topics %s", lost)
        sleep(every)


def skip_applied(frames: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """Frames that lie above what was applied of their partition, each address once; empty values (tombstones) are none.

    ``applied``: ``topic, kafka_partition, next_offset`` (the first that wasn't); of
    several rows of a partition the highest counts. Only addresses are compared and
    shuffled, so payloads stay where they are if ``frames`` has none.
    """
    live = frames.where(F.octet_length("msg_value") > 0) if "msg_value" in frames.columns else frames
    address = ["topic", "kafka_partition", "kafka_offset"]
    if applied is not None:
        above = applied.groupBy("topic", "kafka_partition").agg(F.max("next_offset").alias("_next"))
        live = live.join(above, ["topic", "kafka_partition"], "left").where(F.col("_next").isNull() | (F.col("kafka_offset") >= F.col("_next"))).drop("_next")
    return live.dropDuplicates(address)


def start_merge(
    frames: DataFrame, to_changes: Callable[[DataFrame], DataFrame], table: VersionedTable, keys: list[str], columns: list[str], checkpoint: str,
    soft_delete: bool = False, trigger: dict | None = None, placeholder_columns: list[str] | None = None, notify: Callable[[str, dict], None] | None = None,
    staging: VersionedTable | None = None, flushes: int | None = None, **options: object,
) -> StreamingQuery:
    """Fold and merge every micro-batch; a replayed batch is recognised by its id and does nothing.

    ``to_changes`` makes ``keys``, ``columns``, ``op`` and the frame's address of the frames;
    a key's order is its partition's offsets. A frame that comes twice in a batch folds to
    itself, so payloads are never shuffled to find repeats. No watermark: late changes are
    changes. With ``staging`` and ``flushes`` batches are gathered there and merged by every
    ``flushes + 1``-th (see :class:`MultiStepMerge`). ``options`` go to :func:`merge_batch`.
    ``notify`` is told what happens: ``started``, ``batch_applied``, ``batch_gathered``, ``batch_skipped``, ``columns_added``, ``failed``.
    """
    say = notify or (lambda what, more: None)
    steps = MultiStepMerge(table, staging, keys, flushes, soft_delete=soft_delete, placeholder_columns=placeholder_columns, **options) if staging is not None and flushes else None

    def apply(staged: DataFrame, batch_id: int) -> tuple[str, int | None]:
        if steps:
            before = staging.version()
            merged = steps.add(staged, batch_id)
            return ("batch_applied" if merged else "batch_gathered" if staging.version() > before else "batch_skipped"), table.version()
        done = merge_batch(table, staged, keys, batch_id, soft_delete, placeholder_columns=placeholder_columns, **options)
        return ("batch_applied" if done else "batch_skipped"), done

    def each(batch: DataFrame, batch_id: int) -> None:
        path = fresh_path(batch.sparkSession, "staged")
        fold(to_changes(batch), keys, ["kafka_partition", "kafka_offset"], "op", columns).drop("kafka_partition", "kafka_offset").write.parquet(path)
        staged = batch.sparkSession.read.parquet(path)
        before = {c["name"] for c in table.columns()} if table.exists() else None
        try:
            what, version = with_retries(lambda: apply(staged, batch_id))
        except Exception as e:
            say("failed", {"batch_id": batch_id, "error": str(e)})
            raise
        finally:
            remove(batch.sparkSession, path)
        say(what, {"batch_id": batch_id, "version": version})
        if before is not None and (new := sorted({c["name"] for c in table.columns()} - before)):
            say("columns_added", {"batch_id": batch_id, "columns": new})

    query = frames.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    say("started", {"id": str(query.id)})
    return query


def lag(frames: DataFrame, ends: DataFrame, now: Column | None = None) -> DataFrame:
    """How far each partition lags: ``topic, kafka_partition, row_lag`` (frames of its end not read yet) and ``ingestion_lag_seconds`` (since the last frame read was published).

    ``ends``: ``topic, kafka_partition, end_offset`` (the next offset that the broker will give).
    """
    read = frames.groupBy("topic", "kafka_partition").agg(F.max("kafka_offset").alias("last"), F.max_by("kafka_ts", "kafka_offset").alias("at"))
    since = F.unix_micros((now if now is not None else F.current_timestamp()).cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))
    return ends.join(read, ["topic", "kafka_partition"], "left").select(
        "topic", "kafka_partition", (F.col("end_offset") - 1 - F.coalesce("last", F.lit(-1))).alias("row_lag"), (since / 1_000_000).alias("ingestion_lag_seconds")
    )


class Heartbeat:
    """Says every ``every`` seconds, after ``after`` seconds, that a long step still runs."""

    def __init__(self, say: Callable[[float], None], after: float = 1_800.0, every: float = 120.0):
        self.say, self.after, self.every, self._done = say, after, every, threading.Event()

    def __enter__(self) -> Heartbeat:
        began = time.monotonic()

        def beat() -> None:
            wait = self.after
            while not self._done.wait(wait):
                self.say(time.monotonic() - began)
                wait = self.every

        threading.Thread(target=beat, daemon=True).start()
        return self

    def __exit__(self, *error: object) -> None:
        self._done.set()


def start_history(frames: DataFrame, to_rows: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append every change; the file sink's own log makes a replayed batch count once."""
    return to_rows(frames).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def offset_lag(source) -> int | None:  # noqa: ANN001
    """Rows between what a source has read and its latest offset, of all partitions; None if the source doesn't say."""
    try:
        end, latest = (json.loads(x) if isinstance(x, str) else x for x in (source.endOffset, source.latestOffset))
    except (TypeError, ValueError):
        return None
    if not isinstance(end, dict) or not isinstance(latest, dict):
        return None
    flat = lambda o: {(t, p): n for t, ps in o.items() if isinstance(ps, dict) for p, n in ps.items()}
    a, b = flat(end), flat(latest)
    return sum(max(0, n - a.get(k, 0)) for k, n in b.items()) if b else None


class LagListener(StreamingQueryListener):
    """Passes rows, duration, end offsets and lag of each batch to ``report``.

    ``row_lag``: frames not read yet; ``execution_ms``: from the trigger to the batch's end.
    """

    def __init__(self, report: Callable[[dict], None]):
        self.report = report

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.report({"event": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        self.report({
            "event": "progress", "batch": p.batchId, "rows": p.numInputRows, "ms": p.batchDuration, "sources": [s.endOffset for s in p.sources],
            "row_lag": [offset_lag(s) for s in p.sources], "execution_ms": dict(p.durationMs).get("triggerExecution"),
        })

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.report({"event": "terminated", "error": event.exception})
