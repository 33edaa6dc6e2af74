"""The folder that all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir`` as the session has it.

    Only where it is unset (a local session, tests) a folder of our own is made.
    """
    try:
        given = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # noqa: BLE001 - a static conf that isn't set
        given = None
    given = given or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _LOCAL[app] = tempfile.mkdtemp(prefix="changeflow-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/changeflow/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    The written table replaces the plan, so a stage that needs it twice doesn't
    compute it twice, and it survives the loss of an executor.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that was written to the shared folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete every table that was written below the shared folder; none may be in use."""
    remove(spark, f"{shared_dir(spark)}/changeflow")


def plan_bytes(df: DataFrame) -> int | None:
    """Bytes of the files and tables that ``df`` reads, as the optimizer knows them; None if it doesn't (rows from the driver, an RDD)."""
    unknown = 1 << 55
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(s >= unknown for s in sizes) else sum(sizes)


#: From so many tasks on, an input's own splits serve as well and cost no shuffle.
ENOUGH_TASKS = 20_000


def task_count(source: DataFrame, bytes_per_task: int = 4 << 20) -> int:
    """Tasks for a step that costs much more CPU than reading ``source``: two a core at least, :data:`ENOUGH_TASKS` at most."""
    spark = source.sparkSession
    size = plan_bytes(source)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions")) if size is None else -(-size // bytes_per_task)
    return min(max(tasks, 2 * spark.sparkContext.defaultParallelism), ENOUGH_TASKS)


def spread(df: DataFrame, source: DataFrame | None = None, bytes_per_task: int = 4 << 20) -> DataFrame:
    """Rows dealt out evenly, whatever they hold, to as many tasks as the input's size asks for.

    For steps that cost much more CPU than reading: a file split is too coarse a task for
    them, unless the input is so large that there are plenty of splits; then nothing moves.
    Spark deals in the order of the rows' hashes, so a task that is run again deals alike.
    """
    tasks = task_count(source if source is not None else df, bytes_per_task)
    return df if tasks >= ENOUGH_TASKS else df.repartition(tasks)
