"""Cutting rows into batches of bounded bytes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greedy(sizes: Iterable[int | None], limit: int, fail: bool = False) -> Iterator[int | None]:
    """Batch number of each item, in order: full when the next would pass ``limit``; an item over it has none, or is an error."""
    batch, filled = 0, 0
    for n in sizes:
        n = n or 0
        if n > limit:
            if fail:
                raise ValueError(f"an item of {n} bytes is larger than {limit}")
            yield None
            continue
        if filled + n > limit:
            batch, filled = batch + 1, 0
        filled += n
        yield batch
        if filled == limit:
            batch, filled = batch + 1, 0


def batch_by_bytes(df: DataFrame, group: list[str], order: list[str], payload: str, limit: int, fail: bool = False, out: str = "batch_no") -> DataFrame:
    """``df`` with the number of each row's batch within its group, in ``order``; null for a row over the limit.

    Groups should be bounded (a partition of a topic in one run); they are streamed, not
    held, and a group stays in one task because a batch depends on all before it.
    """
    names = [*df.columns]
    sized = df.withColumn("_n", F.octet_length(payload)).repartition(*group).sortWithinPartitions(*group, *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` bigint"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sizes = None, None
        current: list[int] = [0]

        def feed() -> Iterator[int]:
            while True:
                yield current[0]

        for b in it:
            keys = list(zip(*[b.column(g).to_pylist() for g in group], strict=True)) if group else [()] * b.num_rows
            numbers: list[int | None] = []
            for key, n in zip(keys, b.column("_n").to_pylist(), strict=True):
                if sizes is None or key != held:
                    held, sizes = key, greedy(feed(), limit, fail)
                current[0] = n or 0
                numbers.append(next(sizes))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(numbers, pa.int64())], names=[*names, out])

    return sized.mapInArrow(run, schema)
