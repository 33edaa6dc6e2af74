"""Problem 4: a stream of inserts, updates and deletes, by composing patches.

A change is a function on a row: it sets columns, or removes the row, at a position.
Composing such functions is associative: the patch of a run of changes holds the
last change (position and operation), the last removal, and per column the last
value that was sent, each with its position. So a hot row's changes are composed
chunk by chunk (a chunk is a range of positions), each chunk first within every
input split (map-side), then the chunks of a row, then the row's one patch is
applied to the base table. Nothing is sorted and no group is ever held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Operations that end a row's life; the rest set its columns.
REMOVE = ("d",)


def change_patches(changes: DataFrame, key: list[str], pos: str, op: str, values: dict[str, Column], missing: dict[str, Column] | None = None) -> DataFrame:
    """One patch a change: ``_top`` (position and, in its lowest bit, removal), ``_gone`` (position of a removal), ``_v_<c>`` (position, value).

    ``values``: new value of each column; ``missing``: condition under which the
    column's value was not sent and stays as it was. A change whose key or position
    is null can't be applied and leaves no row. Positions lie below 2^62, so that a
    patch without columns is two numbers, which Spark combines in a hash table.
    """
    missing = missing or {}
    usable = F.col(pos).isNotNull()
    for k in key:
        usable = usable & F.col(k).isNotNull()
    removal = F.coalesce(F.col(op).isin(*REMOVE), F.lit(False))
    cols = [(F.col(pos) * 2 + removal.cast("bigint")).alias("_top"), F.when(removal, F.col(pos)).alias("_gone")]
    for c, v in values.items():
        sent = ~removal & ~F.coalesce(missing.get(c, F.lit(False)), F.lit(False))
        cols.append(F.when(sent, F.struct(F.col(pos).alias("pos"), v.alias("value"))).alias(f"_v_{c}"))
    return changes.where(usable).select(*key, *cols)


def compose(patches: DataFrame, by: list) -> DataFrame:
    """Compose the patches of each group into one; associative, so any order and grouping of calls gives the same."""
    parts = [c for c in patches.columns if c in ("_top", "_gone") or c.startswith("_v_")]
    return patches.groupBy(*by).agg(*[F.max(c).alias(c) for c in parts])


def compose_by_chunks(patches: DataFrame, key: list[str], chunk_bits: int = 20) -> DataFrame:
    """One patch a key: chunks of ``2**chunk_bits`` positions first, then the chunks of each key.

    A key with any number of changes is as many groups as its positions span chunks.
    """
    chunk = F.shiftright("_top", chunk_bits + 1).alias("_chunk")
    first = compose(patches, [*key, chunk])
    return compose(first, key)


def apply_patches(base: DataFrame, patch: DataFrame, key: list[str], base_pos: str, columns: list[str]) -> DataFrame:
    """The current table: ``key``, ``columns`` and ``base_pos`` (position that shaped the row).

    The higher of the base row's position and the patch's decides; at the same
    position the message does (a repeat of the change that the base row holds, or
    its removal). A base row with a null position yields to any change. A row that
    was removed and sent again starts from nothing. Base rows that repeat a key count
    once, the one with the highest position.
    """
    mine = F.struct(F.col(base_pos).alias("pos"), *[F.col(c).alias(f"b_{c}") for c in columns])
    top = F.shiftright("_top", 1)
    usable = F.lit(True)
    for k in key:
        usable = usable & F.col(k).isNotNull()
    by = base.where(usable).groupBy(*key)
    held = by.agg(F.max(mine).alias("_base")) if columns else by.agg(F.max(base_pos).alias("pos")).select(*key, F.struct("pos").alias("_base"))
    both = held.join(patch, key, "full_outer")
    stale = F.col("_base").isNotNull() & (F.col("_top").isNull() | F.coalesce(F.col("_base.pos") > top, F.lit(False)))
    out = [*key]
    for c in columns:
        v = F.col(f"_v_{c}")
        sent = v.isNotNull() & (F.col("_gone").isNull() | (v["pos"] > F.col("_gone")))
        newer = sent & (F.col("_base.pos").isNull() | (v["pos"] >= F.col("_base.pos")))
        lives = F.col("_base").isNotNull() & (F.col("_gone").isNull() | (F.col("_base.pos") > F.col("_gone")))
        out.append(F.when(stale, F.col(f"_base.b_{c}")).when(newer, v["value"]).when(lives, F.col(f"_base.b_{c}")).when(sent, v["value"]).alias(c))
    out.append(F.when(stale, F.col("_base.pos")).otherwise(top).alias(base_pos))
    return both.where(stale | (F.col("_top").bitwiseAND(F.lit(1)) == 0)).select(*out)
