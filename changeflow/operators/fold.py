"""Folding changes to one net change a key.

``fold`` is the fast form for a fixed set of columns: every part of the result is a
maximum by the order of changes, so it is combined map-side before the shuffle and a
hot key is no large group. ``fold_maps`` is the exact form for rows whose columns come
and go; it gathers a key's changes, in bounded runs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.frames import UNAVAILABLE


def fold(changes: DataFrame, keys: list[str], seq: list[str], op: str, columns: list[str], meta: list[str] | None = None, prefix: str = "__cf_") -> DataFrame:
    """One row a key: ``keys``, ``columns``, ``meta``, ``delete``, ``only_set_delete`` and ``seq`` of the last change.

    A later change replaces an earlier one; a value not sent (the placeholder, in text
    columns) is taken from the last change that sent it. A delete keeps the values before
    it. ``only_set_delete``: the key saw nothing but deletes. Null keys form one group;
    null values are values. ``seq`` must order a key's changes totally; among repeats of
    one change either serves.
    """
    meta = meta or []
    order = F.struct(*seq)
    alive = F.coalesce(F.col(op) != "d", F.lit(True))
    text = {f.name for f in changes.schema.fields if f.dataType.typeName() == "string"}
    aggs: list[Column] = [
        F.max(order).alias("_last"), F.max_by(F.col(op), order).alias("_op"), F.bool_or(alive).alias("_any"),
        F.min(F.when(alive, order)).alias("_first_alive"),
    ]
    for m in meta:
        aggs.append(F.max_by(F.struct(F.col(m).alias("v")), order).alias(f"_m_{m}"))
    for c in columns:
        boxed = F.struct(F.col(c).alias("v"))
        sent = F.coalesce(F.col(c) != UNAVAILABLE, F.lit(True)) if c in text else F.lit(True)
        aggs.append(F.max_by(F.when(alive & sent, boxed), F.when(alive & sent, order)).alias(f"_c_{c}"))
        aggs.append(F.min_by(boxed, order).alias(f"_f_{c}"))
        aggs.append(F.max_by(F.when(alive, boxed), F.when(alive, order)).alias(f"_l_{c}"))
    g = changes.groupBy(*keys).agg(*aggs, F.min(order).alias("_first"))
    out = []
    for c in columns:
        # Only deletes can come before the first other change; the first one's values count.
        lead = F.when(F.col("_first") < F.coalesce("_first_alive", "_last"), F.col(f"_f_{c}")).otherwise(F.when(~F.col("_any"), F.col(f"_f_{c}")))
        box = F.when(F.col("_any"), F.coalesce(F.col(f"_c_{c}"), lead, F.col(f"_l_{c}"))).otherwise(F.coalesce(lead, F.col(f"_f_{c}")))
        out.append(box["v"].alias(c))
    gone = F.coalesce(F.col("_op") == "d", F.lit(False))
    return g.select(
        *keys, *out, *[F.col(f"_m_{m}.v").alias(m) for m in meta],
        gone.alias(f"{prefix}delete"), (gone & ~F.col("_any")).alias(f"{prefix}only_set_delete"), *[F.col(f"_last.{s}").alias(s) for s in seq],
    )


#: A placeholder whose column the row before it lacked: nothing older is carried over to it.
_SETTLED = UNAVAILABLE + "\x01"


def _step(acc: Column, e: Column) -> Column:
    """The fold of one more change onto a net row: structs of (seq, gone, only, row)."""
    held = F.map_filter(e["row"], lambda k, v: F.coalesce(v != UNAVAILABLE, F.lit(True)) | ~F.map_contains_key(acc["row"], k))
    carried = F.map_filter(acc["row"], lambda k, v: F.map_contains_key(e["row"], k) & ~F.map_contains_key(held, k))
    settle = lambda m: F.transform_values(m, lambda k, v: F.when(v == UNAVAILABLE, F.lit(_SETTLED)).otherwise(v))
    upsert = F.map_concat(settle(held), carried)
    extra = settle(F.map_filter(e["row"], lambda k, v: ~F.map_contains_key(acc["row"], k)))
    delete = F.map_concat(acc["row"], extra)
    return F.struct(e["seq"].alias("seq"), e["gone"].alias("gone"), F.when(e["gone"], acc["only"]).otherwise(F.lit(False)).alias("only"), F.when(e["gone"], delete).otherwise(upsert).alias("row"))


def fold_maps(changes: DataFrame, keys: list[str], seq: str, op: str, row: str, prefix: str = "__cf_", run: int = 10_000) -> DataFrame:
    """The fold for rows as maps of text, where a missing column is not a null one.

    An upsert's missing columns vanish; a delete keeps the columns before it and adds its
    own new ones. Changes of a key are folded in runs of ``run`` sequence numbers, then the
    runs, so a hot key's changes never stand in one list: a fold of folds is the fold of
    all, as each step needs only the net row before it and a run's net row says what it
    replaces (its first upsert forgets all before it but values not sent).
    """
    one = F.struct(F.col(seq).alias("seq"), F.coalesce(F.col(op) == "d", F.lit(False)).alias("gone"), F.coalesce(F.col(op) == "d", F.lit(False)).alias("only"), F.col(row).alias("row"))
    by_seq = lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)

    def folded(column: str) -> Column:
        items = F.array_sort(F.col(column), by_seq)
        return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), items[0], _step)

    chunk = F.floor(F.col(seq) / run).alias("_run")
    # A run that begins with deletes and goes on can't be folded alone: its leading deletes stay apart.
    lists = changes.groupBy(*keys, chunk).agg(F.collect_list(one).alias("l")).select(*keys, F.array_sort("l", by_seq).alias("l"))
    lead = F.aggregate("l", F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, e: F.struct(F.when(a["on"] & e["gone"], a["n"] + 1).otherwise(a["n"]).alias("n"), (a["on"] & e["gone"]).alias("on")))["n"]
    split = lists.select(*keys, "l", lead.alias("n"))
    rest = F.slice("l", F.col("n") + 1, F.greatest(F.size("l") - F.col("n"), F.lit(0)))
    ups = F.aggregate(F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0))), rest[0], _step)
    heads = F.slice("l", 1, F.col("n"))
    net_head = F.aggregate(F.slice(heads, 2, F.greatest(F.size(heads) - 1, F.lit(0))), heads[0], _step)
    # A net row of upserts then deletes is told apart: as the upsert part and one delete.
    parts = F.concat(F.when(F.size(heads) > 0, F.array(net_head)).otherwise(F.array().cast(_type(changes, seq))), F.when(F.size(rest) > 0, _unfold(ups)).otherwise(F.array().cast(_type(changes, seq))))
    flat = split.select(*keys, parts.alias("p")).groupBy(*keys).agg(F.flatten(F.collect_list("p")).alias("p"))
    settled = F.transform_values("r.row", lambda k, v: F.when(v == _SETTLED, F.lit(UNAVAILABLE)).otherwise(v))
    return flat.select(*keys, folded("p").alias("r")).select(*keys, settled.alias(row), F.col("r.gone").alias(f"{prefix}delete"), F.col("r.only").alias(f"{prefix}only_set_delete"), F.col("r.seq").alias(seq))


def _type(changes: DataFrame, seq: str) -> str:
    return f"array<struct<seq:{changes.schema[seq].dataType.simpleString()},gone:boolean,only:boolean,row:map<string,string>>>"


def _unfold(net: Column) -> Column:
    """The net row of a run that has an upsert, as an upsert, and a delete after it where it ends in one."""
    up = F.struct(net["seq"].alias("seq"), F.lit(False).alias("gone"), F.lit(False).alias("only"), net["row"].alias("row"))
    gone = F.struct(net["seq"].alias("seq"), F.lit(True).alias("gone"), F.lit(True).alias("only"), net["row"].alias("row"))
    return F.when(net["gone"], F.array(up, gone)).otherwise(F.array(up))


def batch_flags(changes: DataFrame, op: str, soft_delete: bool = False) -> DataFrame:
    """One row: rows, whether any is no delete, whether any is a hard delete, approximate bytes."""
    gone = F.coalesce(F.col(op) == "d", F.lit(False))
    return changes.agg(
        F.count("*").alias("rows"), F.coalesce(F.bool_or(~gone), F.lit(False)).alias("other_operations"),
        F.coalesce(F.bool_or(gone & F.lit(not soft_delete)), F.lit(False)).alias("hard_deletes"), F.sum(F.octet_length(F.to_json(F.struct("*")))).alias("bytes"),
    )


def latest_event(changes: DataFrame, keys: list[str], at: str, seq: str) -> DataFrame:
    """``keys, last_at, events``: the time of each group's last saved event by ``seq``, which need not be the latest time, and how many it has."""
    return changes.groupBy(*keys).agg(F.max_by(at, seq).alias("last_at"), F.count("*").alias("events"))
