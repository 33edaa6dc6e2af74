"""Applying a folded batch to a target table: the merge family.

There is one join, by key, and Spark picks its form. Functions return the new table;
writing it is :mod:`changeflow.table`'s part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decode import is_unavailable

#: Most distinct dates that are turned into a pruning predicate; beyond it nothing is pruned, which changes no row.
MOST_DATES = 1_000


def _condition(keys: list[str], null_safe: bool, extra: list[str], null_safe_extra: bool = False) -> Column:
    on = F.lit(True)
    for k in keys:
        a, b = F.col(f"t.{k}"), F.col(f"s.{k}")
        on = on & (a.eqNullSafe(b) if null_safe else a == b)
    for c in extra:
        a, b = F.col(f"t.{c}"), F.col(f"s.{c}")
        on = on & (a.eqNullSafe(b) if null_safe_extra else a == b)
    return on


def available(new: Column, text: bool) -> Column:
    """Whether a staged value was sent: a text that isn't the placeholder in one of its forms; a null was sent."""
    return ~is_unavailable(new) if text else F.lit(True)


def _joined(target: DataFrame, staged: DataFrame, keys: list[str], null_safe: bool, extra: list[str], null_safe_extra: bool = False) -> DataFrame:
    t = target.withColumn("__in_t", F.lit(True)).alias("t")
    s = staged.withColumn("__in_s", F.lit(True)).alias("s")
    return t.join(s, _condition(keys, null_safe, extra, null_safe_extra), "full_outer")


def merge(
    target: DataFrame, staged: DataFrame, keys: list[str], soft_delete: bool = False, placeholder_columns: list[str] | None = None,
    null_safe: bool = False, extra: list[str] | None = None, prefix: str = "__cf_", null_safe_extra: bool = False,
) -> DataFrame:
    """``target`` after ``staged`` (one row a key, with the delete markers) is merged into it.

    Hard: a matched delete removes the row, an unmatched one does nothing. Soft: rows stay,
    the delete marker is set; a key that only saw deletes keeps its other values, and an
    unmatched one is inserted. A value not sent (in ``placeholder_columns``) keeps the
    target's. A null delete marker is no delete. Null keys match only if ``null_safe``.
    Target columns that the batch lacks keep their values; ``extra`` columns join too, their nulls with ``null_safe_extra``.
    """
    gone_col, only_col = f"{prefix}delete", f"{prefix}only_set_delete"
    both = _joined(target, staged, keys, null_safe, extra or [], null_safe_extra)
    in_t, in_s = F.col("t.__in_t").isNotNull(), F.col("s.__in_s").isNotNull()
    gone = F.coalesce(F.col(f"s.{gone_col}"), F.lit(False))
    only = F.coalesce(F.col(f"s.{only_col}"), F.lit(False))
    flagged = set(placeholder_columns or [])
    text = {f.name for f in staged.schema.fields if f.dataType.typeName() == "string"}
    out = []
    for c in target.columns:
        if c not in staged.columns:
            out.append(F.col(f"t.{c}").alias(c))
            continue
        new, old = F.col(f"s.{c}"), F.col(f"t.{c}")
        sent = F.when(in_t & ~available(new, c in text), old).otherwise(new) if c in flagged else new
        if soft_delete:
            value = F.when(~in_s, old).when(in_t & only, new if c == gone_col else old).otherwise(sent)
        else:
            value = F.when(in_s, sent).otherwise(old)
        out.append(value.alias(c))
    kept = both if soft_delete else both.where(~(in_s & gone))
    return kept.select(*out)


def split_update(target: DataFrame, staged: DataFrame, keys: list[str], placeholder_columns: list[str] | None = None, prefix: str = "__cf_") -> DataFrame:
    """The target rows that a batch updates, with their new values: the UPDATE of engines without MERGE."""
    live = staged.where(~F.coalesce(F.col(f"{prefix}delete"), F.lit(False)))
    text = {f.name for f in staged.schema.fields if f.dataType.typeName() == "string"}
    both = target.alias("t").join(live.alias("s"), _condition(keys, False, []), "inner")
    cols = []
    for c in target.columns:
        if c not in staged.columns:
            cols.append(F.col(f"t.{c}").alias(c))
        elif c in (placeholder_columns or []):
            cols.append(F.when(available(F.col(f"s.{c}"), c in text), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c))
        else:
            cols.append(F.col(f"s.{c}").alias(c))
    return both.select(*cols)


def split_insert(target: DataFrame, staged: DataFrame, keys: list[str], soft_delete: bool = False, prefix: str = "__cf_") -> DataFrame:
    """The batch's rows that the target has no key for: the anti-join INSERT; deletes only if soft."""
    rows = staged if soft_delete else staged.where(~F.coalesce(F.col(f"{prefix}delete"), F.lit(False)))
    return rows.alias("s").join(target.select(*keys).alias("t"), _condition(keys, False, []), "left_anti")


def split_delete(target: DataFrame, staged: DataFrame, keys: list[str], prefix: str = "__cf_") -> DataFrame:
    """The target without the keys that the batch deletes."""
    gone = staged.where(F.col(f"{prefix}delete")).select(*keys).distinct()
    return target.alias("t").join(gone.alias("s"), _condition(keys, False, []), "left_anti")


def upsert_staging(pending: DataFrame, batch: DataFrame, keys: list[str], placeholder_columns: list[str] | None = None, prefix: str = "__cf_") -> DataFrame:
    """A pending batch with a later one folded onto it: the accumulation of a multi-step merge.

    By the rules of the fold: a later upsert replaces, values not sent are kept, a delete
    keeps the pending values and doesn't forget that there was an upsert. Columns of
    either side are kept: of rows that the other side brought they are null, of rows on
    both sides the pending values stay where the batch lacks the column.
    """
    both = _joined(pending, batch, keys, True, [])
    in_t, in_s = F.col("t.__in_t").isNotNull(), F.col("s.__in_s").isNotNull()
    gone = F.coalesce(F.col(f"s.{prefix}delete"), F.lit(False))
    text = {f.name for f in batch.schema.fields if f.dataType.typeName() == "string"}
    out = []
    for c in [*pending.columns, *[c for c in batch.columns if c not in pending.columns]]:
        if c not in batch.columns:
            out.append(F.col(f"t.{c}").alias(c))
            continue
        if c not in pending.columns:
            out.append(F.col(f"s.{c}").alias(c))
            continue
        new, old = F.col(f"s.{c}"), F.col(f"t.{c}")
        if c == f"{prefix}only_set_delete":
            value = F.when(~in_s, old).when(~in_t, new).otherwise(new & old)
        elif c.startswith(prefix) or c in keys:
            value = F.when(in_s, new).otherwise(old)
        else:
            sent = F.when(available(new, c in text), new).otherwise(old) if c in (placeholder_columns or []) else new
            value = F.when(~in_s, old).when(~in_t, new).when(gone, old).otherwise(sent)
        out.append(value.alias(c))
    return both.select(*out)


def distinct_dates(rows: DataFrame, column: str) -> DataFrame:
    """The different dates ``d`` of a column, a null among them."""
    return rows.select(F.to_date(column).alias("d")).distinct()


def batch_dates(rows: DataFrame, column: str) -> list | None:
    """:func:`distinct_dates` in order, for pruning; None if there are too many."""
    dates = [r.d for r in distinct_dates(rows, column).limit(MOST_DATES + 1).collect()]
    return None if len(dates) > MOST_DATES else sorted(dates, key=lambda d: (d is not None, d))


def on_dates(column: str, dates: list) -> Column:
    """Whether a row's date is among ``dates``: a range of the raw column, which a scan can skip files by, and the list."""
    known = [d for d in dates if d is not None]
    hit = F.lit(False)
    if known:
        c = F.col(column)
        hit = (c >= F.lit(known[0])) & (c < F.date_add(F.lit(known[-1]), 1)) & F.to_date(c).isin(known)
    return F.coalesce(hit, F.lit(False)) | F.col(column).isNull() if None in dates else F.coalesce(hit, F.lit(False))


def merge_pruned(target: DataFrame, staged: DataFrame, keys: list[str], column: str, null_safe: bool = False, **options) -> DataFrame:  # noqa: ANN003
    """:func:`merge`, its very result, where only the target's rows of the dates that the batch's keys have there take part in the join.

    Those dates are looked up first, by a scan of keys and date alone, so a row whose date
    moves is found where it was. The other rows are carried over as they are, without a
    shuffle. With more than :data:`MOST_DATES` dates the whole target takes part.
    """
    held = target.alias("t").join(staged.select(*keys).alias("s"), _condition(keys, null_safe, []), "left_semi")
    dates = batch_dates(held, column)
    if dates is None:
        return merge(target, staged, keys, null_safe=null_safe, **options)
    touched = on_dates(column, dates)
    return target.where(~touched).unionByName(merge(target.where(touched), staged, keys, null_safe=null_safe, **options))


def merge_counts(target: DataFrame, staged: DataFrame, keys: list[str], prefix: str = "__cf_") -> DataFrame:
    """One row: staged, matched, inserted, deleted and still unavailable values."""
    gone = F.coalesce(F.col(f"{prefix}delete"), F.lit(False))
    known = target.select(*keys).distinct().withColumn("__known", F.lit(True))
    cols = [c for c, t in staged.dtypes if t == "string"]
    lost = sum((is_unavailable(F.col(c)).cast("int") for c in cols), F.lit(0))
    return staged.join(known, keys, "left").agg(
        F.count("*").alias("staged"), F.count("__known").alias("matched"), F.count(F.when(F.col("__known").isNull() & ~gone, 1)).alias("inserted"),
        F.count(F.when(F.col("__known").isNotNull() & gone, 1)).alias("deleted"), F.sum(F.when(F.col("__known").isNull(), lost).otherwise(0)).alias("unavailable"),
    )


class MergeError(RuntimeError):
    """A merge's result doesn't hold what the batch says."""


def unmerged(merged: DataFrame, staged: DataFrame, keys: list[str], soft_delete: bool = False, prefix: str = "__cf_") -> DataFrame:
    """The batch's keys that a merge's result contradicts: ``keys, problem`` (``lost`` or ``not deleted``); none after a right merge."""
    gone = F.lit(False) if soft_delete else F.coalesce(F.col(f"{prefix}delete"), F.lit(False))
    there = merged.select(*keys).withColumn("__there", F.lit(True)).alias("t")
    s = staged.select(*keys, gone.alias("__gone")).alias("s")
    both = s.join(there, _condition(keys, True, []), "left").select(*[F.col(f"s.{k}").alias(k) for k in keys], F.col("s.__gone").alias("g"), F.col("t.__there").isNotNull().alias("there"))
    return both.where(F.col("g") == F.col("there")).select(*keys, F.when(F.col("g"), "not deleted").otherwise("lost").alias("problem"))


def assert_merged(merged: DataFrame, staged: DataFrame, keys: list[str], soft_delete: bool = False, prefix: str = "__cf_") -> None:
    """:class:`MergeError` if any key of the batch is missing from, or left in, the merged rows."""
    bad = unmerged(merged, staged, keys, soft_delete, prefix).limit(3).collect()
    if bad:
        raise MergeError(f"the merge contradicts its batch: {[r.asDict() for r in bad]}")
