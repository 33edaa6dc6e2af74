"""Problem 2: messages delivered more than once, by disjoint seen ranges.

Each producer (a source row) numbers its messages. What was seen of a producer is
a set of disjoint ranges of numbers; a message is accepted if no range covers its
number, which then joins the ranges. A range never leaves its block of
``2**block_bits`` numbers, so a hot producer is many (producer, block) groups.
Repeats of one number are first thinned within ``salts`` slices, so that a number
sent a billion times is no single task either.

Identifiers that are no number have no range: they are looked up exactly, by text,
and kept in a keyed table beside the ranges from batch to batch.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize

RANGE_SCHEMA = "producer array<string>, block bigint, lo bigint, hi bigint"
TEXT_SCHEMA = "producer array<string>, text string"


def _sweep(df: DataFrame, part: list, arrival: list[str], out: str) -> DataFrame:
    """Sweep each group in the order of numbers: covered if a range or message before reaches the number."""
    w = Window.partitionBy(*part).orderBy("_lo", "_is_message", *arrival).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.max("_hi").over(w) >= F.col("_lo"), F.lit(False)))


def mark_repeats(
    messages: DataFrame,
    producer: list[str],
    number: str,
    number_text: str,
    arrival: list[str],
    seen: DataFrame | None = None,
    block_bits: int = 20,
    salts: int = 1024,
    texts: DataFrame | None = None,
) -> DataFrame:
    """``messages`` with ``is_repeat``: the number was covered by ``seen`` or by an earlier message.

    ``producer``: columns that name the producer; ``number``: the bigint, null where
    malformed; ``number_text``: its text, the exact key of malformed ones; ``arrival``:
    columns whose ascending order says which copy came first (unique).
    A message with a null producer column, or with neither number nor text, has no
    identity: never a repeat. Repeated rows equal in ``arrival`` are repeats as well.
    ``seen``: ranges as of :func:`seen_ranges`, or ranges and malformed identifiers as of
    :func:`next_state`; ``texts``: malformed identifiers as of :func:`seen_texts`. Empty
    input gives an empty result.
    """
    spread = F.pmod(F.xxhash64(*arrival), F.lit(salts)).cast("int")
    known = F.lit(True)
    for c in producer:
        known = known & F.col(c).isNotNull()
    known = known & (F.col(number).isNotNull() | F.col(number_text).isNotNull())
    block = F.floor(F.col(number) / F.lit(1 << block_bits)).cast("bigint") if block_bits > 52 else F.shiftright(F.col(number), block_bits)
    df = messages.withColumns({
        "_producer": F.when(known, F.array(*[F.col(c).cast("string") for c in producer])),
        "_block": F.when(F.col(number).isNotNull(), block),
        "_text": F.when(F.col(number).isNull(), F.col(number_text)),
        "_lo": F.coalesce(F.col(number), F.lit(0).cast("bigint")),
        "_is_message": F.lit(1),
        "_salt": spread,
    }).withColumn("_hi", F.col("_lo"))
    # Messages without identity: each slice alone, and never marked.
    group = [F.col("_producer"), F.col("_block"), F.col("_text")]
    df = _sweep(df, [*group, F.col("_salt")], arrival, "_local")
    if seen is not None:
        texts_too = [F.col("text").alias("_text")] if "text" in seen.columns else []
        df = df.unionByName(
            seen.select(F.col("producer").alias("_producer"), F.col("block").alias("_block"), *texts_too, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.lit(0).alias("_is_message"), F.lit(False).alias("_local")),
            allowMissingColumns=True,
        )
    if texts is not None:
        zero = F.lit(0).cast("bigint")
        df = df.unionByName(
            texts.select(F.col("producer").alias("_producer"), F.col("text").alias("_text"), zero.alias("_lo"), zero.alias("_hi"), F.lit(0).alias("_is_message"), F.lit(False).alias("_local")),
            allowMissingColumns=True,
        )
    # A local repeat stays in its slice; only the first of each slice meets the others.
    at = F.when(F.col("_local") | F.col("_producer").isNull(), F.coalesce(F.col("_salt"), F.lit(-1))).otherwise(F.lit(-1))
    df = _sweep(df, [*group, at], arrival, "_global").where("_is_message = 1")
    repeat = F.col("_producer").isNotNull() & (F.col("_local") | F.col("_global"))
    return df.withColumn("is_repeat", repeat).drop("_producer", "_block", "_text", "_lo", "_hi", "_is_message", "_salt", "_local", "_global")


def seen_ranges(accepted: DataFrame, producer: list[str], number: str, seen: DataFrame | None = None, block_bits: int = 20) -> DataFrame:
    """The state after ``accepted``: disjoint, merged ranges of numbers (``producer, block, lo, hi``).

    Ranges that touch are one. Rows without producer or number add nothing; malformed
    identifiers are in :func:`seen_texts`, the other half of the state.
    """
    ok = F.col(number).isNotNull()
    for c in producer:
        ok = ok & F.col(c).isNotNull()
    new = accepted.where(ok).select(
        F.array(*[F.col(c).cast("string") for c in producer]).alias("producer"),
        F.shiftright(F.col(number), block_bits).alias("block"),
        F.col(number).alias("lo"), F.col(number).alias("hi"),
    )
    every = new if seen is None else new.unionByName(seen.select("producer", "block", "lo", "hi"))
    return merge_ranges(every, ["producer", "block"])


def seen_texts(accepted: DataFrame, producer: list[str], number: str, number_text: str, texts: DataFrame | None = None) -> DataFrame:
    """The malformed identifiers seen after ``accepted``, each once (``producer, text``)."""
    ok = F.col(number).isNull() & F.col(number_text).isNotNull()
    for c in producer:
        ok = ok & F.col(c).isNotNull()
    new = accepted.where(ok).select(F.array(*[F.col(c).cast("string") for c in producer]).alias("producer"), F.col(number_text).alias("text"))
    return (new if texts is None else new.unionByName(texts.select("producer", "text"))).distinct()


def merge_ranges(ranges: DataFrame, group: list[str]) -> DataFrame:
    """Disjoint ranges of inclusive ``lo``..``hi`` per ``group``; those that overlap or touch become one."""
    w = Window.partitionBy(*group).orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts: Column = F.coalesce((F.col("lo") > before + 1).cast("int"), F.lit(1))
    return (
        ranges.withColumn("_s", starts)
        .withColumn("_island", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*group, "_island")
        .agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .drop("_island")
    )


def next_state(accepted: DataFrame, producer: list[str], number: str, number_text: str, state: DataFrame | None = None, block_bits: int = 20) -> DataFrame:
    """The whole state after ``accepted``: ``producer, block, text, lo, hi``; ranges have no text, a malformed identifier is one row with its text."""
    known = F.col(number).isNotNull() | F.col(number_text).isNotNull()
    for c in producer:
        known = known & F.col(c).isNotNull()
    at = F.coalesce(F.col(number), F.lit(0).cast("bigint"))
    new = accepted.where(known).select(
        F.array(*[F.col(c).cast("string") for c in producer]).alias("producer"), F.shiftright(F.col(number), block_bits).alias("block"),
        F.when(F.col(number).isNull(), F.col(number_text)).alias("text"), at.alias("lo"), at.alias("hi"),
    )
    return merge_ranges(new if state is None else new.unionByName(state), ["producer", "block", "text"])


def sweep(batches: Iterable[DataFrame], producer: list[str], number: str, number_text: str, arrival: list[str], state: DataFrame | None = None, block_bits: int = 20, salts: int = 1024) -> tuple[DataFrame, DataFrame]:
    """Batch after batch against the state that those before left: (all messages, marked; the state after them).

    Every batch is marked by :func:`mark_repeats` with the ranges and texts stored so far,
    and what it accepts is merged into them; marked messages and the state are written to the
    shared folder before the next batch, so none is worked out again. Batches must come in
    the order of arrival for the copy that came first to be the one that is kept. No batch at
    all is an error.
    """
    done: list[DataFrame] = []
    for batch in batches:
        if done:
            state = materialize(next_state(done[-1].where("not is_repeat"), producer, number, number_text, state, block_bits), "ranges")
        done.append(materialize(mark_repeats(batch, producer, number, number_text, arrival, state, block_bits, salts), "marked"))
    out = done[0]
    for m in done[1:]:
        out = out.unionByName(m)
    return out, next_state(done[-1].where("not is_repeat"), producer, number, number_text, state, block_bits)


def time_slices(df: DataFrame, at: str, slices: int) -> list[DataFrame]:
    """``df`` in at most ``slices`` parts by equal spans of the timestamp ``at``, the earliest first; a null time is in the first part."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    r = df.agg(F.min(micros).alias("a"), F.max(micros).alias("b")).first()
    if r.a is None or slices < 2:
        return [df]
    step = max((r.b - r.a) // slices + 1, 1)
    part = F.coalesce(((micros - F.lit(r.a)) / F.lit(step)).cast("int"), F.lit(0))
    return [df.where(part == i) for i in range((r.b - r.a) // step + 1)]
