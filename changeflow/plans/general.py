"""Queries of the general training-data problems (1 to 5) over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import drift, incremental, nested, once, patches
from ..shared import fresh_path, materialize, spread
from ..sources.frames import UNAVAILABLE, parse_messages, read_table


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return parse_messages(read_table(spark, d, "change_messages"))


ARRIVAL = ["kafka_ts", "kafka_partition", "kafka_offset", "topic"]


PRODUCER = ["db", "table_name", "id_key"]
#: Batches that the feed is swept in.
BATCHES = 2


def _swept(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The feed's messages, marked batch by batch in the order of publishing against the ranges seen so far, and the ranges in the end."""
    m = _messages(spark, d).withColumn("id_key", F.coalesce(F.col("row_id").cast("string"), F.col("id_text")))
    slim = m.select("topic", "kafka_partition", "kafka_offset", "kafka_ts", "db", "table_name", "id_key", "lsn", "position_text")
    slim = materialize(slim.withColumn("position_text", F.when(F.col("lsn").isNull(), F.col("position_text"))), "messages")
    return once.sweep(once.time_slices(slim, "kafka_ts", BATCHES), PRODUCER, "lsn", "position_text", ARRIVAL)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each message to be dropped: its number was in the ranges seen before, or came before in its batch."""
    return _swept(spark, d)[0].where("is_repeat").select("topic", "kafka_partition", "kafka_offset")


def p2_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The seen ranges after the whole feed, by source table: how many, and how many numbers they hold."""
    r = _swept(spark, d)[1].where("text is null")
    return r.groupBy(F.col("producer")[0].alias("src_db"), F.col("producer")[1].alias("src_table")).agg(
        F.count("*").alias("ranges"), F.sum(F.col("hi") - F.col("lo") + 1).alias("numbers")
    )


def _current(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    m = _messages(spark, d).select(F.col("db").alias("src_db"), F.col("table_name").alias("src_table"), "row_id", "lsn", "op", *(["after"] if columns else []))
    key = ["src_db", "src_table", "row_id"]
    values = {c: F.get_json_object("after", f"$.{c}") for c in columns}
    changes = m.withColumns({f"new_{c}": v for c, v in values.items()})
    p = patches.change_patches(changes, key, "lsn", "op", {c: F.col(f"new_{c}") for c in columns}, {c: F.col(f"new_{c}") == UNAVAILABLE for c in columns})
    base = read_table(spark, d, "mirror_rows").select(*key, *columns, "last_lsn")
    return patches.apply_patches(base, patches.compose_by_chunks(p, key), key, "last_lsn", columns)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each row of the current state with the position that shaped it."""
    return p4_state(spark, d).select("src_db", "src_table", "row_id", "last_lsn")


def p4_state(spark: SparkSession, d: str) -> DataFrame:
    """The current state with its e-mail column, values that were not sent carried over."""
    return _current(spark, d, ["email"])


CHANGE = ["topic", "row_id", "lsn"]
#: What a change says; its identity is its row and position.
CONTENT = ["op", "before", "after"]
STATE_COLUMNS = "topic string, row_id bigint, lsn bigint, content_hash bigint"


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    """The feed's changes with the hash of what they say, written once."""
    m = _messages(spark, d).where("row_id is not null and lsn is not null")
    slim = incremental.with_hash(m, CONTENT).select(*CHANGE, "kafka_partition", "kafka_offset", "kafka_ts", "content_hash")
    return materialize(slim, "changes")


def _next_run(spark: SparkSession, d: str) -> DataFrame:
    """New and changed against the state that the committed attempts left."""
    current = _hashed(spark, d)
    done = incremental.committed_ranges(read_table(spark, d, "sync_runs"))
    processed = incremental.mark_covered(current, done, ["topic", "kafka_partition"], "kafka_offset").where("covered")
    state = incremental.HashState(spark, fresh_path(spark, "state"), STATE_COLUMNS)
    state.swap(processed.select(*CHANGE, "content_hash").distinct())
    return incremental.select_new(current, state.read(), CHANGE)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct change that no committed attempt has processed, against a persisted state; one that was processed with another content isn't among them."""
    return _next_run(spark, d).where("change_kind = 'new'").select(*CHANGE).distinct()


def p5_changed(spark: SparkSession, d: str) -> DataFrame:
    """Changes that were processed, and have come again with another content (texts as they are, so another order of members is another content)."""
    return _next_run(spark, d).where("change_kind = 'changed'").groupBy("topic").agg(F.count("*").alias("contents"), F.count_distinct("row_id", "lsn").alias("changes"))


def p5_rerun(spark: SparkSession, d: str) -> DataFrame:
    """Three runs over one state: over the frames of half the partitions, then over all, then over all again; what each selected.

    The second run's first try fails before its state is in force, and is made again.
    """
    current = _hashed(spark, d)
    state = incremental.HashState(spark, fresh_path(spark, "state"), STATE_COLUMNS)
    picked = []
    for i, rows in enumerate((current.where("kafka_partition % 2 = 0"), current, current, current)):
        new, done = incremental.run_hashed(rows, state, CHANGE)
        if i != 1:  # the run that fails
            done()
            picked.append(new.groupBy("change_kind").agg(F.count("*").alias("contents")).withColumn("run", F.lit(len(picked) + 1)))
    return picked[0].unionByName(picked[1]).unionByName(picked[2])


def _objects(spark: SparkSession, d: str, values: bool = True, every: bool = False) -> DataFrame:
    t = read_table(spark, d, "doc_messages")
    return nested.shred(spread(t.select("rec_id", "msg_value"), t), "rec_id", "msg_value", values=values, every=every)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each object, of any variant, that is an element of a list, with the nearest such object around it."""
    return _objects(spark, d, values=False).where("variant is not null").select("rec_id", "parent_path", "child_path")


def p1_objects(spark: SparkSession, d: str) -> DataFrame:
    """Each object, the record and lone ones included, with the object around it, its scalars and its lists of scalars."""
    as_json = [F.to_json(c).alias(c) for c in ("members", "lists")]
    return _objects(spark, d, every=True).select("rec_id", "parent_path", "child_path", "member_path", "variant", *as_json)


def _by_signature(variants: DataFrame) -> DataFrame:
    """Variants added up by what their own members are, in the order of names."""
    members = F.array_sort(F.transform(F.map_entries(F.from_json("signature", "map<string,string>")), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return variants.groupBy("member_path", F.array_join(members, ",").alias("members")).agg(F.sum("objects").alias("objects"))


def p1_variants(spark: SparkSession, d: str) -> DataFrame:
    """The structural variants of each member, and how many objects have them."""
    return _by_signature(nested.variants(_objects(spark, d, values=False)))


def p1_subtypes(spark: SparkSession, d: str) -> DataFrame:
    """The same, counted in the typed table that each variant was sent to."""
    objects = _objects(spark, d)
    path = fresh_path(spark, "subtypes")
    listed = nested.route(objects, path).select("member_path", F.concat(F.lit("m"), F.md5("member_path")).alias("member"))
    stored = spark.read.schema("misfit string, member string, variant string").parquet(f"{path}/tables").groupBy("member", "variant").agg(F.count("*").alias("objects"))
    signatures = spark.read.schema(f"{nested.OBJECTS}, member string").parquet(f"{path}/objects").groupBy("member", "variant").agg(F.min("signature").alias("signature"))
    return _by_signature(stored.join(signatures, ["member", "variant"]).join(listed, "member"))


def p1_rejects(spark: SparkSession, d: str) -> DataFrame:
    """Records that can't be read, and why."""
    return nested.rejects(read_table(spark, d, "doc_messages"), "rec_id", "msg_value").select("rec_id", "reason")


def p1_order_lines(spark: SparkSession, d: str) -> DataFrame:
    """The typed rows of order lines, of all their variants."""
    return nested.subtype_table(_objects(spark, d), "payload.after.orders.lines", {"sku": "string", "qty": "bigint"}).drop("misfit", "variant", "lists")


def p1_tables(spark: SparkSession, d: str) -> DataFrame:
    """The typed subtype table of every member, written to the shared folder: its place, fields, variants and rows."""
    return nested.route(_objects(spark, d, every=True), fresh_path(spark, "subtypes"))


def _feed(spark: SparkSession, d: str) -> DataFrame:
    """The feeds' records, parsed and written once."""
    t = read_table(spark, d, "feed_records").select("feed", "file_no", "rec_id", "written_at", "rec_value")
    return materialize(drift.parse_feed(t), "feed")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Each change of a feed's schema from one file to the next."""
    return drift.changes_of(_feed(spark, d))


def p3_table(spark: SparkSession, d: str) -> DataFrame:
    """All records under their feed's last schema, as JSON, with what it can't hold rescued."""
    parsed = _feed(spark, d)
    rows = drift.consistent(parsed, drift.changes_of(parsed))
    return rows.withColumn("row", F.to_json(F.map_from_entries(F.array_sort(F.map_entries("row")))))
