"""Problem 3: schemas that drift between files, by rescue-column ingestion.

A file is read against the target schema in force, that of the feed's file before
it. Fields that the target knows, of the type it has, are enforced; what it doesn't
know, or has in another type, is rescued as JSON. The rescued fields are the
candidates for promotion: a field that replays into a column which the file left
empty, giving the values that the same records had there, is that column under a
new name; any other becomes a column of its own. Replaying the rescued values of
every promoted field makes one consistent table of all files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import materialize

_FIELD = "STRUCT<field: STRING, type: STRING, fields: ARRAY<STRUCT<field: STRING, type: STRING>>>"
_RECORD = f"`schema` STRUCT<fields: ARRAY<{_FIELD}>>, payload STRING"


def _lower_names(entries: Column) -> Column:
    """Entries of (key, value) with lower-cased keys."""
    return F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))


def _to_map(entries: str) -> Column:
    """A map of a column of entries; of entries with one key the first counts. Such are rare, and looked for only where there are any."""
    e = F.col(entries)
    keys = F.transform(e, lambda x: x["key"])
    first = F.filter(e, lambda x, i: F.array_position(keys, x["key"]) == i + 1)
    return F.when(F.size(F.array_distinct(keys)) == F.size(e), F.map_from_entries(e)).otherwise(F.map_from_entries(first))


def parse_feed(records: DataFrame) -> DataFrame:
    """Records with their own schema and values: ``feed, file_no, rec_id, written_at, fields, row``.

    ``fields``: map of lower-cased column name to type, null for a record without schema;
    ``row``: map of lower-cased name to the value's JSON text (JSON null: null), null
    where the record has no values. Columns are the fields of the member ``after``, or
    ``schema.fields`` themselves. Null or unreadable values give nulls for both.
    """
    keys = ["feed", "file_no", "rec_id", "written_at"]
    # Lists of one that are exploded keep what they hold from being worked out again in every use.
    held = lambda df, **cols: df.select(*[c for c in df.columns], F.explode(F.array(F.struct(*[v.alias(n) for n, v in cols.items()]))).alias("_h"))
    df = held(records.select(*keys, "rec_value"), j=F.from_json("rec_value", _RECORD)).select(*keys, F.col("_h.j").alias("j"))
    fields, payload = F.col("j.schema.fields"), F.col("j.payload")
    df = held(df, after=F.filter(fields, lambda f: (f["field"] == "after") & f["fields"].isNotNull()), inner=F.get_json_object(payload, "$.after")).withColumnRenamed("_h", "_a")
    wrapped = F.size("_a.after") > 0
    columns = F.when(wrapped, F.col("_a.after")[0]["fields"]).otherwise(F.transform(fields, lambda f: F.struct(f["field"].alias("field"), f["type"].alias("type"))))
    named = F.transform(F.filter(columns, lambda f: f["field"].isNotNull()), lambda f: F.struct(f["field"].alias("key"), F.coalesce(f["type"], F.lit("")).alias("value")))
    body = F.when(wrapped | (fields.isNull() & F.col("_a.inner").startswith("{")), F.col("_a.inner")).otherwise(payload)
    df = held(df, f=_lower_names(named), r=_lower_names(F.map_entries(F.from_json(body, "map<string,string>")))).select(*keys, F.col("_h.f").alias("f"), F.col("_h.r").alias("r"))
    return df.select(*keys, _to_map("f").alias("fields"), _to_map("r").alias("row"))


def file_schemas(parsed: DataFrame) -> DataFrame:
    """Each file's schema, that of most of its records: ``feed, file_no, fields, prev_no, target``.

    Of schemas with equally many records the one whose last record has the higher id
    counts. A file in which no record has a schema has none and is passed over.
    ``target``: the schema of the feed's preceding file, null for the first.
    """
    entries = F.array_sort(F.map_entries("fields"))
    by = parsed.where("fields is not null").groupBy("feed", "file_no", entries.alias("e")).agg(F.count("*").alias("n"), F.max("rec_id").alias("last"))
    top = by.groupBy("feed", "file_no").agg(F.max_by("e", F.struct("n", "last")).alias("e"))
    w = Window.partitionBy("feed").orderBy("file_no")
    return top.select(
        "feed", "file_no", F.map_from_entries("e").alias("fields"),
        F.lag("file_no").over(w).alias("prev_no"), F.map_from_entries(F.lag("e").over(w)).alias("target"),
    )


def enforce(schema: Column, target: Column) -> dict[str, Column]:
    """What a target schema makes of a file's: ``kept``, ``rescued`` (unknown), ``uncastable`` (other type), ``empty`` (columns left out)."""
    names, known = F.map_keys(schema), F.map_keys(target)
    both = F.array_intersect(names, known)
    same = lambda n: schema[n] == target[n]
    return {
        "kept": F.filter(both, same), "uncastable": F.filter(both, lambda n: ~same(n)),
        "rescued": F.array_except(names, known), "empty": F.array_except(known, names),
    }


def rescue(row: Column, schema: Column, target: Column) -> tuple[Column, Column]:
    """(values under the target, rescued values): maps; a value whose declared type isn't the target's is rescued."""
    fits = lambda n: F.coalesce(target[n] == schema[n], F.lit(False))
    return F.map_filter(row, lambda n, _: fits(n)), F.map_filter(row, lambda n, _: ~fits(n))


def schema_changes(records: DataFrame, record_key: str = "id", keep: float = 0.5) -> DataFrame:
    """Every difference between a file's schema and the preceding file's: ``feed, file_no, change_kind, field_from, field_to``.

    ``added``, ``removed``, ``renamed``, ``retyped``. Renamed: the rescued field, replayed
    into an emptied column of its type, gives back more than ``keep`` of the values that
    records with the same ``record_key`` had there (records that have a value on either
    side count; without such a record nothing shows a rename). Among several fits the
    best share wins, then the order of names.
    """
    return changes_of(parse_feed(records), record_key, keep)


def changes_of(parsed: DataFrame, record_key: str = "id", keep: float = 0.5) -> DataFrame:
    """:func:`schema_changes` of records parsed before; they are read four times, so a written table serves best."""
    files = materialize(file_schemas(parsed).where("target is not null"), "files")
    parts = enforce(F.col("fields"), F.col("target"))
    diff = files.select("feed", "file_no", "prev_no", "fields", "target", *[c.alias(n) for n, c in parts.items() if n != "kept"])
    renames = _renames(parsed, diff, record_key, keep)
    moved = renames.groupBy("feed", "file_no").agg(F.collect_list("field_from").alias("gone"), F.collect_list("field_to").alias("come"), F.collect_list(F.struct(F.lit("renamed").alias("change_kind"), "field_from", "field_to")).alias("pairs"))
    line = lambda kind, a, b: F.struct(F.lit(kind).alias("change_kind"), a.alias("field_from"), b.alias("field_to"))
    none = F.array().cast("array<string>")
    every = F.concat(
        F.transform(F.array_except("rescued", F.coalesce("come", none)), lambda n: line("added", F.lit(""), n)),
        F.transform(F.array_except("empty", F.coalesce("gone", none)), lambda n: line("removed", n, F.lit(""))),
        F.transform("uncastable", lambda n: line("retyped", n, n)),
        F.coalesce("pairs", F.array().cast("array<struct<change_kind:string,field_from:string,field_to:string>>")),
    )
    return diff.join(moved, ["feed", "file_no"], "left").select("feed", "file_no", F.explode(every).alias("c")).select("feed", "file_no", "c.change_kind", "c.field_from", "c.field_to")


def _renames(parsed: DataFrame, diff: DataFrame, record_key: str, keep: float) -> DataFrame:
    pairs = F.flatten(F.transform("empty", lambda a: F.transform(F.filter("rescued", lambda b: F.col("fields")[b] == F.col("target")[a]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    open_ = diff.select("feed", "file_no", "prev_no", "fields", "target", pairs.alias("pairs")).where(F.size("pairs") > 0)
    key = F.trim(F.col("row")[record_key], ).alias("key")
    # One record of a key in a file: that written last, with a schema before one without.
    one = parsed.where(F.col("row")[record_key].isNotNull()).groupBy("feed", "file_no", key).agg(F.max_by("row", F.struct(F.col("fields").isNotNull(), F.size("row"), "written_at", "rec_id")).alias("row"))
    now = one.join(open_, ["feed", "file_no"]).select("feed", "file_no", "key", "pairs", rescue(F.col("row"), F.col("fields"), F.col("target"))[1].alias("rescued_row"))
    before = one.withColumnRenamed("file_no", "prev_no").join(open_.select("feed", "file_no", "prev_no"), ["feed", "prev_no"]).select("feed", "file_no", "key", F.col("row").alias("old"))
    # Read twice: once for all pairs, once for the few that may be renames.
    both = materialize(now.join(before, ["feed", "file_no", "key"]).select("feed", "file_no", "pairs", "old", "rescued_row"), "replayed")
    # A record gives a row for each pair whose values are equal, and one for each value it has on either side; not for all pairs.
    was, replayed = (lambda p: F.col("old")[p["a"]]), (lambda p: F.col("rescued_row")[p["b"]])
    nothing = F.lit(None).cast("string")
    alike = F.transform(F.filter("pairs", lambda p: F.coalesce(was(p) == replayed(p), F.lit(False))), lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b")))
    left = F.transform(F.filter(F.array_distinct(F.transform("pairs", lambda p: p["a"])), lambda a: F.col("old")[a].isNotNull()), lambda a: F.struct(a.alias("a"), nothing.alias("b")))
    right = F.transform(F.filter(F.array_distinct(F.transform("pairs", lambda p: p["b"])), lambda b: F.col("rescued_row")[b].isNotNull()), lambda b: F.struct(nothing.alias("a"), b.alias("b")))
    n = both.select("feed", "file_no", F.explode(F.concat(alike, left, right)).alias("p")).groupBy("feed", "file_no", "p.a", "p.b").agg(F.count("*").alias("n"))
    file = ["feed", "file_no"]
    # Records with a value on either side are at least as many as those with one on the more frequent: the share can't be above keep for other pairs.
    likely = (
        n.where("a is not null and b is not null").withColumnRenamed("n", "same")
        .join(n.where("b is null").select(*file, "a", F.col("n").alias("n_a")), [*file, "a"]).join(n.where("a is null").select(*file, "b", F.col("n").alias("n_b")), [*file, "b"])
        .where(F.col("same") > keep * F.greatest("n_a", "n_b"))
    )
    picked = likely.groupBy(*file).agg(F.collect_list(F.struct("a", "b", "same", "n_a", "n_b")).alias("likely"))
    counted = (
        both.join(picked, file).select(*file, F.explode("likely").alias("p"), (F.col("old")[F.col("p.a")].isNotNull() & F.col("rescued_row")[F.col("p.b")].isNotNull()).cast("int").alias("both"))
        .groupBy(*file, F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg((F.max("p.same") / (F.max("p.n_a") + F.max("p.n_b") - F.sum("both"))).alias("share"))
    )
    return best_matches(counted.where(F.col("share") > keep))


def best_matches(score: DataFrame) -> DataFrame:
    """One-to-one pairs of each file, the best share first: a pair counts if no better one has either name."""
    by_file = score.groupBy("feed", "file_no").agg(F.array_sort(F.collect_list(F.struct((-F.col("share")).alias("s"), "a", "b"))).alias("l"))
    empty = F.array().cast("array<struct<s:double,a:string,b:string>>")
    taken = F.aggregate("l", empty, lambda acc, x: F.when(F.exists(acc, lambda t: (t["a"] == x["a"]) | (t["b"] == x["b"])), acc).otherwise(F.concat(acc, F.array(x))))
    return by_file.select("feed", "file_no", F.explode(taken).alias("m")).select("feed", "file_no", F.col("m.a").alias("field_from"), F.col("m.b").alias("field_to"))


def promoted_names(files: DataFrame, changes: DataFrame) -> DataFrame:
    """For each feed: its last schema (``final``) and, by old name, the file and the name it went over to (``moves``)."""
    last = files.groupBy("feed").agg(F.max_by("fields", "file_no").alias("final"))
    moves = changes.where("change_kind = 'renamed'").groupBy("feed").agg(F.array_sort(F.collect_list(F.struct("file_no", "field_from", "field_to"))).alias("moves"))
    return last.join(moves, "feed", "left").select("feed", "final", F.coalesce("moves", F.array().cast("array<struct<file_no:int,field_from:string,field_to:string>>")).alias("moves"))


#: Spark type that a declared type is checked against.
CASTS = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float": "float", "float32": "float", "double": "double", "float64": "double", "boolean": "boolean"}


def consistent_rows(records: DataFrame, changes: DataFrame) -> DataFrame:
    """Every record under its feed's last schema: ``feed, file_no, rec_id, row, rescued``.

    ``row``: values by the last names, renamed fields replayed under them; ``rescued``:
    JSON of the values that the last schema has no column for or whose text its type
    can't take; null if none. A record without values has a null ``row``.
    """
    return consistent(parse_feed(records), changes)


def consistent(parsed: DataFrame, changes: DataFrame) -> DataFrame:
    """:func:`consistent_rows` of records parsed before."""
    names = promoted_names(file_schemas(parsed), changes)
    # A feed without a name, or without any schema, has no columns: all its values are rescued.
    none = {"final": F.create_map().cast("map<string,string>"), "moves": F.array().cast("array<struct<file_no:int,field_from:string,field_to:string>>")}
    df = parsed.join(names, "feed", "left").withColumns({c: F.coalesce(c, v) for c, v in none.items()})
    step = lambda at, m: F.when((m["file_no"] > F.col("file_no")) & (m["field_from"] == at), m["field_to"]).otherwise(at)
    over = F.transform(F.map_entries("row"), lambda e: F.struct(F.aggregate("moves", e["key"], step).alias("key"), e["value"].alias("value")))
    df = df.withColumn("_over", over).withColumn("_all", _to_map("_over"))

    def fits(n: Column, v: Column) -> Column:
        t = F.col("final")[n]
        ok = t.isNotNull()
        for kind, cast in CASTS.items():
            ok = ok & ((t != kind) | v.isNull() | v.try_cast(cast).isNotNull())
        return F.coalesce(ok, F.lit(False))

    left = F.map_filter("_all", lambda n, v: ~fits(n, v))
    return df.select(
        "feed", "file_no", "rec_id", F.map_filter("_all", fits).alias("row"), F.when(F.size(left) > 0, F.to_json(left)).alias("rescued")
    )
