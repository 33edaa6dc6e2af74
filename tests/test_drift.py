import json
from datetime import datetime

from changeflow.operators import drift

T0 = datetime(2025, 1, 1)
FEED = "rec_id bigint, feed string, file_no int, file_name string, written_at timestamp_ntz, rec_value string"


class Feed:
    def __init__(self, name="f"):
        self.rows, self.name = [], name

    def add(self, no, fields, *rows, wrapped=True, **more):
        for r in rows:
            f = None if fields is None else [{"field": k, "type": t} for k, t in fields.items()]
            if wrapped:
                v = {"schema": f and {"fields": [{"field": "before", "type": "struct", "fields": f}, {"field": "after", "type": "struct", "fields": f}]}, "payload": {"after": r}}
            else:
                v = {"schema": f and {"fields": f}, "payload": r}
            self.rows.append((len(self.rows), self.name, no, f"x{no}", T0, json.dumps({**v, **more})))
        return self

    def df(self, spark):
        return spark.createDataFrame(self.rows, FEED)


def changes(spark, feed):
    return sorted(tuple(r)[1:] for r in drift.schema_changes(feed.df(spark)).collect())


def row(i, **v):
    return {"id": i, **v}


def test_kinds_of_changes(spark):
    f = Feed()
    f.add(1, {"id": "int64", "a": "string", "b": "int32", "gone": "double"}, *[row(i, a=f"v{i}", b=i, gone=i / 2) for i in range(5)])
    f.add(2, {"ID": "int64", "B": "string", "renamed_a": "string", "new": "double"}, *[row(i, renamed_a=f"v{i}", B=str(i), new=7.5) for i in range(5)])
    assert changes(spark, f) == [(2, "added", "", "new"), (2, "removed", "gone", ""), (2, "renamed", "a", "renamed_a"), (2, "retyped", "b", "b")]


def test_a_rename_needs_the_values_and_the_type(spark):
    f = Feed()
    f.add(1, {"id": "int64", "a": "string", "c": "int32"}, *[row(i, a=f"v{i}", c=i) for i in range(5)])
    f.add(2, {"id": "int64", "x": "string", "d": "int64"}, *[row(i, x=f"w{i}", d=i) for i in range(5)])
    assert [c[1] for c in changes(spark, f)] == ["added", "added", "removed", "removed"]
    g = Feed().add(1, {"id": "int64", "a": "string"}, row(1, a="v")).add(2, {"id": "int64", "b": "string"}, row(2, b="v"))
    assert [c[1] for c in changes(spark, g)] == ["added", "removed"]


def test_most_records_tell_the_schema_and_files_without_are_passed_over(spark):
    old, new = {"id": "int64"}, {"id": "int64", "a": "string"}
    f = Feed().add(1, old, row(1), row(2)).add(2, None, row(3)).add(4, old, row(1)).add(4, new, row(2, a="x"), row(3, a="y")).add(4, None, row(5))
    f.rows += [(90, "f", 4, "x4", T0, None), (91, "f", 4, "x4", T0, "{"), (92, "f", 4, "x4", T0, "[]")]
    assert changes(spark, f) == [(4, "added", "", "a")]


def test_unwrapped_feeds_versions_and_case(spark):
    f = Feed().add(1, {"id": "int64", "a": "string"}, row(1, a="x"), wrapped=False).add(2, {"A": "string", "id": "int64"}, row(1, A="x"), wrapped=False)
    assert changes(spark, f) == []
    f.add(3, {"id": "int64", "b": "string"}, row(1, b="x"), wrapped=False)
    assert changes(spark, f) == [(3, "renamed", "a", "b")]
    assert changes(spark, Feed()) == []


def test_best_pair_wins(spark):
    f = Feed()
    f.add(1, {"id": "int64", "a": "string", "b": "string"}, *[row(i, a=f"a{i}", b="k" if i else "z") for i in range(5)])
    f.add(2, {"id": "int64", "x": "string", "y": "string"}, *[row(i, x="k", y=f"a{i}") for i in range(5)])
    assert changes(spark, f) == [(2, "renamed", "a", "y"), (2, "renamed", "b", "x")]


def test_one_consistent_table_with_rescued_values(spark):
    f = Feed()
    f.add(1, {"id": "int64", "a": "string", "n": "string", "dropped": "int32"}, *[row(i, a=f"v{i}", n="12" if i else "twelve", dropped=1) for i in range(4)])
    f.add(2, {"id": "int64", "b": "string", "n": "int32"}, *[row(i, b=f"v{i}", n=12) for i in range(4)])
    df = f.df(spark)
    out = {(r.file_no, r.rec_id): r for r in drift.consistent_rows(df, drift.schema_changes(df)).collect()}
    assert len(out) == 8
    assert out[1, 1].row == {"id": "1", "b": "v1", "n": "12"} and json.loads(out[1, 1].rescued) == {"dropped": "1"}
    assert out[1, 0].row == {"id": "0", "b": "v0"} and json.loads(out[1, 0].rescued) == {"dropped": "1", "n": "twelve"}
    assert out[2, 4].row == {"id": "0", "b": "v0", "n": "12"} and out[2, 4].rescued is None


def test_nulls_repeats_and_long_values(spark):
    f = Feed().add(1, {"id": "int64", "a": "string"}, row(1, a="x" * 100_000)).add(2, {"id": "int64", "b": "string"}, row(1, b="x" * 100_000), row(1, b="x" * 100_000))
    f.rows += [(50, None, 1, "x", T0, f.rows[0][5]), (51, "f", None, "x", T0, f.rows[0][5]), (None, "f", 1, "x", None, None)]
    df = f.df(spark).selectExpr("*", "'clash' as fields", "1 as row", "'x' as target")
    assert sorted(tuple(r)[1:] for r in drift.schema_changes(df).where("file_no = 2").collect()) == [(2, "renamed", "a", "b")]
    out = drift.consistent_rows(df, drift.schema_changes(df)).collect()
    assert len(out) == 6
    alone = next(r for r in out if r.feed is None)
    assert alone.row == {} and json.loads(alone.rescued) == {"id": "1", "a": "x" * 100_000}
    assert next(r for r in out if r.rec_id is None).row is None
