import random

import pytest
from changeflow.operators import batch, dedupe, fold, merge
from changeflow.sources.frames import UNAVAILABLE as PH

D, O = "__cf_delete", "__cf_only_set_delete"


def model(events):
    """The keyed fold, one event after the other: (row, deleted, only deletes)."""
    net = None
    for op, row in events:
        gone = op == "d"
        if net is None:
            net = (dict(row), gone, gone)
        elif gone:
            old, _, only = net
            net = ({**row, **old}, True, only)
        else:
            old = net[0]
            net = ({k: old[k] if v == PH and k in old else v for k, v in row.items()}, False, False)
    return net


def sequences(seed, full):
    r = random.Random(seed)
    for key in range(150):
        events = []
        for _ in range(r.randint(1, 7)):
            op = r.choice("cuudd")
            names = "abc" if full else [c for c in "abc" if r.random() < 0.7]
            row = {c: r.choice([PH, None, "1", "2", "3"] if op != "d" or not full else [None, "7", "8"]) for c in names}
            events.append((op, row))
        yield key, events


def test_fast_fold_is_the_model(spark):
    data = dict(sequences(1, True))
    rows = [(k, i, op, row["a"], row["b"], row["c"]) for k, ev in data.items() for i, (op, row) in enumerate(ev)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows + rows[:50], "k int, seq bigint, op string, a string, b string, c string")
    got = {r.k: r for r in fold.fold(df, ["k"], ["seq"], "op", ["a", "b", "c"]).collect()}
    for k, ev in data.items():
        row, gone, only = model(ev)
        assert ({c: got[k][c] for c in "abc"}, got[k][D], got[k][O]) == (row, gone, only), (k, ev)


@pytest.mark.parametrize("run", [1, 3, 1000])
def test_exact_fold_is_the_model(spark, run):
    data = dict(sequences(2, False))
    rows = [(k, i, op, row) for k, ev in data.items() for i, (op, row) in enumerate(ev)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, seq bigint, op string, row map<string,string>")
    got = {r.k: r for r in fold.fold_maps(df, ["k"], "seq", "op", "row", run=run).collect()}
    assert len(got) == len(data)
    for k, ev in data.items():
        row, gone, only = model(ev)
        assert (got[k].row, got[k][D], got[k][O]) == (row, gone, only), (k, ev)


FEED = "k int, seq bigint, op string, v string"


def folded(spark, rows):
    return fold.fold(spark.createDataFrame(rows, FEED), ["k"], ["seq"], "op", ["v"]).drop("seq")


def test_fold_of_null_keys_and_an_empty_table(spark):
    got = folded(spark, [(None, 1, "c", "x"), (None, 2, "u", None), (1, 1, None, "y")]).collect()
    assert {r.k: (r.v, r[D]) for r in got} == {None: (None, False), 1: ("y", False)}
    assert folded(spark, []).count() == 0


@pytest.fixture(scope="module")
def target(spark):
    return spark.createDataFrame([(i, f"t{i}") for i in range(10)], "k int, v string")


def table(df):
    return sorted((r.k if r.k is not None else -1, r.v) for r in df.collect())


def test_hard_merge(spark, target):
    s = folded(spark, [(1, 1, "u", "new"), (2, 1, "d", "x"), (20, 1, "c", "in"), (21, 1, "d", "x"), (3, 1, "u", PH), (4, 1, "u", None), (22, 1, "c", PH)])
    got = table(merge.merge(target, s, ["k"], placeholder_columns=["v"]))
    assert got == sorted([(0, "t0"), (1, "new"), (3, "t3"), (4, None), *[(i, f"t{i}") for i in range(5, 10)], (20, "in"), (22, PH)])
    once = merge.merge(target, s, ["k"], placeholder_columns=["v"])
    assert table(merge.merge(once, s, ["k"], placeholder_columns=["v"])) == got
    c = merge.merge_counts(target, s, ["k"]).first()
    assert (c.staged, c.matched, c.inserted, c.deleted, c.unavailable) == (7, 4, 2, 1, 1)


def test_soft_merge(spark, target):
    from pyspark.sql import functions as F

    t = target.withColumn(D, F.lit(False))
    s = folded(spark, [(1, 1, "d", "zero"), (2, 1, "u", "u2"), (2, 2, "d", "zero"), (20, 1, "d", "gone")])
    got = {r.k: (r.v, r[D]) for r in merge.merge(t, s, ["k"], soft_delete=True).collect()}
    assert (got[1], got[2], got[20], got[0]) == (("t1", True), ("u2", True), ("gone", True), ("t0", False)) and len(got) == 11


def test_split_batches_give_the_same_table(spark, target):
    r = random.Random(4)
    rows = [(r.randrange(15), i, r.choice("cuud"), r.choice(["a", "b", None])) for i in range(60)]
    whole = table(merge.merge(target, folded(spark, rows), ["k"]))
    first = merge.merge(target, folded(spark, rows[:30]), ["k"])
    assert table(merge.merge(first, folded(spark, rows[30:]), ["k"])) == whole
    pending = merge.upsert_staging(folded(spark, rows[:30]), folded(spark, rows[30:]), ["k"])
    assert table(merge.merge(target, pending, ["k"])) == whole


def test_split_form_is_the_merge(spark, target):
    s = folded(spark, [(1, 1, "u", "new"), (2, 1, "d", "x"), (20, 1, "c", "in"), (21, 1, "d", "x")])
    updated = merge.split_update(target, s, ["k"])
    rest = merge.split_delete(target, s, ["k"]).join(updated.select("k"), "k", "left_anti")
    assert table(rest.union(updated).union(merge.split_insert(target, s, ["k"]).select("k", "v"))) == table(merge.merge(target, s, ["k"]))


def test_null_keys_match_only_if_asked(spark):
    t = spark.createDataFrame([(None, "t")], "k int, v string")
    s = folded(spark, [(None, 1, "u", "s")])
    assert table(merge.merge(t, s, ["k"])) == [(-1, "s"), (-1, "t")]
    assert table(merge.merge(t, s, ["k"], null_safe=True)) == [(-1, "s")]
    assert table(merge.merge(t.limit(0), s, ["k"])) == [(-1, "s")]
    assert table(merge.merge(t, s.limit(0), ["k"])) == [(-1, "t")]


def test_pruned_merge_is_the_merge_whatever_the_dates(spark, monkeypatch):
    t = spark.sql("select * from values (0, date'2025-01-09', 't'), (1, date'2025-01-01', 't'), (2, date'2025-01-02', 't'), (3, cast(null as date), 't'), (4, date'2025-01-07', 't') x(k, day, v)")
    rows = lambda df: sorted((r.k, str(r.day), r.v) for r in df.collect())
    for staged in (
        "(1, date'2025-01-05', 's', false), (2, date'2025-01-02', 's', false), (4, date'2025-01-07', 's', true)", "(3, date'2025-01-03', 's', false), (9, cast(null as date), 's', false)",
        "(3, cast(null as date), 's', true)", "(8, date'2025-01-01', 's', true)",
    ):
        s = spark.sql(f"select *, {D} as {O} from values {staged} x(k, day, v, {D})")
        whole = rows(merge.merge(t, s, ["k"]))
        assert len({k for k, _, _ in whole}) == len(whole)
        for most in (1_000, 1, 0):
            monkeypatch.setattr(merge, "MOST_DATES", most)
            assert rows(merge.merge_pruned(t, s, ["k"], "day")) == whole, (staged, most)
            assert rows(merge.merge_pruned(t.limit(0), s, ["k"], "day")) == rows(merge.merge(t.limit(0), s, ["k"]))
    monkeypatch.undo()
    assert merge.batch_dates(t, "day")[0] is None and merge.batch_dates(t.limit(0), "day") == []


def test_staging_keeps_columns_of_either_side(spark):
    a = folded(spark, [(1, 1, "u", "x"), (2, 1, "u", "y")])
    from pyspark.sql import functions as F

    wide = folded(spark, [(2, 2, "u", "z"), (3, 1, "u", "w")]).withColumn("extra", F.lit("e"))
    got = {r.k: (r.v, r.extra) for r in merge.upsert_staging(a, wide, ["k"]).collect()}
    assert got == {1: ("x", None), 2: ("z", "e"), 3: ("w", "e")}
    back = {r.k: (r.v, r.extra) for r in merge.upsert_staging(wide, a, ["k"]).collect()}
    assert back == {1: ("x", None), 2: ("y", "e"), 3: ("w", "e")}


def test_the_assertion_finds_what_a_merge_lost_or_left(spark, target):
    s = folded(spark, [(1, 1, "u", "new"), (2, 1, "d", "x"), (20, 1, "c", "in"), (21, 1, "d", "x")])
    good = merge.merge(target, s, ["k"])
    assert merge.unmerged(good, s, ["k"]).count() == 0
    assert sorted((r.k, r.problem) for r in merge.unmerged(target, s, ["k"]).collect()) == [(2, "not deleted"), (20, "lost")]
    with pytest.raises(merge.MergeError, match="lost"):
        merge.assert_merged(good.where("k <> 20"), s, ["k"])


def test_dedupe(spark):
    rows = [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "d"), (2, 2, "e"), (3, 1, "f"), (None, 1, "g"), (None, 2, "h"), (4, 1, None), (4, 1, None)]
    df = spark.createDataFrame(rows, "k int, at int, v string")
    got = lambda d: sorted((r.k if r.k is not None else -1, r.v or "") for r in d.collect())
    assert got(dedupe.dedupe(df, ["k"], ["at"])) == [(-1, "h"), (1, "c"), (2, "e"), (3, "f"), (4, "")]
    for slices in (1, 64):
        assert got(dedupe.dedupe(df, ["k"], ["at"], "second", slices)) == [(-1, "h"), (1, "b"), (2, "e"), (3, "f"), (4, "")]
    assert got(dedupe.dedupe_by_identity(df, ["k"], "at")) == [(-1, "h"), (1, "c"), (2, "e"), (3, "f"), (4, "")]
    assert dedupe.dedupe_by_identity(df, ["k"]).count() == 5
    assert dedupe.dedupe(df.limit(0), ["k"], ["at"]).count() == 0


def test_batches_by_bytes(spark):
    assert list(batch.greedy([3, 3, 4, 1, 11, 9, 1, 1], 10)) == [0, 0, 0, 1, None, 1, 2, 2]
    with pytest.raises(ValueError):
        list(batch.greedy([11], 10, fail=True))
    df = spark.createDataFrame([("a", i, "x" * n) for i, n in enumerate([3, 3, 4, 1, 11, 9, 1])] + [("b", 0, None)], "g string, i int, p string")
    got = {(r.g, r.i): r.batch_no for r in batch.batch_by_bytes(df, ["g"], ["i"], "p", 10).collect()}
    assert [got["a", i] for i in range(7)] == [0, 0, 0, 1, None, 1, 2] and got["b", 0] == 0
