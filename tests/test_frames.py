import json
from datetime import datetime, timedelta

import pytest
from changeflow.operators import incremental, once, patches
from changeflow.sources import frames
from pyspark.sql import functions as F

T0 = datetime(2025, 1, 1)
FRAMES = "topic string, kafka_partition int, kafka_offset bigint, kafka_ts timestamp_ntz, msg_key binary, msg_value binary"


def message(id_=1, pos=10, op="u", before=None, sequence="", **after):
    row = None if op == "d" else {"id": id_, **after}
    seq = json.dumps([None, str(pos)]) if sequence == "" else sequence
    return json.dumps({"payload": {"before": before, "after": row, "op": op, "source": {"db": "d", "schema": "s", "table": "t", "ts_ms": 1, "sequence": seq, "lsn": None}}}).encode()


def frame(value, offset=0, key=None, partition=0, ts=T0):
    return ("d.s.t", partition, offset, ts, key, value)


def test_only_complete_json_is_a_message(spark):
    whole = message()
    rows = [frame(v, i) for i, v in enumerate([whole, None, b"", b"   ", whole[:-1], whole[: len(whole) // 2], b"[1]", b'"x"', whole + b" "])]
    got = frames.parse_messages(spark.createDataFrame(rows, FRAMES))
    assert sorted(r.kafka_offset for r in got.collect()) == [0, 8]


@pytest.mark.parametrize(
    ("key", "id_"),
    [(b'{"id": 7}', 7), (b'{"schema":{},"payload":{"id":7.0}}', 7), (b"Struct{id=7}", 7), (b"Struct{a=1,id=7}", 7), (b"", None), (None, None), (b"{", None)],
)
def test_key_forms(spark, key, id_):
    value = message(op="d")
    got = frames.parse_messages(spark.createDataFrame([frame(value, key=key)], FRAMES)).first()
    assert got.row_id == id_


@pytest.mark.parametrize(("text", "n"), [("7", 7), ("7.0", 7), (" 7 ", 7), ("7e0", 7), ("1E3", 1000), ("7.5", None), ("x", None), (None, None), ("", None), ("9223372036854775807", 2**63 - 1), ("99999999999999999999", None)])
def test_whole_numbers(spark, text, n):
    assert spark.createDataFrame([(text,)], "a string").select(frames.whole_number(F.col("a")).alias("n")).first().n == n


def test_parsed_frames_of_an_empty_table(spark):
    assert frames.parse_messages(spark.createDataFrame([], FRAMES)).count() == 0


IDS = "producer string, n bigint, text string, at bigint, part int"


def repeats(spark, rows, seen=None, **kw):
    df = spark.createDataFrame(rows, IDS)
    return sorted((r.at for r in once.mark_repeats(df, ["producer"], "n", "text", ["at", "part"], seen, **kw).where("is_repeat").collect()))


def test_one_copy_of_each_number_is_kept(spark):
    rows = [("a", 5, None, 3, 0), ("a", 5, None, 1, 0), ("a", 5, None, 2, 0), ("b", 5, None, 4, 0), ("a", 6, None, 9, 0)]
    assert repeats(spark, rows) == [2, 3]
    assert repeats(spark, rows, salts=1) == [2, 3]
    assert repeats(spark, rows, block_bits=1) == [2, 3]


def test_malformed_numbers_are_looked_up_by_text(spark):
    rows = [("a", None, "x", 1, 0), ("a", None, "x", 2, 0), ("a", None, "y", 3, 0), ("a", None, None, 4, 0), ("a", None, None, 5, 0), (None, 5, None, 6, 0), (None, 5, None, 7, 0)]
    assert repeats(spark, rows) == [2]


def test_nothing_and_extra_columns(spark):
    assert repeats(spark, []) == []
    df = spark.createDataFrame([("a", 1, None, 1, 0)], IDS).selectExpr("*", "'x' as lo", "1 as block", "'y' as is_message", "array(1) as hi")
    out = once.mark_repeats(df, ["producer"], "n", "text", ["at", "part"])
    assert out.columns == [*df.columns, "is_repeat"] and out.count() == 1
    assert once.seen_ranges(df.limit(0), ["producer"], "n").count() == 0
    long = "9" * 100_000
    assert repeats(spark, [("a", None, long, 1, 0), ("a", None, long, 2, 0)]) == [2]


def test_one_hot_number_and_one_hot_producer(spark):
    rows = [("hot", 7, None, i, 0) for i in range(3000)] + [("hot", n, None, 10_000 + n, 0) for n in range(3000)]
    assert len(repeats(spark, rows, salts=8)) == 3000


def test_numbers_that_a_range_covers_are_repeats(spark):
    seen = spark.createDataFrame([(["a"], 0, 3, 7)], once.RANGE_SCHEMA)
    rows = [("a", n, None, n, 0) for n in range(1, 10)]
    assert repeats(spark, rows, seen) == [3, 4, 5, 6, 7]


def test_repeats_match_brute_force(spark):
    import random

    r = random.Random(3)
    rows = [(r.choice("abc"), r.randrange(-5, 40), None, i, 0) for i in range(600)]
    first, expect = set(), []
    for p, n, _, at, _ in rows:
        if (p, n) in first:
            expect.append(at)
        first.add((p, n))
    assert repeats(spark, rows, salts=4, block_bits=3) == expect
    kept = once.mark_repeats(spark.createDataFrame(rows, IDS), ["producer"], "n", "text", ["at", "part"]).where("not is_repeat")
    ranges = once.seen_ranges(kept, ["producer"], "n", block_bits=3).collect()
    assert {(x.producer[0], n) for x in ranges for n in range(x.lo, x.hi + 1)} == first
    by = {}
    for x in ranges:
        by.setdefault((x.producer[0], x.block), []).append((x.lo, x.hi))
    for spans in by.values():
        spans.sort()
        assert all(b[0] > a[1] + 1 for a, b in zip(spans, spans[1:], strict=False))


def test_malformed_identifiers_are_known_in_later_batches(spark):
    batches = [
        [("a", None, "x", 1, 0), ("a", 0, None, 2, 0), ("b", None, "y", 3, 0), ("a", None, None, 4, 0), (None, None, "x", 5, 0)],
        [("a", None, "x", 6, 0), ("b", None, "x", 7, 0), ("a", 0, None, 8, 0), ("a", None, "z", 9, 0), ("a", None, None, 10, 0), (None, None, "x", 11, 0)],
        [("b", None, "y", 12, 0), ("a", None, "z", 13, 0), ("a", None, "0", 14, 0), ("a", 1, None, 15, 0)],
    ]
    ranges = texts = None
    got = []
    for rows in batches:
        marked = once.mark_repeats(spark.createDataFrame(rows, IDS), ["producer"], "n", "text", ["at", "part"], ranges, texts=texts)
        got += [r.at for r in marked.where("is_repeat").collect()]
        kept = marked.where("not is_repeat")
        ranges, texts = once.seen_ranges(kept, ["producer"], "n", ranges), once.seen_texts(kept, ["producer"], "n", "text", texts)
    assert sorted(got) == repeats(spark, [r for b in batches for r in b]) == [6, 8, 12, 13]
    assert sorted((r.producer[0], r.text) for r in texts.collect()) == [("a", "0"), ("a", "x"), ("a", "z"), ("b", "x"), ("b", "y")]


def test_batches_with_state_equal_one_batch(spark):
    rows = [("a", n % 7, None, i, 0) for i, n in enumerate([3, 4, 3, 9, 2, 4, 8, 1, 2])]
    df = lambda part: spark.createDataFrame(part, IDS)
    one = once.mark_repeats(df(rows[:5]), ["producer"], "n", "text", ["at", "part"])
    state = once.seen_ranges(one.where("not is_repeat"), ["producer"], "n")
    two = repeats(spark, rows[5:], state)
    assert sorted([r.at for r in one.where("is_repeat").collect()] + two) == repeats(spark, rows)


CHANGES = "k string, pos bigint, op string, v string, w string"


def current(spark, base, changes, chunk=1):
    c = spark.createDataFrame(changes, CHANGES)
    p = patches.change_patches(c, ["k"], "pos", "op", {"v": F.col("v"), "w": F.col("w")}, {"v": F.col("v") == "PH"})
    b = spark.createDataFrame(base, "k string, pos bigint, v string, w string, extra int")
    out = patches.apply_patches(b, patches.compose_by_chunks(p, ["k"], chunk), ["k"], "pos", ["v", "w"])
    return {r.k: (r.pos, r.v, r.w) for r in out.collect()}


def test_patches(spark):
    base = [("a", 5, "a5", "x", 1), ("b", 5, "b5", "x", 1), ("c", 9, "c9", "x", 1), ("d", 5, "d5", "x", 1), ("e", None, "e", "x", 1), (None, 1, "n", "x", 1), ("a", 4, "old", "x", 1)]
    changes = [
        ("a", 7, "u", "PH", "y"), ("a", 6, "u", "a6", "z"), ("a", 6, "u", "a6", "z"), ("b", 6, "d", None, None), ("c", 8, "d", None, None), ("d", 5, "d", None, None),
        ("e", 1, "u", "e1", None), ("f", 3, "d", None, None), ("f", 4, "c", "PH", "w"), ("g", 1, "c", "g", "w"), ("g", 3, "u", "g3", None), ("g", 2, "d", None, None), (None, 1, "c", "n", "n"), ("h", None, "c", "n", "n"),
    ]
    assert current(spark, base, changes) == {"a": (7, "a6", "y"), "c": (9, "c9", "x"), "e": (1, "e1", None), "f": (4, None, "w"), "g": (3, "g3", None)}
    assert current(spark, base, []) == {"a": (5, "a5", "x"), "b": (5, "b5", "x"), "c": (9, "c9", "x"), "d": (5, "d5", "x"), "e": (None, "e", "x")}
    assert current(spark, [], changes[:3]) == {"a": (7, "a6", "y")}


def test_patches_compose_in_any_grouping(spark):
    import random

    r = random.Random(5)
    changes = [(r.choice("ab"), i, r.choice("cuud"), r.choice(["PH", str(i)]), None) for i in range(80)]
    changes = [(k, i, op, None if op == "d" else v, w) for k, i, op, v, w in changes]
    state, value = {}, {}
    for k, i, op, v, _ in changes:
        if op == "d":
            state.pop(k, None)
            value.pop(k, None)
        else:
            value[k] = value.get(k) if v == "PH" else v
            state[k] = (i, value[k], None)
    r.shuffle(changes)
    for chunk in (0, 3, 30):
        assert current(spark, [], changes, chunk) == state


def test_state_swap_and_selection(spark, tmp_path):
    s = incremental.HashState(spark, str(tmp_path / "state"), "k string, content_hash bigint")
    rows = lambda *x: incremental.with_hash(spark.createDataFrame(list(x), "k string, v string"), ["v"])
    new = lambda df: sorted((r.k or "") for r in incremental.select_new(df, s.read(), ["k"]).collect())
    first = rows(("a", "1"), ("b", None), (None, "x"), ("a", "1"))
    assert new(first) == ["", "a", "b"]
    s.swap(first.select("k", "content_hash"))
    assert new(first) == []
    second = rows(("a", "2"), ("b", ""), (None, "x"))
    assert new(second) == ["a", "b"]
    # A run that fails before its swap leaves the state: the records are selected again.
    spark.createDataFrame([("junk", 1)], "k string, content_hash bigint").write.parquet(f"{s.path}/versions/2-broken")
    assert new(second) == ["a", "b"]
    s.swap(second.select("k", "content_hash"))
    assert new(second) == [] and new(second.limit(0)) == []
    three = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, None), ("", None)], "x string, y string")
    assert incremental.with_hash(three, ["x", "y"]).select("content_hash").distinct().count() == 4


RUNS = "log_id bigint, run_id bigint, attempt_no int, topic string, kafka_partition int, first_offset bigint, next_offset bigint, run_status string, logged_at timestamp_ntz"


def test_committed_ranges(spark):
    t = lambda s: datetime(2025, 1, 1, 0, 0, s)
    rows = [
        (1, 1, 1, "t", 0, 0, 10, " Committed ", t(5)), (2, 1, 1, "t", 0, 0, None, "started", t(1)), (3, 2, 1, "t", 0, 10, 20, "committed", t(1)), (4, 2, 1, "t", 0, 10, 20, "rolled_back", t(2)),
        (5, 3, 1, "t", 0, 30, 40, "COMMITTED", t(1)), (6, 4, 1, "t", 0, 35, 50, "committed", t(1)), (7, 5, 1, "t", 1, 0, None, "committed", t(1)), (5, 3, 1, "t", 0, 30, 40, "COMMITTED", t(1)), (8, 6, 1, "t", 2, 5, 5, "committed", t(1)),
    ]
    runs = spark.createDataFrame(rows, RUNS)
    ranges = incremental.committed_ranges(runs)
    assert sorted(tuple(r) for r in ranges.collect()) == [("t", 0, 0, 9), ("t", 0, 30, 49)]
    offsets = spark.createDataFrame([("t", 0, n) for n in (0, 9, 10, 29, 30, 49, 50)] + [("t", 1, 0), ("u", 0, 3), ("t", None, 1)], "topic string, kafka_partition int, kafka_offset bigint")
    got = incremental.mark_covered(offsets, ranges, ["topic", "kafka_partition"], "kafka_offset", block_bits=2)
    assert got.count() == 10
    assert sorted(r.kafka_offset for r in got.where("covered").collect()) == [0, 9, 30, 49]
    assert incremental.committed_ranges(runs.limit(0)).count() == 0


@pytest.mark.parametrize("slices", [1, 2, 5])
def test_sweeping_in_batches_keeps_the_first_copy(spark, slices):
    """Against a plain loop over all messages in the order of arrival, malformed identifiers and negative numbers among them."""
    import random

    r = random.Random(slices)
    rows = []
    for i in range(600):
        n = r.choice([None, r.randint(-40, 40), r.randint(0, 5), 7])
        rows.append((r.choice(["a", "b", "hot", "hot", None]), n, None if n is not None else r.choice(["x", "y", None]), datetime(2025, 1, 1) + timedelta(seconds=r.randint(0, 300)), i))
    df = spark.createDataFrame(rows, "producer string, n bigint, text string, at timestamp_ntz, part int")
    marked, state = once.sweep(once.time_slices(df, "at", slices), ["producer"], "n", "text", ["at", "part"], block_bits=3, salts=4)
    got = {x.part: x.is_repeat for x in marked.collect()}
    seen, want = set(), {}
    for p, n, t, at, i in sorted(rows, key=lambda x: (x[3], x[4])):
        known = p is not None and (n is not None or t is not None)
        want[i] = known and (p, n, t) in seen
        if known:
            seen.add((p, n, t))
    assert got == want
    held = set()
    for x in state.collect():
        ids = [(x.producer[0], None, x.text)] if x.text is not None else [(x.producer[0], n, None) for n in range(x.lo, x.hi + 1)]
        assert not held & {*ids}, "ranges are disjoint"
        held |= {*ids}
    assert held == seen
    assert once.time_slices(df.limit(0), "at", 3)[0].count() == 0


def test_new_changed_and_failed_runs(spark, tmp_path):
    s = incremental.HashState(spark, str(tmp_path / "s"), "k string, content_hash bigint")
    df = lambda *r: spark.createDataFrame(list(r), "k string, v string, extra string")
    run = lambda rows: incremental.run_new(rows, s, ["k"], ["v"])
    kinds = lambda new: sorted((r.k or "", r.change_kind) for r in new.collect())
    first = df(("a", "1", "x"), ("a", "1", "y"), (None, "1", "x"), ("b", None, "x"))
    new, done = run(first)
    assert kinds(new) == [("", "new"), ("a", "new"), ("b", "new")] and s.version() == 0
    new, done = run(first)
    other, other_done = run(first)
    done()
    with pytest.raises(Exception, match="taken"):
        other_done()
    new, done = run(df(("a", "1", "z"), ("a", "2", "x"), ("b", "", "x"), ("c", "1", "x")))
    assert kinds(new) == [("a", "changed"), ("b", "changed"), ("c", "new")]
    done()
    assert kinds(run(df(("a", "2", None), ("c", "1", None), (None, "1", None)))[0]) == [] and kinds(run(first.limit(0))[0]) == []


def test_one_bad_bound_spans_no_blocks(spark):
    rows = spark.createDataFrame([("t", 0, 5), ("t", 0, 70_000), ("u", 0, 1)], "topic string, p int, o bigint")
    ranges = spark.createDataFrame([("t", 0, 6, 2**62), ("v", 0, 0, 2**62)], "topic string, p int, lo bigint, hi bigint")
    got = sorted((r.topic, r.o, r.covered) for r in incremental.mark_covered(rows, ranges, ["topic", "p"], "o").collect())
    assert got == [("t", 5, False), ("t", 70_000, True), ("u", 1, False)]
