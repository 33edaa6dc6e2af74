import json
from datetime import datetime, timedelta

import pytest
from changeflow import table
from changeflow.config import HISTORY, EngineConfig, SoftPartitions, TopicConfig
from changeflow.operators import evolve, incremental, route, transform
from changeflow.functions import masking
from changeflow.operators.fold import fold
from changeflow.shared import clear, materialize, plan_bytes, shared_dir
from changeflow.sinks import files
from changeflow.sources.frames import parse_messages
from changeflow.streaming import apply
from pyspark.sql import functions as F
from pyspark.sql import types as T

D, O = "__cf_delete", "__cf_only_set_delete"


def staged(spark, *rows):
    df = spark.createDataFrame(list(rows), "k int, seq bigint, op string, v string")
    return fold(df, ["k"], ["seq"], "op", ["v"]).drop("seq")


def content(t):
    return {r.k: r.v for r in t.read().collect()}


def test_merging_into_a_versioned_table(spark, tmp_path):
    t = table.VersionedTable(spark, str(tmp_path / "t"))
    assert not t.exists() and t.properties() == {}
    assert table.merge_batch(t, staged(spark, (1, 1, "c", "a"), (2, 1, "c", "b"), (3, 1, "d", "x")), ["k"], 1)
    assert content(t) == {1: "a", 2: "b"}
    assert table.merge_batch(t, staged(spark, (1, 2, "d", "a"), (4, 1, "c", "d")), ["k"], 2)
    assert content(t) == {2: "b", 4: "d"}
    assert table.merge_batch(t, staged(spark, (9, 1, "c", "again")), ["k"], 2) is None
    assert content(t) == {2: "b", 4: "d"} and t.properties()["batch_id"] == 2
    wider = staged(spark, (2, 5, "u", "b2")).withColumn("extra", F.lit("e"))
    table.merge_batch(t, wider, ["k"], 3, defaults={"extra": "none"})
    assert {r.k: (r.v, r.extra) for r in t.read().collect()} == {2: ("b2", "e"), 4: ("d", "none")}
    assert t.properties()["backfilled"] == ["extra"]
    assert len(t.vacuum(keep=1)) == 2 and content(t) == {2: "b2", 4: "d"}
    stale = t.version()
    t.commit(t.read(), expect=stale)
    with pytest.raises(table.Conflict):
        t.commit(t.read(), expect=stale)
    assert [(c["name"], c["in_key"], c["backfilled"]) for c in t.columns()] == [("k", True, False), ("v", False, False), ("extra", False, True)]


def test_of_two_writers_one_fails_and_its_rows_are_in_no_version(spark, tmp_path):
    path = str(tmp_path / "t")
    a, b = table.VersionedTable(spark, path), table.VersionedTable(spark, path)
    table.merge_batch(a, staged(spark, (1, 1, "c", "a")), ["k"], 1)

    def meanwhile(written):
        b.commit(b.read().withColumn("v", F.lit("b won")))

    with pytest.raises(table.Conflict):
        a.commit(a.read().withColumn("v", F.lit("a lost")), check=meanwhile)
    assert content(a) == content(b) == {1: "b won"} and a.version() == 2
    s, t = (incremental.HashState(spark, str(tmp_path / "s"), "k int, content_hash bigint") for _ in range(2))
    rows = lambda k: spark.createDataFrame([(k, k)], "k int, content_hash bigint")
    s.swap(rows(1))
    now = s.version()
    t.swap(rows(2), now, add=True)
    with pytest.raises(table.Conflict):
        s.swap(rows(3), now, add=True)
    assert sorted(r.k for r in s.read().collect()) == [1, 2] and s.version() == 2


def test_racing_writers_take_each_number_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from changeflow.pointer import Conflict, Pointer

    p = Pointer(spark, str(tmp_path / "p"))

    def take(i):
        try:
            p.put(1, {"by": i})
            return i
        except Conflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [i for i in pool.map(take, range(24)) if i is not None]
    assert len(won) == 1 and p.read(1) == {"by": won[0]} and p.numbers() == [1]


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    t = table.VersionedTable(spark, str(tmp_path / "t"))
    rows = staged(spark, *[(k, 1, "c", "x" * 50) for k in range(2000)])
    table.merge_batch(t, rows, ["k"], 1, buckets=50)
    first = t.state()["parts"]
    table.merge_batch(t, staged(spark, (7, 2, "u", "new"), (8, 2, "d", "x")), ["k"], 2)
    now = t.state()["parts"]
    assert len(first) == 50 and 1 <= sum(first[b] != p for b, p in now.items()) <= 2
    size = lambda name: sum(f.stat().st_size for f in (tmp_path / "t" / "data" / name).rglob("*.parquet"))
    assert size(next(p for b, p in now.items() if first[b] != p)) < 0.1 * size(next(iter(first.values())))
    got = content(t)
    assert len(got) == 1999 and got[7] == "new" and 8 not in got
    assert t.vacuum(keep=1) == [1] and content(t) == got


def test_a_merge_that_contradicts_its_batch_is_not_committed(spark, tmp_path, monkeypatch):
    t = table.VersionedTable(spark, str(tmp_path / "t"))
    table.merge_batch(t, staged(spark, (1, 1, "c", "a"), (2, 1, "c", "b")), ["k"], 1)
    real = table.merge.merge
    monkeypatch.setattr(table.merge, "merge", lambda *a, **k: real(*a, **k).where("k <> 1"))
    with pytest.raises(table.merge.MergeError, match="lost"):
        table.merge_batch(t, staged(spark, (1, 2, "u", "c")), ["k"], 2)
    assert content(t) == {1: "a", 2: "b"} and t.properties()["batch_id"] == 1


def test_columns_are_dropped_in_two_steps_and_not_by_deletes(spark, tmp_path):
    t = table.VersionedTable(spark, str(tmp_path / "t"))
    wide = lambda *r: staged(spark, *r).withColumn("old", F.lit("o"))
    table.merge_batch(t, wide((1, 1, "c", "a"), (2, 1, "c", "b")), ["k"], 1)
    day = datetime(2025, 1, 1)
    go = lambda rows, n, at, clock: table.merge_batch(t, rows, ["k"], n, drop_missing=True, event_time=at, now=clock)
    go(staged(spark, (9, 2, "d", "x")), 2, day, day)
    go(staged(spark, (9, 3, "d", "x")), 3, day + timedelta(days=1), day)
    assert "old" in t.read().columns and t.properties()["pending_drops"] == {}
    go(staged(spark, (1, 4, "u", "c")), 4, day, day + timedelta(days=30))
    go(staged(spark, (1, 5, "u", "d")), 5, day + timedelta(days=2), day + timedelta(days=30))
    assert "old" in t.read().columns, "events of the past drop nothing"
    go(staged(spark, (1, 6, "u", "e")), 6, day + timedelta(days=31), day + timedelta(days=31))
    assert t.read().columns == ["k", "v"] and content(t) == {1: "e", 2: "b"}
    table.merge_batch(t, wide((1, 7, "u", "f")), ["k"], 7)
    assert {r.k: r.old for r in t.read().collect()} == {1: "o", 2: None}


def test_soft_deletes_in_a_table(spark, tmp_path):
    t = table.VersionedTable(spark, str(tmp_path / "t"))
    table.merge_batch(t, staged(spark, (1, 1, "c", "a")), ["k"], 1, soft_delete=True)
    table.merge_batch(t, staged(spark, (1, 2, "d", "zero")), ["k"], 2, soft_delete=True)
    assert [(r.k, r.v, r[D]) for r in t.read().collect()] == [(1, "a", True)]
    assert O not in t.read().columns


def test_multi_step_merge(spark, tmp_path):
    target, staging = (table.VersionedTable(spark, str(tmp_path / n)) for n in ("t", "s"))
    m = table.MultiStepMerge(target, staging, ["k"], flushes=2)
    assert [m.add(staged(spark, (1, 1, "c", "a")), 1), m.add(staged(spark, (1, 2, "u", "b"), (2, 1, "c", "c")), 2), m.add(staged(spark, (2, 2, "u", "x")), 2)] == [False, False, False]
    assert not target.exists()
    assert m.add(staged(spark, (2, 3, "d", "c")), 3) is True
    assert content(target) == {1: "b"}


def test_staging_names(spark, tmp_path):
    name = table.staging_name("orders", suffix="abcde", now=0)
    assert table.staging_name("orders", multi_step=True) == "orders_cf_msm" and table.staging_name("orders", reusable=True, schema="s") == "s_orders_cf_reusable"
    assert not table.expired("orders_cf_msm") and not table.expired("s_orders_cf_reusable", now=1e12)
    assert name == "orders_cf_abcde_21600" and table.expired(name, now=30_000) and not table.expired(name, now=10) and not table.expired("orders")
    for n in (name, table.staging_name("orders"), "orders"):
        (tmp_path / n).mkdir()
    assert table.sweep(spark, str(tmp_path)) == [name]


def test_schema_evolution(spark):
    t = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("old", T.StringType()), T.StructField("__cf_delete", T.BooleanType())])
    s = T.StructType([T.StructField("A", T.IntegerType()), T.StructField("new", T.StringType()), T.StructField("none", T.NullType()), T.StructField("__cf_x", T.StringType())])
    assert evolve.schema_diff(s, t) == (["new"], ["old"])
    assert evolve.schema_diff(s, t, frozenset({"__cf_x", "__cf_delete"})) == (["new", "__cf_x"], ["old", "__cf_delete"])
    df = spark.createDataFrame([("7", '{"a":1}'), ("x", None)], "A string, j string").select("A", F.from_json("j", "a int").alias("j"))
    got = evolve.cast_to_target(df, T.StructType([T.StructField("a", T.IntegerType()), T.StructField("j", T.StringType())])).collect()
    assert [tuple(r) for r in got] == [(7, '{"a":1}'), (None, None)]
    assert evolve.widen_length(df, "A", 0) == 1 and evolve.widen_length(df, "A", 9) == 9 and evolve.widen_length(df, "A", None) is None
    assert [evolve.default_counts(x) for x in (None, "1970-01-01", "00000000-0000-0000-0000-000000000000", 0, "x")] == [False, False, False, True, True]


def test_two_phase_drops():
    p, t = evolve.PendingDrops(), datetime(2025, 1, 1)
    assert p.see(["a"], t, False, now=t) == [] and p.due == {}
    assert p.see(["a"], t, True, now=t) == [] and p.see(["a"], t + timedelta(hours=3), True, now=t) == []
    assert p.see(["a"], t + timedelta(hours=5), False, now=t) == [] and p.see(["a"], t + timedelta(hours=5), True, enabled=False) == []
    assert p.see([], t + timedelta(hours=6), True, now=t) == [] and p.see(["a"], t + timedelta(hours=7), True, now=t + timedelta(hours=7)) == []
    assert p.see(["a"], t + timedelta(hours=10), True, now=t) == []
    assert p.see(["a"], t + timedelta(hours=12), True, now=t) == ["a"] and p.due == {}
    replay = evolve.PendingDrops()
    assert [replay.see(["a"], t - timedelta(days=9 - i), True) for i in range(9)] == [[]] * 9


def test_routes(spark):
    df = spark.createDataFrame([(1, datetime(2025, 1, 31, 23)), (2, datetime(2025, 2, 1, 1)), (3, None)], "k int, at timestamp_ntz")
    now = F.lit(datetime(2025, 2, 1, 2)).cast("timestamp_ntz")
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "table_name string")
    got = lambda f, e: [r.dest_table for r in route.soft_partition(df, "at", f, now, "t", e).orderBy("k").collect()]
    assert got("monthly", names()) == ["t_default", "t_2025_02", None] and got("monthly", names("t_2025_01")) == ["t_2025_01", "t_2025_02", None]
    assert got("daily", names()) == ["t_2025_01_31", "t_2025_02_01", None], "less than a day ago is no distance"
    assert got("hourly", names()) == ["t_default", "t_default", None]
    with pytest.raises(Exception, match="future"):
        route.soft_partition(df, "at", "hourly", F.lit(datetime(2025, 1, 1)).cast("timestamp_ntz"), "t", names()).collect()


def test_settings():
    t = {"topic": "t", "schema": "s"}
    for bad in (
        {"topic": ""}, {"key_format": "x"}, {"include": ("a",), "exclude": ("b",)}, {"keys_override": ("a",), "keys_include": ("b",)}, {"encrypt": ("a",), "keys_override": ("a",)}, {"multi_step_flushes": 0},
    ):
        with pytest.raises(ValueError):
            TopicConfig(**{**t, **bad})
    for bad in (("", "daily", 1), ("c", "weekly", 1), ("c", "daily", 0)):
        with pytest.raises(ValueError):
            SoftPartitions(*bad)
    ok = TopicConfig(**t)
    for bad in ({"topics": ()}, {"mode": "x"}, {"flush_seconds": 1}, {"buffer_rows": 0}, {"mode": HISTORY}, {"topics": (TopicConfig(**t, reference="r"),) * 2}, {"topics": (TopicConfig(**t, encrypt=("a",)),)}):
        with pytest.raises(ValueError):
            EngineConfig(**{"topics": (ok,), **bad})
    EngineConfig((TopicConfig(**t, encrypt=("a",)),), passphrase="p")
    EngineConfig((TopicConfig(**t, db_updated_at=True),), mode=HISTORY)
    assert TopicConfig(**t, skip_operations=" D, c ,").skipped() == {"d", "c"}
    assert transform.key_columns(TopicConfig(**t, keys_include=("z", "a")), ["m"]) == ["a", "m", "z"] and transform.key_columns(TopicConfig(**t, keys_override=("o",)), ["m"]) == ["o"]


def test_column_steps(spark):
    df = spark.createDataFrame([(1, "c", "x", None), (2, "D", "y", "z")], "id int, op string, a string, b string")
    with pytest.raises(ValueError):
        transform.include_columns(df, ["a"], ["id"])
    with pytest.raises(ValueError):
        transform.static_columns(df, {"A": "1"})
    with pytest.raises(ValueError):
        transform.check_rows(df, ["id"], "t")
    cfg = TopicConfig("t", "s", exclude=("b",), static=(("src", "x"),), hash=("a",), skip_operations="d")
    got = transform.apply_topic(df, cfg, ["id"]).collect()
    assert len(got) == 1 and got[0].src == "x" and len(got[0].a) == 64 and "b" not in got[0]
    with pytest.raises(ValueError, match="no key"):
        transform.apply_topic(df, TopicConfig("t", "s", encrypt=("a",)), ["id"])
    with pytest.raises(ValueError, match="no key"):
        transform.apply_topic(df, TopicConfig("t", "s", encrypt_json=True), ["id"])
    key = masking.key_of("p")
    deep = df.withColumn("j", F.struct("a", "b"))
    sealed = transform.apply_topic(deep, TopicConfig("t", "s", encrypt_json=True), ["id"], key)
    assert [json.loads(r[0]) for r in sealed.orderBy("id").select(masking.decrypt(F.col("j"), key)).collect()] == [{"a": "x"}, {"a": "y", "b": "z"}] and [r.a for r in sealed.orderBy("id").collect()] == ["x", "y"]
    with pytest.raises(ValueError, match="no key"):
        transform.key_columns(TopicConfig("t", "s"), None)
    rows = lambda *r: transform.check_rows(spark.createDataFrame(list(r), f"id int, v string, {D} boolean"), ["id"], "t").collect()
    assert len(rows((1, None, False))) == 1 and rows() == []
    for bad, why in (((None, "x", False), "key id"), ((1, "x", None), "delete is null"), ((None, None, False), "no data")):
        with pytest.raises(Exception, match=why):
            rows(bad)
    num = spark.createDataFrame([("7",), ("7.0",), ("1e12",), ("x",), (None,)], "a string").select(transform.same_number(F.col("a")).alias("n"))
    assert [r.n for r in num.collect()] == ["7", "7", "1000000000000", "x", None]


def test_parquet_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5, {"a": "b"}, datetime(2025, 1, 1, 0, 0, 0, 123456))], "k int, f double, m map<string,string>, at timestamp_ntz")
    files.ParquetSink(str(tmp_path), "db.s.t", narrow=True).append(df)
    r = spark.read.parquet(str(tmp_path / "db.s.t")).first()
    assert (r.k, r.f, r.m, r.at.microsecond) == (1, 1.5, '{"a":"b"}', 123000) and r.date is not None
    assert list((tmp_path / "db.s.t").glob("date=*/*.gz.parquet"))


def test_message_sink(spark, tmp_path):
    folder = str(tmp_path)

    def connect():
        import uuid

        def send(texts):
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                json.dump(texts, f)

        return send

    df = spark.range(25).select(F.col("id"), F.lit(None).cast("string").alias("n")).coalesce(1)
    files.MessageSink(connect).append(df)
    sent = [json.loads(p.read_text()) for p in tmp_path.iterdir()]
    assert sorted(len(s) for s in sent) == [5, 10, 10] and json.loads(sent[0][0])["n"] is None
    with pytest.raises(Exception, match="larger"):
        files.MessageSink(connect, most_bytes=5).append(df)
    assert files.chunks(["aa", "bb", "cccccc", "d"], 4) == [["aa", "bb"], ["d"]]


def frames_at(path, n, rows, spark):
    def msg(id_, v, op):
        row = json.dumps({"id": id_, "v": v})
        return json.dumps({"payload": {"before": json.loads(row) if op == "d" else None, "after": None if op == "d" else json.loads(row), "op": op, "source": {"db": "d", "table": "t"}}}).encode()

    df = spark.createDataFrame([("t", 0, n * 100 + i, datetime(2025, 1, 1), None, msg(*r)) for i, r in enumerate(rows)], apply.FRAMES)
    df.coalesce(1).write.mode("append").parquet(path)


def test_waiting_for_topics():
    seen = iter([set(), {"a"}, {"a", "b", "c"}])
    slept = []
    apply.wait_for_topics(lambda: next(seen), ["a", "b"], sleep=slept.append)
    assert slept == [300.0, 300.0]
    with pytest.raises(TimeoutError, match="b"):
        apply.wait_for_topics(lambda: ["a"], ["a", "b"], tries=2, sleep=slept.append)


def test_lag(spark):
    f = spark.createDataFrame([("t", 0, 3, datetime(2025, 1, 1)), ("t", 0, 5, datetime(2025, 1, 1, 0, 1))], "topic string, kafka_partition int, kafka_offset bigint, kafka_ts timestamp_ntz")
    ends = spark.createDataFrame([("t", 0, 10), ("t", 1, 4)], "topic string, kafka_partition int, end_offset bigint")
    got = {r.kafka_partition: (r.row_lag, r.ingestion_lag_seconds) for r in apply.lag(f, ends, F.lit(datetime(2025, 1, 1, 0, 2)).cast("timestamp_ntz")).collect()}
    assert got == {0: (4, 60.0), 1: (4, None)}

    class Source:
        def __init__(self, end, latest):
            self.endOffset, self.latestOffset = end, latest

    assert apply.offset_lag(Source('{"t":{"0":5,"1":7}}', '{"t":{"0":9,"1":7,"2":3}}')) == 7 and apply.offset_lag(Source('{"logOffset":1}', "null")) is None
    beats = []
    with apply.Heartbeat(beats.append, after=0.02, every=0.02):
        import time

        time.sleep(0.2)
    assert len(beats) >= 2


def test_a_stream_of_several_steps(spark, tmp_path):
    path = str(tmp_path / "in")
    t, s = (table.VersionedTable(spark, str(tmp_path / n)) for n in ("t", "s"))
    said = []
    changes = lambda f: parse_messages(f).select("kafka_partition", "kafka_offset", "op", F.col("row_id").alias("k"), F.get_json_object(F.coalesce("after", "before"), "$.v").alias("v"))
    for n, rows in enumerate([[(1, "a", "c"), (1, "b", "u")], [(2, "b", "c"), (1, "c", "u")], [(2, "b", "d")], [(3, "x", "c")]]):
        frames_at(path, n, rows, spark)
        apply.start_merge(apply.frame_stream(spark, path, max_files=1), changes, t, ["k"], ["v"], str(tmp_path / "check"), staging=s, flushes=2, notify=lambda what, more: said.append(what)).awaitTermination()
    assert [x for x in said if x != "started"] == ["batch_gathered", "batch_gathered", "batch_applied", "batch_gathered"]
    assert content(t) == {1: "c"} and content(s) == {3: "x"}


def test_a_stream_is_the_batch(spark, tmp_path):
    path, check = str(tmp_path / "in"), str(tmp_path / "check")
    t = table.VersionedTable(spark, str(tmp_path / "t"))
    said = []
    changes = lambda f: parse_messages(f).select("kafka_partition", "kafka_offset", "op", F.col("row_id").alias("k"), F.get_json_object(F.coalesce("after", "before"), "$.v").alias("v"))
    run = lambda: apply.start_merge(apply.frame_stream(spark, path, max_files=1), changes, t, ["k"], ["v"], check, notify=lambda what, more: said.append(what)).awaitTermination()
    frames_at(path, 0, [(1, "a", "c"), (2, "b", "c"), (1, "a2", "u")], spark)
    run()
    assert content(t) == {1: "a2", 2: "b"}
    frames_at(path, 1, [(2, "b", "d"), (3, "c", "c"), (1, "a3", "u")], spark)
    run()
    assert content(t) == {1: "a3", 3: "c"} and said == ["started", "batch_applied"] * 2
    out = str(tmp_path / "hist")
    for _ in range(2):
        apply.start_history(apply.frame_stream(spark, path), lambda f: f.select("kafka_offset"), out, str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(out).count() == 6


def test_retries():
    tries = []

    def fails():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("not yet")
        return "done"

    assert apply.with_retries(fails, sleep=lambda s: None) == "done" and len(tries) == 3
    with pytest.raises(OSError):
        apply.with_retries(lambda: (_ for _ in ()).throw(OSError("never")), tries=2, sleep=lambda s: None)


def test_the_shared_folder(spark):
    assert shared_dir(spark) == shared_dir(spark)
    df = materialize(spark.range(3), "x")
    assert df.count() == 3 and "Range" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan_bytes(df) < 1 << 20 and plan_bytes(df.crossJoin(df)) < 1 << 20
    assert plan_bytes(spark.createDataFrame(spark.sparkContext.parallelize([(1,)]), "a int")) is None
    clear(spark)
    with pytest.raises(Exception):
        df.count()
